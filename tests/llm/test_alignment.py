"""Cross-tokenizer alignment against a plain computation."""

import hashlib
from bisect import bisect_left
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.llm.queries import BYTE_MODEL, PIECE_MODEL
from siteloom.llm.token_alignment import Aligner, ByteTokens, PieceTokens, align_tokens, byte_level_alphabet, pointer_groups

pytestmark = pytest.mark.skipif(not (Path(BYTE_MODEL).exists() and Path(PIECE_MODEL).exists()), reason="vocabularies not present")
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def files():
    return Path(BYTE_MODEL).read_bytes(), Path(PIECE_MODEL).read_bytes()


def plain_tokens(texts):
    """(bytes, id) of every token, by the vocabularies' own libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_MODEL)
    t.encode_special_tokens = True
    names = {i: p for p, i in t.get_vocab().items()}
    letters = byte_level_alphabet()
    s = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    for text in texts:
        if not text:
            yield [], []
            continue
        a = [(bytes(letters[c] for c in names[i]), i) for i in t.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in s.encode(text):
            p = s.id_to_piece(i)
            b.append((bytes([int(p[3:5], 16)]) if s.is_byte(i) else p.replace("▁", " ").encode(), i))
        raw = (" " + text).encode()
        yield (a, b) if b"".join(x for x, _ in a) == raw == b"".join(x for x, _ in b) else ([], [])


def alignment_reference(rows):
    found, pairs = [], Counter()
    for i, (a, b) in zip([i for i, _ in rows], plain_tokens([t for _, t in rows])):
        ends = []
        for side in (a, b):
            at, own = 0, {}
            for raw, k in side:
                at += len(raw)
                own[at] = k
            ends.append(own)
        cuts = sorted(ends[0].keys() & ends[1].keys())
        links = [(ends[0][c], ends[1][c]) for c in cuts]
        pairs.update(links)
        groups = [([], []) for _ in cuts]
        for n, side in enumerate(ends):
            for e, k in side.items():
                groups[bisect_left(cuts, e)][n].append(str(k))
        found.append((i, len(a), len(b), links, ";".join("|".join(map(",".join, g)) for g in groups)))
    best = {}
    for (_, b), n in pairs.items():
        best[b] = max(best.get(b, 0), n)
    return Counter(
        (i, na, nb, len(links), len(links), sum(pairs[x] == best[x[1]] for x in links), sum(pairs[x] for x in links),
         hashlib.sha256(g.encode()).hexdigest() if g else "")
        for i, na, nb, links, g in found
    )


ODD = ["▁ mark", "a▁b", " two  blanks ", "tab\tand\nline\n\n  end ", "<s>special</s><|endoftext|>", "<0x41>", "日本語 ünïcödé 🙂🙂", "…don't it's", " x", "a\0b"]


def digest(df):
    return Counter(tuple(r) for r in df.select(*NAMES).collect())


def test_awkward(spark, awkward, files):
    odd = spark.createDataFrame(list(enumerate(ODD, 100)), "doc_id long, text string")
    docs = awkward.unionByName(odd, allowMissingColumns=True).repartition(4)
    got = align_tokens(docs, *files)
    assert digest(got) == alignment_reference([(r.doc_id, r.text) for r in docs.collect()])
    zero = got.where("n_a = 0").collect()
    assert {r.groups_sha256 for r in zero} == {""} and {100, 101} <= {r.doc_id for r in zero}


def test_documents(spark, documents, files):
    docs = documents.where("doc_id < 60")
    assert digest(align_tokens(docs, *files)) == alignment_reference([(r.doc_id, r.text) for r in docs.collect()])


def test_nothing_groups_and_clashing_columns(spark, nothing, files):
    assert align_tokens(nothing, *files).count() == 0
    docs = spark.createDataFrame([(1, "Hello  world"), (1, "Hello  world"), (None, "x")], "doc_id long, text string")
    clash = docs.select("*", *[F.lit("?").alias(c) for c in ("links", "n_links", "groups", "n_a", "link", "n")])
    got = align_tokens(clash, *files, with_groups=True).collect()
    assert len(got) == 3 and all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in got)
    assert {r.groups.count(";") + 1 for r in got if r.doc_id} == {got[0].n_groups if got[0].doc_id else got[1].n_groups}


def test_pointers_meet_at_cuts():
    rng = np.random.default_rng(7)
    for n in (1, 2, 50, 3000):
        every = np.arange(1, n + 1)
        a, b = (np.append(every[:-1][rng.random(n - 1) < p], n) for p in (0.3, 0.2))
        group_a, group_b = pointer_groups(a, b)
        cuts = np.intersect1d(a, b)
        assert (group_a == np.searchsorted(cuts, a)).all() and (group_b == np.searchsorted(cuts, b)).all()


def test_ranks_equal_the_library(files):
    from tokenizers import Tokenizer

    own, t = ByteTokens(files[0]), Tokenizer.from_str(files[0].decode())
    t.encode_special_tokens = True
    texts = ODD + [f" a{chr(c)}b 1{chr(c)}2 .{chr(c)}" for c in range(0x21, 0x3000, 7)]
    assert own._ranked is not None
    assert own.encode(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_possible_links_are_bounded_by_the_vocabularies(files):
    aligner = Aligner.of(*files)
    links = aligner.links()
    most = sum(map(len, aligner.a.bytes)) + sum(map(len, aligner.b.bytes))
    assert len(links) < 2 * most and len(PieceTokens(files[1]).bytes) == 32000
