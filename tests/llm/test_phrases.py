"""Phrase collocations against a plain computation."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siteloom.llm.collocations import coded, collocations, phrase_counts

from .conftest import LOWER


def phrases_reference(rows, longest=3, min_count=10, percent=50, top=2000):
    """``rows`` of (lang, text); integers of any size."""
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: c for p, c in f.items() if len(p) > 1 and c >= min_count}
        best = []
        for p, a in found.items():
            inside = any(
                len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()
            )
            if inside:
                continue
            score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def run(df, **options):
    return sorted(tuple(r) for r in collocations(df, slots=1 << 12, **options).select(*NAMES).collect())


@pytest.mark.parametrize("shards,longest", [(1, 3), (3, 3), (4, 2), (2, 4)])
def test_awkward(spark, awkward, shards, longest):
    want = phrases_reference([(r.lang, r.text) for r in awkward.collect()], longest, 2)
    assert run(awkward, min_count=2, shards=shards, longest=longest) == want and want


def test_many_small_blocks_and_shared_slots(spark, documents):
    """Blocks of a kilobyte over many partitions: every phrase begins in another shard, and slots collide."""
    docs = documents.select("lang", "text").repartition(7)
    counts, n = phrase_counts(docs, 3, 5, shards=3, slots=1 << 12, block=1 << 10)
    rows = [(r.lang, r.text) for r in docs.collect()]
    want = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 4):
                want[k].update((lang or "und", *w[i : i + k]) for i in range(len(w) - k + 1))
    for k in range(1, 4):
        got = sorted(r.n for r in counts[k - 1].select("n").collect())
        assert got == sorted(c for c in want[k].values() if c >= 5)
    assert {r.lang: r.n for r in n.collect()} == {
        lang: sum(c for w, c in want[1].items() if w[0] == lang) for lang in {w[0] for w in want[1]}
    }


def test_ties_null_langs_and_exact_large_numbers(spark):
    rows = [("en", "A b. a B, c\td\nc d"), (None, "x y"), (None, "x y"), ("und", "x y z"), ("", "x y"), ("", "x y"), ("en", None), ("xx", ""), ("en", "...")]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert run(df, min_count=2) == phrases_reference(rows, 3, 2)
    assert run(df, min_count=2, top=1) == phrases_reference(rows, 3, 2, top=1)
    from siteloom.llm.collocations import _score

    a, left, right = 123456789012345, 223456789012345, 323456789012345
    got = spark.range(1).select(_score(str(a), str(left), str(right), 1000000).alias("s")).first().s
    assert got == 1000000 * a * a // (left * right)


def test_nothing_and_clashing_columns(spark, nothing, awkward):
    assert run(nothing) == []
    extra = awkward.select("lang", "text", *[F.lit(1).alias(c) for c in ("w1", "w2", "n", "word", "size", "rank", "phrase", "shard")])
    assert run(extra, min_count=2) == run(awkward, min_count=2)


def test_coded_words():
    own, codes = coded([b"A b,C  a", None, b"", b"a"])
    names = own.tobytes().decode().split("\n")
    assert [names[c - 1] if c else None for c in codes] == ["a", "b", None, "c", "a", None, "a"]
