"""Alignment of two tokenizers' tokens over the same bytes, by pointer jumping."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocks import id_and_text, text_batches
from .piece_codec import MARK

_ZSTD = pa.Codec("zstd", compression_level=1)
# how byte-level tokenizers split a text before the merges: a fixed value of the public format
_BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_level_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class ByteTokens:
    """A byte-level BPE file: ids of whole texts, bytes of each id.

    Merging by rank and merging by id are the same where merges are listed in the order of their ids;
    then a text is encoded by ranks, else by the file's own library.
    """

    def __init__(self, data: bytes):
        spec = json.loads(data)
        vocabulary, special = spec["model"]["vocab"], {t["id"] for t in spec.get("added_tokens", ())}
        alphabet = byte_level_alphabet()
        size = 1 + max([*vocabulary.values(), *special])
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocabulary.items():
            if i not in special:
                self.bytes[i] = bytes([alphabet[c] for c in token])
        self._ranked = self._ranks(spec, vocabulary, special)
        if self._ranked is None:
            from tokenizers import Tokenizer

            self._own = Tokenizer.from_str(data.decode())
            self._own.encode_special_tokens = True

    def _ranks(self, spec: dict, vocabulary: dict[str, int], special: set[int]):
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [vocabulary[a + b] for a, b in pairs]
        single = sum(len(b) == 1 for b in self.bytes)
        if not plain or made != sorted(made) or single != 256 or len(made) + 256 != len(vocabulary.keys() - special) or model.get("ignore_merges"):
            return None
        import tiktoken

        ranks = {b: i for i, b in enumerate(self.bytes) if b}
        return tiktoken.Encoding("ranks", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self._ranked is not None:
            return [self._ranked.encode_ordinary(t) for t in texts]
        return [e.ids for e in self._own.encode_batch_fast(texts, add_special_tokens=False)]


class PieceTokens:
    """A SentencePiece model file: ids of whole texts, bytes of each id."""

    def __init__(self, data: bytes):
        import sentencepiece

        self._own = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes = []
        for i in range(self._own.get_piece_size()):
            piece = self._own.id_to_piece(i)
            if self._own.is_byte(i):
                self.bytes.append(bytes([int(piece[3:-1], 16)]))
            else:
                nothing = self._own.is_control(i) or self._own.is_unknown(i)
                self.bytes.append(b"" if nothing else piece.replace(MARK, " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._own.encode(texts, num_threads=1)


def pointer_groups(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers of the tokens of two sequences that cover the same bytes; ``end`` is past a token's last byte.

    Every token points to the overlapping token that reaches farthest to the right (itself, where none
    reaches farther; of two that end together the first sequence's). Successors are doubled until nothing changes:
    then each points to the last token of its component.
    """
    n_a, n_b = len(end_a), len(end_b)
    start_a, start_b = np.concatenate([[0], end_a[:-1]]), np.concatenate([[0], end_b[:-1]])
    last_b = np.searchsorted(start_b, end_a, side="left") - 1  # the last one that begins before the token's end
    last_a = np.searchsorted(start_a, end_b, side="left") - 1
    points = np.empty(n_a + n_b, np.int64)
    points[:n_a] = np.where(end_b[last_b] > end_a, n_a + last_b, np.arange(n_a))
    points[n_a:] = last_a
    while True:
        farther = points[points]
        if np.array_equal(farther, points):
            break
        points = farther
    number = np.cumsum(points[:n_a] == np.arange(n_a)) - 1
    return number[points[:n_a]], number[points[n_a:]]


class Aligner:
    """Both vocabularies of a worker, and what is spelt for each id."""

    _built: dict[int, Aligner] = {}

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteTokens(a), PieceTokens(b)
        self.size_a = np.array([len(x) for x in self.a.bytes], np.int64)
        self.size_b = np.array([len(x) for x in self.b.bytes], np.int64)
        n_a, n_b = len(self.size_a), len(self.size_b)
        ids = [*map(str, range(n_a)), *map(str, range(n_b))]
        # an id goes on with a comma inside its side of a group; at its end with | (first) or ; (second)
        self.spelt = [x + "," for x in ids] + [x + "|" for x in ids[:n_a]] + [x + ";" for x in ids[n_a:]]

    @classmethod
    def of(cls, a: bytes, b: bytes) -> Aligner:
        key = hash((a, b))
        if key not in cls._built:
            cls._built[key] = cls(a, b)
        return cls._built[key]

    def links(self) -> np.ndarray:
        """Keys ``a * n_b + b`` of all pairs that can end together, sorted.

        One token's bytes then end the other's, so the vocabularies alone bound their number: a token has
        no more endings than bytes.
        """
        n_b = len(self.size_b)
        found = set()
        for mine, theirs, first in ((self.a.bytes, self.b.bytes, True), (self.b.bytes, self.a.bytes, False)):
            known: dict[bytes, list[int]] = {}
            for i, x in enumerate(theirs):
                if x:
                    known.setdefault(x, []).append(i)
            for i, x in enumerate(mine):
                for cut in range(len(x)):
                    for j in known.get(x[cut:], ()):
                        found.add(i * n_b + j if first else j * n_b + i)
        return np.array(sorted(found), np.int64)

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both for each text; none where the bytes of either differ from a blank and the text."""
        spaced = [" " + t for t in texts]
        of_a, of_b = self.a.bytes, self.b.bytes
        out = []
        for t, s, a, b in zip(texts, spaced, self.a.encode(spaced), self.b.encode(texts)):
            raw = s.encode()
            same = t and b"".join([of_a[i] for i in a]) == raw and b"".join([of_b[i] for i in b]) == raw
            out.append((a, b) if same else ([], []))
        return out

    def align(self, coded: list[tuple[list[int], list[int]]]):
        """For all texts end to end: (n_a, n_b, n_groups) per text, ids of each link, group strings."""
        count = np.array([(len(a), len(b)) for a, b in coded], np.int64).reshape(-1, 2)
        ids_a = np.fromiter((i for a, _ in coded for i in a), np.int64, count[:, 0].sum())
        ids_b = np.fromiter((i for _, b in coded for i in b), np.int64, count[:, 1].sum())
        if not len(ids_a):
            return count[:, 0], count[:, 1], np.zeros(len(coded), np.int64), ids_a, ids_b, [""] * len(coded)
        end_a, end_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        group_a, group_b = pointer_groups(end_a, end_b)
        last_a = np.flatnonzero(np.append(group_a[1:] != group_a[:-1], True))
        last_b = np.flatnonzero(np.append(group_b[1:] != group_b[:-1], True))
        # a text ends in a cut, so the groups of a text are those of its tokens
        ends = np.concatenate([[0], np.cumsum(count[:, 0])])
        n_groups = np.diff(np.concatenate([[0], np.cumsum(np.bincount(last_a, minlength=len(ids_a)))])[ends])
        n = len(self.size_a) + len(self.size_b)
        word = np.empty(len(ids_a) + len(ids_b), np.int64)
        code_a, code_b = ids_a.copy(), ids_b + len(self.size_a)
        code_a[last_a] += n
        code_b[last_b] += n
        before_b = np.concatenate([[0], last_b + 1])  # tokens of the second sequence before each group
        word[np.arange(len(ids_a)) + before_b[group_a]] = code_a
        word[np.arange(len(ids_b)) + last_a[group_b] + 1] = code_b
        spelt, at, strings = self.spelt, 0, []
        for size in count.sum(axis=1).tolist():
            strings.append("".join([spelt[i] for i in word[at : at + size].tolist()])[:-1])
            at += size
        return count[:, 0], count[:, 1], n_groups, ids_a[last_a], ids_b[last_b], strings


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest() if text else ""


def _packed(links: np.ndarray) -> bytes:
    return _ZSTD.compress(links.tobytes(), asbytes=True) if len(links) else b""


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Links of all rows end to end, and how many each has."""
    sizes = batch.column("n_links").to_numpy()
    parts = [_ZSTD.decompress(x.as_py(), decompressed_size=4 * n, asbytes=True) for x, n in zip(batch.column("links"), sizes.tolist()) if n]
    return np.frombuffer(b"".join(parts), np.int32), sizes


def align_tokens(docs: DataFrame, a: bytes, b: bytes, with_groups: bool = False) -> DataFrame:
    """Groups of tokens of a byte-level BPE (file ``a``) and a SentencePiece model (file ``b``) over the same bytes.

    Each text is encoded whole by both, the first with a blank before it, which the second adds itself. Byte offsets
    where tokens of both end cut them into groups (``pointer_groups``); the two tokens that end at a cut are
    linked. How often an id pair is linked in all texts is its count. The pairs that can be linked are bounded by the
    vocabularies (``Aligner.links``), so counts are added up in one array per task and broadcast whatever the input.
    Texts are encoded once; the links of a text are kept, packed, in the shared folder for the second pass.

    Returns per row of ``docs`` doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair has the highest count of
    all pairs of its second id, ties included), count_sum (counts of its links), groups_sha256 (of ``a1,a2|b1;a3|b2``);
    with ``with_groups`` the string itself too, as groups. Null, empty and not reproducible texts (bytes of
    either differ from the blank and the text) have zeros and ''. Rows that repeat an id or have none are treated as they
    are; other columns are not read. An empty table gives no rows.
    """
    sc = docs.sparkSession.sparkContext
    files = sc.broadcast((a, b))
    links = Aligner.of(a, b).links()
    keys = sc.broadcast(links)
    text = ", groups string" if with_groups else ""
    schema = f"doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string{text}, links binary"

    def encode(batches):
        aligner, pairs = Aligner.of(*files.value), keys.value
        n_second = len(aligner.size_b)
        for ids, texts in text_batches(batches):
            n_a, n_b, n_groups, link_a, link_b, groups = aligner.align(aligner.encode([(t or b"").decode() for t in texts]))
            at = np.searchsorted(pairs, link_a * n_second + link_b).astype(np.int32)
            cuts = np.concatenate([[0], np.cumsum(n_groups)])
            packed = [_packed(at[x:y]) for x, y in zip(cuts, cuts[1:])]
            columns = [pa.array(ids, pa.int64()), *map(pa.array, (n_a, n_b, n_groups, np.diff(cuts))), pa.array(map(_sha, groups), pa.string())]
            columns += [pa.array(groups, pa.string())] if with_groups else []
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if with_groups else []), "links"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary())], names=names)

    done = cut_lineage(id_and_text(docs).mapInArrow(encode, schema), "alignment")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(keys.value), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                total += np.bincount(_unpacked(batch.slice(i, 500))[0], minlength=len(total))
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["link", "n"])

    counted = done.select("n_links", "links").mapInArrow(add_up, "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))
    count = np.zeros(len(links), np.int64)
    for r in counted.toLocalIterator():  # at most one row per possible pair
        count[r.link] = r.n
    second = links % len(Aligner.of(a, b).size_b)
    highest = np.zeros(1 + int(second.max()) if len(second) else 1, np.int64)
    np.maximum.at(highest, second, count)
    sent = sc.broadcast((count, count == highest[second]))
    names = [f.name for f in done.schema if f.name not in ("links", "groups_sha256", "groups")]
    tail = ["groups_sha256", *(["groups"] if with_groups else [])]

    def score(batches):
        n, best = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                own, sizes = _unpacked(part)
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                sums = [np.diff(np.concatenate([[0], np.cumsum(x[own])])[cuts]).astype(np.int64) for x in (best, n)]
                columns = [part.column(c) for c in names] + [pa.array(s) for s in sums] + [part.column(c) for c in tail]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_best", "count_sum", *tail])

    out = f"doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string{text}"
    return done.mapInArrow(score, out)
