"""SentencePiece encoding and decoding on the tokenizers library."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import text_batches
from .words import slices

MARK = "▁"  # stands for a blank
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
# field numbers and values of the public model format
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_UNKNOWN, _CONTROL, _USER, _BYTE = 2, 3, 4, 6
_UNIGRAM, _BPE = 1, 2
_AT_ONCE = 4000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message: int, bytes, or four or eight raw bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class PieceModel:
    """What the model file says, as far as encoding and decoding need it."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = _UNIGRAM
    byte_fallback: bool = False
    unknown: int = 0
    charsmap: bytes = b""
    add_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        import struct

        m = cls()
        for number, value in _fields(data):
            if number == _PIECES:
                own = dict(_fields(value))
                score = struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0]
                m.pieces.append((own.get(1, b"").decode(), score, own.get(3, 1)))
            elif number == _TRAINER:
                own = dict(_fields(value))
                m.kind, m.byte_fallback, m.unknown = own.get(3, _UNIGRAM), bool(own.get(35, 0)), own.get(40, 0)
            elif number == _NORMALIZER:
                own = dict(_fields(value))
                m.charsmap = own.get(2, b"")
                m.add_prefix, m.squeeze, m.escape = (bool(own.get(n, 1)) for n in (3, 4, 5))
        return m


def build(model: PieceModel):
    """The same tokenizer on the tokenizers library: normaliser, blank marker, scores, byte fallback."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if not model.escape:
        raise ValueError("models that keep blanks unescaped are not supported")
    vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    if model.kind == _UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unknown, byte_fallback=model.byte_fallback)
    elif model.kind == _BPE:
        core = models.BPE(
            vocabulary, _merges(model), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback
        )
    else:
        raise ValueError(f"model type {model.kind} has no counterpart")
    t = Tokenizer(core)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.squeeze:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    steps.append(normalizers.Replace(" ", MARK))
    if model.add_prefix:
        steps.append(normalizers.Prepend(MARK))
    t.normalizer = normalizers.Sequence(steps)
    if _words(model):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(_WORD.pattern), "isolated")
    t.add_special_tokens([AddedToken(p, special=True, normalized=False) for p, _, kind in model.pieces if kind == _CONTROL])
    t.add_tokens([AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == _USER])
    t.encode_special_tokens = True  # their spelling in a text is ordinary text
    end = [decoders.Strip(" ", 1, 0)] if model.add_prefix else []
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *end])
    return t


def _merges(model: PieceModel) -> list[tuple[str, str]]:
    """Merges in order of rank: the best-scored result first, then by the scores of the parts."""
    rank = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind not in (_UNKNOWN, _CONTROL, _BYTE)}
    score = {p: s for p, s, _ in model.pieces}
    found = []
    for whole in rank:
        own = [(whole[:i], whole[i:]) for i in range(1, len(whole)) if whole[:i] in rank and whole[i:] in rank]
        found += [(-score[whole], rank[whole], rank[a], rank[b], a, b) for a, b in own]
    return [(a, b) for *_, a, b in sorted(found)]


def _words(model: PieceModel) -> bool:
    """No piece goes on over a marker, so neither does a merge: words can be encoded apart."""
    plain = [p for p, _, kind in model.pieces if kind != _CONTROL]
    return not any(re.search(f"[^{MARK}]{MARK}", p) for p in plain) and all(kind != _USER for _, _, kind in model.pieces)


class Codec:
    """Encodes and decodes batches in one process; built once per Python worker and model.

    Where words can be encoded apart, each distinct word of a batch is encoded once, on all threads, decoded
    again to see whether it comes back, and kept for the next batches. Beyond ``keep`` words, those seen
    once since the last time go; of the others at most half of ``keep`` stay, the more frequent ones.
    """

    _built: dict[int, Codec] = {}

    def __init__(self, data: bytes, threads: int = 1, keep: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true" if threads > 1 else "false")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = PieceModel.parse(data)
        self.by_word = _words(self.model)
        self.keep = keep
        self._whole = None
        if self.by_word:
            self.parts = build(self.model)
            self.normalizer = self.parts.normalizer
            self.simple = not self.model.charsmap and not self.model.squeeze
            self.parts.normalizer = None
            self.parts.pre_tokenizer = None
            self.known: dict[str, int] = {}
            self.ids, self.starts, self.same = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool)
            self.seen = np.zeros(0, np.int64)

    @classmethod
    def of(cls, data: bytes, threads: int = 1) -> Codec:
        key = hash((data, threads))
        if key not in cls._built:
            cls._built[key] = cls(data, threads)
        return cls._built[key]

    @property
    def tokenizer(self):
        """For whole texts; words need only the part without normaliser, so it is built when asked for."""
        if self._whole is None:
            self._whole = build(self.model)
        return self._whole

    def _forget(self) -> None:
        """Keep the words that came again, the frequent ones first."""
        order = np.argsort(-self.seen, kind="stable")[: self.keep // 2]
        order = np.sort(order[self.seen[order] > 1])
        names = list(self.known)
        self.known = {names[i]: n for n, i in enumerate(order.tolist())}
        size = np.diff(self.starts)[order]
        self.ids = self.ids[_spread(self.starts[order], size)]
        self.starts = np.concatenate([[0], np.cumsum(size)])
        self.same, self.seen = self.same[order], np.zeros(len(order), np.int64)

    def _learn(self, new: list[str]) -> None:
        coded: list[list[int]] = []
        same: list[bool] = []
        lead = MARK if self.model.add_prefix else ""
        for i in range(0, len(new), _AT_ONCE):  # an encoding is much larger than its ids
            own = new[i : i + _AT_ONCE]
            ids = [e.ids for e in self.parts.encode_batch_fast(own, add_special_tokens=False)]
            back = self.parts.decode_batch(ids, skip_special_tokens=False)
            same += [b == w.removeprefix(lead).replace(MARK, " ") for b, w in zip(back, own)]
            coded += ids
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter(chain.from_iterable(coded), np.int32, int(size.sum()))
        self.ids = np.concatenate([self.ids, flat])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(size)])
        self.same = np.concatenate([self.same, np.array(same, bool)])
        self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))

    def encode_arrays(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """Ids of all texts end to end, their offsets, and whether each decodes to its text."""
        if not self.by_word:
            ids = self.encode(texts)
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
            return np.array([i for x in ids for i in x], np.int32), offsets, [a == b for a, b in zip(self.decode(ids), texts)]
        if len(self.known) > self.keep:
            self._forget()
        if self.simple:
            lead = MARK if self.model.add_prefix else ""
            normal = [lead + t.replace(" ", MARK) if t else "" for t in texts]
        else:
            normal = [self.normalizer.normalize_str(t) for t in texts]
        words = [_WORD.findall(t) for t in normal]
        every = list(chain.from_iterable(words))
        get = self.known.get
        at = np.fromiter((get(w, -1) for w in every), np.int64, len(every))
        if (at < 0).any():
            self._learn(list(dict.fromkeys(every[i] for i in np.flatnonzero(at < 0).tolist())))
            known = self.known
            for i in np.flatnonzero(at < 0).tolist():
                at[i] = known[every[i]]
        self.seen += np.bincount(at, minlength=len(self.seen))
        size = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(size)
        ids = self.ids[_spread(self.starts[at], size)]
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in words])]).astype(int)
        offsets = np.concatenate([[0], ends])[cuts]
        good = np.concatenate([[0], np.cumsum(~self.same[at])])[cuts]
        lead = 1 if self.model.add_prefix else 0
        back = [b == a and n[lead:] == t.replace(" ", MARK) and MARK not in t for a, b, n, t in zip(good, good[1:], normal, texts)]
        return ids, offsets, back

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, without control symbols. An empty text has none."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False) if ids else []


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def read_model(spark: SparkSession, path: str) -> bytes:
    """The model file by Spark's reader, from any store; a local file of the driver otherwise."""
    if "://" not in path and os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def encode(docs: DataFrame, model: bytes, threads: int = 2, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Token ids of every whole text, and whether they decode to the same text.

    The tokenizer is rebuilt from the model file (``build``) once per worker and encodes batches of about
    a megabyte on ``threads`` threads; a longer text is a batch of its own. One pass, no shuffle.

    Returns ``columns`` of ``docs`` plus n_tokens (long), ids (array<int>), round_trip (the decoded ids are the
    text; models that squeeze or fold characters change some). A null text gives null in all three,
    an empty one no ids. Rows keep their ids, repeated or null; other columns are left out.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    kept = [c for c in columns if c != "text"]

    def rows(batches):
        codec = Codec.of(sent.value, threads)
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            numbered = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(at)], names=["row", "text"])
            done = 0
            for names, texts in text_batches([numbered]):
                part = batch.slice(done, len(names))
                done += len(names)
                full = [(t or b"").decode() for t in texts]
                ids, offsets, back = codec.encode_arrays(full)
                none = np.array([t is None for t in texts], bool)
                fields = [
                    pa.array(np.diff(offsets), pa.int64(), mask=none),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(none)),
                    pa.array(back, pa.bool_(), mask=none),
                ]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], *fields], names=[*kept, "n_tokens", "ids", "round_trip"]
                )

    narrow = docs.select(*kept, F.col("text").cast("string").alias("_text"))
    schema = docs.select(*kept, F.lit(0).cast("long").alias("n_tokens"), F.array(F.lit(0)).alias("ids"), F.lit(True).alias("round_trip")).schema
    for f in schema.fields:
        f.nullable = True
    return narrow.mapInArrow(rows, schema)


def decode(tokens: DataFrame, model: bytes, threads: int = 2) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the library's decoder over portions of about a million ids; a longer row stands alone.

    Null ids give a null text, no ids the empty one; rows keep their ids, repeated or null; other columns are not read; an
    empty table gives no rows.
    """
    sent = tokens.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        codec = Codec.of(sent.value, threads)
        for batch in batches:
            sizes = [n or 0 for n in pc.list_value_length(batch.column(1)).to_pylist()]
            for a, b in slices(sizes):
                part = batch.slice(a, b - a)
                ids = part.column(1).to_pylist()
                back = iter(codec.decode([i for i in ids if i is not None]))
                text = [None if i is None else next(back) for i in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(
        rows, "doc_id long, text string"
    )
