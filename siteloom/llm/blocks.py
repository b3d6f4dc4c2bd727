"""Documents packed into blocks, and counts of window hashes exchanged between the blocks.

A block holds about a megabyte of whole texts, compressed, with their ids; a longer text is a block
of its own. Blocks are written once, so a block has the same texts and the same positions in every
later pass, whichever executor reads it. To learn which of its windows occur elsewhere, a block sends
their hashes, sorted, to buckets of the hash space; a bucket adds up what all blocks sent and answers
each block in the same order. Nothing but hashes and answers travels, no group of rows with one key
is ever gathered, and a bucket holds a bounded share of the hash space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .words import slices

BLOCK_SCHEMA = "block long, n_words long, ids array<long>, lens array<int>, body binary"
SENT_SCHEMA = "block long, bucket int, keys binary, counts binary"
REPLY_SCHEMA = "block long, bucket int, level int, reply binary, n_repeated long"
_CODEC = pa.Codec("zstd", compression_level=3)


def pack_texts(texts: list[bytes]) -> bytes:
    """Length of the raw bytes, then the texts end to end, compressed."""
    raw = b"".join(texts)
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def unpack_texts(body: bytes, lens: list[int]) -> list[bytes | None]:
    """The texts of a block; a length of -1 stands for null."""
    raw = _CODEC.decompress(body[8:], decompressed_size=int.from_bytes(body[:8], "little"), asbytes=True)
    out, at = [], 0
    for n in lens:
        out.append(None if n < 0 else raw[at : at + n])
        at += max(n, 0)
    return out


def text_batches(batches: Iterable[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[tuple[list, list[bytes | None]]]:
    """(ids, texts) of about ``limit`` bytes from batches of (doc_id, text)."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(1)).fill_null(0).to_pylist()
        for a, b in slices(sizes, limit):
            part = batch.slice(a, b - a)
            kind = pa.large_binary() if pa.types.is_large_string(part.column(1).type) else pa.binary()
            yield part.column(0).to_pylist(), part.column(1).cast(kind).to_pylist()
    pa.default_memory_pool().release_unused()  # the worker stays for other tasks


def id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def write_blocks(docs: DataFrame, count: Callable[[list[bytes | None]], int], limit: int = 1 << 20) -> DataFrame:
    """Blocks of (doc_id, text), written to the shared folder. ``block + i`` is the number of row i."""

    def pack(batches):
        task, at = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def block():
            nonlocal at
            lens = [-1 if t is None else len(t) for t in texts]
            row = [(task << 33) + at, count(texts), ids, lens, pack_texts([t or b"" for t in texts])]
            at += len(ids)
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            names = ["block", "n_words", "ids", "lens", "body"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        for more_ids, more in text_batches(batches, limit):
            n = sum(len(t or b"") for t in more)
            if texts and size + n > limit:
                yield block()
                ids, texts, size = [], [], 0
            ids, texts, size = ids + more_ids, texts + more, size + n
        if texts:
            yield block()

    return cut_lineage(id_and_text(docs).mapInArrow(pack, BLOCK_SCHEMA), "blocks")


def bucket_bits(blocks: DataFrame, per_bucket: int = 1 << 20, least: int = 8) -> int:
    """Buckets, as a power of two, so that one holds about ``per_bucket`` windows at any input size."""
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    return max(least, int(np.ceil(np.log2(max(1, total / per_bucket)))))


class Codec:
    """How hashes travel: a bucket number and ``width`` more bytes of each hash, sorted, once each.

    With 8 bytes the whole hash is sent. With fewer the answer may report a chance match, about one
    key in ``2**(8*width) / per_bucket``, at any input size; use that only to rule windows out.
    """

    def __init__(self, bits: int, width: int):
        self.bits, self.width = bits, width
        self.shift = np.uint64(0 if width == 8 else 64 - bits - 8 * width)

    def short(self, keys: np.ndarray) -> np.ndarray:
        return keys >> self.shift

    def send(self, block: int, keys: np.ndarray, with_counts: bool = False) -> pa.RecordBatch:
        """One row per bucket for the distinct ``keys`` (shortened hashes) of a block."""
        keys, counts = np.unique(keys, return_counts=True)
        top = np.uint64(64 - self.bits) - self.shift
        bucket = (keys >> top).astype(np.int32)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        a, b = np.concatenate([[0], cuts]).astype(int), np.concatenate([cuts, [len(keys)]]).astype(int)
        if not len(keys):
            a = b = np.zeros(0, int)
        raw = np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, : self.width])
        counts = np.minimum(counts, 2**16 - 1).astype(np.uint16)
        body = [raw[x:y].tobytes() for x, y in zip(a, b)]
        many = [counts[x:y].tobytes() if with_counts and (counts[x:y] > 1).any() else None for x, y in zip(a, b)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(a), block), pa.int64()),
                pa.array(bucket[a] if len(a) else [], pa.int32()),
                pa.array(body, pa.binary()),
                pa.array(many, pa.binary()),
            ],
            names=["block", "bucket", "keys", "counts"],
        )

    def read(self, body: bytes) -> np.ndarray:
        """The sent part of the keys, enough to tell keys of one bucket apart."""
        raw = np.frombuffer(body, np.uint8).reshape(-1, self.width)
        if self.width == 8:
            return raw.reshape(-1).view(np.uint64)
        wide = np.zeros((len(raw), 4 if self.width <= 4 else 8), np.uint8)
        wide[:, : self.width] = raw
        return wide.reshape(-1).view(np.uint32 if self.width <= 4 else np.uint64)


def log_class(total: np.ndarray) -> np.ndarray:
    """0 for a key seen once, else a size class that grows with the logarithm of the count."""
    return np.where(total <= 1, 0, np.minimum(255, 1 + 8 * np.log2(np.maximum(total, 1)))).astype(np.uint8)


def answers(sent: DataFrame, codec: Codec, level: int, as_class: bool = False) -> DataFrame:
    """Add up the keys of each bucket and answer every block, in the order it sent them.

    The answer is one bit per key (it occurs in another block too) or, with ``as_class``, one byte
    (``log_class`` of its total count).
    """

    def reduce(_, batches):
        blocks, parts, counts = [], [], []
        for batch in batches:
            for block, keys, many in zip(*(batch.column(n).to_pylist() for n in ("block", "keys", "counts"))):
                keys = codec.read(keys)
                blocks.append(block)
                parts.append(keys)
                counts.append(np.ones(len(keys), np.uint16) if many is None else np.frombuffer(many, np.uint16))
            bucket = batch.column("bucket")[0].as_py()
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        order = np.argsort(np.concatenate(parts))
        keys = np.concatenate(parts)[order]
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        length = np.diff(np.concatenate([starts, [len(keys)]]))
        if as_class:
            total = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), starts)
            value = log_class(total)
        else:
            value = (length > 1).astype(np.uint8)
        said = np.empty(len(keys), np.uint8)
        said[order] = np.repeat(value, length)
        at = np.concatenate([[0], np.cumsum(sizes)])
        pieces = [said[a:b] for a, b in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(blocks, pa.int64()),
                pa.array([bucket] * len(blocks), pa.int32()),
                pa.array([level] * len(blocks), pa.int32()),
                pa.array([(p if as_class else np.packbits(p)).tobytes() for p in pieces], pa.binary()),
                pa.array([int(np.count_nonzero(p)) for p in pieces], pa.int64()),
            ],
            names=["block", "bucket", "level", "reply", "n_repeated"],
        )

    return sent.groupBy("bucket").applyInArrow(_iterated(reduce), REPLY_SCHEMA)


def _iterated(fn):
    """applyInArrow picks the streaming form by annotation."""

    def streamed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(key, batches)

    return streamed


class Replies:
    """The answers one block got, by level; reads them back in the order of its own sorted keys."""

    def __init__(self, table: pa.Table):
        rows = sorted(zip(*(table.column(n).to_pylist() for n in ("level", "bucket", "reply"))), key=lambda r: r[:2])
        self.rows = {}
        for level, bucket, reply in rows:
            self.rows.setdefault(level, {})[bucket] = reply

    def values(self, codec: Codec, level: int, keys: np.ndarray, as_class: bool = False) -> np.ndarray:
        """For each of ``keys`` (shortened, repeats allowed, the same as were sent): its answer."""
        if not len(keys):
            return np.zeros(0, np.uint8)
        own, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        bucket = (own >> (np.uint64(64 - codec.bits) - codec.shift)).astype(np.int64)
        got = self.rows.get(level, {})
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(own)]])
        said = np.empty(len(own), np.uint8)
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            reply = np.frombuffer(got[int(bucket[a])], np.uint8)
            said[a:b] = reply if as_class else np.unpackbits(reply, count=b - a)
        if not as_class:
            said |= counts > 1  # twice in the block itself
        return said[inverse]


def with_replies(blocks: DataFrame, replies: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(block, ids, texts, Replies)`` for each block, next to all the answers it got."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        return pa.Table.from_batches([fn(row["block"], row["ids"], unpack_texts(row["body"], row["lens"]), Replies(right))])

    names = ["block", "ids", "lens", "body"]
    left = blocks.select(*names).groupBy("block")
    return left.cogroup(replies.select("block", "bucket", "level", "reply").groupBy("block")).applyInArrow(both, schema)


def map_blocks(blocks: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(block, ids, texts)`` for each block."""

    def each(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield fn(row["block"], row["ids"], unpack_texts(row["body"], row["lens"]))

    return blocks.select("block", "ids", "lens", "body").mapInArrow(each, schema)
