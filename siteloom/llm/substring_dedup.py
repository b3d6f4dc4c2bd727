"""Substring deduplication by level-wise doubling."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import cut_lineage
from .blocks import SENT_SCHEMA, Codec, answers, bucket_bits, map_blocks, with_replies, write_blocks
from .words import Words, words

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def levels(length: int, shortest: int) -> list[int]:
    """Window lengths from short to ``length``, each at most twice the one before."""
    out = [length]
    while out[-1] > shortest:
        out.append((out[-1] + 1) // 2)
    return out[::-1]


def _candidates(w: Words, codec, lengths: list[int], replies) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the windows of the last length whose halves were all found repeated, and hashes."""
    left = w.left()
    at = np.flatnonzero(left >= lengths[0])
    for level, (short, long) in enumerate(zip(lengths, lengths[1:])):
        keys = codec(level).short(w.windows(at, short))
        repeated = np.zeros(len(w.hash) + 1, bool)
        repeated[at] = replies.values(codec(level), level, keys).astype(bool)
        at = np.flatnonzero((left >= long) & repeated[:-1])
        at = at[repeated[at + long - short]]
    return at, w.windows(at, lengths[-1])


def substring_dedup(docs: DataFrame, length: int = 35, shortest: int = 18, with_text: bool = True) -> DataFrame:
    """Remove every word covered by a ``length``-word window that also starts anywhere else.

    Words are runs without blank, tab, line feed, vertical tab, form feed and carriage return, taken
    unchanged from the whole text. Windows lie within one document and are judged on the input, so
    all occurrences go. A document copied anywhere goes wholly; a text shorter than ``length`` stays.

    The search goes up by doubling: windows of the first length (``shortest`` to twice that) that
    occur once rule out every longer window over them; those repeated are extended to twice the length,
    which needs both halves repeated, until no candidate survives or ``length`` is reached. Hashes
    of the short levels travel in three bytes and a bucket, which may let a window through but never
    rules out a repeated one; the last level compares whole 64-bit hashes.

    Returns one row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (lowercase hex of the
    kept words joined by one blank, UTF-8) and, ``with_text``, kept_text. A null text has no words;
    null and repeated ids stay as they are; other columns of ``docs`` are ignored.
    """
    lengths = levels(length, shortest)
    blocks = write_blocks(docs, lambda texts: len(words(texts).hash))
    bits = bucket_bits(blocks)

    def codec(level: int) -> Codec:
        return Codec(bits, 8 if level == len(lengths) - 1 else 3)

    replies = None
    for level in range(len(lengths)):

        def send(block, _, texts, got=None, level=level):
            _, hashes = _candidates(words(texts), codec, lengths[: level + 1], got)
            return codec(level).send(block, codec(level).short(hashes))

        sent = map_blocks(blocks, send, SENT_SCHEMA) if replies is None else with_replies(blocks, replies, send, SENT_SCHEMA)
        more = cut_lineage(answers(sent, codec(level), level), "repeats")
        replies = more if replies is None else replies.unionByName(more)
        if more.isEmpty():
            break  # no candidate survived: the next levels have nothing to ask

    def finish(_, ids, texts, got):
        w = words(texts)
        at, hashes = _candidates(w, codec, lengths, got)
        if len(at):
            last = len(lengths) - 1
            at = at[got.values(codec(last), last, codec(last).short(hashes)).astype(bool)]
        cover = np.zeros(len(w.hash) + 1, np.int32)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
        kept = np.cumsum(cover)[:-1] == 0
        n_kept = np.add.reduceat(np.append(kept, False).astype(np.int64), w.first[:-1])
        n_kept = np.where(w.counts > 0, n_kept, 0)
        return pa.RecordBatch.from_pydict(_rows(ids, w, kept, n_kept, with_text), schema=_arrow(with_text))

    schema = SCHEMA if with_text else SCHEMA.rsplit(",", 1)[0]
    return with_replies(blocks, replies, finish, schema)


def _arrow(with_text: bool) -> pa.Schema:
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    return pa.schema([*fields, *([("kept_text", pa.string())] if with_text else [])])


def _rows(ids, w: Words, kept: np.ndarray, n_kept: np.ndarray, with_text: bool) -> dict:
    texts = []
    for i, (a, b) in enumerate(zip(w.first.tolist(), w.first[1:].tolist())):
        if n_kept[i] == b - a:
            texts.append(w.text(a, b))
        else:
            at = a + np.flatnonzero(kept[a:b])
            d = w.data
            texts.append(b" ".join(d[s:e].tobytes() for s, e in zip(w.start[at].tolist(), w.end[at].tolist())))
    out = {
        "doc_id": ids,
        "n_words": w.counts.tolist(),
        "n_removed": (w.counts - n_kept).tolist(),
        "kept_sha256": [hashlib.sha256(t).hexdigest() for t in texts],
    }
    return out | ({"kept_text": [t.decode("utf-8", "replace") for t in texts]} if with_text else {})
