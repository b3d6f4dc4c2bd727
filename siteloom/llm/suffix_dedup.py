"""Suffix-array deduplication with sparse suffixes at minimiser positions."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import cut_lineage
from .blocks import SENT_SCHEMA, Codec, Replies, answers, bucket_bits, log_class, map_blocks, unpack_texts, with_replies, write_blocks
from .words import Words, minimisers, mix, words

SUFFIX_SCHEMA = "bucket int, block long, position binary, member binary, weight binary, room binary, right binary, left binary"
HIT_SCHEMA = "block long, position binary, first binary, last binary"
SPAN_SCHEMA = "doc_id long, start_word long, n_words long, span_sha256 string, span_text string"


def _anchors(w: Words, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the kept suffixes and the hash of the k words there."""
    left = w.left()
    grams = np.full(len(w.hash), 2**64 - 1, np.uint64)
    at = np.flatnonzero(left >= k)
    grams[at] = w.windows(at, k)
    spots = minimisers(grams, left, k, length - k + 1)
    return spots, grams[spots]


def _context(w: Words, at: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each suffix: words to its left and right within the text, and their 32-bit hashes, nearest first."""
    before = length - k
    doc = w.doc_of(at)
    room = np.stack([np.minimum(at - w.first[doc], before), np.minimum(w.first[doc + 1] - at, length)], axis=1)
    short = np.append((w.hash >> np.uint64(32)).astype(np.uint32), np.uint32(0))
    far = len(w.hash)
    right = at[:, None] + np.arange(length)
    left = at[:, None] - 1 - np.arange(before)
    right = short[np.where(np.arange(length) < room[:, 1:], right, far)]
    left = short[np.where(np.arange(before) < room[:, :1], left, far)]
    return room.astype(np.uint16), right, left


def _cores(w: Words, at: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the stretches around the anchors ``at`` that lie within their text, one rightwards and one
    leftwards: the ``length`` words around an anchor hold one or the other. Whose, and which of the two."""
    half = (length - k) // 2
    doc = w.doc_of(at)
    right = np.flatnonzero(at + length - half <= w.first[doc + 1])
    left = np.flatnonzero(at - half >= w.first[doc])
    return np.concatenate([at[right], at[left] - half]), np.concatenate([right, left]), np.repeat([False, True], [len(right), len(left)])


def _core_hashes(w: Words, start: np.ndarray, leftwards: np.ndarray, length: int, k: int) -> np.ndarray:
    half = (length - k) // 2
    return w.windows(start, np.where(leftwards, half + k, length - half))


def _windows_of(w: Words, at: np.ndarray, leftwards: np.ndarray, length: int, k: int) -> np.ndarray:
    """Starts of the ``length``-word windows that hold the stretches found again at the anchors ``at``."""
    half, before = (length - k) // 2, length - k
    starts = [np.zeros(0, np.int64)]
    for side, reach in ((False, np.arange(half + 1)), (True, np.arange(half, before + 1))):
        spot = at[leftwards == side]
        doc = w.doc_of(spot)
        start = spot[:, None] - reach
        starts.append(start[(start >= w.first[doc][:, None]) & (start + length <= w.first[doc + 1][:, None])])
    return np.unique(np.concatenate(starts))


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First row of each distinct row over all columns, which of them each row is, and how often it occurs."""
    raw = np.ascontiguousarray(np.concatenate([c.astype(np.uint32) for c in columns], axis=1))
    _, first, member, weight = np.unique(
        raw.view(np.dtype((np.void, raw.shape[1] * 4))).ravel(), return_index=True, return_inverse=True, return_counts=True
    )
    return first, member.astype(np.int32), weight.astype(np.int32)


def compare(
    room: np.ndarray, right: np.ndarray, left: np.ndarray, length: int, weight: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest number of words to the left at which the ``length`` words around a suffix repeat.

    The suffixes are sorted by the words from their anchor on. Neighbours are compared: those sharing
    at least ``length - l`` words stand in one run. Within a run the match is extended ``l`` words to the
    left; two suffixes equal there share a passage of ``length`` words that starts ``l`` words before
    the anchor. -1 where there is none. ``weight``: how many suffixes a row stands for.
    """
    n, before = len(right), left.shape[1]
    many = np.ones(n) if weight is None else weight.astype(np.float64)
    order = np.argsort(np.ascontiguousarray(right.astype(">u4")).view(f"S{4 * length}").ravel(), kind="stable")
    r, a = right[order], room[order].astype(np.int64)
    differ = r[1:] != r[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    shared = np.minimum(shared, np.minimum(a[1:, 1], a[:-1, 1]))
    first, last = np.full(n, -1), np.full(n, -1)
    behind = np.zeros(n, np.uint64)
    for l in range(before + 1):  # noqa: E741
        if l:
            behind = mix(behind * np.uint64(0x9E3779B97F4A7C15) + left[order, l - 1].astype(np.uint64) + np.uint64(1))
        run = np.concatenate([[0], np.cumsum(shared < length - l)])
        fit = np.flatnonzero((a[:, 0] >= l) & (a[:, 1] >= length - l))
        key = mix(behind[fit] + mix(run[fit].astype(np.uint64) + np.uint64(1)))
        _, inverse = np.unique(key, return_inverse=True)
        hit = fit[np.bincount(inverse, many[order[fit]])[inverse] > 1] if len(fit) else fit
        last[hit] = l
        first[hit] = np.where(first[hit] < 0, l, first[hit])
    out = np.empty((2, n), np.int64)
    out[:, order] = first, last
    return out[0], out[1]


def suffix_dedup(docs: DataFrame, length: int = 50, k: int = 8, hot: int = 4096) -> DataFrame:
    """Passages of ``length`` words or more that also stand elsewhere, in any document.

    Words are runs without ASCII white space, unchanged, of whole texts. Of all suffixes only those are
    kept that start at a minimiser: the k words of least hash among any ``length - k + 1`` consecutive
    ones. Every passage of ``length`` words holds one, at the same place in each copy. Suffixes whose k
    words occur once are ruled out by counting; the others, with the words around them that matter,
    meet in a bucket of the hash space, are sorted, compared with neighbours and extended left and
    right (``compare``). A block sends equal suffixes once, so a frequent passage costs a bucket one
    row per block. Words are compared by 32-bit hash, passages thus by ``32 * length`` bits.

    The suffixes of an anchor that stands in more than about ``hot`` places do not meet. Their stretches of
    half the words around are counted next; where one stands elsewhere too, the windows that hold it are
    counted by their 64-bit hashes. So an anchor in every document costs a bucket at most one hash per
    block and window, and nothing where the passage around it is too short.

    Returns a row per maximal repeated passage: doc_id, start_word (from 0), n_words, span_sha256 (of the
    words joined by one blank) and span_text. Documents without any are not in the result. Null and short
    texts have none; null and repeated ids stay as they are; other columns are ignored.
    """
    blocks = write_blocks(docs, lambda texts: len(words(texts).hash))
    bits = bucket_bits(blocks)
    codec, whole = Codec(bits, 3), Codec(bits, 8)
    limit = int(log_class(np.array([hot]))[0])

    def send(block, _, texts):
        return codec.send(block, codec.short(_anchors(words(texts), length, k)[1]), with_counts=True)

    counted = cut_lineage(answers(map_blocks(blocks, send, SENT_SCHEMA), codec, 0, as_class=True), "anchors")

    def hot_cores(w: Words, got: Replies) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at, grams = _anchors(w, length, k)
        at = at[got.values(codec, 0, codec.short(grams), as_class=True) > limit]
        start, of, leftwards = _cores(w, at, length, k)
        return at[of], start, leftwards, codec.short(_core_hashes(w, start, leftwards, length, k))

    def hot_windows(w: Words, got: Replies) -> tuple[np.ndarray, np.ndarray]:
        at, _, leftwards, keys = hot_cores(w, got)
        again = got.values(codec, 1, keys).astype(bool)
        start = _windows_of(w, at[again], leftwards[again], length, k)
        return start, w.windows(start, length)

    def send_cores(block, _, texts, got):
        return codec.send(block, hot_cores(words(texts), got)[3])

    def send_windows(block, _, texts, got):
        return whole.send(block, hot_windows(words(texts), got)[1])

    def hot_hits(block, _, texts, got):
        start, keys = hot_windows(words(texts), got)
        start = start[got.values(whole, 2, keys).astype(bool)].astype(np.int32)
        none = np.zeros(len(start), np.int32).tobytes()
        values = [[block], [start.tobytes()], [none], [none]] if len(start) else [[], [], [], []]
        types = [pa.int64(), *[pa.binary()] * 3]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=["block", "position", "first", "last"])

    cores = cut_lineage(answers(with_replies(blocks, counted, send_cores, SENT_SCHEMA), codec, 1), "cores")
    met_often = None
    if not cores.isEmpty():
        replies = counted.unionByName(cores)
        found = cut_lineage(answers(with_replies(blocks, replies, send_windows, SENT_SCHEMA), whole, 2), "windows")
        met_often = with_replies(blocks, replies.unionByName(found), hot_hits, HIT_SCHEMA)

    def suffixes(block, _, texts, got):
        w = words(texts)
        at, grams = _anchors(w, length, k)
        count = got.values(codec, 0, codec.short(grams), as_class=True)
        kept = (count > 0) & (count <= limit)
        at, grams = at[kept], grams[kept]
        order = np.argsort(grams, kind="stable")
        at, bucket = at[order], (grams[order] >> np.uint64(64 - bits)).astype(np.int32)
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(at)]
        out = [[] for _ in range(8)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                room, right, left = _context(w, at[a:b], length, k)
                one, member, weight = _distinct(room, right, left)
                row = (int(bucket[a]), block, at[a:b].astype(np.int32), member, weight, room[one], right[one], left[one])
                for column, value in zip(out, row):
                    column.append(value if isinstance(value, int) else value.tobytes())
        types = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
        names = [f.split()[0] for f in SUFFIX_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=names)

    def meet(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        sizes = [len(r["weight"]) // 4 for r in rows]

        def stacked(name: str, kind, width: int) -> np.ndarray:
            return np.frombuffer(b"".join(r[name] for r in rows), kind).reshape(-1, width)

        first, last = compare(
            stacked("room", np.uint16, 2), stacked("right", np.uint32, length), stacked("left", np.uint32, length - k), length,
            stacked("weight", np.int32, 1).ravel(),
        )
        at = np.concatenate([[0], np.cumsum(sizes)])
        out = {"block": [], "position": [], "first": [], "last": []}
        for r, a, b in zip(rows, at, at[1:]):
            member = np.frombuffer(r["member"], np.int32)
            hit = np.flatnonzero(last[a:b][member] >= 0)
            if len(hit):
                out["block"].append(r["block"])
                out["position"].append(np.frombuffer(r["position"], np.int32)[hit].tobytes())
                out["first"].append(first[a:b][member[hit]].astype(np.int32).tobytes())
                out["last"].append(last[a:b][member[hit]].astype(np.int32).tobytes())
        types = [pa.int64(), *[pa.binary()] * 3]
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), types)})

    sent = with_replies(blocks, counted, suffixes, SUFFIX_SCHEMA)
    hits = sent.groupBy("bucket").applyInArrow(meet, HIT_SCHEMA)
    hits = cut_lineage(hits if met_often is None else hits.unionByName(met_often), "repeats")

    def spans(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"doc_id": [], "start_word": [], "n_words": [], "span_sha256": [], "span_text": []}
        if left.num_rows and right.num_rows:
            row = left.to_pylist()[0]
            w = words(unpack_texts(row["body"], row["lens"]))
            at, first, last = (np.frombuffer(b"".join(right.column(c).to_pylist()), np.int32) for c in ("position", "first", "last"))
            cover = np.zeros(len(w.hash) + 1, np.int32)
            np.add.at(cover, at - last, 1)
            np.add.at(cover, at - first + length, -1)
            covered = np.cumsum(cover)[:-1] > 0
            # spans end at their text's end
            starts = covered & ~np.concatenate([[False], covered[:-1]])
            starts[w.first[:-1][w.counts > 0]] |= covered[w.first[:-1][w.counts > 0]]
            edge = np.flatnonzero(starts)
            doc = w.doc_of(edge)
            gap = np.append(np.flatnonzero(~covered), len(covered))
            stop = np.minimum(np.minimum(gap[np.searchsorted(gap, edge)], w.first[doc + 1]), np.append(edge[1:], len(covered)))
            for d, a, b in zip(doc.tolist(), edge.tolist(), stop.tolist()):
                text = w.text(a, b)
                values = (row["ids"][d], a - int(w.first[d]), b - a, hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace"))
                for column, value in zip(out.values(), values):
                    column.append(value)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), types)})

    left = blocks.select("block", "ids", "lens", "body").groupBy("block")
    return left.cogroup(hits.groupBy("block")).applyInArrow(spans, SPAN_SCHEMA)
