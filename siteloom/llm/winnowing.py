"""Benchmark decontamination by winnowing."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocks import text_batches
from .carry import carried
from .words import NOT_ALPHANUMERIC, Words, minimisers, words

_ADDED = ("_hit", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "hit_text")


class Fingerprints:
    """Fingerprints and windows of a slice of the benchmark, as sorted arrays.

    A window has ``length`` words; a shorter item is one window. Winnowing keeps the least hash of
    any ``length - k + 1`` consecutive k-grams, so each full window holds at least one fingerprint,
    and equal windows hold equal ones. Windows of shorter items are kept by their length.
    """

    def __init__(self, items: list[tuple[str | None, bytes | None]], length: int, k: int):
        self.length, self.k = length, min(k, length)
        w = words([t for _, t in items], NOT_ALPHANUMERIC, lower=True)
        left, counts = w.left(), w.counts
        grams = _grams(w, left, self.k)
        self.prints = np.unique(grams[minimisers(grams, left, self.k, length - self.k + 1)])
        self.names = [name for name, _ in items]
        at = np.flatnonzero(left >= length)
        self.windows = {length: _lists(w.windows(at, length), w.doc_of(at))}
        for n in np.unique(counts[(counts > 0) & (counts < length)]).tolist():
            at = w.first[:-1][counts == n]
            self.windows[n] = _lists(w.windows(at, n), np.flatnonzero(counts == n))

    def hits(self, w: Words) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(start, number of the window among those of its length, length) of every benchmark window in the texts."""
        left = w.left()
        found = []
        for n, (names, starts, item) in self.windows.items():
            if n < self.length:
                at = np.flatnonzero(left >= n)
            elif len(names):
                grams = _grams(w, left, self.k)
                spots = minimisers(grams, left, self.k, n - self.k + 1)
                spots = spots[_in(grams[spots], self.prints)]
                # extend: every window that holds a matching fingerprint
                at = np.unique((spots[:, None] - np.arange(n - self.k + 1)).ravel()) if len(spots) else spots
                at = at[at >= 0]
                at = at[left[at] >= n]
            else:
                continue
            if not len(at):
                continue
            hashes = w.windows(at, n)
            spot = np.searchsorted(names, hashes)
            spot[spot == len(names)] = 0
            same = names[spot] == hashes
            found.append((at[same], spot[same], n))
        return found

    def items_of(self, n: int, windows: np.ndarray) -> np.ndarray:
        """Distinct indices of the items that hold any of ``windows`` of length ``n``."""
        _, starts, item = self.windows[n]
        return np.unique(np.concatenate([item[starts[i] : starts[i + 1]] for i in windows.tolist()]))


def _grams(w: Words, left: np.ndarray, k: int) -> np.ndarray:
    out = np.full(len(w.hash), 2**64 - 1, np.uint64)
    at = np.flatnonzero(left >= k)
    out[at] = w.windows(at, k)
    return out


def _lists(hashes: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pairs = np.unique(np.stack([hashes, item.astype(np.uint64)], axis=1), axis=0) if len(hashes) else np.zeros((0, 2), np.uint64)
    names, starts = np.unique(pairs[:, 0], return_index=True)
    return names, np.append(starts, len(pairs)), pairs[:, 1].astype(np.int64)


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    spot = np.searchsorted(known, values)
    spot[spot == len(known)] = 0
    return known[spot] == values


def _slices(benchmark: DataFrame, slice_bytes: int):
    """The benchmark's (item_id, text) in slices of about ``slice_bytes``, by a hash of the item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-total // slice_bytes) or 1
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield [(r.item_id, r.text.encode()) for r in part.collect()]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, length: int = 13, k: int = 7, one_in: int = 20, slice_bytes: int = 16 << 20, in_a_row: int = 4
) -> DataFrame:
    """Words of documents that lie inside an occurrence of a benchmark window.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased, of whole texts. A
    window is ``length`` consecutive words of an item, or a whole shorter item. Winnowing
    (``Fingerprints``) finds the places in a document worth looking at: every span shared with the
    benchmark over ``length`` words or more has a fingerprint in common; hits are extended to the
    windows around them, which are compared by 64-bit hash.

    The benchmark is sent to the tasks in slices of at most about ``slice_bytes`` of text. One slice is
    the usual case; each further one adds a pass over the documents, ``in_a_row`` of them in one job before
    the marked documents are written, without a shuffle, so a benchmark of any size gives the whole result.

    Returns all columns of ``docs`` plus n_words, n_hit, n_items, items (their ids as sorted strings),
    items_sha256 (of the ids, comma-joined), contaminated (``one_in * n_hit >= n_words`` with a hit) and
    hit_text (the words hit); columns of these names are replaced. A null text has no words. An item
    of null text has no window; one of null id marks words but has no name to count. Equal items, and
    rows that repeat an id, count once. Ids of documents are not looked at.
    """
    return carried(docs, _ADDED[1:], lambda rows: _find(rows, benchmark, length, k, one_in, slice_bytes, in_a_row))


def _find(docs: DataFrame, benchmark: DataFrame, length: int, k: int, one_in: int, slice_bytes: int, in_a_row: int) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select("row", "text")
    own = docs.columns
    at = own.index("text")
    now = docs.withColumns({"_hit": F.lit(None).cast("binary"), "items": F.lit(None).cast("array<string>")})
    sent, used = None, []
    for i, items in enumerate(_slices(benchmark, slice_bytes)):
        if sent is not None:

            def mark(batches, sent=sent):
                for part, texts, hit, items in _parts(batches, at):
                    _mark(sent.value, texts, hit, items)
                    columns = [*part.columns[: len(own)], pa.array(hit, pa.binary()), pa.array(items, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*own, "_hit", "items"])

            now = now.mapInArrow(mark, now.schema)
            used.append(sent)
            if i % in_a_row == 0:
                now = cut_lineage(now, "marked")
                # what is written needs them no more
                while used:
                    used.pop().destroy()
        sent = spark.sparkContext.broadcast(Fingerprints(items, length, k))

    # the last slice is marked in the pass that gives the result
    def finish(batches, sent=sent):
        for part, texts, hit, items in _parts(batches, at):
            _mark(sent.value, texts, hit, items)
            added = _digest(texts, hit, items, one_in)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(own)], *added.values()], names=[*own, *added])

    schema = now.drop("_hit", "items").withColumns(
        {c: F.lit(None).cast(t) for c, t in zip(_ADDED[1:], ("long", "long", "long", "array<string>", "string", "boolean", "string"))}
    ).schema
    return now.mapInArrow(finish, schema)


def _parts(batches, at: int):
    """(rows, texts, hit words so far, items so far) in parts of about a megabyte of text."""
    for batch in batches:
        numbered = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(at)], names=["row", "text"])
        done = 0
        for names, texts in text_batches([numbered]):
            part = batch.slice(done, len(names))
            done += len(names)
            yield part, texts, *(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("_hit", "items"))


def _mark(prints: Fingerprints, texts, hit: list, items: list) -> None:
    """Add the hit words and items of each text to ``hit`` and ``items``."""
    w = words(texts, NOT_ALPHANUMERIC, lower=True)
    cover = np.zeros(len(w.hash) + 1, np.int32)
    named: dict[int, set] = {}
    for at, window, n in prints.hits(w):
        np.add.at(cover, at, 1)
        np.add.at(cover, at + n, -1)
        # each window of a text once, however often it occurs; its items only then
        seen = np.unique(np.stack([w.doc_of(at), window], axis=1), axis=0)
        cuts = np.flatnonzero(np.append(True, seen[1:, 0] != seen[:-1, 0])) if len(seen) else []
        for a, b in zip(cuts, [*cuts[1:], len(seen)]):
            own = {prints.names[i] for i in prints.items_of(n, seen[a:b, 1]).tolist()} - {None}
            named.setdefault(int(seen[a, 0]), set()).update(own)
    covered = np.cumsum(cover)[:-1] > 0
    for d in np.unique(w.doc_of(np.flatnonzero(covered))).tolist():
        own = covered[w.first[d] : w.first[d + 1]]
        if hit[d] is not None:
            own = own | np.unpackbits(np.frombuffer(hit[d], np.uint8), count=len(own)).astype(bool)
        hit[d] = np.packbits(own).tobytes()
        items[d] = sorted(set(items[d] or ()) | named.get(d, set()))


def _digest(texts, hit, items, one_in: int) -> dict[str, pa.Array]:
    w = words(texts, NOT_ALPHANUMERIC, lower=True)
    n_words = w.counts.tolist()
    n_hit, hit_text = [], []
    for d, bits in enumerate(hit):
        own = np.flatnonzero(np.unpackbits(np.frombuffer(bits or b"", np.uint8), count=n_words[d] if bits else 0)) + w.first[d]
        n_hit.append(len(own))
        spans = zip(w.start[own].tolist(), w.end[own].tolist())
        hit_text.append(b" ".join(w.data[a:b].tobytes() for a, b in spans).decode("utf-8", "replace") if len(own) else None)
    items = [i or [] for i in items]
    return {
        "n_words": pa.array(n_words, pa.int64()),
        "n_hit": pa.array(n_hit, pa.int64()),
        "n_items": pa.array([len(i) for i in items], pa.int64()),
        "items": pa.array(items, pa.list_(pa.string())),
        "items_sha256": pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()),
        "contaminated": pa.array([h > 0 and one_in * h >= n for h, n in zip(n_hit, n_words)], pa.bool_()),
        "hit_text": pa.array(hit_text, pa.string()),
    }
