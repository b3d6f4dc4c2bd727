"""Phrase collocations by dynamic itemset counting."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, stage_folder
from .blocks import text_batches
from .words import mix, words

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_NEVER = 255
_CODEC = pa.Codec("zstd", compression_level=1)
_LOWER = bytes(b + 32 if 0x41 <= b < 0x5B else b for b in range(256))
BLOCK_SCHEMA = "lang string, size int, n_distinct int, words binary, codes binary, shard int"


def _separators() -> np.ndarray:
    sep = np.zeros(256, bool)
    sep[[0x20, 0x09, *b".,;:!?", *range(0x0A, 0x0E)]] = True
    return sep


_SEPARATORS = _separators()
_ENDS = _SEPARATORS.copy()  # what ends a piece; blanks only end a word
_ENDS[[0x20, 0x09]] = False
_LINE_FEED = np.arange(256) == 0x0A


def _squeeze(a: np.ndarray) -> bytes:
    return len(a.tobytes()).to_bytes(8, "little") + _CODEC.compress(a.tobytes(), asbytes=True)


def _spread(b: bytes) -> bytes:
    return _CODEC.decompress(b[8:], decompressed_size=int.from_bytes(b[:8], "little"), asbytes=True)


def coded(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct lower-cased words (line feeds between them, as bytes) and the texts as their numbers.

    Words count from 1; 0 stands for the end of a piece or text.
    """
    w = words(texts, _SEPARATORS, lower=True)
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int32)
    _, at, code = np.unique(w.hash, return_index=True, return_inverse=True)
    raw = w.data.tobytes().translate(_LOWER)
    own = b"\n".join([raw[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist())])
    ended = np.cumsum(_ENDS[w.data])
    piece = ended[w.start]
    cut = np.zeros(n, bool)
    cut[1:] = piece[1:] != piece[:-1]
    first = w.first[(w.first > 0) & (w.first < n)]
    cut[first] = True
    out = np.zeros(n + int(cut.sum()), np.int32)
    out[np.arange(n) + np.cumsum(cut)] = code + 1
    return np.frombuffer(own, np.uint8), out


def _write_blocks(docs: DataFrame, shards: int, size: int) -> DataFrame:
    """Texts as word numbers, about ``size`` bytes of one lang a block, dealt to the shards in turn."""

    def pack(batches):
        task, at = TaskContext.get().partitionId(), 0
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def block(lang: str) -> pa.RecordBatch:
            nonlocal at
            own, code = coded(held.pop(lang))
            n = sizes.pop(lang)
            row = [lang, n, 1 + own.tobytes().count(b"\n") if len(own) else 0, _squeeze(own), _squeeze(code), (task + at) % shards]
            at += 1
            types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32()]
            names = ["lang", "size", "n_distinct", "words", "codes", "shard"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        for langs, texts in text_batches(batches, size):
            for lang, text in zip(langs, texts):
                if not text:
                    continue
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
                if sizes[lang] >= size:
                    yield block(lang)
            # many rare langs must not add up
            while sum(sizes.values()) > 8 * size:
                yield block(max(sizes, key=sizes.get))
        for lang in list(held):
            yield block(lang)

    text = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    path = f"{stage_folder(docs.sparkSession)}/collocations-{uuid.uuid4().hex}"
    text.mapInArrow(pack, BLOCK_SCHEMA).write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(BLOCK_SCHEMA).parquet(path)


def word_keys(own: bytes, lang: str) -> np.ndarray:
    """A 64-bit key of each word of one lang; never 0, which stands for no word."""
    two = words([own, lang.encode().hex().encode()], _LINE_FEED)
    tag = two.windows(two.first[1:2], two.first[2] - two.first[1:2])
    keys = mix((two.hash[: two.first[1]] + tag) * _ODD)
    return np.where(keys == 0, _U(1), keys)


@dataclass(frozen=True)
class Slots:
    """Where counters of phrases stand: a bucket of the hash space, and a place in the bucket's part of a fixed table."""

    buckets: int
    slots: int

    @property
    def per(self) -> int:
        return self.slots // self.buckets // 8 * 8

    def of(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, four more bytes of the hash) of phrases given as columns of word keys."""
        h = np.full(len(parts[0]), len(parts), _U)
        for p in parts:
            h = mix((h ^ p) * _ODD)
        return ((h >> _U(32)) * _U(self.buckets) >> _U(32)).astype(np.int32), h.astype(np.uint32)

    def place(self, bucket, low: np.ndarray) -> np.ndarray:
        return np.asarray(bucket, np.int64) * self.per + (mix(low.astype(_U)) % _U(self.per)).astype(np.int64)

    def at(self, parts: list[np.ndarray]) -> np.ndarray:
        return self.place(*self.of(parts))


def _unique_rows(codes: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases of ``length`` from positions ``at``: a position of each, and how often it occurs."""
    wide = codes[at].astype(np.int64)
    spread = int(codes.max()) + 1
    for i in range(1, length):
        if wide.size and int(wide.max()) > (1 << 62) // spread:
            _, wide = np.unique(wide, return_inverse=True)
        wide = wide * spread + codes[at + i]
    _, first, n = np.unique(wide, return_index=True, return_counts=True)
    return at[first], n


def active_phrases(codes: np.ndarray, keys: np.ndarray, acts: list[np.ndarray], slots: Slots, step: int, shards: int):
    """(start, columns of word keys, counts) of what a block adds at ``step``; ``start`` is when those phrases began.

    ``acts[j]`` has, by slot, the step from which phrases of j + 1 words count as frequent. A phrase begins when
    both parts that are one word shorter are frequent, and is counted for ``shards`` steps: one full cycle. A slot
    may be shared; then a phrase begins earlier, but at the same step in every block, so its cycle stays full.
    """
    if not len(keys):
        return
    if step < shards:
        yield 0, [keys], np.bincount(codes, minlength=len(keys) + 1)[1:]
    start = np.full(len(keys) + 1, _NEVER, np.uint8)
    start[1:] = acts[0][slots.at([keys])]
    begins = start[codes]  # of the phrase of ``length - 1`` words from each position
    for length in range(2, len(acts) + 2):
        if len(begins) < 2:
            return
        here = np.maximum(begins[:-1], begins[1:])
        for began in range(max(1, step - shards + 1), step + 1):
            at = np.flatnonzero(here == began)
            if len(at):
                first, n = _unique_rows(codes, at, length)
                yield began, [keys[codes[first + i] - 1] for i in range(length)], n
        if length > len(acts):
            return
        # from when the phrase itself is frequent, wherever it stands; never before it was counted at all
        begun = np.flatnonzero(here <= step)
        begins = np.full(len(here), _NEVER, np.uint8)
        if len(begun):
            parts = [keys[codes[begun + i] - 1] for i in range(length)]
            begins[begun] = np.maximum(acts[length - 1][slots.at(parts)], here[begun] + 1)


SENT_SCHEMA = "size int, start int, bucket int, keys binary, counts binary"


def _count_step(blocks: DataFrame, acts, slots: Slots, step: int, shards: int, flush: int) -> DataFrame:
    """What one shard adds to the counters: per task, length, start and bucket the hashes in order, and a byte of count each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.frombuffer(a, np.uint8) for a in acts.value]
        held: dict[tuple[int, int], list] = {}
        total = 0

        def drain():
            for (size, start), found in held.items():
                bucket, low, n = (np.concatenate(x) for x in zip(*found))
                whole = (bucket.astype(_U) << _U(32)) | low
                order = np.argsort(whole)
                whole, n = whole[order], n[order]
                edge = np.flatnonzero(np.append(True, whole[1:] != whole[:-1]))
                whole, n = whole[edge], np.minimum(np.add.reduceat(n, edge), 255).astype(np.uint8)
                bucket = (whole >> _U(32)).astype(np.int32)
                cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                ends = np.append(cuts[1:], len(bucket))
                low = whole.astype(np.uint32)
                columns = [np.full(len(cuts), size, np.int32), np.full(len(cuts), start, np.int32), bucket[cuts]]
                bodies = [[x[a:b].tobytes() for a, b in zip(cuts, ends)] for x in (low, n)]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, columns), *[pa.array(b, pa.binary()) for b in bodies]], names=["size", "start", "bucket", "keys", "counts"]
                )
            held.clear()

        for own, codes, lang in _unpacked(batches):
            for start, parts, n in active_phrases(codes, word_keys(own, lang), tables, slots, step, shards):
                held.setdefault((len(parts), start), []).append((*slots.of(parts), n))
                total += len(n)
            if total > flush:
                yield from drain()
                total = 0
        yield from drain()

    return blocks.where(F.col("shard") == step % shards).select("lang", "words", "codes").mapInArrow(count, SENT_SCHEMA)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, np.ndarray, str]]:
    for batch in batches:
        for i in range(batch.num_rows):
            lang, own, code = (batch.column(c)[i].as_py() for c in ("lang", "words", "codes"))
            yield _spread(own), np.frombuffer(_spread(code), np.int32), lang


def _reached(sent: DataFrame, slots: Slots, min_count: int) -> DataFrame:
    """(size, bucket, bits): the slots of each bucket whose phrases have ``min_count`` occurrences so far."""

    def add_up(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, n = [], []
        for b in batches:
            low += [np.frombuffer(x, np.uint32) for x in b.column("keys").to_pylist()]
            n += [np.frombuffer(x, np.uint8) for x in b.column("counts").to_pylist()]
        low, n = np.concatenate(low), np.concatenate(n)
        order = np.argsort(low)
        low = low[order]
        edge = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        found = low[edge][np.add.reduceat(n[order], edge, dtype=np.int64) >= min_count]
        bits = np.zeros(slots.per, bool)
        bits[slots.place(0, found)] = True
        row = [key[0].as_py(), key[2].as_py(), np.packbits(bits).tobytes()]
        types = [pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=["size", "bucket", "bits"])

    return sent.groupBy("size", "start", "bucket").applyInArrow(add_up, "size int, bucket int, bits binary")


def _set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each bit is set, in the order of ``packbits``."""
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _exact(blocks: DataFrame, found, slots: Slots, longest: int, flush: int, tasks: int) -> DataFrame:
    """Whole counts of every phrase whose slot was reached: (size, lang, word, w1.., n); size 0: all words of a lang."""
    names = [f"w{i + 1}" for i in range(longest)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(b, np.uint8) for b in found.value]
        held: dict[int, list] = {}
        words_of: dict[str, int] = {}
        total = 0

        def rows(size, parts, n, langs=None, texts=None):
            none = pa.nulls(len(n), pa.string())
            zero = np.zeros(len(n), np.int64)
            columns = [p.view(np.int64) for p in parts] + [zero] * (longest - len(parts))
            head = [pa.array(np.full(len(n), size, np.int32)), none if langs is None else pa.array(langs), none if texts is None else pa.array(texts)]
            tail = [*map(pa.array, columns), pa.array(np.asarray(n, np.int64))]
            return pa.RecordBatch.from_arrays([*head, *tail], names=["size", "lang", "word", *names, "n"])

        def merge() -> int:
            """Add up equal phrases of all that is held; how many different ones there are."""
            for size, own in held.items():
                *parts, n = (np.concatenate(x) for x in zip(*(x[0] for x in own)))
                # only words carry their text
                text = np.concatenate([x[1] for x in own]) if size == 1 else None
                held[size] = own = None
                mixed = np.zeros(len(n), _U)
                for p in parts:
                    mixed = mix((mixed ^ p) * _ODD)
                order = np.argsort(mixed)
                parts, n = [p[order] for p in parts], n[order]
                new = np.any([p[1:] != p[:-1] for p in parts], axis=0)
                edge = np.flatnonzero(np.append(True, new)) if len(n) else np.zeros(0, np.int64)
                kept = (*[p[edge] for p in parts], np.add.reduceat(n, edge) if len(n) else n)
                held[size] = [(kept, text[order[edge]] if size == 1 else None)]
            return sum(len(own[0][0][0]) for own in held.values())

        def drain():
            for size, own in held.items():
                (*parts, n), text = own[0]
                for i in range(0, len(n), 100_000):
                    j = slice(i, i + 100_000)
                    named = zip(*(x.split("\t", 1) for x in text[j])) if size == 1 else (None, None)
                    yield rows(size, [p[j] for p in parts], n[j], *(x if x is None else list(x) for x in named))
            held.clear()

        for own, codes, lang in _unpacked(batches):
            keys = word_keys(own, lang)
            words_of[lang] = words_of.get(lang, 0) + int(np.count_nonzero(codes))
            known = np.zeros(len(keys) + 1, bool)
            if len(keys):
                known[1:] = _set(bits[0], slots.at([keys]))
                number = np.flatnonzero(known[1:])
                own = own.decode().split("\n")
                # words have no tab, so lang and word can share a string
                text = np.array([f"{lang.encode().hex()}\t{own[i]}" for i in number.tolist()] + [None], object)[:-1]
                held.setdefault(1, []).append(((keys[number], np.bincount(codes, minlength=len(known))[1:][number]), text))
                total += len(number)
            there = known[codes]
            for size in range(2, longest + 1):
                there = there[:-1] & there[1:]
                at = np.flatnonzero(there)
                if not len(at):
                    break
                at, n = _unique_rows(codes, at, size)
                parts = [keys[codes[at + i] - 1] for i in range(size)]
                kept = _set(bits[size - 1], slots.at(parts))
                at, n, parts = at[kept], n[kept], [p[kept] for p in parts]
                held.setdefault(size, []).append(((*parts, n), None))
                total += len(n)
                if size < longest:
                    there = np.zeros(len(there), bool)
                    every = np.flatnonzero(known[codes[: len(there)]])
                    every = every[np.all([known[codes[every + i]] for i in range(size)], axis=0)]
                    there[every] = _set(bits[size - 1], slots.at([keys[codes[every + i] - 1] for i in range(size)]))
            if total > flush:
                # what a task counts more than once stays here; it goes on only where it would not fit
                if merge() > flush:
                    yield from drain()
                total = 0
        merge()
        yield from drain()
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks
        langs = list(words_of)
        yield rows(0, [], np.array(list(words_of.values()), np.int64), [x.encode().hex() for x in langs])

    schema = f"size int, lang string, word string, {', '.join(f'{w} long' for w in names)}, n long"
    return blocks.select("lang", "words", "codes").coalesce(tasks).mapInArrow(count, schema)


def phrase_counts(
    docs: DataFrame, longest: int = 3, min_count: int = 10, shards: int = 2, slots: int = 1 << 24, block: int = 1 << 20, flush: int = 1 << 20
) -> tuple[list[DataFrame], DataFrame]:
    """Exact counts of the phrases that reach ``min_count``, for every length, by dynamic itemset counting.

    The texts are dealt to ``shards`` and scanned shard by shard, again and again. Words are counted from the first
    shard on; a longer phrase begins at the shard after both its parts (without the last, without the first word)
    reached ``min_count``, and is counted for one full cycle. So lengths interleave: phrases of three words begin
    while some of two are still being counted. Scans end when nothing is being counted any more.

    Counters are kept by hash, in buckets whose number follows the input (a bucket's number and four more bytes of
    the hash; a task sends each hash once per ``flush`` of them); what reached ``min_count`` there is
    counted once more by whole word keys, so hashes that meet only cost time. A table of ``slots`` says from which step
    a phrase counts as frequent; it and nothing else is broadcast and collected, whatever the input.

    Returns, per length, (w1.., n) - for single words also (lang, word) - and (lang, n): all occurrences of words.
    """
    if not 1 <= min_count <= 255:
        raise ValueError("counters hold up to 255")
    spark = docs.sparkSession
    blocks = _write_blocks(docs, shards, block)
    total = blocks.agg(F.sum("size")).first()[0] or 0
    buckets = min(max(8, total >> 25), slots // 64)  # some four million words each
    where = Slots(buckets, slots)
    acts = [np.full(where.per * buckets, _NEVER, np.uint8) for _ in range(longest)]
    sent: list[DataFrame] = []
    last = [shards - 1] + [-1] * (longest - 1)  # the last step at which a length is still counted
    step = 0
    while step <= max(last):
        now = spark.sparkContext.broadcast([a.tobytes() for a in acts[:-1]])
        sent.append(cut_lineage(_count_step(blocks, now, where, step, shards, flush), f"counts{step}"))
        both = sent[-1]
        for earlier in sent[max(0, step - shards + 1) : -1]:
            both = both.union(earlier)
        grown = set()
        for r in _reached(both.where(F.col("start") > step - shards), where, min_count).toLocalIterator():
            own = acts[r.size - 1][r.bucket * where.per : (r.bucket + 1) * where.per]
            new = np.unpackbits(np.frombuffer(r.bits, np.uint8)).view(bool) & (own == _NEVER)
            if new.any():
                own[new] = step + 1
                grown.add(r.size)
        for size in range(1, longest):
            if size in grown:
                last[size] = max(last[size], step + shards)
            if size > 1 and last[size] >= 0:
                # a phrase that shares the slot of an earlier one counts as frequent a step after it began
                last[size] = max(last[size], last[size - 1] + 1)
        now.destroy()
        step += 1
    found = spark.sparkContext.broadcast([np.packbits(a != _NEVER).tobytes() for a in acts])
    # tasks of some 128 MB of text: the larger, the fewer rows have the same phrase
    tasks = max(2 * spark.sparkContext.defaultParallelism, total >> 27)
    counted = _exact(blocks, found, where, longest, flush, tasks)
    keys = [f"w{i + 1}" for i in range(longest)]
    # texts are grouping keys, never aggregates, so the counts stay in hash maps
    added = counted.groupBy("size", "lang", "word", *keys).agg(F.sum("n").alias("n"))
    added = cut_lineage(added.where((F.col("size") == 0) | (F.col("n") >= min_count)), "phrases")
    lang = F.decode(F.unhex("lang"), "UTF-8").alias("lang")
    out = [added.where("size = 1").select("w1", lang, "word", "n")]
    out += [added.where(F.col("size") == k).select(*keys[:k], "n") for k in range(2, longest + 1)]
    return out, added.where("size = 0").select(lang, "n")


def _score(a: str, left: str, right: str, scale: int) -> Column:
    """floor(scale * a * a / (left * right)), exactly: decimals of 38 digits; counts may have 15, scale 7."""
    a, left, right = (f"CAST({x} AS DECIMAL(15,0))" for x in (a, left, right))
    return F.expr(f"({a} * {a} * CAST({scale} AS DECIMAL(7,0))) div ({left} * {right})")


def _cut(phrases: DataFrame, counts: list[DataFrame], length: int, scale: int) -> DataFrame:
    """(lang, phrase, n, l, r, score) of the cut with the lowest score, the first of equal ones.

    Single words are joined once each, for their counts and their texts.
    """
    keys = [f"w{i + 1}" for i in range(length)]
    out, cuts = phrases, []
    for i, key in enumerate(keys):
        own = [F.col("w1").alias(key), F.col("word").alias(f"t{i}"), F.col("n").alias(f"n{i}_{i + 1}"), *(["lang"] if i == 0 else [])]
        out = out.join(counts[0].select(*own), key)
    for size in range(2, length):
        for i in (0, length - size):
            own = [F.col(f"w{j + 1}").alias(keys[i + j]) for j in range(size)]
            out = out.join(counts[size - 1].select(*own, F.col("n").alias(f"n{i}_{i + size}")), keys[i : i + size])
    for k in range(1, length):
        left, right = f"n0_{k}", f"n{k}_{length}"
        cuts.append(F.struct(_score("n", left, right, scale).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")))
    best = F.least(*cuts) if len(cuts) > 1 else cuts[0]
    phrase = F.concat_ws(" ", *[f"t{i}" for i in range(length)])
    return out.select("lang", phrase.alias("phrase"), F.col("n").alias("a"), best.alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def collocations(
    docs: DataFrame, longest: int = 3, min_count: int = 10, contained_percent: int = 50, top: int | None = 2000,
    scale: int = 1_000_000, shards: int = 2, slots: int = 1 << 24,
) -> DataFrame:
    """Phrases of 2 to ``longest`` words whose parts attract each other, by lang.

    Texts are lower-cased (A-Z), split into pieces at ``. , ; : ! ?`` and line ends, pieces into words at blanks and
    tabs. Phrases of ``min_count`` occurrences or more within pieces are candidates (``phrase_counts``). A candidate
    is cut where ``scale * a * a / (l * r)`` is lowest, with a, l, r the occurrences of it and its two parts; the
    first of equal cuts counts. A candidate goes when its words lie in a longer candidate that has at least
    ``contained_percent`` of its occurrences.

    Returns lang, rank (long, from 1), phrase, a, l, r, n (all words of the lang) and score, the first ``top`` of each
    lang (None: all) by score and a, descending, then phrase in the order of its UTF-8 bytes.

    A null lang is ``und``; null and empty texts hold no words; repeated rows and ids count as often as they stand
    there; other columns are not read, so none can clash. An empty table gives no rows. Words are told apart by
    64-bit hashes together with their lang.
    """
    if not 2 <= longest <= 5:
        raise ValueError("phrases may have 2 to 5 words")
    counts, n = phrase_counts(docs, longest, min_count, shards, slots)
    named = None
    for length in range(2, longest + 1):
        keys = [f"w{i + 1}" for i in range(length)]
        own = counts[length - 1]
        covers = []
        for longer in range(length + 1, longest + 1):
            names = [f"w{i + 1}" for i in range(longer)]
            for at in range(longer - length + 1):
                inner = [F.col(c).alias(w) for c, w in zip(names[at : at + length], keys)]
                covers.append(counts[longer - 1].select(*inner, F.col("n").alias("most")))
        if covers:
            most = covers[0]
            for c in covers[1:]:
                most = most.unionByName(c)
            most = most.groupBy(*keys).agg(F.max("most").alias("most"))
            share = F.expr(f"CAST(most AS DECIMAL(20,0)) * 100 >= CAST(n AS DECIMAL(20,0)) * {int(contained_percent)}")
            own = own.join(most, keys, "left").where(~F.coalesce(share, F.lit(False))).drop("most")
        part = _cut(own, counts, length, scale)
        named = part if named is None else named.unionByName(part)
    # the limit per lang is applied in every task before rows of a lang meet
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.col("phrase"))
    ranked = named.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    out = ranked.join(n, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations_sql(source: str = "documents", min_count: int = 10, top: int = 2000) -> str:
    """The same rows in DuckDB's SQL, for phrases of two and three words."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, regexp_extract_all(part, '[^ \t]+') AS w
  FROM (SELECT lang, unnest(string_split_regex(translate(text, '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS part
        FROM {source} WHERE text IS NOT NULL)
), spots AS (SELECT lang, piece, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
uni AS (SELECT lang, w[i] AS p, count(*) AS f FROM spots GROUP BY ALL),
bi AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM spots WHERE i < len(w) GROUP BY ALL),
tri AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM spots WHERE i + 1 < len(w) GROUP BY ALL HAVING count(*) >= {min_count}),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM uni GROUP BY lang),
cuts AS (
  SELECT b.lang, b.x || ' ' || b.y AS phrase, b.f AS a, u.f AS l, v.f AS r, 1 AS k
  FROM bi b JOIN uni u ON b.lang = u.lang AND b.x = u.p JOIN uni v ON b.lang = v.lang AND b.y = v.p
  WHERE b.f >= {min_count} AND NOT EXISTS (
    SELECT 1 FROM tri t WHERE t.lang = b.lang AND t.x = b.x AND t.y = b.y AND 2 * t.f >= b.f)
    AND NOT EXISTS (SELECT 1 FROM tri t WHERE t.lang = b.lang AND t.y = b.x AND t.z = b.y AND 2 * t.f >= b.f)
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, u.f, b.f, 1
  FROM tri t JOIN uni u ON t.lang = u.lang AND t.x = u.p JOIN bi b ON t.lang = b.lang AND t.y = b.x AND t.z = b.y
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, b.f, u.f, 2
  FROM tri t JOIN uni u ON t.lang = u.lang AND t.z = u.p JOIN bi b ON t.lang = b.lang AND t.x = b.x AND t.y = b.y
), scored AS (
  SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
)
SELECT r.lang, r.rank::BIGINT AS rank, r.phrase, r.a::BIGINT AS a, r.l::BIGINT AS l, r.r::BIGINT AS r, t.n, r.score
FROM ranked r JOIN total t USING (lang) WHERE r.rank <= {top}"""
