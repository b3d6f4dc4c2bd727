"""N-gram Jaccard join by T-occurrence search (DivideSkip) over inverted lists."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocks import SENT_SCHEMA, Codec, answers, bucket_bits, map_blocks, with_replies, write_blocks
from .components import components
from .words import SPACE, Words, words

ROW_SCHEMA = "doc_id long, n_shingles long, sig long, n_tokens int, tokens binary"
_TOKEN_BITS = 48  # of a shingle's hash, within one search
_DIVIDE = 0.0085  # DivideSkip's weight of the longest list


def _shingle_sets(w: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, an empty one none."""
    left = w.left()
    at = np.flatnonzero(left >= size)
    hashes = w.windows(at, size)
    bounds = np.searchsorted(at, w.first)
    out = []
    for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
        n = int(w.first[i + 1] - w.first[i])
        if 0 < n < size:
            out.append(w.windows(w.first[i : i + 1], n))
        else:
            out.append(np.unique(hashes[a:b]))
    return out


def _signature(keys: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(keys.tobytes(), digest_size=8).digest(), "little", signed=True)


def _needed(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any partner: 100 * overlap >= percent * union >= percent * n."""
    return -(-percent * n // 100)


def _pack(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(body: bytes) -> np.ndarray:
    wide = np.zeros((len(body) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(body, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view(np.uint64)


class Forest:
    """Union-find whose roots are the first members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def search(index: list, queries: list | None, percent: int) -> Iterator[tuple[int, int]]:
    """Links between sets (key, size, tokens): T-occurrence search of each query in the index.

    A query's inverted lists are ordered by length. The longest are set aside, as many as DivideSkip's
    balance allows; the others are merged, and a set met often enough there to still reach the
    required overlap is looked up in the set-aside lists by binary search. Without ``queries`` each
    set of the index looks among the ones before it. Sets already tied together are not compared
    again: the links given connect all sets that are similar, through others if not directly.
    """
    own = queries is None
    asked = index if own else queries
    sizes = np.array([n for _, n, _ in index], np.int64)
    if not len(sizes) or not asked:
        return
    token = np.concatenate([t for _, _, t in index])
    member = np.repeat(np.arange(len(index), dtype=np.int32), [len(t) for _, _, t in index])
    order = np.argsort(token, kind="stable")  # members stay in order within a list
    token, member = token[order], member[order]
    names, starts = np.unique(token, return_index=True)
    ends = np.append(starts[1:], len(token))
    forest = Forest(len(index) + (0 if own else len(asked)))
    base = 0 if own else len(index)
    for q, (key, n, tokens) in enumerate(asked):
        at = np.searchsorted(names, tokens)
        at[at == len(names)] = 0
        at = at[names[at] == tokens]
        at = at[(ends - starts)[at] > (1 if own else 0)]
        need = _needed(n, percent)
        if len(at) < need:
            continue
        length = (ends - starts)[at]
        at = at[np.argsort(length, kind="stable")]
        longest = int(length.max())
        aside = min(need - 1, int(need / (_DIVIDE * np.log2(longest + 1) + 1)))
        short, long = at[: len(at) - aside], at[len(at) - aside :]
        # a stable sort merges the runs, each already in order
        merged = np.sort(np.concatenate([member[starts[i] : ends[i]] for i in short]), kind="stable")
        edge = np.concatenate([[0], np.flatnonzero(merged[1:] != merged[:-1]) + 1])
        found, often = merged[edge], np.diff(np.append(edge, len(merged)))
        keep = often >= need - aside
        if own:
            keep &= found < q
        found, often = found[keep], often[keep]
        fits = (100 * sizes[found] >= percent * n) & (100 * n >= percent * sizes[found])
        found, often = found[fits], often[fits]
        # first the likeliest set of each tree: one link settles all sets tied to it; then the others at once
        for likeliest in (True, False):
            mine = forest.root(base + q)
            other = np.array([forest.root(int(i)) for i in found], np.int64)
            found, often, other = (x[other != mine] for x in (found, often, other))
            if not len(found):
                break
            pick = np.arange(len(found))
            if likeliest:
                by = np.lexsort((-often, other))
                pick = by[np.concatenate([[True], other[by][1:] != other[by][:-1]])]
            sets, overlap = found[pick], often[pick].astype(np.int64)
            for i in long:
                run = member[starts[i] : ends[i]]
                spot = np.minimum(np.searchsorted(run, sets), len(run) - 1)
                overlap += run[spot] == sets
            linked = 100 * overlap >= percent * (n + sizes[sets] - overlap)
            for i in sets[linked].tolist():
                if forest.join(i, base + q):
                    yield int(key), int(index[i][0])


def _sets(rows: pa.Table) -> list:
    rows = rows.to_pylist()
    out = [(r["sig"], r["n_shingles"], np.sort(_unpack(r["tokens"]))) for r in rows]
    return sorted(out, key=lambda s: (s[1], s[0]))


def _links_table(links) -> pa.Table:
    links = list(links)
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _candidates(rows: DataFrame, bits: int, percent: int) -> DataFrame:
    """Edges (a, b) that tie together all sets sharing a token among their rarest.

    Two sets with the required overlap share one of the ``size - needed + 1`` rarest tokens of each,
    in an order common to all. Such tokens go to buckets; a bucket chains the sets of one token by
    size, as long as neighbours are near enough in size, so a list gives fewer edges than entries.
    """

    def send(batches):
        for batch in batches:
            token, sig, size = [], [], []
            for r in batch.to_pylist():
                tokens = _unpack(r["tokens"])
                rare = tokens[: max(0, len(tokens) - _needed(r["n_shingles"], percent) + 1)]
                token.append(rare)
                sig.append(np.full(len(rare), r["sig"], np.int64))
                size.append(np.full(len(rare), r["n_shingles"], np.int32))
            if not token:
                continue
            token, sig, size = map(np.concatenate, (token, sig, size))
            order = np.argsort(token)
            token, sig, size = token[order], sig[order], size[order]
            bucket = (token >> np.uint64(_TOKEN_BITS - bits)).astype(np.int32)
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(token)]
            parts = [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(bucket[a]) for a, _ in parts], pa.int32()),
                    pa.array([_pack(token[a:b]) for a, b in parts], pa.binary()),
                    pa.array([sig[a:b].tobytes() for a, b in parts], pa.binary()),
                    pa.array([size[a:b].tobytes() for a, b in parts], pa.binary()),
                ],
                names=["bucket", "token", "sig", "size"],
            )

    def chain(table: pa.Table) -> pa.Table:
        join = lambda name: b"".join(table.column(name).to_pylist())
        token, sig, size = _unpack(join("token")), np.frombuffer(join("sig"), np.int64), np.frombuffer(join("size"), np.int32)
        order = np.lexsort((sig, size, token))
        token, sig, size = token[order], sig[order], size[order].astype(np.int64)
        near = (token[1:] == token[:-1]) & (sig[1:] != sig[:-1]) & (100 * size[:-1] >= percent * size[1:])
        pairs = np.stack([sig[:-1][near], sig[1:][near]], axis=1)
        pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    sent = rows.select("sig", "n_shingles", "tokens").mapInArrow(send, "bucket int, token binary, sig binary, size binary")
    return sent.groupBy("bucket").applyInArrow(chain, "a long, b long").distinct()


def _large_groups(sets: DataFrame, sizes: DataFrame, percent: int, at_most: int) -> DataFrame:
    """Links inside candidate groups too large for one task.

    Every set of such a group is compared with the group's first; those similar to it are settled, as
    they hang together through it. The others meet all sets of their group, block by block: a task
    holds two blocks of at most about ``at_most`` sets.
    """
    blocks = F.ceil(F.col("n_sets") / at_most).cast("int")
    big = sets.join(sizes.select("group", "n_sets", "pivot"), "group")
    big = big.withColumn("of", blocks).withColumn("part", F.pmod(F.xxhash64("sig"), F.col("of")).cast("int"))
    big = cut_lineage(big, "large-groups")
    # one row per group, repeated for each of its blocks
    pivots = big.where("sig = pivot").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    cols = ["group", "part", "sig", "n_shingles", "tokens"]
    pivots = pivots.select(*[F.col(c).alias(c) for c in cols])

    def to_pivot(members: pa.Table, pivot: pa.Table) -> pa.Table:
        one = _sets(pivot)
        near = [
            (s[0], one[0][0])
            for s in _sets(members)
            if s[0] != one[0][0]
            and 100 * (o := np.intersect1d(s[2], one[0][2], assume_unique=True).size) >= percent * (s[1] + one[0][1] - o)
        ]
        return _links_table(near)

    key = ["group", "part"]
    settled = cut_lineage(
        big.select(*cols).groupBy(*key).cogroup(pivots.groupBy(*key)).applyInArrow(to_pivot, "a long, b long"), "pivots"
    )
    open_ = big.where("sig <> pivot").join(settled.select(F.col("a").alias("sig")), "sig", "left_anti")
    n_open = open_.groupBy("group").agg(F.ceil(F.count("*") / at_most).cast("int").alias("open_parts"))
    asked = open_.join(n_open, "group").withColumn("open_part", F.pmod(F.xxhash64("sig", F.lit(1)), F.col("open_parts")).cast("int"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    index = big.join(n_open, "group").withColumn("open_part", F.explode(F.sequence(F.lit(0), F.col("open_parts") - 1)))
    cols, key = [*cols, "open_part"], ["group", "part", "open_part"]

    def meet(members: pa.Table, few: pa.Table) -> pa.Table:
        queries = _sets(few)
        return _links_table((a, b) for a, b in search(_sets(members), queries, percent) if a != b)

    asked = asked.select(*[F.col(c).alias(c) for c in cols])  # columns of its own, as both come from one table
    met = index.select(*cols).groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(meet, "a long, b long")
    return settled.unionByName(met)


def ngram_join(
    docs: DataFrame, size: int = 5, percent: int = 75, group_sets: int = 500, block_sets: int = 1000, task_tokens: int = 1 << 20
) -> DataFrame:
    """Documents whose sets of ``size``-word shingles have a Jaccard similarity of ``percent`` % or more.

    Words are runs without ASCII white space, A-Z lower-cased, of the whole text. A text of fewer
    words is one shingle; one without words, or null, has none and links with nothing. Two documents
    link when ``100 * |intersection| >= percent * |union|``. Documents with equal sets are one class and
    are compared once.

    1. Shingle counts over all documents tell rare from common. A shingle of one document cannot
       be shared: a document with too many of those has no partner and is done.
    2. Sets sharing one of their rarest shingles form candidate groups.
    3. Within a group, T-occurrence search by DivideSkip finds the links (``search``).

    Groups are packed so that a task holds about ``task_tokens`` shingles; a group of over
    ``group_sets`` sets is first compared with one of its sets, and only those not similar to it are searched,
    in blocks of ``block_sets``. Sets are named by a 64-bit hash and compared
    through 48-bit shingle hashes.

    Returns one row per row of ``docs``: doc_id, n_shingles, component_id (least doc_id reachable by
    links, itself included), sig (class of equal sets). Links of every similar pair of classes
    are honoured; copies are not expanded. Rows with equal ids stay apart as rows; null ids are never
    the least. Other columns are ignored.
    """
    blocks = write_blocks(docs, lambda texts: len(words(texts).hash))
    bits = min(24, bucket_bits(blocks))
    codec = Codec(bits, 3)

    def of(texts):
        sets = _shingle_sets(words(texts, SPACE, lower=True), size)
        sigs = [_signature(s) if len(s) else None for s in sets]
        first = {s: i for i, s in reversed(list(enumerate(sigs)))}
        return sets, sigs, [s is not None and first[s] == i for i, s in enumerate(sigs)]

    def send(block, _, texts):
        sets, _, first = of(texts)
        keys = [s for s, new in zip(sets, first) if new]
        return codec.send(block, codec.short(np.concatenate(keys) if keys else np.zeros(0, np.uint64)), with_counts=True)

    counted = cut_lineage(answers(map_blocks(blocks, send, SENT_SCHEMA), codec, 0, as_class=True), "counts")

    def rows(_, ids, texts, got):
        sets, sigs, first = of(texts)
        keys = [s for s, new in zip(sets, first) if new]
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        classes = got.values(codec, 0, codec.short(flat), as_class=True)
        at, tokens = 0, []
        for s, new in zip(sets, first):
            body = None
            if new:
                c = classes[at : at + len(s)]
                at += len(s)
                shared = c > 0
                if np.count_nonzero(shared) >= _needed(len(s), percent):
                    short = s[shared] >> np.uint64(64 - _TOKEN_BITS)
                    body = _pack(short[np.lexsort((short, c[shared]))])
            tokens.append(body)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(sigs, pa.int64()),
                pa.array([None if t is None else len(t) // 6 for t in tokens], pa.int32()),
                pa.array(tokens, pa.binary()),
            ],
            names=["doc_id", "n_shingles", "sig", "n_tokens", "tokens"],
        )

    found = cut_lineage(with_replies(blocks, counted, rows, ROW_SCHEMA), "sets")
    sets = found.where("tokens is not null").select("sig", "n_shingles", "n_tokens", "tokens")
    groups = components(cut_lineage(_candidates(sets, bits, percent), "candidates"))
    groups = groups.select(F.col("node").alias("sig"), F.col("label").alias("group"))
    # copies in several blocks bring the same set; one is enough, chosen before the shuffle and after it
    sets = sets.groupBy("sig").agg(*[F.first(c).alias(c) for c in ("n_shingles", "n_tokens", "tokens")]).join(groups, "sig")
    sets = cut_lineage(sets, "grouped-sets")
    sizes = sets.groupBy("group").agg(F.count("*").alias("n_sets"), F.min("sig").alias("pivot"))
    large = cut_lineage(sizes.where(F.col("n_sets") > group_sets), "large-sizes")
    total = sets.agg(F.sum("n_tokens")).first()[0] or 0
    packs = max(1, -(-total // task_tokens)) * 4

    def within(table: pa.Table) -> pa.Table:
        return _links_table(search(_sets(table), None, percent))

    small = sets.join(large.select("group"), "group", "left_anti")
    small = small.withColumn("pack", F.pmod(F.xxhash64("group"), F.lit(packs)))
    # a set number of partitions, as run time depends on more than bytes
    links = small.repartition(packs, "pack").groupBy("pack").applyInArrow(within, "a long, b long")
    if not large.isEmpty():
        links = links.unionByName(_large_groups(sets, large, percent, block_sets))
    labels = components(cut_lineage(links, "links")).withColumnRenamed("node", "sig")
    classes = found.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"))
    classes = classes.join(labels, "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    least = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = classes.select("sig", "label").join(least, "label").select("sig", "component_id")
    return found.select("doc_id", "n_shingles", "sig").join(of_class, "sig", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "sig"
    )
