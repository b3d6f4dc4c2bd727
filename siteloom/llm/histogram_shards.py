"""Sharding by histogram sort: exact counts below candidate boundaries, then one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .carry import carried

_LEAST, _MOST = -(2**63), 2**63 - 1


def _size() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1


def _text_key() -> Column:
    """Equal texts have equal keys; a null text is not an empty one."""
    return F.xxhash64("text", F.col("text").isNull())


def _histogram(keys: DataFrame, probes: list[int]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows below each of the sorted ``probes``."""
    below = F.size(F.filter(F.lit(probes).cast("array<bigint>"), lambda p: p <= F.col("key")))
    got = {r[0]: (r[1], r[2]) for r in keys.groupBy(below.alias("b")).agg(F.sum("size"), F.count("*")).collect()}
    sizes, rows, out = 0, 0, ([], [])
    for i in range(len(probes)):
        s, r = got.get(i, (0, 0))
        sizes, rows = sizes + s, rows + r
        out[0].append(sizes)
        out[1].append(rows)
    return out


def _spread(lo: int, hi: int, n: int) -> list[int]:
    return sorted({lo + (hi - lo) * i // (n + 1) for i in range(1, n + 1)} - {lo, hi})


def split_keys(keys: DataFrame, targets: list[int], tolerance: float, probes: int = 16) -> list[int]:
    """Boundaries so that the bytes of keys below the j-th come within ``tolerance`` of ``targets[j]``.

    Each round counts the exact bytes below a few probes inside the bracket of every open boundary
    and narrows the bracket around its target, until a probe is near enough or the bracket holds
    one key; then its nearer end is taken. Probes and counts are ``len(targets) * probes`` numbers.
    """
    sizes, rows = _histogram(keys, [_LEAST, _MOST])
    total, n_rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    known = {_LEAST: (0, 0), _MOST: (sizes[1], rows[1])}
    brackets = [(_LEAST, _MOST)] * len(targets)
    found: list[int | None] = [None] * len(targets)
    while True:
        for j, goal in enumerate(targets):
            if found[j] is None:
                lo = max((p for p in known if known[p][0] <= goal), key=lambda p: (known[p][0], p))
                hi = min((p for p in known if known[p][0] > goal and p > lo), default=_MOST)
                near = min((lo, hi), key=lambda p: abs(known[p][0] - goal))
                done = hi - lo <= 1 or known[hi][1] - known[lo][1] <= 1
                brackets[j] = (lo, hi)
                if done or abs(known[near][0] - goal) <= tolerance:
                    found[j] = near
        if None not in found:
            return found
        asked = sorted({p for j, f in enumerate(found) if f is None for p in _spread(*brackets[j], probes)} - set(known))
        if not asked:
            found = [min(b, key=lambda p: abs(known[p][0] - t)) if f is None else f for f, b, t in zip(found, brackets, targets)]
            return found
        sizes, rows = _histogram(keys, asked)
        known |= {p: (s, r) for p, s, r in zip(asked, sizes, rows)}


def _levels(heavy: list[int], light: int) -> list[int]:
    """How many of the ``light`` bytes each shard gets so that all come to one level where possible."""
    order = sorted(range(len(heavy)), key=lambda j: heavy[j])
    for n in range(len(order), 0, -1):
        level = (light + sum(heavy[j] for j in order[:n])) / n
        if level >= heavy[order[n - 1]]:
            return [max(0, round(level - heavy[j])) if j in order[:n] else 0 for j in range(len(heavy))]
    return [0] * len(heavy)


def histogram_shards(docs: DataFrame, shards: int = 8, tolerance: float = 0.001, heavy: float = 0.01) -> DataFrame:
    """Deal whole documents into ``shards`` of nearly equal bytes, equal texts together.

    A document weighs the UTF-8 bytes of its text (null: none) plus one. The sort key is a hash of
    the text. Groups of equal texts above ``heavy`` of a shard's share, at most ``shards / heavy`` of
    them, are placed first, each in the emptiest shard; a group above a whole share is keyed by
    document instead, so it is spread. The boundaries for the rest come from ``split_keys`` over a
    narrow written table. Then every document moves once, straight to its shard's part of the key range;
    heavy groups are salted by document. A shard has several partitions, and positions follow from
    the partitions' counts, so no task holds a shard.

    Returns all columns of ``docs`` plus size (long), shard (int), slot (long, gapless from 0 in each
    shard, in order of partition, key and doc_id) and spread (boolean: the row's group of equal texts is larger
    than a shard, so it stands in several); columns of these names in ``docs`` are replaced. Null
    ids and repeated rows are kept like others. An empty table gives an empty one.
    """
    return carried(docs, ("size", "shard", "slot", "spread"), lambda rows: _deal(rows, shards, tolerance, heavy))


def _deal(docs: DataFrame, shards: int, tolerance: float, heavy: float) -> DataFrame:
    keys = cut_lineage(docs.select(_text_key().alias("text_key"), F.col("doc_id").cast("long").alias("doc_id"), _size().alias("size")), "keys")
    share = (keys.agg(F.sum("size")).first()[0] or 0) / shards
    groups = keys.groupBy("text_key").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    # at most shards / heavy rows
    large = groups.where(F.col("size") > heavy * share).collect() if share else []
    giants = [r.text_key for r in large if r.size > share and r.n > 1]
    placed, load = {}, [0] * shards
    for r in sorted(large, key=lambda r: (-r.size, r.text_key)):
        if r.text_key not in giants:
            j = min(range(shards), key=lambda j: (load[j], j))
            placed[r.text_key] = j
            load[j] += r.size

    def key(text_key: Column) -> Column:
        if not giants:
            return text_key
        return F.when(text_key.isin(giants), F.xxhash64(text_key, F.col("doc_id").cast("long"))).otherwise(text_key)

    light = keys.where(~F.col("text_key").isin(list(placed))) if placed else keys
    light = light.select(key(F.col("text_key")).alias("key"), "size")
    room = _levels(load, round(share * shards) - sum(load))
    targets = [sum(room[: j + 1]) for j in range(shards - 1)]
    cuts = split_keys(light, targets, tolerance * share) if share else []
    cuts = [max(cuts[: j + 1]) for j in range(len(cuts))]
    per_shard = max(1, -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards))

    moved = docs.withColumns({"_text_key": _text_key(), "size": _size()}).withColumn("_key", key(F.col("_text_key")))
    moved = moved.withColumn("_spread", F.col("_text_key").isin(giants) if giants else F.lit(False))
    own_shard = F.coalesce(F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c <= F.col("_key"))), F.lit(0)) if cuts else F.lit(0)
    edges = F.lit([_LEAST, *cuts, _MOST]).cast("array<bigint>")
    if placed:
        table = docs.sparkSession.createDataFrame(sorted(placed.items()), "_text_key long, _at int")
        moved = moved.join(F.broadcast(table), "_text_key", "left")  # at most shards / heavy rows
    else:
        moved = moved.withColumn("_at", F.lit(None).cast("int"))
    moved = moved.withColumn("shard", F.coalesce("_at", own_shard).cast("int"))
    # a shard's key range in equal steps, as the keys are hashes; heavy groups by document
    low, high = (F.element_at(edges, F.col("shard") + i).cast("double") for i in (1, 2))
    step = F.floor((F.col("_key").cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * per_shard)
    step = F.least(F.greatest(step, F.lit(0)), F.lit(per_shard - 1))
    spread = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(7)), F.lit(per_shard))
    part = F.col("shard") * per_shard + F.when(F.col("_at").isNull(), step).otherwise(spread).cast("int")
    moved = moved.withColumn("_part", part.cast("int")).drop("_at", "_text_key")
    dealt = moved.repartitionById(shards * per_shard, "_part").sortWithinPartitions("_part", "_key", "doc_id")
    dealt = cut_lineage(dealt.withColumn("_pos", F.monotonically_increasing_id()), "dealt")
    runs = dealt.groupBy("_part").agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    earlier = W.partitionBy(F.floor(F.col("_part") / per_shard)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    slot = (F.col("_pos") - F.col("_first") + F.col("_before")).cast("long")
    spread = F.col("_spread")
    return dealt.join(F.broadcast(runs), "_part").select("row", "text", "size", "shard", slot.alias("slot"), spread.alias("spread"))  # a row per partition
