"""Stored keys of an incremental job as bucketed runs with a Bloom sketch, so that a batch reads what may hold its keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import pick

_PROBES = 4
_BITS_PER_KEY = 16  # with four probes about one absent key in four hundred is looked for in vain


class KeyRuns:
    """Keys, and optionally their current values, of all batches so far.

    Every batch adds one run: its rows in hash buckets of about ``capacity`` keys, and per bucket a Bloom sketch, kept
    as one row per 64 bits and built with ``bit_or``. Each ``fan`` runs of a level are merged into one of the next, the latest
    row of a key staying, so before batch n there are at most ``(fan - 1) * log(n)`` of them. A run's number of buckets
    follows its own size (up to ``max_buckets``). A lookup reads the sketch rows of the buckets its keys fall into, and
    then the key files of those buckets whose sketch has all bits of a key: its cost follows the batch, not
    the store. Merging costs each key a rewrite per level.

    A run's place follows from the batch number alone and a batch reads only runs of earlier ones, so a
    repeated batch overwrites what it wrote and sees what it saw. ``opened`` lists the files of the last lookup.
    """

    def __init__(
        self, spark: SparkSession, folder: str, keys: list[str], values: list[str] | None = None, fan: int = 4, capacity: int = 1 << 14,
        max_buckets: int = 4096,
    ):
        self.spark, self.folder, self.keys, self.values = spark, folder.rstrip("/"), keys, values or []
        self.fan, self.capacity, self.max_buckets = fan, capacity, max_buckets
        self.opened: list[str] = []

    def _path(self, level: int, upto: int) -> str:
        return f"{self.folder}/level={level}/upto={upto}"

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _children(self, path: str) -> list[str]:
        fs, target = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []

    def runs(self, before: int) -> list[tuple[int, int]]:
        """(level, last batch) of the runs that hold batches 0 to ``before - 1``, in order."""
        found, at = [], 0
        level = 0
        while self.fan ** (level + 1) <= before:
            level += 1
        for lv in range(level, -1, -1):
            while at + self.fan**lv <= before:
                at += self.fan**lv
                found.append((lv, at - 1))
        return found

    def _hash(self, salt: int = 0) -> Column:
        return F.xxhash64(F.lit(salt), *self.keys)

    def _probes(self) -> Column:
        """Distinct (word, bit) of a key in its bucket's sketch."""
        spots = [F.pmod(self._hash(i + 1), F.lit(self.capacity * _BITS_PER_KEY)) for i in range(_PROBES)]
        return F.array_distinct(F.array(*[F.struct(F.floor(s / 64).cast("int").alias("word"), F.pmod(s, F.lit(64)).cast("int").alias("bit")) for s in spots]))

    def _write(self, level: int, upto: int, rows: DataFrame) -> None:
        path = self._path(level, upto)
        n = rows.count()
        buckets = 1
        while buckets < self.max_buckets and buckets * self.capacity < n:
            buckets *= 2
        fs, target = self._fs(path)
        fs.delete(target, True)
        placed = rows.select(*self.keys, *self.values).withColumn("bucket", F.pmod(self._hash(), F.lit(buckets)).cast("int"))
        # one task and so one file per bucket
        placed.repartition(buckets, "bucket").write.partitionBy("bucket").parquet(f"{path}/buckets={buckets}/keys")
        stored = self._stored(level, upto, buckets, "keys").select(*self.keys, "bucket")
        bits = stored.select("bucket", F.explode(self._probes()).alias("p")).groupBy("bucket", "p.word").agg(
            F.bit_or(F.expr("shiftleft(1L, p.bit)")).alias("bits")
        )
        bits.repartition(buckets, "bucket").sortWithinPartitions("bucket", "word").write.partitionBy("bucket").parquet(f"{path}/buckets={buckets}/bits")

    def _stored(self, level: int, upto: int, buckets: int, part: str) -> DataFrame:
        return self.spark.read.schema(self._schema(part)).parquet(f"{self._path(level, upto)}/buckets={buckets}/{part}")

    def _schema(self, part: str):
        from pyspark.sql import types as T

        extra = [T.StructField("bucket", T.IntegerType())]
        if part == "bits":
            return T.StructType([T.StructField("word", T.IntegerType()), T.StructField("bits", T.LongType()), *extra])
        return T.StructType([*self.schema.fields, *extra])

    def append(self, batch: int, rows: DataFrame) -> None:
        """Add the rows of a batch, one per key, and merge the levels that are full now."""
        self.schema = rows.select(*self.keys, *self.values).schema
        self._write(0, batch, rows)
        level = 1
        while (batch + 1) % self.fan**level == 0:
            step = self.fan ** (level - 1)
            parts = [(level - 1, batch - i * step) for i in range(self.fan)]
            self._write(level, batch, self._latest(parts))
            level += 1

    def _buckets(self, run: tuple[int, int]) -> int:
        names = [n for n in self._children(self._path(*run)) if n.startswith("buckets=")]
        if not names:
            raise ValueError(f"no run for batch {run[1]} in {self.folder}: a store and its checkpoint belong together")
        return int(names[0].split("=")[1])

    def _latest(self, runs: list[tuple[int, int]]) -> DataFrame:
        parts = [self._stored(*r, self._buckets(r), "keys").select(*self.keys, *self.values, F.lit(r[1]).alias("_run")) for r in runs]
        every = reduce(DataFrame.unionByName, parts)
        if not self.values:
            return every.select(*self.keys).distinct()
        return pick(every, self.keys, [-F.col("_run")], self.values)

    def lookup(self, keys: DataFrame, before: int) -> DataFrame | None:
        """Stored rows of ``keys`` (distinct, not null) as of the batches before ``before``; None if there are none."""
        self.schema = getattr(self, "schema", None) or keys.select(*self.keys).schema
        self.opened = []
        runs = self.runs(before)
        if not runs:
            return None
        sizes = {r[1]: self._buckets(r) for r in runs}
        every = F.array(*[F.struct(F.lit(upto).alias("run"), F.pmod(self._hash(), F.lit(n)).cast("int").alias("bucket")) for upto, n in sizes.items()])
        wanted = keys.select(*self.keys, F.explode(every).alias("at")).select(*self.keys, "at.*")
        touched = _by_run(wanted)
        probes = wanted.withColumn("p", self._probes())
        probes = probes.withColumn("of", F.size("p")).withColumn("p", F.explode("p")).select(*self.keys, "run", "bucket", "of", "p.*")
        bits = self._open(runs, sizes, touched, "bits")
        if bits is None:
            return None
        hit = probes.join(bits, ["run", "bucket", "word"]).where(F.expr("(bits & shiftleft(1L, bit)) <> 0"))
        maybe = hit.groupBy(*self.keys, "run", "bucket", "of").agg(F.count("*").alias("n")).where("n = of")
        found = self._open(runs, sizes, _by_run(maybe), "keys")
        if found is None:
            return None
        found = found.select(*self.keys, *self.values, F.col("run").alias("_run")).join(keys.select(*self.keys), self.keys, "left_semi")
        return pick(found, self.keys, [-F.col("_run")], self.values) if self.values else found.select(*self.keys).distinct()

    def _open(self, runs, sizes, wanted: dict[int, list[int]], part: str) -> DataFrame | None:
        parts = []
        for run in runs:
            own = wanted.get(run[1])
            if not own:
                continue
            df = self._stored(*run, sizes[run[1]], part)
            if len(own) < sizes[run[1]]:
                df = df.where(F.col("bucket").isin(own))
            self.opened += [f for f in df.inputFiles() if int(f.split("bucket=")[-1].split("/")[0]) in set(own)]
            parts.append(df.withColumn("run", F.lit(run[1])))
        return reduce(DataFrame.unionByName, parts) if parts else None

    def latest(self, before: int) -> DataFrame:
        """Current row of every key."""
        runs = self.runs(before)
        first = f"{self._path(*runs[0])}/buckets={self._buckets(runs[0])}/keys"
        self.schema = self.spark.read.parquet(first).select(*self.keys, *self.values).schema
        return self._latest(runs)

    def batches(self) -> int:
        """Batches stored so far."""
        ends = [int(n.split("=")[1]) for n in self._children(f"{self.folder}/level=0") if n.startswith("upto=")]
        above = [int(n.split("=")[1]) for lv in self._children(self.folder) for n in self._children(f"{self.folder}/{lv}") if n.startswith("upto=")]
        return 1 + max([*ends, *above], default=-1)

    def vacuum(self, before: int) -> None:
        """Delete runs that were merged into others before batch ``before``; that batch itself may still be repeated."""
        kept = set(self.runs(before))
        for name in self._children(self.folder):
            level = int(name.split("=")[1])
            for own in self._children(f"{self.folder}/{name}"):
                upto = int(own.split("=")[1])
                if upto < before and (level, upto) not in kept:
                    fs, target = self._fs(self._path(level, upto))
                    fs.delete(target, True)


def _by_run(places: DataFrame) -> dict[int, list[int]]:
    """Distinct buckets of each run: at most ``max_buckets`` of a handful of runs."""
    out: dict[int, list[int]] = {}
    for r in places.select("run", "bucket").distinct().collect():
        out.setdefault(r.run, []).append(r.bucket)
    return out
