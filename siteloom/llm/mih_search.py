"""Nearest neighbours by multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RESULT_SCHEMA = "query_id long, vec_id long, score double"
# byte values by distance: _RING[d] holds the masks of at most d bits
_BITS = np.bitwise_count(np.arange(256, dtype=np.uint8))
_RING = [np.flatnonzero(_BITS <= d) for d in range(9)]


@dataclass
class Codes:
    """Centre, rotation and search radius learned from a sample; one bit per rotated dimension."""

    mean: np.ndarray
    rotation: np.ndarray  # dimensions x bits
    radius: int

    def of(self, unit: np.ndarray) -> np.ndarray:
        """Codes of unit vectors, as bytes."""
        return np.packbits((unit - self.mean) @ self.rotation > 0, axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn(sample: np.ndarray, k: int, target: float, rounds: int = 30, asked: int = 200, seed: int = 7) -> Codes:
    """Principal axes, rotated so that signs lose least (iterative quantisation); then the least
    Hamming radius at which ``target`` of the true ``k`` neighbours within the sample are reached."""
    unit = _unit(sample)
    mean = unit.mean(axis=0)
    centred = unit - mean
    bits = max(8, min(unit.shape[1] // 8 * 8, 256))
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    if axes.shape[1] < bits:  # fewer dimensions than a byte
        axes = np.pad(axes, ((0, 0), (0, bits - axes.shape[1])))
    v = centred @ axes
    turn = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.sign(v @ turn).T @ v)
        turn = (left @ right).T
    codes = Codes(mean, axes @ turn, bits)
    all_codes = codes.of(unit)
    far = []
    for q in np.linspace(0, len(unit) - 1, min(asked, len(unit))).astype(int):
        near = unit @ unit[q]
        near[q] = -2
        best = np.argsort(-near)[: min(k, len(unit) - 1)]
        far.append(np.bitwise_count(all_codes[best] ^ all_codes[q]).sum(axis=1))
    reached = np.sort(np.concatenate(far)) if far else np.zeros(0)
    codes.radius = int(reached[min(len(reached) - 1, int(target * len(reached)))]) if len(reached) else bits
    return codes


class Index:
    """One table per byte of the code, from byte value to the rows that hold it."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: Codes):
        self.ids, self.vectors, self.codes = ids, vectors, codes
        self.norms = np.linalg.norm(vectors, axis=1)
        self.code = codes.of(vectors / self.norms[:, None])
        self.rows = [np.argsort(c, kind="stable") for c in self.code.T]
        self.starts = [np.searchsorted(c[r], np.arange(257)) for c, r in zip(self.code.T, self.rows)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row within the radius: one of its bytes differs in at most ``radius // bytes`` bits."""
        n = len(self.rows)
        seen = np.zeros(len(self.ids), bool)
        masks = _RING[min(8, radius // n)]
        for j in range(n):
            values = masks ^ code[j]
            a, b = self.starts[j][values], self.starts[j][values + 1]
            seen[np.concatenate([self.rows[j][x:y] for x, y in zip(a.tolist(), b.tolist())])] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.code[rows] ^ code).sum(axis=1) <= radius]

    def nearest(self, query_id: int, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``k`` by exact cosine among the rows within the radius, which grows until there are k."""
        norm = np.linalg.norm(vector)
        code = self.codes.of(vector[None] / norm)[0]
        bits, radius = 8 * len(code), self.codes.radius
        while True:
            rows = self.within(code, radius)
            rows = rows[self.ids[rows] != query_id]
            if len(rows) >= k or radius >= bits:
                break
            radius = min(bits, radius + len(code))
        score = self.vectors[rows] @ vector / (self.norms[rows] * norm)
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][best], score[best]


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of rows that can be compared; the usual length rules."""
    v = F.col("embedding").cast("array<double>")
    finite: Column = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = vectors.where("vec_id is not null").where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.where(F.exists("v", lambda x: x != 0) & (F.size("v") == (length.n if length else 0)))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = table.column("v").combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return table.column("vec_id").to_numpy(), flat.reshape(table.num_rows, -1)


def nearest(
    vectors: DataFrame, queries: Column, k: int = 5, target: float = 0.97, sample: int = 10000, block: int = 20000, ask: int = 5000
) -> DataFrame:
    """The ``k`` rows of largest cosine for each row of ``vectors`` (vec_id, embedding) where ``queries`` holds.

    Codes are learned from the ``sample`` rows of least id hash, a bound on what reaches the driver,
    and so is the Hamming radius that reaches ``target`` of true neighbours there. All rows are
    indexed, in blocks of about ``block`` rows; every block of index meets every block of about
    ``ask`` queries, retrieves all codes within the radius, ranks them by the cosine of the original
    vectors in double precision, and gives its best ``k``. A block that finds fewer than ``k`` widens the
    radius until it does, so a query always gets ``k``, or all candidates if there are fewer.

    Rows whose vector is null, zero, of unusual length or holds null, NaN or infinity take no part; nor
    do rows without vec_id. A query's candidates are all rows of another vec_id, repeated rows
    included; of repeated query ids the least vector asks. Ties go to the smaller vec_id. Returns
    query_id, rank (from 1), vec_id, score; an empty table gives an empty one.
    """
    rows = _usable(vectors)
    n = rows.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    first = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).select("v").toArrow()
    matrix = first.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(first.num_rows, -1)
    codes = vectors.sparkSession.sparkContext.broadcast(learn(matrix, k, target))
    asked = vectors.where(queries).select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    asked = rows.join(asked, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
    n_blocks, n_asks = max(1, -(-n // block)), max(1, -(-asked.count() // ask))

    def parts(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    asked = asked.select(F.col("vec_id").alias("vec_id"), F.col("v").alias("v"))  # columns of its own, beside the index
    index = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")).withColumn("ask", parts(n_asks))
    asked = asked.withColumn("ask", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_asks)).cast("int")).withColumn("block", parts(n_blocks))

    def meet(members: pa.Table, few: pa.Table) -> pa.Table:
        out: list = [[], [], []]
        if members.num_rows and few.num_rows:
            found = Index(*_matrix(members), codes.value)
            for q, v in zip(*_matrix(few)):
                ids, score = found.nearest(q, v, k)
                for column, values in zip(out, (np.full(len(ids), q), ids, score)):
                    column.append(values)
        names, types = ("query_id", "vec_id", "score"), (pa.int64(), pa.int64(), pa.float64())
        return pa.table({c: pa.array(np.concatenate(x) if x else [], t) for c, x, t in zip(names, out, types)})

    key = ["block", "ask"]
    best = index.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(meet, RESULT_SCHEMA)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
