"""Lookups against keyed tables: tiered, prefix, positional, and safe under hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .ranking import number_rows, pick

_SKETCH_KEYS = 100


def hot_keys(df: DataFrame, on: list[str], share: float = 0.01) -> DataFrame:
    """Hashes of the keys that hold more than ``share`` of the rows; never more than 1/share rows.

    A frequent-items sketch is merged map-side, so finding them costs one narrow scan, no shuffle
    of the data.
    """
    sketch = df.select(F.xxhash64(*on).alias("h")).agg(
        F.expr(f"approx_top_k(h, {_SKETCH_KEYS}, 10000)").alias("top"), F.count(F.lit(1)).alias("total")
    )
    return (
        sketch.select(F.explode("top").alias("t"), "total")
        .where(F.col("t.count") > F.col("total") * share)
        .select(F.col("t.item").alias("_hot"))
    )


def unsent(df: DataFrame) -> DataFrame:
    """A join side that grows with the input and is never broadcast.

    Spark goes by the size of the files, and keys and paths take thirty times that as rows in every task's memory.
    """
    return df.hint("merge")


def skew_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "left", hot: DataFrame | None = None, salts: int = 32
) -> DataFrame:
    """Equi-join of a ``left`` that may have hot keys with a ``right`` that is unique on them.

    Without ``hot`` the plan is a plain join: Spark broadcasts the right side when its measured
    size allows, and splits an oversized partition of the left side at run time otherwise. Where
    heavy keys are certain, pass ``hot`` (see ``hot_keys``): their rows are spread over ``salts``
    sub-keys, and only the matching right rows are repeated.
    """
    if hot is None:
        return left.join(right, on, how)
    hot = F.broadcast(hot)  # at most 1/share rows
    # a hash of the row, not a random number: a re-run task must send a row to the same place
    plain = [c for c, t in left.dtypes if not t.startswith(("map", "array", "struct", "variant"))]
    spread = F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int")
    salted = (
        left.withColumn("_h", F.xxhash64(*on))
        .join(hot, F.col("_h") == F.col("_hot"), "left")
        .withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(spread))
        .drop("_h", "_hot")
    )
    copies = F.when(F.col("_hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(salts - 1)))
    repeated = (
        right.withColumn("_h", F.xxhash64(*on))
        .join(hot, F.col("_h") == F.col("_hot"), "left")
        .withColumn("_salt", F.explode(copies))
        .drop("_h", "_hot")
    )
    return salted.join(unsent(repeated), [*on, "_salt"], how).drop("_salt")


def tiered_lookup(
    left: DataFrame,
    right: DataFrame,
    key: list[str],
    tiers: list[list[str]],
    order: list,
    values: list[str],
    skew: bool = True,
) -> DataFrame:
    """Resolve ``values`` from the first tier that has a match; adds ``match_tier`` (1-based, null if none).

    Each tier lists extra columns that must agree besides ``key``; the last tier is usually empty
    ("any page"). Candidates are reduced to one per tier key before joining, so no pairs of a busy
    key are ever formed. With ``skew`` the heavy keys of ``left`` are found by one scan of its key
    columns per tier: pass a stored table, or switch it off. Neither side is broadcast: both may grow with the input.
    """
    out = left
    for i, extra in enumerate(tiers, start=1):
        on = [*key, *extra]
        best = pick(right.where(F.col(key[0]).isNotNull()), on, order, values)
        best = best.select(*on, F.struct(*values).alias(f"_tier{i}"))
        out = skew_join(out, unsent(best), on, hot=hot_keys(left, on) if skew else None)
    found = F.coalesce(*[F.col(f"_tier{i}") for i in range(1, len(tiers) + 1)])
    tier = F.coalesce(
        *[F.when(F.col(f"_tier{i}").isNotNull(), F.lit(i)) for i in range(1, len(tiers) + 1)]
    )
    return out.select(
        *[F.col(c) for c in left.columns], *[found[v].alias(v) for v in values], tier.alias("match_tier")
    )


def prefix_classify(
    paths: DataFrame, path: str, prefixes: DataFrame, prefix: str, label: str, order: str
) -> DataFrame:
    """Label each path with the first prefix (by ``order``) it lies under; the prefix itself is excluded.

    The theta join 'path starts with prefix/' becomes an equi-join on the proper ancestors of the
    path, one row per level, folded back by path. Each distinct path is classified once.
    """
    lower = F.regexp_replace(F.lower(F.col(path)), r"^/+|/+$", "")
    table = prefixes.select(
        F.regexp_replace(F.lower(F.col(prefix)), r"^/+|/+$", "").alias("_prefix"),
        F.col(order).alias("_ord"),
        F.col(label).alias("_label"),
    )
    table = pick(table, ["_prefix"], ["_ord"], ["_ord", "_label"])
    distinct = paths.select(F.col(path).alias("_path"), lower.alias("_low")).distinct()
    steps = distinct.select("_path", urls.path_prefixes(F.col("_low")).alias("_up"))
    proper = F.slice("_up", F.lit(1), F.greatest(F.size("_up") - 1, F.lit(0)))
    ancestors = steps.select("_path", F.explode(proper).alias("_anc")).withColumn("_anc", F.substr("_anc", F.lit(2)))
    hits = skew_join(ancestors, table.withColumnRenamed("_prefix", "_anc"), ["_anc"], "inner")
    first = hits.groupBy("_path").agg(F.min_by("_label", "_ord").alias(label))
    return skew_join(paths, first.withColumnRenamed("_path", path), [path])


def slug_lookup(
    slugs: DataFrame, slug: str, sitemap: DataFrame, home: str = "/home", prefer: str = "last"
) -> DataFrame:
    """Full path of a leaf slug, case-insensitively; 'home' and unknown slugs stay directly at home.

    ``prefer`` decides between sitemap lines that share a leaf: the last or the first one.
    """
    lines = sitemap.select("seq", "path", F.lower(F.substring_index("path", "/", -1)).alias("_leaf"))
    keyed = lines.select("seq", "path", F.col("_leaf").alias("_key")).unionByName(
        lines.select("seq", "path", F.lower("path").alias("_key"))
    )
    rank = [-F.col("seq")] if prefer == "last" else ["seq"]
    hit = unsent(pick(keyed, ["_key"], rank, ["path"]).withColumnRenamed("path", "_hit"))
    joined = skew_join(slugs.withColumn("_key", F.lower(slug)), hit, ["_key"])
    target = (
        F.when(F.col(slug) == "home", F.lit(home))
        .when(F.col("_hit").isNotNull(), F.concat(F.lit(home + "/"), F.col("_hit")))
        .otherwise(F.concat(F.lit(home + "/"), F.col(slug)))
    )
    return joined.withColumn("target_path", target).drop("_key", "_hit")


def positional_zip(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_order: list,
    right_order: list,
    how: str = "inner",
    bounded: bool = False,
) -> DataFrame:
    """Pair the n-th left row with the n-th right row of each key; surplus follows ``how``.

    ``bounded`` says that a key's rows come from one page, so an ordinary window is enough.
    """
    if bounded:
        from pyspark.sql import Window as W

        def numbered(df, order):
            return df.withColumn("pos", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    else:

        def numbered(df, order):
            return number_rows(df, order, keys, "pos")

    return numbered(left, left_order).join(numbered(right, right_order), [*keys, "pos"], how)


def completed(df: DataFrame, base: str, src: str = "src") -> DataFrame:
    """Make manifest sources absolute."""
    return df.withColumn(src, urls.complete(F.col(base), F.col(src)))


def pair_reference(pages: DataFrame, captured: DataFrame, page: str = "page", slug: str = "slug") -> DataFrame:
    """Pair a page with its capture: dashed full path, last segment, then 'home'.

    ``match_kind`` is path, leaf, fallback_home or none; only the first two are worth scoring.
    """
    bare = F.regexp_replace(F.regexp_replace(F.col(page), r"^/+", ""), r"\.html$", "")
    bare = F.regexp_replace(bare, r"^home/", "")
    bare = F.when(bare == "", "home").otherwise(bare)
    base = pages.withColumn("_dash", F.replace(bare, F.lit("/"), F.lit("-"))).withColumn(
        "_leaf", urls.basename(bare)
    )
    names = captured.select(F.col(slug).alias("_s")).distinct()
    out = skew_join(base, names.select(F.col("_s").alias("_dash"), F.col("_s").alias("_hit1")), ["_dash"])
    out = skew_join(out, names.select(F.col("_s").alias("_leaf"), F.col("_s").alias("_hit2")), ["_leaf"])
    has_home = F.broadcast(names.where("_s = 'home'").agg((F.count(F.lit(1)) > 0).alias("_home")))
    kind = (
        F.when(F.col("_hit1").isNotNull(), "path")
        .when(F.col("_hit2").isNotNull(), "leaf")
        .when(F.col("_home"), "fallback_home")
        .otherwise("none")
    )
    ref = F.coalesce("_hit1", "_hit2", F.when(F.col("_home"), F.lit("home")))
    return out.crossJoin(has_home).select(
        *[F.col(c) for c in pages.columns], ref.alias("reference"), kind.alias("match_kind")
    )
