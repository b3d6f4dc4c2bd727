"""Line-oriented inputs: sitemaps, path lists, label files, crawl logs."""

from __future__ import annotations

import json
import sys
from decimal import Decimal

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules

# Python workers receive the code itself, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, value): file order survives, because the files are ordered by name and read in order.

    ``seq`` grows with the position; it is not dense.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.monotonically_increasing_id().alias("seq"), F.regexp_replace("value", r"\r$", "").alias("value"))


def sitemap(lines: DataFrame, inline_comments: bool = True) -> DataFrame:
    """(seq, path, leaf, section) from (seq, value) lines.

    Either strip everything after '#', or drop only lines that start with it.
    """
    value = F.regexp_replace("value", "#.*", "") if inline_comments else F.col("value")
    rows = lines.select("seq", F.trim(F.regexp_replace(value, r"\s+$|^\s+", "")).alias("path"))
    rows = rows.where(F.length("path") > 0)
    if not inline_comments:
        rows = rows.where(~F.col("path").startswith("#"))
    return rows.select(
        "seq", "path", F.substring_index("path", "/", -1).alias("leaf"), F.split("path", "/")[0].alias("section")
    )


def path_list(lines: DataFrame) -> DataFrame:
    return lines.select("seq", F.trim("value").alias("path")).where(F.col("path") != "")


def section_rollup(site: DataFrame) -> DataFrame:
    """(section, pages, first_seq), 'home' first, then first seen."""
    return (
        site.groupBy("section")
        .agg(F.count(F.lit(1)).alias("pages"), F.min("seq").alias("first_seq"))
        .orderBy((F.col("section") != "home").cast("int"), "first_seq")
    )


def property_labels(lines: DataFrame, lang: str) -> DataFrame:
    """(lang, key, value) from key=value lines with escaped colons."""
    text = F.trim("value")
    key = F.trim(F.substring_index("value", "=", 1))
    return lines.where(~text.startswith("#") & F.contains("value", F.lit("="))).select(
        F.lit(lang).alias("lang"),
        F.replace(key, F.lit("\\:"), F.lit(":")).alias("key"),
        F.trim(F.regexp_replace("value", r"^[^=]*=", "")).alias("value"),
    )


def json_leaves(text: str | None) -> list[tuple[str, str | None]]:
    """(dotted key, value) of every leaf of a nested dictionary, in order; none for anything that is not one.

    Texts are values as they stand; other leaves are JSON. A dictionary that names a key twice is no valid one.
    """

    def unique(pairs):
        own = dict(pairs)
        if len(own) < len(pairs):
            raise ValueError("a key is named twice")
        return own

    def refuse(name):
        raise ValueError(name)

    try:
        doc = json.loads(text or "", object_pairs_hook=unique, parse_float=Decimal, parse_constant=refuse)
    except (ValueError, RecursionError):
        return []
    out: list[tuple[str, str | None]] = []
    open_ = [(k, v) for k, v in reversed(doc.items())] if isinstance(doc, dict) else []
    while open_:
        key, value = open_.pop()
        if isinstance(value, dict):
            open_ += [(f"{key}.{k}" if key else k, v) for k, v in reversed(value.items())]
        elif key != "":
            out.append((key, value if isinstance(value, str) else _json(value)))
    return out


def _json(value) -> str:
    """A leaf that is no text, as compact JSON; a number without trailing zeros."""
    if isinstance(value, Decimal):
        plain = value.normalize()
        return f"{plain:f}" if plain.as_tuple().exponent > -39 and plain.adjusted() < 39 else repr(float(plain))
    if isinstance(value, list):
        return "[" + ",".join(json.dumps(v, ensure_ascii=False) if isinstance(v, str) else _json(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{json.dumps(v, ensure_ascii=False) if isinstance(v, str) else _json(v)}" for k, v in sorted(value.items())) + "}"
    return json.dumps(value)


def flatten_labels(docs: DataFrame, column: str = "json", keep: tuple[str, ...] = ("lang",)) -> DataFrame:
    """(keep, key, value): nested dictionaries -> dotted leaf keys, one pass over each text at any depth."""

    def flat(batches):
        for batch in batches:
            rows, keys, values = [], [], []
            for i, text in enumerate(batch.column("_json").to_pylist()):
                for key, value in json_leaves(text):
                    rows.append(i)
                    keys.append(key)
                    values.append(value)
                if len(rows) > 50_000:  # a long file need not wait for the others
                    yield part(batch, rows, keys, values)
                    rows, keys, values = [], [], []
            yield part(batch, rows, keys, values)

    def part(batch, rows, keys, values):
        kept = batch.column("_keep").take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([kept, pa.array(keys, pa.string()), pa.array(values, pa.string())], names=["_keep", "key", "value"])

    packed = docs.select(F.struct(*keep).alias("_keep"), F.col(column).cast("string").alias("_json"))
    schema = packed.select("_keep", F.lit("").alias("key"), F.lit("").alias("value")).schema
    for f in schema.fields:
        f.nullable = True
    return packed.mapInArrow(flat, schema).select(*[F.col("_keep").getField(c).alias(c) for c in keep], "key", "value")


def crawl_errors(lines: DataFrame) -> DataFrame:
    """Distinct failing URLs of a crawl log, sorted."""
    hit = F.col("value").rlike(r"HTTP/[0-9.]+ [4-9][0-9][0-9]")
    rows = lines.where(hit).select(F.regexp_extract("value", r"(https?://[^ ]+)", 1).alias("url"))
    return rows.where("url <> ''").distinct().orderBy("url")


def throttled(lines: DataFrame) -> DataFrame:
    """One row: responses that say the crawl was too fast."""
    status = F.regexp_extract("value", r"HTTP/[0-9.]+ (\d{3})", 1).try_cast("int")
    return lines.agg(F.count_if(status.isin(rules.THROTTLE_CODES)).alias("throttled"))
