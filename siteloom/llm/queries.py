"""The registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations, collocations_sql
from .histogram_shards import histogram_shards
from .mih_search import nearest
from .ngram_join import ngram_join
from .piece_codec import encode, read_model
from .pseudonyms import pseudonyms
from .pu_quality import quality
from .site_templates import site_text
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .template_lines import template_lines, template_lines_sql
from .token_alignment import align_tokens
from .winnowing import decontaminate

#: the model file that op5 and the pipeline read; any SentencePiece model of kind unigram or BPE will do
PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: the byte-level BPE file that op11 aligns with it
BYTE_MODEL = os.environ.get("BYTE_MODEL", "/opt/tokenizers/byte_bpe_50k.json")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_substring_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), length=35, with_text=False)


@query("op2_ngram_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


@query("op9_winnowing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op10_histogram_shards")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = histogram_shards(table(spark, sf_dir, "documents"), shards=8)
    return dealt.select(
        "doc_id", "size",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op7_template_lines", template_lines_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


@query("op8_pu_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@query("op4_pseudonyms")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the query's own key, so that its result can be compared; production passes a secret
    return pseudonyms(table(spark, sf_dir, "documents").select("doc_id", "text"), key=b"op4 query")


@query("op5_piece_codec")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), read_model(spark, PIECE_MODEL))


@query("op6_mih_search")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op3_suffix_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), length=50).drop("span_text")


@query("op13_collocations", collocations_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), longest=3, min_count=10, contained_percent=50, top=2000)


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"), read_model(spark, BYTE_MODEL), read_model(spark, PIECE_MODEL))


@query("op12_site_templates")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
