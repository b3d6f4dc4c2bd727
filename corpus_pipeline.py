"""From raw documents to tokens: quality, recurring lines, near duplicates, benchmark passages, tokens.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns what stays of
``docs``, in the columns of documents (the last one: tokens). ``run`` writes what a stage returns and
reads it again as the next one's input.

In all stages: an empty table gives an empty one; columns besides doc_id and text are carried as they are, whatever
their names (n_chars, where there is one, follows the text); rows without doc_id are kept like others unless a stage says else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.carry import carried
from siteloom.llm.ngram_join import ngram_join
from siteloom.llm.piece_codec import encode, read_model
from siteloom.llm.pu_quality import quality
from siteloom.llm.queries import PIECE_MODEL, table
from siteloom.llm.template_lines import template_lines
from siteloom.llm.winnowing import decontaminate
from siteloom.session import cut_lineage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts.

    Null and empty texts are scored as texts without features, which the model decides; equal texts have equal scores, so
    repeated rows stay or go together. Without labels all stay.
    """
    labels = table(spark, sf_dir, "labels")
    return carried(docs, (), lambda rows: quality(rows, labels).where("predicted = 1"))


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier ones have; those left with nothing of their own go.

    Of equal lines the document of least doc_id keeps its own. Null texts and texts empty before stay; rows that repeat a
    doc_id are one document, and so are rows without one.
    """

    def kept(rows: DataFrame) -> DataFrame:
        found = template_lines(rows)
        return found.where(~((F.col("n_dropped") > 0) & (F.trim("text") == "")))

    out = carried(docs, (), kept)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of every group of near duplicates.

    Null and empty texts are groups of their own and stay; rows that repeat a doc_id stay or go together; rows without
    doc_id stay where their group has no other.
    """
    found = ngram_join(docs.select("doc_id", "text"))
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept")).distinct()
    return carried(docs, (), lambda rows: rows.join(stays, F.col("doc_id").eqNullSafe(F.col("kept")), "left_semi"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text.

    Null and empty texts have none and stay; each row is judged by its text alone.
    """
    benchmark = table(spark, sf_dir, "benchmark")
    return carried(docs, (), lambda rows: decontaminate(rows, benchmark).where("not contaminated"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left: null for a null text, none for an empty one, a row for each row."""
    return encode(docs, read_model(spark, PIECE_MODEL))


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", own_lines),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", uncontaminated),
    ("SentencePiece encoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut_lineage(docs, name.split()[0].lower())
    return docs


#: a fitted classifier and a tokenizer are beyond SQL; the stages are tested one by one instead
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
