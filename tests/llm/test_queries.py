"""The registered queries and the pipeline, each stage against a plain computation on its own input."""

import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siteloom.llm import queries
from siteloom.session import cut_lineage

from .conftest import DATA
from .test_sets import contamination_reference, groups_reference

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables not present")
COLUMNS = {
    "op1_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op2_ngram_join": "doc_id n_shingles component_id",
    "op3_suffix_dedup": "doc_id start_word n_words span_sha256",
    "op4_pseudonyms": "doc_id text n_values kinds",
    "op5_piece_codec": "doc_id n_tokens ids round_trip",
    "op6_mih_search": "query_id rank vec_id score",
    "op7_template_lines": "doc_id text n_lines n_dropped",
    "op8_pu_quality": "doc_id held_out score predicted",
    "op9_winnowing": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op10_histogram_shards": "doc_id size text_crc32 law shard slot grown_shard",
    "op11_token_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op12_site_templates": "page_id url text n_chars",
    "op13_collocations": "lang rank phrase a l r n score",
}


def test_all_are_registered():
    assert set(queries.QUERIES) == set(COLUMNS) and set(queries.ORACLE) <= set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = queries.QUERIES[name](spark, str(DATA))
    assert set(COLUMNS[name].split()) <= set(df.columns)
    n = df.count()
    if name == "op6_mih_search":
        assert n == 5 * queries.table(spark, str(DATA), "embeddings").where("vec_id % 50 = 0").count()
    elif name == "op12_site_templates":
        assert n == queries.table(spark, str(DATA), "pages").count()
    elif name not in ("op3_suffix_dedup", "op13_collocations"):
        assert n == queries.table(spark, str(DATA), "documents").count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, str(DATA)).select(*names).collect()
    assert Counter(tuple(r) for r in got) == Counter(want.fetchall())


def test_pipeline_stage_by_stage(spark):
    sf = str(DATA)
    inputs, docs = [], queries.table(spark, sf, "documents")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES:
        inputs.append(docs)
        docs = cut_lineage(stage(spark, docs, sf), "test")
        assert docs.columns == columns or stage is corpus_pipeline.tokens
    text = [{r.doc_id: r.text for r in d.collect()} for d in inputs]
    # quality: what stays is untouched
    assert text[1].items() <= text[0].items() and len(text[1]) < len(text[0])
    # lines: the operator's SQL over the stage's own input
    con = duckdb.connect()
    con.register("kept", inputs[1].toPandas())
    want = con.execute(queries.template_lines_sql("kept")).fetchall()
    assert text[2] == {i: t for i, t, _, n in want if not (n and not t.strip(" "))}
    # near duplicates: the least id of each group
    groups = groups_reference(list(text[2].items()))
    assert set(text[3]) == {d for d, _, c in groups if c in (d, None)}
    # contamination: by the contract's rule
    items = [(r.item_id, r.text) for r in queries.table(spark, sf, "benchmark").collect()]
    judged = contamination_reference(list(text[3].items()), items)
    assert set(text[4]) == {r[0] for r in judged if not r[5]}
    # tokens
    rows = docs.collect()
    assert {r.doc_id for r in rows} == set(text[4]) and all(r.n_tokens == len(r.ids) for r in rows)
    assert math.isclose(sum(r.round_trip for r in rows), len(rows))


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, str(DATA)).columns == ["doc_id", "n_tokens", "ids", "round_trip"]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and set(corpus_pipeline.QUERIES) == {"pipeline"}


def test_stages_on_awkward_input(spark, awkward, nothing, tmp_path):
    """Nulls, empty and long texts, repeated rows, names the operators use inside: every stage keeps the columns."""
    labels = spark.createDataFrame([(1, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "none of these words stands anywhere in the documents at all here")], "item_id long, text string")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["row", "kept", "_kept", "n_lines", "n_dropped", "predicted", "contaminated", "component_id", "hash", "n_hit"]
    docs = awkward.select("*", *[F.lit(n).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert all(r[n] == n and r.block == 1 and r._key == "k" for r in rows for n in names), name
        assert {r.doc_id for r in rows} <= {r.doc_id for r in awkward.collect()}
        assert stage(spark, nothing, str(tmp_path)).collect() == []
    assert corpus_pipeline.tokens(spark, docs, str(tmp_path)).count() == awkward.count()
