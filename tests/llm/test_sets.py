"""Near duplicates, decontamination and shards."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.llm.components import components
from siteloom.llm.histogram_shards import _levels, histogram_shards, split_keys
from siteloom.llm.ngram_join import ngram_join, search
from siteloom.llm.winnowing import decontaminate

from .conftest import DATA, EXTRA, LOWER, SCHEMA, passage, plain_words

BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = plain_words(text, lower=True)
    return frozenset(tuple(w[p : p + 5]) for p in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups_reference(rows):
    """(n_shingles, component) of each row, by comparing every pair."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return Counter((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def edited(words, n, seed):
    rng, out = random.Random(seed), list(words)
    for p in rng.sample(range(len(out)), n):
        out[p] = f"edit{seed}x{p}"
    return " ".join(out)


def test_join_awkward(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(awkward).collect())
    assert got == groups_reference(rows)


@pytest.mark.parametrize("limits", [{}, {"group_sets": 8, "block_sets": 8}])
def test_join_of_a_loose_group(spark, limits):
    """Copies with one to nine words changed: some pairs link, some only through others, some not."""
    base = passage(11, 150).split()
    rows = [(i, edited(base, 1 + i % 9, i)) for i in range(60)] + [(100 + i, passage(200 + i, 30)) for i in range(5)]
    rows += [(200, rows[3][1]), (201, rows[3][1].upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(df, **limits).collect())
    assert got == groups_reference(rows)


def test_join_empty_table(nothing):
    assert ngram_join(nothing).collect() == []


def test_search_keeps_every_connection():
    rng = np.random.default_rng(5)
    sets = []
    for i in range(80):
        tokens = np.unique(rng.integers(0, 60, 25).astype(np.uint64))
        sets.append((i, len(tokens), tokens))
    sets.sort(key=lambda s: (s[1], s[0]))
    for percent in (30, 50, 75):
        links = {frozenset(x) for x in search(sets, None, percent)}
        truth = {
            frozenset((a[0], b[0]))
            for a in sets
            for b in sets
            if a[0] < b[0] and 100 * (o := len(np.intersect1d(a[2], b[2]))) >= percent * (a[1] + b[1] - o)
        }
        assert links <= truth

        def labels(edges):
            up = {i: i for i in range(80)}
            for e in edges:
                a, b = e
                la, lb = up[a], up[b]
                up = {k: min(la, lb) if v in (la, lb) else v for k, v in up.items()}
            return up

        assert labels(links) == labels(truth)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (300, 300), (500, 7), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 500: 0, 100: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def contamination_reference(rows, items):
    windows = defaultdict(set)
    for item_id, text in items:
        w = BENCH_WORD.findall((text or "").translate(LOWER))
        n = min(13, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[p : p + n])].add(item_id)
    lengths = {len(k) for k in windows}
    out = []
    for doc_id, text in rows:
        w = BENCH_WORD.findall((text or "").translate(LOWER))
        hit, names = [False] * len(w), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[p : p + n]))) is not None:
                    names |= {str(i) for i in x if i is not None}
                    hit[p : p + n] = [True] * n
        ids = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(w), sum(hit), len(names), ids, sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return Counter(out)


DIGEST = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.mark.parametrize("slice_bytes", [16 << 20, 40000])
def test_decontaminate_awkward(spark, awkward, slice_bytes):
    long = plain_words(passage(7, 30000))
    items = [
        (1, passage(1, 60)), (2, passage(1, 13)), (3, "only three words"), (4, None), (5, ""), (None, passage(2, 15)),
        (10, " ".join(long[100:112])), (11, " ".join(long[500:540])), (1, passage(1, 60)), (12, "Again again"), (13, "x" * 200000),
    ]
    more = [(50, "Some ONLY-three: words here", "en", *EXTRA), (51, "only three", "en", *EXTRA)]
    docs = awkward.unionByName(spark.createDataFrame(more, SCHEMA))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(docs, bench, slice_bytes=slice_bytes)
    assert set(awkward.columns) - {"n_words", "items"} <= set(got.columns)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(tuple(r) for r in got.select(*DIGEST).collect()) == contamination_reference(rows, items)


def test_decontaminate_documents(spark, documents):
    bench = spark.read.parquet(str(DATA / "benchmark.parquet"))
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = Counter(tuple(r) for r in decontaminate(documents, bench).select(*DIGEST).collect())
    assert got == contamination_reference(rows, items)


def test_decontaminate_empty_tables(nothing, awkward):
    bench = awkward.select(F.col("doc_id").alias("item_id"), "text")
    assert decontaminate(nothing, bench).collect() == []
    assert not any(r.n_hit for r in decontaminate(awkward, bench.limit(0)).collect())


def shard_facts(df):
    rows = df.collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r.size == len((r.text or "").encode()) + 1 for r in rows)
    return rows, sizes


def test_shards_awkward(awkward, nothing):
    rows, sizes = shard_facts(histogram_shards(awkward, 8))
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in awkward.collect())
    assert all(r._key == "k" and r.shard in range(8) for r in rows)
    assert histogram_shards(nothing, 8).collect() == []


def test_shards_with_a_hot_text(spark):
    rows = [(i, "hot text " * 5) for i in range(3000)] + [(3000 + i, passage(i, 3 + i % 9)) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got, sizes = shard_facts(histogram_shards(df, 8))
    assert len(got) == 9000 and max(sizes.values()) <= 1.01 * min(sizes.values())


def test_shards_keep_equal_texts_together(documents):
    got, sizes = shard_facts(histogram_shards(documents, 4))
    of = defaultdict(set)
    for r in got:
        of[r.text].add(r.shard)
    assert all(len(s) == 1 for s in of.values())
    assert max(sizes.values()) <= 1.1 * min(sizes.values())
    assert zlib.crc32(got[0].text.encode()) == spark_crc(documents, got[0].doc_id)


def spark_crc(documents, doc_id):
    return documents.where(F.col("doc_id") == doc_id).select(F.crc32(F.col("text").cast("binary"))).first()[0]


def test_split_keys_exact(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(-(2**63), 2**63), rng.randrange(1, 50)) for _ in range(500)] + [(17, 5)] * 40
    df = spark.createDataFrame(rows, "key long, size long")
    total = sum(s for _, s in rows)
    targets = [total // 4, total // 2, 3 * total // 4]
    cuts = split_keys(df, targets, total * 0.001)
    for cut, goal in zip(cuts, targets):
        below = sum(s for k, s in rows if k < cut)
        assert abs(below - goal) <= max(total * 0.001, 200)


def test_levels_fill_evenly():
    assert _levels([10, 0, 0], 20) == [0, 10, 10]
    assert _levels([0, 0], 0) == [0, 0]
    assert sum(_levels([5, 1, 1, 1], 9)) == 9


def test_one_prompt_of_many_items(spark):
    """A text that repeats what thousands of items share: its windows meet the items once each."""
    prompt = passage(77, 30)
    items = spark.createDataFrame([(f"i{i:05}", f"{prompt} {passage(100 + i, 5)}") for i in range(4000)], "item_id string, text string")
    docs = spark.createDataFrame([(1, " ".join([prompt] * 100)), (2, passage(5, 50))], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate(docs, items, slice_bytes=1 << 17).collect()}
    assert got[1].n_items == 4000 and got[1].items == sorted(f"i{i:05}" for i in range(4000)) and got[1].n_hit == 3000 and got[2].n_hit == 0


def test_strangers_columns_survive(spark):
    """Every name the operators use inside, as somebody else's column."""
    names = ["row", "_hit", "_text_key", "_at", "_first", "_key", "_part", "_pos", "_n", "_before", "_spread", "text_key", "key", "items_", "hash", "doc", "nothing"]
    docs = spark.createDataFrame([(i, passage(i, 20)) for i in range(6)], "doc_id long, text string").select("*", *[F.lit(n).alias(n) for n in names])
    items = spark.createDataFrame([("a", passage(2, 20))], "item_id string, text string")
    for got, added in ((decontaminate(docs, items), 7), (histogram_shards(docs, 2), 4)):
        assert got.columns[: len(docs.columns)] == docs.columns and len(got.columns) == len(docs.columns) + added
        rows = got.collect()
        assert len(rows) == 6 and all(r[n] == n for r in rows for n in names)
    assert not any(r.spread for r in rows)
