"""Substring, suffix and line deduplication against plain computations."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.llm.substring_dedup import levels, substring_dedup
from siteloom.llm.suffix_dedup import compare, suffix_dedup
from siteloom.llm.template_lines import template_lines
from siteloom.llm.words import SPACE, minimisers, words

from .conftest import passage, plain_words, repeated_cover


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def substring_reference(rows, length):
    texts = [plain_words(t) for _, t in rows]
    out = []
    for (i, _), w, cover in zip(rows, texts, repeated_cover(texts, length)):
        kept = " ".join(x for x, c in zip(w, cover) if not c)
        out.append((i, len(w), sum(cover), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def span_reference(rows, length):
    texts = [plain_words(t) for _, t in rows]
    out = Counter()
    for (i, _), w, cover in zip(rows, texts, repeated_cover(texts, length)):
        p = 0
        while p < len(w):
            q = p
            while q < len(w) and cover[q]:
                q += 1
            if q > p:
                out[(i, p, q - p, hashlib.sha256(" ".join(w[p:q]).encode()).hexdigest())] += 1
            p = max(q, p + 1)
    return out


def digest(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def test_levels_double():
    assert levels(35, 18) == [18, 35]
    assert levels(35, 5) == [5, 9, 18, 35]
    assert levels(8, 8) == [8]


@pytest.mark.parametrize("shortest", [4, 18, 35])
def test_substring_awkward(awkward, shortest):
    got = substring_dedup(awkward, 35, shortest)
    assert digest(got) == substring_reference(pairs(awkward), 35)


def test_substring_documents(documents):
    assert digest(substring_dedup(documents, 35)) == substring_reference(pairs(documents), 35)


def test_substring_kept_text(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "x  b c d\ty")], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in substring_dedup(df, 3, 2).collect()}
    assert got == {1: "a e", 2: "x y"}


def test_substring_empty_table(nothing):
    assert substring_dedup(nothing).collect() == []


def test_suffix_awkward(awkward):
    got = Counter(tuple(r) for r in suffix_dedup(awkward, 50).drop("span_text").collect())
    assert got == span_reference(pairs(awkward), 50)


def test_suffix_documents(documents):
    got = Counter(tuple(r) for r in suffix_dedup(documents, 30, 6).drop("span_text").collect())
    assert got == span_reference(pairs(documents), 30)


@pytest.mark.parametrize("hot", [1, 3])
def test_suffix_hot_anchors(awkward, hot):
    got = Counter(tuple(r) for r in suffix_dedup(awkward, 50, hot=hot).drop("span_text").collect())
    assert got == span_reference(pairs(awkward), 50)


def test_suffix_phrase_with_other_words_around(spark, documents):
    # a phrase of 40 words in every text, longer by its neighbours in some; too short for 50 words in the others
    phrase = " ".join(f"p{i}" for i in range(40))
    texts = [f"{' '.join(f'a{i % 90}x{j}' for j in range(30))} {phrase} {' '.join(f'b{i % 70}x{j}' for j in range(i % 40))}" for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for length, k in ((50, 8), (45, 8), (50, 9), (60, 7)):
        got = Counter(tuple(r) for r in suffix_dedup(docs, length, k, hot=20).drop("span_text").collect())
        assert got == span_reference(list(enumerate(texts)), length)
    got = Counter(tuple(r) for r in suffix_dedup(documents, 30, 6, hot=1).drop("span_text").collect())
    assert got == span_reference(pairs(documents), 30)


def test_suffix_empty_table(nothing):
    assert suffix_dedup(nothing).collect() == []


def test_compare_extends_both_ways():
    # the same ten words, met at the same anchor with three words to the left in common
    room = np.array([[3, 7], [3, 7], [0, 7]], np.uint16)
    right = np.array([[1, 2, 3, 4, 5, 6, 7, 0, 0, 0]] * 3, np.uint32)
    left = np.array([[9, 8, 7], [9, 8, 7], [0, 0, 0]], np.uint32)
    first, last = compare(room, right, left, 10)
    assert first.tolist() == [3, 3, -1] and last.tolist() == [3, 3, -1]


def test_minimisers_meet_every_window():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 50, 400, dtype=np.uint64)
    left = np.concatenate([np.arange(150, 0, -1), np.arange(250, 0, -1)])
    spots = set(minimisers(values, left, 3, 8).tolist())
    for p in np.flatnonzero(left >= 10):
        window = values[p : p + 8]
        assert p + 7 - int(np.argmin(window[::-1])) in spots


def test_words_match_regular_expression():
    texts = ["a  b\tc\n", None, "", "é x y", "\x0bq\x0c", "last"]
    w = words([None if t is None else t.encode() for t in texts], SPACE)
    got = [w.text(a, b).decode().split(" ") if b > a else [] for a, b in zip(w.first, w.first[1:])]
    assert got == [plain_words(t) for t in texts]
    assert len(set(w.hash.tolist())) == len({x for t in texts for x in plain_words(t)})


def test_lines_of_templates(spark):
    rows = [
        (1, "job 17 took 3 s\nown line one\n\nCopyright the authors all rights reserved"),
        (2, "job 99 took 45 s\nanother own line\nCopyright the authors all rights reserved"),
        (3, "job 5 took 6 s\nCopyright  the authors all rights reserved "),
        (4, "error in the module alpha now stops here today\nx"),
        (5, "error in the module beta now stops here today\ny"),
        (6, "error in the module gamma now stops here today\nz"),
        (7, None),
        (8, ""),
    ]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in template_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (rows[0][1], 4, 0)
    assert got[2] == ("another own line", 3, 2)
    assert got[3] == ("", 2, 2)
    assert got[4] == (rows[3][1], 2, 0)
    assert got[5] == ("y", 2, 1) and got[6] == ("z", 2, 1)
    assert got[7] == (None, 0, 0) and got[8] == ("", 1, 0)


def lines_reference(rows, min_docs=2, min_variable=3, depth=3, similarity=0.5, percent=1):
    """(doc_id, text) of every row, by dictionaries; ``rows`` of (doc_id, text), ids repeated or null."""

    def mask(line):
        masked = " ".join("<*>" if re.search("[0-9]", t) else t for t in line.split(" "))
        return line if masked.count("<*>") > (1 - similarity) * (masked.count(" ") + 1) else masked

    def leaf(line):
        t = line.split(" ")
        return len(t), tuple("<*>" if re.search("[0-9]", x) else x for x in t[:depth])

    def first(ids):
        return min((i for i in ids if i is not None), default=None)

    docs_of, leaf_of = defaultdict(set), {}
    split = [[(x, re.sub("[ \t\x0b\f\r]+", " ", x).strip(" ")) for x in (t or "").split("\n")] for _, t in rows]
    for (i, _), lines in zip(rows, split):
        for _, x in lines:
            if x:
                docs_of[mask(x), leaf(x)].add(i)
    leaves = defaultdict(list)
    for m, at in docs_of:
        leaves[at].append(m)
    pattern_of, docs_with = {}, defaultdict(set)
    for at, own in leaves.items():
        if len(own) < 2 or sum(len(docs_of[m, at]) for m in own) < min_variable or at[0] <= depth:
            continue
        counts = Counter((p, t) for m in own for p, t in enumerate(m.split(" ")) if p >= depth and t != "<*>")
        for m in own:
            fixed = [(p, t) for p, t in enumerate(m.split(" ")) if p >= depth and counts[p, t] >= min_variable and counts[p, t] * 100 >= len(own) * percent]
            if len(fixed) >= similarity * (at[0] - depth):
                pattern_of[m] = (at, tuple(fixed))
                docs_with[at, tuple(fixed)] |= docs_of[m, at]

    def dropped(i, x):
        if not x:
            return False
        sets = [(docs_of[mask(x), leaf(x)], min_docs), (docs_with.get(pattern_of.get(mask(x)), ()), min_variable)]
        return any(len(ids) >= n and first(ids) is not None and first(ids) != i for ids, n in sets)

    return Counter((i, None if t is None else "\n".join(raw for raw, x in lines if not dropped(i, x))) for (i, t), lines in zip(rows, split))


def test_lines_awkward(spark, awkward, nothing):
    extra = [(None, f"{passage(8, 40)}\nown"), (None, f"{passage(8, 40)}\nown"), (None, "only here\nonly here"), (40, "only there\nonly there"), (40, f"{passage(8, 40)}")]
    docs = awkward.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    got = template_lines(docs)
    assert got.columns == [*awkward.columns, "n_lines", "n_dropped"]
    assert Counter(pairs(got)) == lines_reference(pairs(docs))
    assert all(r.block == 1 and r.mask == "m" for r in template_lines(awkward).collect())
    assert template_lines(nothing).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_lines_against_plain_computation(spark, seed):
    """Few words, so that leaves fill with several templates, unlike lines and fields with and without digits."""
    rng = np.random.default_rng(seed)
    words_ = ["alpha", "beta", "gamma", "delta", "x1", "y22"]
    rows = []
    for i in range(60):
        lines = [" ".join(["job"] * 3 + [words_[w] for w in rng.integers(0, 6, rng.integers(1, 6))]) for _ in range(rng.integers(0, 5))]
        rows.append((i, "\n".join(lines)))
    got = template_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), percent=20)
    assert Counter(pairs(got)) == lines_reference(rows, percent=20)


def test_line_templates_do_not_switch_each_other_off(spark):
    names = ["ann", "bob", "cat", "dan", "eve", "fay"]
    rows = [(i, f"Posted by user {n} in forum general") for i, n in enumerate(names)] + [(10, "Posted by user groups from around Europe")]
    rows += [(20 + i, f"{passage(3, 64)}\nown {passage(50 + i, 3)}") for i in range(2)]
    got = dict(pairs(template_lines(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert [got[i] for i in range(6)] == [rows[0][1], "", "", "", "", ""] and got[10] == rows[6][1]
    assert got[20] == rows[7][1] and got[21] == f"own {passage(51, 3)}"


def test_lines_keep_strangers_columns(spark):
    names = ["row", "hash", "pos", "line", "leaf", "first", "id", "of", "dropped", "every", "token", "n", "fixed", "pattern", "_doc_id", "_kept", "_dropped", "l"]
    df = spark.createDataFrame([(1, "a b c\nd"), (2, "a b c\ne")], "doc_id long, text string")
    got = template_lines(df.select("*", *[F.lit(n).alias(n) for n in names]))
    assert got.columns == ["doc_id", "text", *names, "n_lines", "n_dropped"]
    assert all(r[n] == n for r in got.collect() for n in names) and dict(pairs(got)) == {1: "a b c\nd", 2: "e"}


def test_lines_use_functions_only(documents):
    plan = template_lines(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
