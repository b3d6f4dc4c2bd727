"""Pseudonyms, tokens, vectors and quality."""

import datetime
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.llm.mih_search import Codes, Index, learn, nearest
from siteloom.llm.piece_codec import Codec, PieceModel, decode, encode
from siteloom.llm.pseudonyms import Feistel, _luhn, pseudonyms, replace
from siteloom.llm import pu_quality
from siteloom.llm.pu_quality import N_FEATURES, Moments, features, fit, quality

from .conftest import DATA

MODEL = Path("/opt/tokenizers/piece_bpe_32k.model")
VALUES = """Card 4111 1111 1111 1111 or 4111111111111111, not 4111111111111112345 nor 0000000000000000.
Call +1 (017) 555-7713 or 017-555-7713; mail Jo.é9@mail.example.com. On 2021-02-28, 28.02.2021, 2/28/2021, never 2021-02-30.
IBAN GB82 WEST 1234 5698 7654 32, DE89370400440532013000; host 10.0.0.1 not 999.1.1.1; 078-05-1120 not 000-12-3456
token = "3f2a9b0c4d5e6f708192a3b4c5d6e7f801234567" and version 1.2.3, year 1999"""


@pytest.mark.parametrize("n", [1, 2, 7, 10, 256, 1000, 10**6 + 3, 26**5 * 10**9])
def test_feistel_is_a_permutation(n):
    there, back = Feistel(b"key"), Feistel(b"key", back=True)
    some = range(n) if n <= 1000 else [random.Random(1).randrange(n) for _ in range(300)]
    out = [there(b"x", x, n) for x in some]
    assert all(0 <= y < n for y in out) and [back(b"x", y, n) for y in out] == list(some)
    if n <= 1000:
        assert sorted(out) == list(range(n))
    if n >= 256:
        assert out != [Feistel(b"other")(b"x", x, n) for x in some]


def test_values_keep_format_and_links():
    there, back = Feistel(b"key"), Feistel(b"key", back=True)
    new, kinds = replace(VALUES, there)
    assert Counter(kinds) == {"card": 2, "number": 1, "phone": 2, "mail": 1, "date": 3, "iban": 2, "address": 1, "social": 1, "secret": 1}
    assert replace(new, back)[0] == VALUES
    assert len(new.split("\n")) == 4 and "@mail.example.com" in new and "1.2.3, year 1999" in new and "999.1.1.1" in new
    spaced, plain = re.search(r"Card ([\d ]{19}) or (\d{16})", new).groups()
    assert spaced.replace(" ", "") == plain != "4111111111111111" and int(plain[-1]) == _luhn(plain[:-1])
    iso, dotted = re.search(r"On (\S+), (\S+),", new).groups()
    assert datetime.date.fromisoformat(iso).strftime("%d.%m.%Y") == dotted != "28.02.2021"
    for secret in ("555-7713", "Jo.é9", "10.0.0.1", "078-05-1120", "3f2a9b0c", "WEST", "370400440532013000"):
        assert secret not in new


@pytest.mark.parametrize(
    "text, kind, clear",
    [
        ("card 4111 1111 1111 1111 12/27 end", "card", "4111 1111 1111 1111"),
        ("1234 4111 1111 1111 1111 123", "card", "4111 1111 1111 1111"),
        ("4111-1111-1111-1111 3782 822463 10005", "card card", "3782 822463 10005"),
        ("6304 0000 0000 0000 075 is grouped in five", "card", "6304 0000 0000 0000 075"),
        ("AT611904300234573201 BIC OPSKATWW", "iban", "1904300234573201"),
        ("pay AT61 1904 3002 3457 3201 BIC now", "iban", "1904 3002 3457 3201"),
        ("ES91 2100 0418 4502 0005 1332 BBVA", "iban", "2100 0418 4502 0005 1332"),
        ("REF1 XX12 AT61 1904 3002 3457 3201 DE89 3704 0044 0532 0130 00", "iban iban", "1904 3002"),
        ("CZ6508000000192000145399 SK3112000000198742637541", "iban iban", "198742637541"),
    ],
)
def test_grouped_values_before_other_groups(text, kind, clear):
    for key in (b"key", b"a", b"b", b"c"):
        new, kinds = replace(text, Feistel(key))
        assert kinds == kind.split() and clear not in new and len(new) == len(text)
        assert replace(new, Feistel(key, back=True))[0] == text
    there, back = Feistel(b"key"), Feistel(b"key", back=True)
    assert replace("4111 1111 1111 1112 end, 3782 822463 10006, AT62 1904 3002 3457 3202 BIC", there)[1] == []
    rng = random.Random(7)
    for _ in range(300):  # rows of groups, where other starts may pass the check by chance
        row = " ".join("".join(rng.choice("0123456789") for _ in range(4)) for _ in range(12))
        assert replace(replace(row, there)[0], back)[0] == row


def test_pseudonyms_of_documents(documents):
    there = pseudonyms(documents, b"key")
    again = pseudonyms(there.drop("n_values", "kinds"), b"key", back=True)
    before = {r.doc_id: r.text for r in documents.collect()}
    rows = there.collect()
    assert {r.doc_id: r.text for r in again.collect()} == before
    assert sum(r.n_values for r in rows) > 0 and all((r.text == before[r.doc_id]) == (r.n_values == 0) for r in rows)
    # equal values of different documents stay linked
    image = {}
    for r in rows:
        for old, new in zip(re.findall(r"(?<!\d)\d{16}(?!\d)", before[r.doc_id]), re.findall(r"(?<!\d)\d{16}(?!\d)", r.text)):
            assert image.setdefault(old, new) == new
    assert len(set(image.values())) == len(image)


def test_pseudonyms_awkward(awkward, nothing):
    rows = pseudonyms(awkward.withColumn("n_values", F.lit("x")), b"key").collect()
    # words of the fixture hold digits, but none is a value
    assert Counter((r.doc_id, r.text, r.n_values) for r in rows) == Counter((r.doc_id, r.text, 0) for r in awkward.collect())
    assert pseudonyms(nothing, b"key").collect() == []


pieces = pytest.mark.skipif(not MODEL.exists(), reason="model not present")
ODD = ["", " ", "  a  b ", "\n\nx\t y", "<s>hi</s> <unk>", "日本 🎉 ▁x a▁b", "▁", "▁ ▁a ", "a\0b", "é́", "x" * 3000]


@pieces
def test_codec_parity():
    import duckdb
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=str(MODEL))
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet'").fetchall()] + ODD
    codec = Codec(MODEL.read_bytes(), 2, keep=5000)
    want = theirs.encode(texts)
    assert codec.encode(texts) == want
    assert codec.decode(want) == theirs.decode(want)
    for part in (texts, texts[::-1], ODD):
        ids, offsets, back = codec.encode_arrays(part)
        own = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
        assert own == theirs.encode(part)
        assert back == [a == b for a, b in zip(theirs.decode(own), part)]


@pieces
def test_unigram_model_with_normalisation(tmp_path):
    """A hand-written unigram model: scores, squeezed blanks, byte fallback."""
    import struct

    import sentencepiece

    def field(number, kind, value):
        tag = bytes([(number << 3 | kind) & 0x7F | (0x80 if number > 15 else 0)]) + (bytes([number >> 4]) if number > 15 else b"")
        if kind == 0:
            return tag + bytes([value])
        return tag + (bytes([len(value) & 0x7F | 0x80, len(value) >> 7]) if len(value) > 127 else bytes([len(value)])) + value if kind == 2 else tag + value

    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    rows += [("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -2.2, 1), ("▁ab", -2.1, 1), ("ba", -4.0, 1)]
    data = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, k)) for p, s, k in rows)
    data += field(2, 2, field(3, 0, 1) + field(35, 0, 1)) + field(3, 2, field(3, 0, 1) + field(4, 0, 1) + field(5, 0, 1))
    path = tmp_path / "u.model"
    path.write_bytes(data)
    theirs = sentencepiece.SentencePieceProcessor(model_file=str(path))
    assert PieceModel.parse(data).kind == 1
    texts = ["ab", "abab ba", "  a   b ", "aé b", "babab abba"]
    codec = Codec(data)
    assert codec.encode(texts) == theirs.encode(texts)
    ids, offsets, _ = codec.encode_arrays(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == theirs.encode(texts)
    assert codec.decode(codec.encode(texts)) == theirs.decode(theirs.encode(texts))


@pieces
def test_tokens_awkward(awkward, nothing):
    model = MODEL.read_bytes()
    got = encode(awkward, model, columns=("doc_id", "items"))
    assert got.columns == ["doc_id", "items", "n_tokens", "ids", "round_trip"]
    rows = got.collect()
    texts = Counter((r.doc_id, r.text) for r in awkward.collect())
    back = Counter((r.doc_id, r.text) for r in decode(got, model).collect())
    assert back == texts and all((r.n_tokens is None) == (r.ids is None) for r in rows)
    assert all(r.round_trip for r in rows if r.ids is not None) and [r.ids for r in rows if r.doc_id == 4] == [[]]
    assert encode(nothing, model).collect() == []


def exact(rows, k):
    """The k nearest by brute force over usable rows (vec_id, vector)."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 16 and None not in v]
    good = [(i, v) for i, v in good if np.isfinite(v).all() and v.any()]
    out = {}
    for q, x in good:
        if q % 10 == 0:
            near = [(-float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))), i) for i, y in good if i != q]
            out[q] = sorted(near)[:k]
    return out


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.4 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(600)]
    rows[33] = (33, list(rows[43][1]))  # equal vectors
    rows += [(700, None), (710, [0.0] * 16), (720, [None, *[1.0] * 15]), (730, [float("nan"), *[1.0] * 15]), (740, [1.0, 2.0])]
    rows += [(None, [1.0] * 16), (750, [float("inf"), *[1.0] * 15])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string").repartition(3)
    want = exact(rows, 5)
    for limits in ({}, {"block": 150, "ask": 20}):
        got = {}
        for r in nearest(df, F.col("vec_id") % 10 == 0, 5, **limits).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert set(got) == set(want)
        hits = 0
        for q, found in got.items():
            assert [r for r, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
            hits += len({i for _, i, _ in found} & {i for _, i in want[q]})
        assert hits >= 0.9 * 5 * len(want)


def test_nearest_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0])], "vec_id long, embedding array<float>")
    got = [tuple(r)[:3] for r in nearest(df, F.col("vec_id") == 0, 5).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert nearest(df.limit(0), F.col("vec_id") == 0).collect() == []


def test_pigeonhole_finds_every_code():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 32))
    codes = learn(x, 5, 0.9)
    index = Index(np.arange(500), x, codes)
    for radius in (0, 3, 7, 12, 32):
        for q in range(0, 500, 50):
            want = np.flatnonzero(np.bitwise_count(index.code ^ index.code[q]).sum(axis=1) <= radius)
            assert index.within(index.code[q], radius).tolist() == want.tolist()
    assert isinstance(codes, Codes) and 0 < codes.radius <= 32


def test_features_ignore_everything_but_the_text():
    x = features([b"The and that.", b"THE!! AND!! THAT!!", None, b"", b"so so so so so so so so so so so so so so so so so so so so so"])
    assert x.shape == (5, N_FEATURES) and np.isfinite(x).all()
    assert not x[2].any() and not x[3].any() and np.abs(x[0] - x[1]).max() > 0.5
    assert np.allclose(features([b"a b"])[0], features([b"zz", b"a b"])[1])


def pu_sample(seed=1):
    rng = np.random.default_rng(seed)
    positive = rng.normal(1.5, 1, (2000, 4))
    unlabelled = rng.permutation(np.concatenate([rng.normal(1.5, 1, (1400, 4)), rng.normal(-1.5, 1, (600, 4))]))
    halves = np.arange(2000) % 2
    moments = tuple(Moments.of(unlabelled[halves == h]) for h in (0, 1))

    def histogram(mean, scale, w):
        return pu_quality._histogram(pu_quality._with_one(unlabelled[halves == 1], mean, scale) @ w)

    def sums(mean, scale, w):
        z = pu_quality._with_one(unlabelled, mean, scale)
        return pu_quality._parts(pu_quality.risk_sums(z[:700], w) + pu_quality.risk_sums(z[700:], w), 5)

    return rng, positive, unlabelled, moments, histogram, sums


def test_prior_and_risk():
    rng, positive, unlabelled, moments, histogram, sums = pu_sample()
    w, b, mean, scale, prior = fit(positive, moments, histogram, sums)
    assert 0.6 < prior < 0.8
    good, bad = (((rng.normal(m, 1, (500, 4)) - mean) / scale) @ w + b for m in (1.5, -1.5))
    assert (good > 0).mean() > 0.95 and (bad < 0).mean() > 0.95
    assert np.allclose((moments[0] + moments[1]).second, unlabelled.T @ unlabelled)


def test_risk_against_plain_search():
    """The least risk of a plain optimiser over the same rows, and a prior counted threshold by threshold."""
    _, positive, unlabelled, moments, histogram, sums = pu_sample(2)
    w, b, mean, scale, prior = fit(positive, moments, histogram, sums, rounds=20)
    zp, zu = (pu_quality._with_one(x, mean, scale) for x in (positive, unlabelled))

    def risk(v):
        bracket = np.logaddexp(0, zu @ v).mean() - prior * np.logaddexp(0, zp @ v).mean()
        return prior * np.logaddexp(0, -(zp @ v)).mean() + max(0.0, bracket) + 0.05 * (1 + 3 * 5 / 2000) * v[:-1] @ v[:-1] / 2

    found = np.append(w, b)
    v = np.zeros(5)
    for step in (0.5, 0.1, 0.02, 0.004):
        for _ in range(300):
            tries = [v + s * step * e for e in np.eye(5) for s in (1, -1)]
            best = min(tries, key=risk)
            if risk(best) >= risk(v):
                break
            v = best
    assert risk(found) <= risk(v) + 1e-4
    half = Moments.of(positive[::2]).scaled(mean, scale)
    g = pu_quality._apart(half, moments[0].scaled(mean, scale), 0.3)
    p, u = zp[1::2] @ g, zu[np.arange(2000) % 2 == 1] @ g
    ratios = [((u >= c).mean() + np.sqrt(np.log(40) / 2) * (len(p) ** -0.5 + len(u) ** -0.5), (u >= c).mean(), (p >= c).mean()) for c in np.arange(-4, 4, 0.002)]
    plain = min((a / m, x / m) for a, x, m in ratios if m >= 0.1)[1]
    assert abs(plain - prior) < 0.01


def test_every_unlabelled_document_counts(spark):
    """No cap: one more kind of unlabelled document, however rare, moves the model."""
    texts = [(i, f"The plain text number {i} says something new each time, and more.", 1 if i < 40 else None) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in texts if q], "doc_id long, quality int")
    one = pu_quality.train(docs, labels, max_positive=20)
    more = docs.union(spark.createDataFrame([(1000, "#### $$$$ !!!! " * 50)], docs.schema))
    two = pu_quality.train(more.repartition(5), labels, max_positive=20)
    assert len(two.mean) > len(one.mean), (len(one.mean), len(two.mean), one.prior)


def test_quality_held_out(spark):
    data = DATA.parent / "sf0.01"
    if not data.exists():
        pytest.skip("test tables not present")
    docs, labels = (spark.read.parquet(str(data / f"{t}.parquet")) for t in ("documents", "labels"))
    got = quality(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    pairs = [(truth[r.doc_id], r.score) for r in got if r.held_out and truth.get(r.doc_id) is not None]
    good, bad = ([s for q, s in pairs if q == x] for x in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    # labels of held-out documents play no part
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: round(r.score, 9) for r in quality(docs, flipped).collect()} == {r.doc_id: round(r.score, 9) for r in got}


def test_quality_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, None), (None, 1), (2, 1), (9, 0)], "doc_id long, quality int")
    got = quality(awkward, labels)
    assert got.columns == [*[c for c in awkward.columns if c != "score"], "held_out", "score", "predicted"]
    assert got.count() == awkward.count() and all(0 <= r.score <= 1 for r in got.collect())
    assert all(r.score == 0.5 for r in quality(awkward, labels.limit(0)).collect())
    assert quality(nothing, labels).collect() == []


def test_nearest_recall_on_the_table(spark):
    """At least 0.95 of the true five nearest of the given vectors, every query and every row."""
    data = DATA.parent / "sf0.1"
    if not data.exists():
        pytest.skip("test tables not present")
    df = spark.read.parquet(str(data / "embeddings.parquet"))
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in df.collect()}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    found = {}
    for r in nearest(df, F.col("vec_id") % 50 == 0, 5).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in found:
        score = x @ x[np.searchsorted(ids, q)]
        score[np.searchsorted(ids, q)] = -2
        hits += len(found[q] & set(ids[np.lexsort((ids, -score))[:5]].tolist()))
    assert len(found) == 40 and hits / (5 * len(found)) >= 0.95
