"""Fixtures of the training-data operators: awkward documents and plain reference computations."""

import re
from collections import Counter
from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# names the operators use inside, as strangers' columns
CLASHING = "block int, n_words int, text_key string, _key string, score string, shard string, items string, mask string, label int"
SCHEMA = f"doc_id long, text string, lang string, {CLASHING}"
EXTRA = (1, 2, "k", "k", "s", "s", "i", "m", 3)


def passage(seed: int, n: int) -> str:
    return " ".join(f"w{(seed * 7919 + i * 104729) % 100003}" for i in range(n))


def awkward_rows() -> list[tuple]:
    shared = passage(1, 60)
    texts = [
        (1, f"{passage(2, 20)} {shared} {passage(3, 10)}"),
        (2, f"{shared}"),
        (3, None),
        (4, ""),
        (5, " \t\n \x0b"),
        (6, f"Ä {passage(4, 34)}"),
        (7, f"Ä {passage(4, 34)}"),
        (7, f"Ä {passage(4, 34)}"),
        (None, passage(5, 40)),
        (9, " ".join(["again"] * 90)),
        (10, passage(6, 3)),
        (11, passage(6, 3).upper()),
        (12, passage(7, 30000) + " " + shared),
        (13, "x" * 200000),
        (14, f"{passage(8, 40)}\n{passage(9, 3)} end"),
        (15, f"{passage(8, 40)}\n{passage(9, 3)} fin"),
        (16, "a\0b   non breaking é"),
    ]
    return [(i, t, None if i == 3 else "en", *EXTRA) for i, t in texts]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    if not DATA.exists():
        pytest.skip("test tables not present")
    return spark.read.parquet(str(DATA / "documents.parquet"))


def plain_words(text, lower=False):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER) if lower else (text or ""))


def repeated_cover(texts: list[list[str]], length: int) -> list[list[bool]]:
    """Words covered by a window that starts anywhere else too."""
    seen = Counter(tuple(w[p : p + length]) for w in texts for p in range(len(w) - length + 1))
    out = []
    for w in texts:
        cover = [False] * len(w)
        for p in range(len(w) - length + 1):
            if seen[tuple(w[p : p + length])] > 1:
                cover[p : p + length] = [True] * length
        out.append(cover)
    return out
