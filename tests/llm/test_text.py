"""The word kernels without Spark: slices and the filter of documents."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tideql.llm import minhash
from tideql.llm import text as T


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcÉxyZß漢") for _ in range(rng.choice([1, 2, 3, 9, 40])))
    return ["".join(word() + rng.choice([" ", "\n", " \t "]) for _ in range(rng.randint(0, 60))) for _ in range(30)] + ["", "x" * 500, " " * 300, None]


@pytest.mark.parametrize("size", [16, 64, 257])
def test_words_do_not_depend_on_slices(monkeypatch, size):
    buf, offsets, _ = T.utf8(pa.array(made(1)))
    want = T.words(buf, offsets, T.SPACE, lower=True)
    monkeypatch.setattr(T, "SLICE", size)
    for a, b in zip(T.words(buf, offsets, T.SPACE, lower=True), want, strict=True):
        assert (a == b).all()
    texts = [t or "" for t in made(1)]
    assert np.diff(want[3]).tolist() == [len(t.split()) for t in texts]


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """With one word of bits nearly every document passes; results stay."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(80):
        w = list(base) if i % 3 else [f"v{rng.randrange(10**6)}" for _ in range(40)]
        for _ in range(rng.choice([0, 1, 2, 5])):
            w[rng.randrange(40)] = f"z{rng.randrange(20)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, minhash.near_duplicates(df).collect()))
    monkeypatch.setattr(minhash, "FILTER_LEAST", 64)
    monkeypatch.setattr(minhash, "FILTER_EACH", 0)
    assert sorted(map(tuple, minhash.near_duplicates(df).collect())) == want
