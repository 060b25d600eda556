import random
import re

import pytest
from pyspark.sql import Row

from tideql.llm import components, minhash, scratch


def brute(rows, k, percent):
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def made(seed, n, vocabulary=60):
    rng = random.Random(seed)
    bases = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 4) + str(rng.randint(0, vocabulary)) for _ in range(rng.randint(5, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"Z{rng.randint(0, 9)}É"
        rows.append(Row(doc_id=i * 7 + 3, text=" ".join(w) if i % 5 else "\t".join(w).upper()))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = made(seed, 150) + [Row(doc_id=5000, text=None), Row(doc_id=5001, text=" \n"), Row(doc_id=5002, text="one two"), Row(doc_id=5003, text="ONE  two"), Row(doc_id=5004, text="one"), Row(doc_id=5005, text="word " * 4000), Row(doc_id=5006, text="word " * 9)]
    df = spark.createDataFrame([Row(**r.asDict(), n=1, key="x", id=2) for r in rows]).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, k=4).collect()}
    assert got == brute(rows, 4, 80)


def test_null_ids_repeats_and_empty(spark):
    rows = [Row(doc_id=None, text="a b c d e f"), Row(doc_id=2, text="a b c d e f"), Row(doc_id=2, text="a b c d e f"), Row(doc_id=9, text="a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()))
    assert got == [(0, None, True), (2, 2, True), (2, 2, True), (9, 2, False)]
    assert minhash.keep_one(df).count() == 3
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (5, 4)], "a long, b long")
    got = {r.u: r.v for r in components.components(links, scratch.Scratch(spark)).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 101: 100}


def test_texts_that_share_an_id(spark):
    a = " ".join(f"w{i}" for i in range(30))
    rows = [Row(doc_id=0, text=a), Row(doc_id=1, text="x " + a), Row(doc_id=1, text="short one"), Row(doc_id=1, text="x " + a)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows)).collect())
    assert got == [(0, 26, 0, True), (1, 1, 1, True), (1, 27, 0, False), (1, 27, 0, False)]
    assert sorted((r.doc_id, r.text) for r in minhash.keep_one(spark.createDataFrame(rows)).collect()) == [(0, a), (1, "short one")]
    mixed = [Row(doc_id=5, text="z " + a), Row(doc_id=7, text=a), Row(doc_id=5, text="other words that are not the same"), Row(doc_id=None, text=a), Row(doc_id=8, text=None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(mixed, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, 5, True), (7, 5, False), (5, 5, True), (None, None, True), (8, 8, True)], key=str)
    twins = spark.createDataFrame([Row(doc_id=1, text=a), Row(doc_id=1, text=a + " y")])
    assert minhash.keep_one(twins).count() == 1


def test_clashing_names(spark):
    a = " ".join(f"w{i}" for i in range(30))
    names = ["key", "row", "id", "print", "t", "component_id", "kept", "_i"]
    df = spark.createDataFrame([(i, a, *([i] * len(names))) for i in range(2)], ["doc_id", "text", *names])
    out = minhash.keep_one(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(0, a, *([0] * len(names)))]


def test_long_texts_of_distinct_words(spark):
    w = [f"w{i}" for i in range(30_000)]
    rows = [Row(doc_id=1, text=" ".join(w)), Row(doc_id=2, text=" ".join([*w[:29_000], *(f"v{i}" for i in range(1000))])), Row(doc_id=3, text=" ".join(w[:15_000])), Row(doc_id=4, text=" ".join(w[5:]))]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows)).collect()}
    assert got == brute(rows, 5, 80)


def test_join_in_place_of_the_filter(spark):
    docs = spark.createDataFrame([Row(id=i, t=f"a b c d e f{i}") for i in range(40)])
    ids = docs.select("id").filter("id < 5")
    got = {r["id"] for r in minhash._sets(docs, ids, 5, most=0).collect()}
    assert got == set(range(5)) <= {r["id"] for r in minhash._sets(docs, ids, 5).collect()}
