import random
import re
from collections import defaultdict

from pyspark.sql import Row

from tideql.llm import suffix_array as S


def brute(rows, least):
    places, n = defaultdict(list), {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        n[r.doc_id] = len(w)
        for i in range(len(w) - least + 1):
            places[tuple(w[i : i + least])].append((r.doc_id, i))
    every, gone = defaultdict(set), defaultdict(set)
    for at in places.values():
        if len(at) > 1:
            least_place = min(at)
            for d, i in at:
                every[d] |= set(range(i, i + least))
                if (d, i) != least_place:
                    gone[d] |= set(range(i, i + least))
    return {d: (len(x), len(gone[d]), x, gone[d]) for d, x in every.items()}


def words(spans):
    return {i for s in spans for i in range(s.start, s.stop)}


def made(seed):
    rng = random.Random(seed)
    text = lambda n: [rng.choice("abcdefgh") * rng.randint(1, 3) + rng.choice(["", "É", "1"]) for _ in range(n)]
    shared = [text(n) for n in (49, 50, 51, 60, 75, 120, 200)]
    rows = []
    for i in range(60):
        w = text(rng.randint(0, 90))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.choice([0, 0, 0, 3, 20])
            w += p[a:] + text(rng.randint(0, 40))
        rows.append(Row(doc_id=rng.randrange(10**9) * 100 + i, text=rng.choice([" ", "\n", " \t"]).join(w)))
    rows.append(Row(doc_id=7, text="same " * 400))
    rows.append(Row(doc_id=8, text="x y " * 30))
    return [*rows, Row(doc_id=1, text=None), Row(doc_id=2, text=""), Row(doc_id=3, text="short")]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = made(seed)
        df = spark.createDataFrame([Row(spans=0, **r.asDict(), n=1, x="") for r in rows]).repartition(3)
        got = {r.doc_id: (r.n_repeated_words, r.n_removable_words, words(r.spans), words(r.removable)) for r in S.repeated_passages(df).collect()}
        assert got == brute(rows, 50)


def test_cut(spark):
    rng = random.Random(5)
    a, b, c = ([f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (70, 30, 20))
    texts = {1: " ".join([*b, *a]), 2: "Lead é \n" + " ".join(a) + " tail", 3: " ".join(a), 4: " ".join(c), None: " ".join(a), 5: None}
    df = spark.createDataFrame([Row(text=t, doc_id=i, n_chars=-1, _row="x") for i, t in texts.items()], "text string, doc_id long, n_chars long, _row string")
    got = {r.doc_id: r for r in S.cut_passages(df).collect()}
    assert set(got) == {1, 2, 4, 5, None}
    assert (got[2].text, got[2].n_chars, got[2]._row) == ("Lead é \n tail", 13, "x")
    assert got[1].text == texts[1] and got[1].n_chars == -1 and got[None].text == texts[None] and got[5].text is None


def test_partitions_of_few_rows(spark):
    """Neighbours at the edges of partitions, runs and suffixes alike."""
    rows = made(3)[:14]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for parts, batch in ((12, 10000), (3, 7), (2, 3)):
            for k, v in zip(old, (parts, "false", batch), strict=True):
                spark.conf.set(k, v)
            got = {r.doc_id: (r.n_repeated_words, r.n_removable_words, words(r.spans), words(r.removable)) for r in S.repeated_passages(spark.createDataFrame(rows)).collect()}
            assert got == brute(rows, 50)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_long_texts_and_large_groups(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    part, long = text(300), text(40_000)
    rows = [Row(doc_id=i, text=f"{text(20)} {part} {text(20)}") for i in range(80)] + [Row(doc_id=100 + i, text=part) for i in range(40)]
    rows += [Row(doc_id=200, text=f"{long} {part} x {long}"), Row(doc_id=201, text="a b " * 4_000), Row(doc_id=202, text="")]
    got = {r.doc_id: (r.n_repeated_words, r.n_removable_words, words(r.spans), words(r.removable)) for r in S.repeated_passages(spark.createDataFrame(rows).repartition(4)).collect()}
    assert got == brute(rows, 50)


def test_equal_ids_with_different_texts(spark):
    a = " ".join(f"w{i}" for i in range(70))
    rows = [Row(doc_id=0, text=a), Row(doc_id=1, text="x " + a), Row(doc_id=1, text="short one"), Row(doc_id=1, text="x " + a), Row(doc_id=1, text="y " + a)]
    got = sorted((r.doc_id, r.n_removable_words) for r in S.repeated_passages(spark.createDataFrame(rows)).collect())
    assert got == [(0, 0), (1, 70), (1, 70)]
    assert sorted((r.doc_id, r.text) for r in S.cut_passages(spark.createDataFrame(rows)).collect()) == [(0, a), (1, "short one"), (1, "x "), (1, "x "), (1, "y ")]


def test_clashing_names(spark):
    a = " ".join(f"w{i}" for i in range(70))
    names = ["_id", "_gone", "_t", "_row", "id", "print", "gone", "t", "row", "cut", "c0", "l", "at", "n"]
    df = spark.createDataFrame([(i, a, *([i] * len(names))) for i in range(2)], ["doc_id", "text", *names])
    out = S.cut_passages(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(0, a, *([0] * len(names)))]
    assert S.repeated_passages(df).count() == 2


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([Row(doc_id=1, text=" ".join(map(str, range(80))))] * 2)
    assert S.repeated_passages(df).count() == 0 and S.cut_passages(df).count() == 2
    assert S.repeated_passages(df.limit(0)).count() == 0
