import random
import re

from pyspark.sql import Row

from tideql.llm import quality_rules as Q


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, lines = set(), 0
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            lines += x in seen
            seen.add(x)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), lines, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w))


def prose(rng, n, lang):
    common = {"en": ["the", "of", "and", "to"], "de": ["der", "die", "und", "für"]}[lang]
    return " ".join(rng.choice(common) if rng.random() < 0.3 else "".join(rng.choice("abdeilnorst") for _ in range(rng.randint(2, 9))) for _ in range(n)).capitalize() + "."


def made():
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(60, 200), lang), lang) for i in range(80) for lang in [rng.choice(["en", "de"])]]
    rows += [(100, " | ".join(prose(rng, 150, "en").split()), "en"), (101, prose(rng, 150, "de").upper(), "de"), (102, " ".join(w + "%%" for w in prose(rng, 150, "en").split()), None)]
    rows += [(200, None, "en"), (201, "", None), (202, "é x\n\n é x\né x\n \né x", "xx"), (203, "a b c d e f " * 800, "en"), (204, "one two three four five six seven eight nine ten", "en"), (205, "a b c d e f a b c d e", "en"), (206, "a b c d e " * 2 + prose(rng, 39, "en"), "en"), (207, "a b c d e " * 2 + prose(rng, 41, "en"), "en")]
    return rows


def test_base_against_brute_force_and_verdicts(spark):
    rows = made()
    df = spark.createDataFrame([Row(doc_id=i, text=t, lang=x, kept="no", a=1) for i, t, x in rows], "doc_id long, text string, lang string, kept string, a int").repartition(3)
    got = {r.doc_id: r for r in Q.judge(df).collect()}
    assert {i: tuple(r[1:7]) for i, r in got.items()} == {i: brute(t) for i, t, _ in rows}
    assert all(got[i].kept for i in range(80)) and not any(got[i].kept for i in (100, 101, 102, 200, 201, 203))
    assert got[204].kept and not any(r.kept for r in got.values() if r.base_failed)
    kept = Q.filter_documents(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_without_languages_and_empty(spark):
    df = spark.createDataFrame([Row(doc_id=None, text="w" * 30 + " x" * 4 + " 1 2 3 4 5 6 7", lang=None)] * 2, "doc_id long, text string, lang string")
    assert [r.kept for r in Q.judge(df).collect()] == [True, True]
    assert Q.judge(df.limit(0)).count() == 0 and Q.filter_documents(df.limit(0)).count() == 0


def test_distance():
    import numpy as np

    assert Q.distance(np.array([[1.0, 0], [0, 1], [0, 0]]), np.array([[1.0, 0]])).round(6).tolist() == [0, 1, 0]


def cyrillic(rng, words, letters):
    return " ".join("".join(rng.choice("абвгдежзиклмнопрстуф") for _ in range(letters)) for _ in range(words)) + "."


def test_every_language_has_a_reference(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 80, "en"), f"l{i // 2:03}") for i in range(140)] + [(500, cyrillic(rng, 80, 6), "zz"), (501, cyrillic(rng, 80, 6), "zz")]
    rows += [(600, cyrillic(rng, 80, 12).replace(" ", "").replace(".", ""), "two"), (601, "x" * 400, "two"), (700, "%%& " * 99, None), (701, prose(rng, 150, "en").upper(), None)]
    df = spark.createDataFrame([Row(doc_id=i, text=t, lang=x) for i, t, x in rows]).repartition(3)
    got = {r.doc_id: r for r in Q.judge(df).collect()}
    assert all(got[i].kept for i in [*range(140), 500, 501]) and got[701].char_distance > Q.MOST_CHAR_DISTANCE


def test_language_without_words_has_a_character_reference(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 80, "en"), "en") for i in range(6)] + [(i, cyrillic(rng, 15, 20), "zz") for i in range(6, 12)]
    rows += [(20, " ".join(rng.choice("abcdefgh") for _ in range(60)), "yy"), (21, prose(rng, 150, "en").upper(), None)]
    df = spark.createDataFrame([Row(doc_id=i, text=t, lang=x) for i, t, x in rows]).repartition(3)
    chars, words = Q.references(df, "text", "lang")
    got = {r.doc_id: r for r in Q.judge(df).collect()}
    assert (len(chars), len(words)) == (2, 2)
    assert all(got[i].kept for i in range(12)) and got[21].char_distance > Q.MOST_CHAR_DISTANCE
