import math
import random
import re

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from tideql.llm import language, quality_mil, quality_rules, toxicity
from tideql.llm import text as T

RNG = random.Random(2)


def prose(n, letters="abdeilnorst"):
    return " ".join("".join(RNG.choice(letters) for _ in range(RNG.randint(2, 8))) for _ in range(n))


def brute_segments(s):
    """By the definition: best run first, then the same on both sides."""

    def rec(a, z):
        if not (s[a:z] > 0).any():
            return []
        sums = np.concatenate(([0], np.cumsum(s[a:z])))
        i, j = max((sums[j] - sums[i], i - j, (i, j)) for i in range(z - a) for j in range(i + 1, z - a + 1))[2]
        return [*rec(a, a + i), (a + i, a + j, s[a + i : a + j].sum()), *rec(a + j, z)]

    return rec(0, len(s))


def test_segments_by_definition():
    for seed in range(200):
        s = np.random.default_rng(seed).normal(-0.3, 1, 25)
        got, want = toxicity.segments(s), brute_segments(s)
        assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])


def logistic(x):
    return 1 / (1 + math.exp(-x))


def plain_toxicity(m, text):
    """The score by its definition, word by word."""
    words = re.findall("(?:[a-z]|[^\x00-\x7f])+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
    odds = dict(zip(m.words.tolist(), m.odds.tolist(), strict=True))
    s = np.array([odds.get(T.word_hash(w), 0.0) - m.drift for w in words])
    chance = math.log(max(m.k * len(words), 1e-9))
    nats = [m.rate * x - chance for _, _, x in (brute_segments(s) if len(s) else []) if m.rate * x > chance]
    return logistic(m.weight * math.log1p(sum(nats)) + m.bias), len(nats)


def plain_quality(m, text):
    """The score of one bag, passage by passage."""
    raw, size = (text or "").encode(), quality_mil.PASSAGE
    kinds, n = quality_rules._CLASS, quality_mil._N
    words = [(x.start(), x[0].lower()) for x in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    hs = []
    for a in range(0, max(1, len(raw)), size):
        z = min(a + size, len(raw))
        one, two = [0.0] * n, [0.0] * (n * n)
        for i in range(a, z):
            one[kinds[raw[i]]] += 1
            if i:
                two[kinds[raw[i - 1]] * n + kinds[raw[i]]] += 1
        mine = [i for i, (at, _) in enumerate(words) if a <= at < z]
        share = lambda f: sum(map(f, mine)) / max(1, len(mine))
        more = [share(lambda i: i > 0 and words[i][1] == words[i - 1][1]), share(lambda i: words[i][1] in [w for _, w in words[:i]]), share(lambda i: len(words[i][1])) / 10, min(len(mine) / 80, 2), math.log1p(z - a) / 6]
        x = (np.array([v / max(1, z - a) for v in one + two] + more) - m.mean) / m.scale
        hs.append(np.tanh(x @ m.p["W"] + m.p["b"]))
    weigh = [math.exp(sum(m.p["w"][j] * math.tanh(h @ m.p["V"][:, j]) * logistic(h @ m.p["U"][:, j]) for j in range(quality_mil.GATE))) for h in hs]
    z = sum(w / sum(weigh) * h for w, h in zip(weigh, hs, strict=True))
    return logistic(float(z @ m.p["c"] + m.p["d"][0]))


def plain_language(m, text):
    """Label and probability by the definition, n-gram by n-gram."""
    if not re.search("[^\\W\\d_]", text or ""):
        return "und", 0.0
    c = [ord(x) if x.isalpha() or ord(x) > 0x7F else 32 for x in text.lower()]
    counts = {}
    for n in (1, 2, 3):
        for i in range(len(c) - n + 1):
            if c[i] != 32 or c[i + n - 1] != 32:
                h = sum((c[i + j] + (j << 24)) * int(language._K[j]) for j in range(n)) % 2**64
                at = int(T.mix(np.array([h], np.uint64))[0]) >> 51
                counts[at] = counts.get(at, 0) + 1
    v = {at: math.log1p(n) * m.idf[at] for at, n in counts.items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    logits = [sum(x / norm * m.weights[at, k] for at, x in v.items()) + m.weights[-1, k] for k in range(len(m.names))]
    e = [math.exp((x - max(logits)) / m.temperature) for x in logits]
    return m.names[int(np.argmax(e))], max(e) / sum(e)


def test_toxic_passages_are_found(spark):
    bad = ["vileword", "foulword", "Grimword"]
    texts, labels = [], []
    for i in range(400):
        w, toxic = prose(60).split(" "), i % 4 == 0
        if toxic:
            for _ in range(5):
                w.insert(RNG.randint(20, 30), RNG.choice(bad))
        texts.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    extra = [(1000, None), (1001, ""), (1002, "x " * 20000), (None, "vileword foulword grimword vileword"), (None, "vileword foulword grimword vileword")]
    df = spark.createDataFrame([Row(doc_id=i, text=t, score="clash", y=3) for i, t in texts + extra], "doc_id long, text string, score string, y int").repartition(3)
    model = toxicity.train(df, spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int"))
    got = toxicity.score(df, model).collect()
    by = {r.doc_id: r for r in got}
    held = [i for i, _ in labels if spark.range(1).select(T.crc_rest(F.lit(i).cast("long"), 5)).first()[0] == 0]
    assert len(got) == len(texts) + 5 and all(by[i].predicted == dict(labels)[i] for i in held)
    p = by[0].passages[0]
    assert "word" in texts[0][1].encode()[p.start : p.stop].decode() and p.stop - p.start < len(texts[0][1]) / 2
    assert [r.predicted for r in got if r.doc_id is None] == [1, 1] and not any(by[i].predicted for i in (1000, 1001, 1002))
    assert toxicity.score(df.limit(0), model).count() == 0
    for r, (i, t) in zip(sorted((r for r in got if r.doc_id is not None and r.doc_id < 40), key=lambda r: r.doc_id), texts[:40], strict=True):
        want, n = plain_toxicity(model, t)
        assert r.doc_id == i and abs(r.score - want) < 1e-6 and len(r.passages) == n
    assert all(abs(by[i].score - plain_toxicity(model, "")[0]) < 1e-9 for i in (1000, 1001))


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.score(df, toxicity.train(df, none)).first().score == 0.5
    assert quality_mil.score(df, quality_mil.train(df, none)).first().score == 0.5
    model = language.train(df.selectExpr("*", "null as lang"))
    assert language.identify(df, model).first().lang_pred == "und"


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    f, h, g = quality_mil.FEATURES, quality_mil.HIDDEN, quality_mil.GATE
    p = {k: rng.normal(0, 0.3, s) for k, s in {"W": (f, h), "b": (h,), "V": (h, g), "U": (h, g), "w": (g,), "c": (h,), "d": (1,)}.items()}
    x, at, y = rng.normal(size=(9, f)), np.array([0, 2, 3, 9]), np.array([1.0, 0, 1])
    loss = lambda: -np.mean(np.log(np.where(y == 1, o := quality_mil.forward(p, x, at)["y"], 1 - o)))
    grad = quality_mil.gradients(p, x, at, y)
    for k in p:
        i = tuple(rng.integers(0, n) for n in p[k].shape)
        p[k][i] += 1e-5
        up = loss()
        p[k][i] -= 2e-5
        down = loss()
        p[k][i] += 1e-5
        assert abs((up - down) / 2e-5 - grad[k][i]) < 1e-6, k


def test_quality_is_learnt(spark):
    rows, labels = [], []
    for i in range(500):
        good, text = i % 3 > 0, prose(RNG.randint(10, 400))
        cut = RNG.randint(0, len(text) // 2)
        rows.append((i, text if good else text[:cut] + " ".join(w + "%%%" for w in text[cut:].split(" "))))
        labels.append((i, int(good)))
    rows += [(900, None), (901, ""), (902, "word " * 20000), (None, "a"), (None, "a")]
    df = spark.createDataFrame([Row(doc_id=i, text=t, x=1, at=2) for i, t in rows]).repartition(2)
    model = quality_mil.train(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = quality_mil.score(df, model).withColumn("held", T.crc_rest(F.col("doc_id"), 5) == 0).collect()
    held = [(r.predicted, dict(labels)[r.doc_id]) for r in got if r.held and r.doc_id is not None and r.doc_id < 500]
    assert len(got) == 505 and np.mean([a == b for a, b in held]) > 0.97
    assert all(abs(sum(r.attention) - 1) < 1e-6 and 0 <= r.score <= 1 for r in got)
    assert quality_mil.score(df.limit(0), model).count() == 0
    text = {i: t for i, t in rows if i is not None}
    assert all(abs(r.score - plain_quality(model, text[r.doc_id])) < 1e-4 for r in got if r.doc_id is not None and (r.doc_id < 60 or r.doc_id in (900, 901)))


def test_language_is_learnt(spark):
    letters = {"xa": "abcdef", "xb": "abcghi", "xc": "éàü你", "xd": "ЖДИ"}
    rows = [(i, prose(RNG.randint(3, 80), letters[x := list(letters)[i % 4]]), x) for i in range(400)]
    rows += [(900, None, "xa"), (901, "12 !!", None), (902, "", None), (903, "ABCDEF fed", None), (None, "你é", None), (None, "你é", None), (905, "жди " * 30000, None)]
    df = spark.createDataFrame([Row(doc_id=i, text=t, lang=x, l=1, count=2) for i, t, x in rows]).repartition(3)
    model = language.train(df)
    assert (model.weights == 0).mean() > 0.8
    got = language.identify(df, model).withColumn("held", T.crc_rest(F.col("doc_id"), 4) == 2).collect()
    by, truth = {r.doc_id: r for r in got}, {i: x for i, _, x in rows}
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held and r.doc_id is not None and r.doc_id < 400]
    assert len(held) > 60 and np.mean(held) > 0.97 and len(got) == len(rows)
    assert [by[i].lang_pred for i in (900, 901, 902, 903, 905)] == ["und", "und", "und", "xa", "xd"] and all(0 <= r.score <= 1 for r in got)
    assert language.identify(df.limit(0), model).count() == 0
    for i, t, _ in rows[:60] + rows[400:404]:
        name, p = plain_language(model, t)
        assert by[i].lang_pred == name and abs(by[i].score - p) < 1e-4


def test_many_languages_and_long_texts(spark, monkeypatch):
    """No language is left out, be there more than the sample would hold, or longer texts alone."""
    monkeypatch.setattr(language, "LONGEST", 400)
    names = [f"l{i:03d}" for i in range(300)]
    rows = [(i * 300 + j, " ".join([chr(0x4E00 + 7 * j) * 3 + chr(0x4E01 + 7 * j)] * (400 if j == 5 else 4)), name) for i in range(4) for j, name in enumerate(names)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), total=300)
    assert model.names == names
