import random
import re

from pyspark.sql import Row

from tideql.llm import decontaminate as D
from tideql.llm import licenses as L

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(docs, items, n):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1)) if w else ():
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, who = words(t), set(), set()
        for k in {len(g) for g in grams}:
            for p in range(len(w) - k + 1):
                if (g := tuple(w[p : p + k])) in grams:
                    hit |= set(range(p, p + k))
                    who |= {str(x) for x in grams[g] if x is not None}
        out[d] = (len(w), len(hit), hit, sorted(who), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_contamination_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "of", "Déjà", "x1", "Quiz"]) + rng.choice(["", "a", "Bc"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 5, 12, 13, 14, 30])))) for i in range(25)] + [(98, None), (99, "..."), (None, "null item has thirteen words or more in it so that it is a window")]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            w += (items[rng.randrange(25)][1]).split(" ")[rng.choice([0, 0, 1]) :]
        docs.append((i, rng.choice([" ", "--", ", \n"]).join(w)))
    docs += [(100, None), (101, ""), (102, "!!"), (103, items[-1][1].upper() + " " + "pad " * 3000)]
    df = spark.createDataFrame([Row(doc_id=i, text=t, x=1, gram=2, print=3) for i, t in docs]).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", D.F.lit(1))
    for block in (D.BLOCK, 12_000):
        got = {r.doc_id: (r.n_words, r.n_hit, {j for s in r.spans for j in range(s.start, s.stop)}, r["items"], r.contaminated) for r in D.contamination(df, bench, block=block).collect()}
        assert got == brute_hits(docs, items, 13)


def test_contamination_edges(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    df = spark.createDataFrame([Row(doc_id=None, text="x A, b C"), Row(doc_id=1, text="a b c"), Row(doc_id=1, text="a b c"), Row(doc_id=1, text="no"), Row(doc_id=2, text=None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_hit) for r in D.contamination(df, bench).collect())
    assert got == [(0, 3), (1, 0), (1, 3), (1, 3), (2, 0)]
    assert sorted(r.text or "" for r in D.drop_contaminated(df, bench).collect()) == ["", "no"]
    assert [r.n_hit for r in D.contamination(df, bench.limit(0)).collect()] == [0] * 5
    assert D.contamination(df.limit(0), bench).count() == 0


def test_clashing_names(spark):
    bench = spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(13)))], "item_id long, text string")
    names = ["_i", "_p", "_s", "_c", "row", "id", "print", "of", "its", "new", "spans", "contaminated", "norm", "gram"]
    texts = {1: "clean", 2: " ".join(f"b{i}" for i in range(13)), 3: " ".join(["pad"] * 400 + [f"b{i}" for i in range(13)])}
    df = spark.createDataFrame([(i, t, *([i] * len(names))) for i, t in texts.items()], ["doc_id", "text", *names])
    out = D.drop_contaminated(df, bench)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, "clean", *([1] * len(names))), (3, "pad " * 400, *([3] * len(names)))]


def brute_scan(text):
    w = words(text)
    at = [(i, label) for p, label in L.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    share, labels = 0.0, {x for _, x in at}
    for label, t, block in L.template_sets():
        for i in range(len(w)) if 100 * len(set(t) & set(w)) >= L.PERCENT * len(t) else ():
            n = len(set(t) & set(w[i : i + block]))
            if 100 * n >= L.PERCENT * len(t):
                share, labels = max(share, n / len(t)), labels | {label}
    places = [i for i, _ in at]
    return (len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})), ",".join(sorted(labels)), 1.0 if at else share)


def test_scan_against_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", "--", "MIT license mit License", "cc-by CC BY cc by", "gnu general public license " * 3, "the " * 5000 + "Apache License", "éMIT license", "mit licensé"]
    for _ in range(80):
        w = [rng.choice(["the", "license", "under", "free", "0", "2", "this", "software", "x"]) for _ in range(rng.randint(0, 90))]
        _, t = L.TEMPLATES[rng.randrange(len(L.TEMPLATES))]
        t = [x for x in t.split(" ") if rng.random() > rng.choice([0, 0.1, 0.3])]
        at = rng.randint(0, len(w))
        texts.append(rng.choice([" ", "\n"]).join(w[:at] + t + w[at:]))
    df = spark.createDataFrame([Row(doc_id=i, text=t, w="x", norm=1, n=1) for i, t in enumerate(texts)]).repartition(3)
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in L.scan(df).collect()}
    assert got == {i: brute_scan(t) for i, t in enumerate(texts)}
    assert sum(bool(x[5]) for x in got.values()) > 30
    assert L.scan(df.limit(0)).count() == 0


def test_scan_finds_a_worn_template_at_every_offset(spark):
    """Wherever it stands, with words missing and others in between."""
    rng = random.Random(8)
    label, t = max(L.TEMPLATES, key=lambda x: len(x[1]))
    w = []
    for x in t.split(" "):
        w += [x] * (rng.random() > 0.05) + ["other"] * (rng.random() < 0.4)
    df = spark.createDataFrame([Row(doc_id=i, text=" ".join(["pad"] * i + w + ["pad"] * 100)) for i in range(70)]).repartition(2)
    assert {r.labels for r in L.scan(df).collect()} == {brute_scan(" ".join(w))[5]}
    assert label in brute_scan(" ".join(w))[5]
    own = [("own", " ".join(f"t{i}" for i in range(150)))]  # a template of a user, longer than any fixed block
    got = L.scan(spark.createDataFrame([Row(doc_id=1, text="x " * 7 + " ".join(f"T{i}" for i in range(20, 145)))]), templates=own).first()
    assert got.labels == "own" and abs(got.score - 125 / 150) < 1e-9
