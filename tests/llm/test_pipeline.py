import random
import re

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import Row
from test_minhash import brute as near
from test_native import brute_hits
from test_suffix_array import brute as passages

import corpus_pipeline
from tideql.llm import quality_rules


def cut(text, gone):
    places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out, at, i = "", 0, 0
    while i < len(places):
        if i in gone:
            j = i
            while j in gone:
                j += 1
            out, at, i = out + text[at : places[i][0]], places[j - 1][1], j
        else:
            i += 1
    return out + text[at:]


@pytest.mark.parametrize("rows", [True, False])
def test_against_brute_force(spark, tmp_path, rows):
    rng = random.Random(9)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choice("abdeilnorst") for _ in range(rng.randint(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, items = [text(70), text(55)], [text(30) for _ in range(4)]
    docs = [text(rng.randint(80, 160)) for _ in range(40)]
    for i in range(0, 40, 4):
        docs[i] += "\n" + rng.choice(shared) + " end"
    docs[5] += " " + items[0]
    docs += [docs[1], docs[1] + " more", docs[2] + " \nmore", "short", None, docs[9].upper() + "!!", " | ".join(docs[8].split())]
    docs = docs if rows else []
    df = spark.createDataFrame([Row(doc_id=i, text=t, lang="en", source="s", n_chars=len(t or ""), ids="x") for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long, ids string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(enumerate(items), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [Row(doc_id=r.doc_id, text=docs[r.doc_id]) for r in quality_rules.judge(df).collect() if r.kept]
    one = near(kept, 5, 80)
    kept = [r for r in kept if one[r.doc_id][2]]
    gone = passages(kept, 50)
    kept = [(r.doc_id, cut(r.text, gone[r.doc_id][3]) if r.doc_id in gone else r.text) for r in kept]
    bad = brute_hits(kept, list(enumerate(items)), 13)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: sp.encode(t, add_eos=True) for i, t in kept if t.strip() and not bad[i][4]}
    assert {r.doc_id: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want
    assert not rows or (5 not in want and 25 < len(want) < 40 and any(r.doc_id in gone and gone[r.doc_id][1] for r in spark.createDataFrame([Row(doc_id=i) for i in want]).collect()))


def test_stages_keep_columns(spark, tmp_path):
    df = spark.createDataFrame([Row(doc_id=i, text=" ".join(f"w{i}x{j}" for j in range(80)), lang="en", source="s", n_chars=1, extra=[1]) for i in range(3)])
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.dtypes == df.dtypes, name
        assert out.count() == 3


def test_decontamination_cuts_hits_below_the_threshold(spark, tmp_path):
    words = lambda p, n: [f"{p}{i}" for i in range(n)]
    a, b, pad, more = words("Ab", 14), words("c", 13), words("pad", 300), words("é", 300)
    texts = {
        1: " ".join(pad) + "\n(" + ", ".join(a) + ") " + " ".join(more) + " --",
        2: "  " + "--".join(b).upper() + ".\n" + " ".join(pad),
        3: " ".join(pad) + " | " + " ".join(b),
        4: " ".join([*pad, *a[:7], *b, *a[7:], *more]),  # a's windows meet where b is cut
        5: " ".join([*pad, *b, *more, *b, *a[:12]]) + "!?",
        6: " ".join([*pad[:30], *a]),
        7: " ".join(pad),
        8: None,
    }
    want = {
        1: " ".join(pad) + "\n() " + " ".join(more) + " --",
        2: "  .\n" + " ".join(pad),
        3: " ".join(pad) + " | ",
        4: " ".join(pad) + "  " + " ".join(more),
        5: " ".join(pad) + "  " + " ".join(more) + "  " + " ".join(a[:12]) + "!?",
        7: texts[7],
        8: None,
    }
    df = spark.createDataFrame([Row(doc_id=i, text=t, n_chars=-1) for i, t in [*texts.items(), (1, texts[1])]], "doc_id long, text string, n_chars int").repartition(3)
    spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.decontamination(spark, df, str(tmp_path))
    assert got.dtypes == df.dtypes
    got = got.collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2, 3, 4, 5, 7, 8]
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.n_chars == (-1 if r.doc_id > 6 else len(r.text)) for r in got)
    left = brute_hits([(r.doc_id, r.text) for r in got], [(1, " ".join(a)), (2, " ".join(b))], 13)
    assert not any(x[1] for x in left.values())


def test_encoding_decodes(spark, tmp_path):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["two words", " Ünï  côde \n東京 \U0001f600 ", "", None, "two words"]
    df = spark.createDataFrame([Row(doc_id=i, text=t, lang="en", source="s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.n_tokens, r["ids"], r.decoded) for r in corpus_pipeline.encoding(spark, df, str(tmp_path)).collect()}
    ids = [sp.encode(t or "", add_eos=True) for t in texts]
    assert got == {i: (len(x), x, sp.decode(x)) for i, x in enumerate(ids)}
