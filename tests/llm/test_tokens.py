import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import Row

from tideql.llm import sentencepiece_table, token_counts

TEXTS = ["", None, " ", "  ", "a", " a", "a ", "a  b", "▁a ▁ b▁", "one two\nthree\tfour\x00", "</s> <s> <unk> <0x0A>", "ﬁ Ａ é 你好 🎉🎉", "x" * 5000, "word " * 3000, "\n\n", "a b", " \n lead", "trail \n ", "the the the", "the the the"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([Row(doc_id=i if i != 3 else None, text=t, n_tokens="clash", ids=i) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, n_tokens string, ids int")


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_encode_is_the_librarys(spark, docs, sp):
    got = sentencepiece_table.encode(docs.coalesce(1)).collect()
    assert len(got) == 2 * len(TEXTS)
    for r, t in zip(got, TEXTS * 2, strict=True):
        ids = sp.encode(t or "", add_eos=True)
        assert (r.ids, r.decoded) == (ids, sp.decode(ids))
    d = sentencepiece_table.digest(sentencepiece_table.encode(docs.coalesce(1))).collect()
    assert d[9].ids_sha256 == hashlib.sha256(" ".join(map(str, sp.encode(TEXTS[9], add_eos=True))).encode()).hexdigest()


def test_parts_share_nothing(sp):
    t = sentencepiece_table.Chunks()
    for most in (1, 10, 100, 1 << 20):
        got = [x for some in sentencepiece_table.parts(pa.array(TEXTS * 2), most) for x in sentencepiece_table._joined(some, t, False, True)[0].to_pylist()]
        assert got == [sp.encode(x or "") for x in TEXTS * 2]


def test_other_models_go_whole(sp):
    t = sentencepiece_table.Chunks()
    t.apart = False
    words, at = t.split(pa.array(["a  b", None, "", "c d"]))
    assert (words.to_pylist(), at.tolist()) == (["a  b", "c d"], [0, 1, 1, 1, 2])
    assert sentencepiece_table._joined(pa.array(["a  b", "", None]), t, True, True)[0].to_pylist() == [sp.encode(x, add_eos=True) for x in ("a  b", "", "")]


def test_counts_are_the_librarys(spark, docs, sp):
    for kw in ({}, {"cache": 3, "leaders": 2, "most": 1}):
        got = token_counts.count_tokens(docs.coalesce(1), limit=3, **kw).collect()
        assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in got] == [(len((t or "").encode()), n := len(sp.encode(t or "")), n > 3) for t in TEXTS * 2]


def test_empty(spark, docs):
    assert token_counts.count_tokens(docs.limit(0)).count() == 0
    assert sentencepiece_table.encode(docs.limit(0)).count() == 0
