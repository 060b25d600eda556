"""Language identification by sparse multinomial logistic regression.

Character 1- to 3-grams, hashed to ``DIM`` places, are weighted by TF-IDF and
scaled to length one.  The weights are learnt by follow-the-regularised-leader
with L1 and L2 penalties, a rate for each coordinate, so most stay exactly zero.
A temperature, fitted on a part of the sample that the weights have not seen,
makes the softmax's largest entry a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Learnt from: about so many documents of each language, and in all (8 of each at least), of at most so many bytes where a language has such.
ROWS, TOTAL, LONGEST = 1000, 64_000, 1 << 16
#: Products of n-grams and languages that are formed at once.
CELLS = 1 << 22
DIM = 1 << 13
UNKNOWN = "und"
_K = T.seeds(3, 4242) | np.uint64(1)
_IS_LETTER = np.ones(0x80, bool)
_IS_LETTER[[i for i in range(0x80) if not chr(i).isalpha()]] = False


def counts(column: pa.Array, size: int = 1 << 19):
    """Runs of documents: the numbers of their n-grams, a row of ``DIM`` each.  The texts are in lower case."""
    buf, offsets, _ = T.utf8(column)
    for lo, hi in T.groups(offsets, size):
        raw = buf[offsets[lo] : offsets[hi]]
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[offsets[lo : hi + 1] - offsets[lo]]
        doc = np.repeat(np.arange(hi - lo), np.diff(chars))
        letter = np.where(points < 0x80, _IS_LETTER[np.minimum(points, 0x7F)], True)
        c = np.where(letter, points, 32).astype(np.uint64)
        out = np.zeros((hi - lo) * DIM, np.float32)
        h = np.zeros(len(c), np.uint64)
        for n in range(min(3, len(c))):
            h = h[: len(c) - n] + (c[n:] + np.uint64(n << 24)) * _K[n]
            ok = doc[n:] == doc[: len(c) - n]
            ok &= letter[n:] | letter[: len(c) - n]
            out += np.bincount(doc[: len(c) - n][ok] * DIM + (T.mix(h[ok]) >> np.uint64(64 - 13)).astype(np.int64), minlength=len(out))
        yield out.reshape(hi - lo, DIM)


@dataclass
class Model:
    names: list[str]
    idf: np.ndarray
    weights: np.ndarray  # DIM + 1 rows, the last the bias
    temperature: float = 1.0

    def logits(self, n: np.ndarray) -> np.ndarray:
        """Of documents by the numbers of their n-grams.  Only the n-grams that they have are looked at."""
        row, at = np.nonzero(n)
        v = np.log1p(n[row, at]) * self.idf[at]
        norm = np.maximum(np.sqrt(np.bincount(row, v * v, len(n))), 1e-9)
        learnt = self.weights[:-1].any(1)[at]
        row, at, v = row[learnt], at[learnt], v[learnt] / norm[row[learnt]]
        out = np.zeros((len(n), self.weights.shape[1])) + self.weights[-1]
        step = max(1, CELLS // self.weights.shape[1])
        for i in range(0, len(row), step):
            some = slice(i, i + step)
            r, first = np.unique(row[some], return_index=True)
            out[r] += np.add.reduceat(v[some, None] * self.weights[at[some]], first)
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 4) -> np.ndarray:
    """Weights from rows of (places, values); the last place is the bias's, which is not penalised."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))
    rng = np.random.default_rng(3)
    first, second = np.full(DIM + 1, l1)[:, None], np.full(DIM + 1, l2)[:, None]
    first[-1] = second[-1] = 0

    def weights(at):
        return np.where(np.abs(z[at]) <= first[at], 0, -(z[at] - np.sign(z[at]) * first[at]) / ((beta + np.sqrt(n[at])) / alpha + second[at]))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            p = softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(np.arange(DIM + 1))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows: int = ROWS, total: int = TOTAL) -> Model:
    """A model of every language, from about ``rows`` documents of each, none held out.

    With more than ``total`` / ``rows`` languages each has fewer, 8 at least, so that the sample stays
    bounded by ``total`` or 8 a language.  Of a language that has longer texts alone, the shortest is learnt.
    """
    spark = docs.sparkSession
    known = docs.select(F.col(doc_id).alias("k"), F.lower(F.col(text).cast("string")).alias("t"), F.col(lang).cast("string").alias("l")).filter(F.col("l").isNotNull() & F.col("t").rlike("\\p{L}") & (F.coalesce(T.crc_rest(F.col("k"), 4), F.lit(0)) != 2))
    size = F.octet_length("t")
    sizes = known.groupBy("l").agg(F.count_if(size <= LONGEST).alias("n"), F.min(size).alias("least")).collect()  # a row for each language
    each = max(8, min(rows, total // max(1, len(sizes))))
    # Each language's documents with the least hash, as large a share as makes the number.
    share = spark.createDataFrame([(r.l, min(1.0, each / max(1, r.n)), max(LONGEST, r.least)) for r in sizes], "l string, share double, most int")
    some = known.join(share, "l").filter((size <= F.col("most")) & (F.pmod(F.xxhash64("k", "t"), F.lit(1 << 30)) < F.col("share") * (1 << 30))).select("k", "t", "l")

    def run(batches):
        for batch in batches:
            at, n = [], []
            for x in counts(batch.column(1)):
                for r in x:
                    i = np.flatnonzero(r)
                    at.append(i.astype(np.uint16).tobytes())
                    n.append(r[i].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["l", "at", "n"])

    got = sorted(((r.l, np.frombuffer(r.at, np.uint16).astype(np.int64), np.frombuffer(r.n, np.float32)) for r in some.mapInArrow(T.freed(run), "l string, at binary, n binary").collect()), key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
    names = sorted({r[0] for r in got})
    df = np.zeros(DIM)
    for _, at, _ in got:
        df[at] += 1
    idf = (np.log((1 + len(got)) / (1 + df)) + 1).astype(np.float32)
    model = Model(names, idf, np.zeros((DIM + 1, max(1, len(names)))))
    if len(names) < 2:
        return model
    x, y = [], np.array([names.index(r[0]) for r in got])
    for _, at, n in got:
        v = np.log1p(n) * idf[at]
        x.append((np.append(at, DIM), np.append(v / max(np.sqrt((v * v).sum()), 1e-9), 1.0)))
    later = np.random.default_rng(5).random(len(x)) < 0.2
    if not later.any() or later.all():
        later = np.arange(len(x)) % 5 == 4
    model.weights = ftrl([r for r, o in zip(x, later, strict=True) if not o], y[~later], len(names))
    logits = np.array([v @ model.weights[at] for (at, v), o in zip(x, later, strict=True) if o])
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(logits)), y[later]] + 1e-12).mean()
    model.temperature = float(min(np.geomspace(0.05, 5, 100), key=loss)) if len(logits) else 1.0
    model.weights = model.weights.astype(np.float32)
    return model


def identify(df: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred and score for each row.

    A text without a letter, and a null one, is ``und`` with score 0; so is every text if no language
    was learnt.  Rows are judged one by one: repeats, null ids and an empty table need no rule;
    other columns are not looked at.
    """
    src = df.select(F.col(doc_id).alias("k"), F.lower(F.col(text).cast("string")).alias("t"), F.coalesce(F.col(text).cast("string").rlike("\\p{L}"), F.lit(False)).alias("ok"))

    def run(batches):
        for batch in batches:
            done = 0
            for n in counts(batch.column(1)):
                ok = np.asarray(batch.column(2).slice(done, len(n))).astype(bool) & bool(model.names)
                p = softmax(model.logits(n) / model.temperature)
                best = p.argmax(1)
                names = [model.names[i] if good else UNKNOWN for i, good in zip(best.tolist(), ok.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(n)), pa.array(names, pa.string()), pa.array(np.where(ok, p.max(1), 0.0).astype(np.float64))], ["k", "lang_pred", "score"])
                done += len(n)

    out = src.mapInArrow(T.freed(run), f"k {src.dtypes[0][1]}, lang_pred string, score double")
    return out.select(F.col("k").alias(doc_id), "lang_pred", "score")


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs)).select("doc_id", F.coalesce(T.crc_rest(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
