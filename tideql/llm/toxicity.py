"""Toxic passages as maximum-scoring segments of token log-odds.

A token's score is its log-odds between toxic and other labelled documents under
a Dirichlet prior (a part for each word, a part in proportion to its frequency), where that is significant, less
a constant drift; words without significant odds cost the drift.  One pass over a document finds all its maximal scoring
segments (Ruzzo and Tompa).  By extreme-value theory a document of m tokens has K m
exp(-lambda S) segments of score S or more by chance; lambda solves the score
equation on clean documents and K is read from their segments.  The evidence of the
significant segments, in nats beyond chance, goes through a logistic curve.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .learning import logistic, rated, sample, sigmoid
from .scratch import Scratch

ROWS = 20_000
PRIOR, EACH, LEAST_DOCUMENTS, LEAST_Z, DRIFT = 50.0, 0.5, 3, 2.5, 0.5


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, stop), in linear time."""
    places = np.flatnonzero(score > 0)
    if not len(places):
        return []
    total = np.concatenate(([0.0], np.cumsum(score)))
    start, stop, low, high, back = [], [], [], [], []
    for i in places.tolist():
        a, z, l, r = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= l:
                j = back[j]
            if j < 0 or high[j] >= r:
                break
            a, l = start[j], low[j]  # joined with all from j on
            del start[j:], stop[j:], low[j:], high[j:], back[j:]
        start.append(a)
        stop.append(z)
        low.append(l)
        high.append(r)
        back.append(j)
    return [(a, z, r - l) for a, z, l, r in zip(start, stop, low, high, strict=True)]


@dataclass
class Model:
    words: np.ndarray  # hashes, in order
    odds: np.ndarray
    rate: float
    k: float
    weight: float
    bias: float
    drift: float = DRIFT

    def scores(self, h: np.ndarray) -> np.ndarray:
        """Of each word, by its hash."""
        if not len(self.words):
            return np.full(len(h), -self.drift)
        at = np.searchsorted(self.words, h).clip(max=len(self.words) - 1)
        return np.where(self.words[at] == h, self.odds[at], 0.0) - self.drift

    def passages(self, h: np.ndarray) -> list[tuple[int, int, float]]:
        """(start, stop, nats beyond chance) of each significant passage."""
        chance = np.log(max(self.k * len(h), 1e-9))
        return [(a, z, self.rate * s - chance) for a, z, s in segments(self.scores(h)) if self.rate * s > chance]

    def score(self, found) -> float:
        return float(sigmoid(self.weight * np.log1p(sum(e for _, _, e in found)) + self.bias))


def _documents(column: pa.Array):
    """(hashes, first bytes, end bytes) of the words of each text."""
    buf, offsets, _ = T.utf8(column)
    for lo, hi in T.groups(offsets):
        part = offsets[lo : hi + 1] - offsets[lo]
        b = buf[offsets[lo] : offsets[hi]]
        h, first, end, at = T.words(b, part, T.NOT_LETTER, lower=True)
        for i in range(hi - lo):
            yield h[at[i] : at[i + 1]], first[at[i] : at[i + 1]] - part[i], end[at[i] : at[i + 1]] - part[i]


def _word_counts(labelled: DataFrame) -> DataFrame:
    """(h, toxic, clean): the numbers of documents that have a word."""

    def run(batches):
        for batch in batches:
            y, parts, marks = np.asarray(batch.column(2)), [], []
            for i, (h, _, _) in enumerate(_documents(batch.column(1))):
                u = np.unique(h)
                parts.append(u)
                marks.append(np.full(len(u), y[i], np.int64))
            h, y = (np.concatenate(x or [np.zeros(0, kind)]) for x, kind in ((parts, np.uint64), (marks, np.int64)))
            u, inverse = np.unique(h, return_inverse=True)
            toxic = np.bincount(inverse, y, len(u)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(toxic), pa.array(np.bincount(inverse, minlength=len(u)) - toxic)], ["h", "toxic", "clean"])

    return labelled.mapInArrow(T.freed(run), "h long, toxic long, clean long").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _rate(odds: np.ndarray, clean_hits: np.ndarray, others: float, drift: float) -> float:
    """lambda: the positive root of the mean of exp(lambda score) = 1 on clean tokens."""
    total = clean_hits.sum() + others
    mean = lambda x: (clean_hits * np.exp(x * (odds - drift))).sum() / total + others / total * np.exp(-x * drift)
    hi = 1.0
    while mean(hi) < 1 and hi < 64:
        hi *= 2
    lo = 0.0
    for _ in range(60):
        x = (lo + hi) / 2
        lo, hi = (x, hi) if mean(x) < 1 else (lo, x)
    return max(hi, 1e-3)


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, text: str = "text", doc_id: str = "doc_id") -> Model:
    """A model from at most ``rows`` labelled documents, with odds for every word that has significant ones in them.

    Without both labels the score is the share of toxic documents (a half if there are none).
    """
    scratch = Scratch(docs.sparkSession)
    labelled = scratch.table(sample(docs, labels, "toxic", rows, text, doc_id).select("id", F.col("t"), "y"))
    counts = scratch.table(_word_counts(labelled))
    n1, n0, kinds = (x or 0 for x in counts.agg(F.sum("toxic"), F.sum("clean"), F.count("*")).first())
    d1, d0 = (x or 0 for x in labelled.agg(F.sum("y"), F.sum(1 - F.col("y"))).first())
    if not d1 or not d0 or not n1 or not n0:
        base = (d1 + 1) / (d1 + d0 + 2)
        return Model(np.zeros(0, np.uint64), np.zeros(0), 1.0, 1.0, 0.0, float(np.log(base / (1 - base))))
    prior = EACH + (F.col("toxic") + F.col("clean")) * (PRIOR / (n1 + n0))
    whole = PRIOR + EACH * kinds
    odds = F.log((F.col("toxic") + prior) / (n1 + whole - F.col("toxic") - prior)) - F.log((F.col("clean") + prior) / (n0 + whole - F.col("clean") - prior))
    z = odds / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    top = counts.filter(F.col("toxic") + F.col("clean") >= LEAST_DOCUMENTS).select("h", "clean", odds.alias("odds"), z.alias("z")).filter(F.abs("z") >= LEAST_Z)
    found = top.collect()
    words = np.array([r.h for r in found], np.int64).view(np.uint64)
    order = np.argsort(words)
    odds_, clean = np.array([r.odds for r in found])[order], np.array([float(r.clean) for r in found])[order]
    model = Model(words[order], odds_, 1.0, 1.0, 1.0, 0.0)
    model.rate = _rate(odds_, clean, max(n0 - clean.sum(), 1.0), model.drift) if len(found) else 1.0

    def run(batches):
        for batch in batches:
            s, n = [], []
            for h, _, _ in _documents(batch.column(1)):
                s.append([x for _, _, x in segments(model.scores(h))])
                n.append(len(h))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.float64()))], ["y", "n", "s"])

    seen = labelled.mapInArrow(T.freed(run), "y int, n long, s array<double>").collect()
    clean_segments = np.array([x for r in seen if not r.y for x in r.s])
    if len(clean_segments):
        middle = np.median(clean_segments)
        model.k = float((clean_segments >= middle).sum() * np.exp(model.rate * middle) / max(1, sum(r.n for r in seen if not r.y)))
    else:
        model.k = 1.0 / max(1, sum(r.n for r in seen))
    beyond = lambda r: sum(e for e in (model.rate * x - np.log(max(model.k * r.n, 1e-9)) for x in r.s) if e > 0)
    w, model.bias = logistic(np.array([[np.log1p(beyond(r))] for r in seen]), np.array([r.y for r in seen], float))
    model.weight = float(w[0])
    scratch.drop(labelled, counts)
    return model


def score(df: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted and passages (byte places [start, stop) and evidence in nats) for each row.

    A null text counts as empty and has no passage.  Rows are scored one by one: repeats, null ids
    and an empty table need no rule; other columns are not looked at.
    """
    src = rated(df, text, doc_id)

    def run(batches):
        for batch in batches:
            out, found = [], []
            for h, first, end in _documents(batch.column(1)):
                p = model.passages(h)
                out.append(model.score(p))
                found.append([{"start": int(first[a]), "stop": int(end[z - 1]), "nats": float(e)} for a, z, e in p])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("nats", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array(found, kind)], ["k", "score", "passages"])

    out = src.mapInArrow(T.freed(run), f"k {src.dtypes[0][1]}, score double, passages array<struct<start:long,stop:long,nats:double>>")
    return out.select(F.col("k").alias(doc_id), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", F.coalesce(T.crc_rest(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
