"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes; labels are known for whole
documents only.  Every passage is encoded: shares of character classes and of
their pairs, and shares of repeated, repeating and long words go through a learnt
tanh layer.  Gated attention, softmax of w . (tanh(V h) * sigmoid(U h)), weighs the
passages; the weighted sum is scored by a logistic unit.  All weights are learnt
together from the documents' labels by gradient descent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .learning import rated, sample, sigmoid
from .quality_rules import _CLASS, CLASSES

#: Learnt from: so many documents of so many bytes at most, whose passages take 160 MB at most.
ROWS, LONGEST = 8192, 1 << 15
PASSAGE = 512
HIDDEN, GATE = 24, 12
_N = len(CLASSES) + 1
FEATURES = _N + _N * _N + 5


def encode(column: pa.Array):
    """Runs of documents: their passages' features (a row each) and each document's first passage; an empty text is one empty passage."""
    buf, offsets, _ = T.utf8(column)
    for lo, hi in T.groups(offsets):
        part, b = offsets[lo : hi + 1] - offsets[lo], buf[offsets[lo] : offsets[hi]]
        size = np.diff(part)
        n = np.maximum(1, -(-size // PASSAGE))
        at = np.concatenate(([0], np.cumsum(n)))
        doc = np.repeat(np.arange(hi - lo), size)
        place = np.arange(len(b)) - part[doc]
        passage = at[doc] + place // PASSAGE
        kind = _CLASS[b]
        rows = int(at[-1])
        one = np.bincount(passage * _N + kind, minlength=rows * _N).reshape(rows, _N)
        pair = passage[1:] * (_N * _N) + kind[:-1] * _N + kind[1:]
        two = np.bincount(pair[doc[1:] == doc[:-1]], minlength=rows * _N * _N).reshape(rows, _N * _N)
        h, first, end, wat = T.words(b, part, T.SPACE, lower=True)
        wp, wd = passage[first], doc[first]
        again = np.concatenate(([False], (h[1:] == h[:-1]) & (wd[1:] == wd[:-1]))) if len(h) else np.zeros(0, bool)
        key = T.mix(h ^ (wd.astype(np.uint64) << np.uint64(40)))
        order = np.argsort(key, kind="stable")
        seen = np.zeros(len(h), bool)
        if len(h):
            seen[order[1:]] = key[order[1:]] == key[order[:-1]]
        words = np.bincount(wp, minlength=rows)
        share = lambda x: np.bincount(wp, x, rows) / np.maximum(words, 1)
        length = one.sum(1)
        more = np.stack([share(again), share(seen), share((end - first).astype(float)) / 10, np.minimum(words / 80, 2), np.log1p(length) / 6], 1)
        yield np.hstack([one / np.maximum(length, 1)[:, None], two / np.maximum(length, 1)[:, None], more]).astype(np.float32), at


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def score(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of documents, attention of passages."""
        out = forward(self.p, (x - self.mean) / self.scale, at)
        return out["y"], out["a"]


def forward(p, x, at):
    h = np.tanh(x @ p["W"] + p["b"])
    v, u = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    e = (v * u) @ p["w"]
    first, bag = at[:-1], np.repeat(np.arange(len(at) - 1), np.diff(at))
    e = np.exp(e - np.maximum.reduceat(e, first)[bag])
    a = e / np.add.reduceat(e, first)[bag]
    z = np.add.reduceat(h * a[:, None], first)
    return {"h": h, "v": v, "u": u, "a": a, "z": z, "bag": bag, "y": sigmoid(z @ p["c"] + p["d"][0])}


def gradients(p, x, at, y):
    f = forward(p, x, at)
    d = (f["y"] - y) / len(y)
    g = {"c": f["z"].T @ d, "d": np.array([d.sum()])}
    dz = d[:, None] * p["c"]
    each = dz[f["bag"]]
    da = (each * f["h"]).sum(1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, at[:-1])[f["bag"]])
    dvu = de[:, None] * p["w"]
    g["w"] = (f["v"] * f["u"]).T @ de
    dv, du = dvu * f["u"] * (1 - f["v"] ** 2), dvu * f["v"] * f["u"] * (1 - f["u"])
    g["V"], g["U"] = f["h"].T @ dv, f["h"].T @ du
    dh = (each * f["a"][:, None] + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
    g["W"], g["b"] = x.T @ dh, dh.sum(0)
    return g


def fit(bags: list[np.ndarray], y: np.ndarray, epochs: int = 25, batch: int = 64, rate: float = 4e-3, decay: float = 1e-4) -> Model:
    x = np.concatenate(bags)
    mean, scale = x.mean(0), x.std(0) + 1e-2
    rng = np.random.default_rng(7)
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    base = np.clip(y.mean(), 0.01, 0.99)
    p = {"W": draw(FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": draw(HIDDEN), "d": np.array([np.log(base / (1 - base))], np.float32)}
    bags = [(b - mean) / scale for b in bags]
    m, v, step = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2)).__iter__(), None, 0
    m, v = list(m)
    steps = epochs * -(-len(bags) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            g = gradients(p, np.concatenate([bags[j] for j in some]), np.cumsum([0, *(len(bags[j]) for j in some)]), y[some])
            step += 1
            now = rate * (1 - step / (steps + 1))
            for k, a in p.items():
                d = g[k] + decay * a
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                p[k] = (a - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(mean, scale, p)


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, text: str = "text", doc_id: str = "doc_id") -> Model:
    """A model from at most ``rows`` labelled documents of at most LONGEST bytes; without labels, one that scores a half."""
    labelled = sample(docs, labels, "quality", rows, text, doc_id, LONGEST).select("id", "t", "y")

    def run(batches):
        for batch in batches:
            bags = [x[a:z].tobytes() for x, at in encode(batch.column(1)) for a, z in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bags, pa.binary())], ["id", "y", "x"])

    got = sorted(labelled.mapInArrow(T.freed(run), f"id {labelled.dtypes[0][1]}, y int, x binary").collect(), key=lambda r: (r.id, r.y, bytes(r.x)))
    if not got:
        zero = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
        return Model(np.zeros(FEATURES), np.ones(FEATURES), {k: np.zeros(s) for k, s in zero.items()})
    return fit([np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in got], np.array([r.y for r in got], np.float32))


def score(df: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted and attention (of each passage) for each row.

    A null text counts as empty, which is one empty passage.  Rows are scored one by one: repeats,
    null ids and an empty table need no rule; other columns are not looked at.
    """
    src = rated(df, text, doc_id)

    def run(batches):
        for batch in batches:
            done = 0
            for x, at in encode(batch.column(1)):
                y, a = model.score(x, at)
                n = len(at) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, n), pa.array(y.astype(np.float64)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(a.astype(np.float64)))], ["k", "score", "attention"])
                done += n

    out = src.mapInArrow(T.freed(run), f"k {src.dtypes[0][1]}, score double, attention array<double>")
    return out.select(F.col("k").alias(doc_id), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "attention")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", F.coalesce(T.crc_rest(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", F.size("attention").alias("n_passages"))
