"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast hash table of the most frequent pre-tokens (white-space marked
words) with their numbers of tokens.  It is drawn from the whole corpus: each task
counts its pre-tokens in a lossy counter of bounded size, and the counters, one row a
task, are merged in a tree.  Pre-tokens themselves are never shuffled, nor grouped by.
Tier two is a cache in each Python worker: what the table lacks is
encoded by the library once and remembered until the cache is full.  The tables
decide speed alone; counts are the library's whatever they hold.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .sentencepiece_table import Chunks, model_of, parts

#: Pre-tokens that a counter hands on, and those of the broadcast table.
LEADERS, FREQUENT = 4096, 65_536
#: Counters that are merged at once, in the tree's first level.
FAN = 64
_COUNTER = "w array<string>, n array<bigint>"


def _leaders(seen: Counter, most: int) -> pa.RecordBatch:
    top = seen.most_common(most)
    return pa.RecordBatch.from_arrays([pa.array([[w for w, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], ["w", "n"])


def frequent(df: DataFrame, text: str = "text", model: str | None = None, leaders: int = LEADERS, most: int = FREQUENT) -> list[str]:
    """Up to ``most`` frequent pre-tokens of all texts; a task hands on ``leaders`` of its own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, seen = model_of(model), Counter()
        for batch in batches:
            for some in parts(batch.column(0)):
                found = pc.value_counts(chunks.split(some)[0])
                found = found.filter(pc.and_(pc.greater(found.field("counts"), 1), pc.less_equal(pc.utf8_length(found.field("values")), 64)))
                for w, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True):
                    seen[w] += n
                if len(seen) > 64 * leaders:  # lossy: the lighter part goes
                    seen = Counter(dict(seen.most_common(16 * leaders)))
        yield _leaders(seen, leaders)

    def merge(size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = Counter()
            for batch in batches:
                for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for w, n in zip(words, counts, strict=True):
                        seen[w] += n
                    if len(seen) > 16 * size:
                        seen = Counter(dict(seen.most_common(4 * size)))
            if seen:
                yield _leaders(seen, size)

        return run

    counters = df.select(F.col(text).cast("string").alias("t")).mapInArrow(T.freed(count), _COUNTER)
    counters = counters.repartition(FAN).mapInArrow(T.freed(merge(most)), _COUNTER).repartition(1).mapInArrow(T.freed(merge(most)), _COUNTER)
    return [w for r in counters.collect() for w in r.w]


def pack(chunks: Chunks, words: list[str]) -> tuple[bytes, bytes]:
    """A compact form of the table: the words as an Arrow buffer, and their counts."""
    counts = np.array([len(x) for x in chunks.encode(words)], np.uint16)
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string())], ["w"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes(), counts.tobytes()


def unpack(packed: tuple[bytes, bytes]) -> tuple[pa.Array, np.ndarray]:
    return pa.ipc.open_stream(packed[0]).read_all().column(0).combine_chunks(), np.frombuffer(packed[1], np.uint16).astype(np.int64)


#: A worker's counts of the pre-tokens that the table lacks.
_MISSES: dict[tuple, dict[str, int]] = {}


def _lengths(chunks: Chunks, words: pa.Array, table: tuple[pa.Array, np.ndarray], misses: dict[str, int], cache: int) -> np.ndarray:
    """The numbers of tokens of distinct pre-tokens."""
    found = pc.index_in(words, table[0])
    out = np.zeros(len(words), np.int64)
    hit = np.asarray(found.is_valid())
    out[hit] = table[1][np.asarray(found.drop_null())]
    rest = words.filter(pa.array(~hit)).to_pylist()
    new = [w for w in rest if w not in misses]
    known = dict(zip(new, map(len, chunks.encode(new)), strict=True))
    out[~hit] = [misses[w] if w in misses else known[w] for w in rest]
    if len(misses) + len(new) > cache:
        misses.clear()
    if len(new) <= cache:
        misses.update(known)
    return out


def count_tokens(df: DataFrame, text: str = "text", doc_id: str = "doc_id", model: str | None = None, limit: int = 4096, cache: int = 200_000, leaders: int = LEADERS, most: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row.

    A null text counts as empty: no bytes, no tokens.  Repeated rows, null ids and columns of
    any other name pass untouched or unseen; an empty table gives an empty result.  ``cache``
    bounds the pre-tokens that a worker remembers.
    """
    packed = df.sparkSession.sparkContext.broadcast(pack(Chunks(model), frequent(df, text, model, leaders, most)))
    src = df.select(F.col(doc_id).alias("k"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, table, misses = model_of(model), unpack(packed.value), _MISSES.setdefault((model,), {})
        for batch in batches:
            at = 0
            for some in parts(batch.column(1)):
                words, first = chunks.split(some)
                distinct = words.dictionary_encode()
                n = _lengths(chunks, distinct.dictionary, table, misses, cache)[np.asarray(distinct.indices)]
                counts = np.diff(np.concatenate(([0], np.cumsum(n)))[first])
                sizes = np.diff(T.utf8(some)[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["k", "n_bytes", "n_tokens"])
                at += len(some)

    out = src.mapInArrow(T.freed(run), f"k {src.dtypes[0][1]}, n_bytes long, n_tokens long")
    return out.select(F.col("k").alias(doc_id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
