"""dedup_trigger: of requested time spans, only what no earlier request has covered.

Requests are taken in order of their end.  ``now`` and ``expire``: a request waits until its
end is past, and one that is older than ``expire`` ms is dropped.  Of sorted spans the covered
part is all before the largest end so far and after a start so far, so what is new of a span
is what lies after that end, and what lies before all of its starts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = "array<struct<start_key:bigint,end_key:bigint>>"
#: A request covers fewer than 2 ** LEVELS whole buckets.
LEVELS = 40


def _first_over(whole: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _b, _q): of the requests that cover a bucket as a whole, the first; all that come after it find nothing there.

    A request's buckets [_l, _r) are cut into runs of 2 ** j that begin at multiples of it, two of each j at
    most, and a run keeps its first request, so that long requests are not written out once for each bucket.
    """

    def runs(j):
        size = F.pow(F.lit(2.0), j).cast("bigint")
        low, high = -F.floor(-F.col("_l") / size), F.floor(F.col("_r") / size)
        run = lambda q: F.struct(j.cast("int").alias("j"), q.cast("bigint").alias("q"))
        return F.array_compact(F.array(F.when((low < high) & (F.pmod(low, F.lit(2)) == 1), run(low)), F.when((low < high) & (F.pmod(high, F.lit(2)) == 1), run(high - 1))))

    top = F.least(F.lit(LEVELS), F.floor(F.log2(F.col("_r") - F.col("_l"))).cast("int"))
    cut = whole.select(*keys, "_q", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), top), runs))).alias("_n"))
    first = cut.groupBy(*keys, "_n").agg(F.min("_q").alias("_q"))
    size = F.pow(F.lit(2.0), F.col("_n.j")).cast("bigint")
    each = first.select(*keys, "_q", F.explode(F.sequence(F.col("_n.q") * size, (F.col("_n.q") + 1) * size - 1)).alias("_b"))
    return each.groupBy(*keys, "_b").agg(F.min("_q").alias("_q"))


def uncovered(df: DataFrame, start: str, end: str, now: Column | None = None, expire: Column | None = None, keys: list[str] | None = None, bucket: int = 3_600_000) -> DataFrame:
    """``df`` with ``parts``, an array of (start_key, end_key) that this request is the first to cover; rows without any go.

    A request is split at multiples of ``bucket`` ms, so that no key's requests meet in one
    task; of those that cover a bucket as a whole only the first is sent there.  Within a bucket
    they are folded in order: what is covered is a stack of spans, and a request takes off it
    those that it reaches over.  Parts that touch are joined again.
    """
    if now is not None:
        df = df.filter(F.col(end) <= now)
        if expire is not None:
            df = df.filter(now - F.col(end) <= expire)
    keys = keys or []
    names = df.columns
    hidden = [F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]
    groups = [f"_g{i}" for i in range(len(keys))]
    # The order of requests; equal ones go by their columns.
    request = F.struct(F.col(end).cast("bigint").alias("e"), F.col(start).cast("bigint").alias("s"), *[F.col(n).alias(f"c{i}") for i, n in enumerate(names)])
    asked = df.select(*hidden, request.alias("_q")).filter("_q.s < _q.e")
    asked = asked.withColumns({"_l": F.floor(F.col("_q.s") / bucket), "_r": F.floor((F.col("_q.e") - 1) / bucket)})
    ends = asked.select(*groups, "_q", F.explode(F.array_distinct(F.array("_l", "_r"))).alias("_b"))
    between = _first_over(asked.withColumn("_l", F.col("_l") + 1).filter("_l < _r"), groups)
    pieces = ends.unionByName(between).select(*groups, "_b", "_q.*")

    def fold(batches):
        group, spans = None, []
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("s", "e", "_b", *groups)]
            keep, found = [], []
            for s, e, *of in zip(*columns, strict=True):
                if of != group:
                    group, spans = of, []
                low, high = max(s, of[0] * bucket), min(e, (of[0] + 1) * bucket)
                parts, first, at = [], low, high
                while spans and spans[-1][1] >= low:
                    a, z = spans.pop()
                    if z < at:
                        parts.append({"start_key": z, "end_key": at})
                    first = at = min(at, a)
                if at > low:
                    parts.append({"start_key": low, "end_key": at})
                spans.append((min(first, low), high))
                keep.append(bool(parts))
                if parts:
                    found.append(parts)
            kept = batch.filter(pa.array(keep, pa.bool_()))
            own = [kept.column(kept.schema.get_field_index(f"c{i}")) for i in range(len(names))]
            kind = pa.list_(pa.struct([("start_key", pa.int64()), ("end_key", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*own, pa.array(found, kind)], [*[f"c{i}" for i in range(len(names))], "parts"])

    schema = T.StructType([*[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema)], T.StructField("parts", T._parse_datatype_string(PARTS))])
    own = [f"c{i}" for i in range(len(names))]
    sent = pieces.repartition(*groups, "_b").sortWithinPartitions(*groups, "_b", "e", "s", *own)
    parts = sent.mapInArrow(fold, schema).groupBy(*own).agg(F.array_sort(F.flatten(F.collect_list("parts"))).alias("l"))
    # Joined where they touch: a part begins where none ends, and ends where none begins; both are sorted alike.
    starts, stops = F.transform("l", lambda p: p["start_key"]), F.transform("l", lambda p: p["end_key"])
    joined = F.arrays_zip(F.array_except(starts, stops).alias("start_key"), F.array_except(stops, starts).alias("end_key")).cast(PARTS)
    return parts.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], joined.alias("parts"))
