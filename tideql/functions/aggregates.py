"""Aggregates, all with partial aggregation where Spark has it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import AGGREGATES, aggregate

@aggregate("count")
def count(call, x=None):
    return F.count(F.lit(1)) if x is None else F.count(x)


@aggregate("avg")
def avg(call, x):
    """Whole numbers have a whole mean, cut towards zero."""
    return F.try_divide(F.sum(x), F.count(x)).cast("bigint") if call.is_whole(x) else F.avg(x)


AGGREGATES["max"] = AGGREGATES["inc_max"] = lambda call, x: F.max(x)
AGGREGATES["min"] = AGGREGATES["inc_min"] = lambda call, x: F.min(x)
AGGREGATES["sum"] = lambda call, x: F.sum(x)
AGGREGATES["median"] = lambda call, x: F.median(x)
AGGREGATES["stddev"] = lambda call, x: F.stddev_pop(x)
AGGREGATES["stddevs"] = lambda call, x: F.stddev_samp(x)
AGGREGATES["var"] = lambda call, x: F.var_pop(x)
AGGREGATES["vars"] = lambda call, x: F.var_samp(x)
AGGREGATES["inc_count"] = AGGREGATES["count"]
AGGREGATES["inc_avg"] = lambda call, x: F.avg(x.cast("double"))
AGGREGATES["inc_sum"] = lambda call, x: F.sum(x.cast("double"))


def ordered(call, x):
    """All values in time order, nulls too; at one time, in the order of their texts."""
    kept = F.struct(x.alias("v"))
    rows = F.collect_list(F.struct(call.time.alias("t"), F.to_json(kept).alias("j"), kept.alias("s")))
    earlier = lambda a, b: (a["t"] < b["t"]) | ((a["t"] == b["t"]) & (a["j"] < b["j"]))
    rows = F.array_sort(rows, lambda a, b: F.when(earlier(a, b), -1).when(earlier(b, a), 1).otherwise(0))
    return F.transform(rows, lambda r: r["s"]["v"])


@aggregate("collect", "inc_collect")
def collect(call, x):
    return ordered(call, x)


@aggregate("merge_agg", "inc_merge_agg")
def merge_agg(call, x):
    if isinstance(call.type_of(x), T.StructType):
        x = F.from_json(F.to_json(x), "map<string,string>")
    rows = F.filter(ordered(call, x), lambda m: m.isNotNull())
    kind = call.type_of(x).simpleString()
    both = lambda a, m: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(m, k)), m)
    return F.when(F.size(rows) > 0, F.aggregate(rows, F.create_map().cast(kind), both))


@aggregate("last_value", "inc_last_value")
def last_value(call, x, ignore=None):
    if ignore is None or not call.values[1]:
        return F.max_by(x, call.time)
    return F.coalesce(F.max_by(x, F.when(x.isNotNull(), call.time)), F.max_by(x, call.time))


@aggregate("deduplicate")
def deduplicate(call, row, key, whole=None):
    """The first row of each key; or, without ``whole``, the last row if its key is new, else null.  Of rows of one time the first that arrived is taken."""
    key, places = key.cast("string"), [] if call.place is None else [call.place]
    if call.values[-1]:
        rows = F.array_sort(F.collect_list(F.struct(F.struct(key.alias("k")).alias("k"), call.time.alias("t"), *[p.alias("o") for p in places], row.alias("r"))))
        # The sorted rows are a lambda's argument, or they would be sorted again for each of them.
        once = lambda a, f: F.get(F.transform(F.array(a), f), F.lit(0))
        kept = once(rows, lambda a: F.filter(a, lambda e, i: (i == 0) | ~e["k"]["k"].eqNullSafe(F.get(a, i - 1)["k"]["k"])))
        kept = F.array_sort(F.transform(kept, lambda e: F.struct(e["t"], *[e["o"] for _ in places], e["k"]["k"], e["r"].alias("r"))))
        return F.transform(kept, lambda e: e["r"])
    last = F.max_by(F.struct(key.alias("k"), row.alias("r")), F.struct(call.time, *[-p for p in places]))
    return F.when(F.size(F.filter(F.collect_list(F.struct(key.alias("k"))), lambda e: e["k"].eqNullSafe(last["k"]))) == 1, last["r"])


@aggregate("percentile_cont")
def percentile_cont(call, x, p):
    """The value of rank p n if that is whole, else the mean of its two neighbours; below rank 1, null."""
    values = F.array_sort(F.collect_list(x.cast("double")))
    rank = F.lit(float(call.values[1])) * F.size(values)
    low = F.floor(rank).cast("int")
    value = lambda i: F.try_element_at(values, F.when(i > 0, i))
    return F.when(rank == low, value(low)).when(rank > 1, (value(low) + value(low + 1)) / 2)


@aggregate("percentile_disc")
def percentile_disc(call, x, p):
    """Nearest rank."""
    values = F.array_sort(F.collect_list(x))
    return F.try_element_at(values, F.greatest(F.lit(1), F.ceil(F.lit(float(call.values[1])) * F.size(values)).cast("int")))
