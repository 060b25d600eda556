"""Array and object functions.  Places are counted from 0, from the end if negative."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .registry import SCALARS, Call, scalar


def pick(a, i):
    """The element at ``i``; out of range, null."""
    i = i.cast("int")
    return F.when(i >= 0, F.get(a, i)).otherwise(F.try_element_at(a, F.when(i < 0, i)))


def _filled(x):
    return F.when(F.size(x) > 0, x)


@scalar("array_create")
def array_create(call, *c):
    return _filled(F.array_compact(F.array(*c)))


@scalar("element_at")
def element_at(call, a, i):
    return F.try_element_at(a, i) if call.is_map(a) else pick(a, i)


SCALARS["array_position"] = lambda call, a, x: F.coalesce(F.array_position(a, x) - 1, F.lit(-1)).cast("bigint")
SCALARS["array_last_position"] = lambda call, a, x: F.coalesce(F.when(F.array_contains(a, x), F.size(a) - F.array_position(F.reverse(a), x)), F.lit(-1)).cast("bigint")
SCALARS["array_contains"] = lambda call, a, x: F.coalesce(F.array_contains(a, x), F.lit(False))
SCALARS["array_contains_any"] = lambda call, a, b: F.coalesce(F.arrays_overlap(a, b), F.lit(False))
SCALARS["array_remove"] = lambda call, a, x: F.array_remove(a, x)
#: Distinct, in the second's order.
SCALARS["array_intersect"] = lambda call, a, b: F.when((F.size(a) > 0) & (F.size(b) > 0), F.array_intersect(b, a))
SCALARS["array_union"] = lambda call, a, b: F.array_union(F.coalesce(a, F.array()), F.coalesce(b, F.array()))
SCALARS["array_except"] = lambda call, a, b: F.array_except(a, F.coalesce(b, F.array()))
SCALARS["array_max"] = lambda call, a: F.array_max(a)
SCALARS["array_min"] = lambda call, a: F.array_min(a)
SCALARS["repeat"] = lambda call, x, n: F.array_repeat(x, n.cast("int"))
SCALARS["sequence"] = lambda call, a, b, step=None: F.sequence(a, b) if step is None else F.sequence(a, b, step)
SCALARS["cardinality"] = lambda call, a: F.coalesce(F.when(a.isNotNull(), F.size(a)), F.lit(0)).cast("bigint")
SCALARS["array_cardinality"] = lambda call, a: F.coalesce(F.when(a.isNotNull(), F.size(F.array_compact(a))), F.lit(0)).cast("bigint")
SCALARS["array_flatten"] = lambda call, a: F.flatten(a)
SCALARS["array_distinct"] = lambda call, a: F.array_distinct(a)
SCALARS["array_join"] = lambda call, a, sep, null=None: F.array_join(a.cast("array<string>"), call.values[1], *([call.values[2]] if null is not None and call.values[2] else []))
SCALARS["array_shuffle"] = lambda call, a: F.shuffle(a)
#: By the elements' texts.
SCALARS["array_sort"] = lambda call, a: F.transform(F.array_sort(F.transform(a, lambda x: F.struct(x.cast("string").alias("k"), x.alias("v")))), lambda p: p["v"])
SCALARS["array_concat"] = lambda call, *a: F.concat(*[F.coalesce(x, F.array()) for x in a])
SCALARS["kvpair_array_to_obj"] = lambda call, a: F.map_from_entries(F.transform(a, lambda e: F.struct(e["key"], e["value"])))


@scalar("array_map")
def array_map(call, name, a):
    f = SCALARS[call.values[0].lower()]
    inner = call.type_of(a).elementType
    return F.transform(a, lambda x: f(Call(call.values[0], [None], lambda _: inner), x))


SCALARS["object"] = lambda call, k, v: F.when((F.size(k) > 0) & (F.size(k) == F.size(v)), F.map_from_arrays(k, v))
SCALARS["zip"] = lambda call, a: F.map_from_entries(F.transform(F.filter(a, lambda p: p.isNotNull()), lambda p: F.struct(F.get(p, F.lit(0)), F.get(p, F.lit(1)))))


def _map(call, o):
    """A struct as a map of texts; a map as it is."""
    if call.is_map(o):
        return o
    return F.from_json(F.to_json(o), "map<string,string>")


SCALARS["keys"] = lambda call, o: F.map_keys(_map(call, o))
SCALARS["values"] = lambda call, o: F.map_values(_map(call, o))
SCALARS["items"] = lambda call, o: _filled(F.transform(F.map_entries(_map(call, o)), lambda e: F.array(e["key"].cast("string"), e["value"].cast("string"))))
SCALARS["obj_to_kvpair_array"] = lambda call, o: F.map_entries(_map(call, o))
SCALARS["object_size"] = lambda call, o: F.coalesce(F.when(o.isNotNull(), F.size(_map(call, o))), F.lit(0)).cast("bigint")


@scalar("object_concat")
def object_concat(call, *o):
    """Shallow; the later object wins."""

    def both(a, b):
        rest = F.map_filter(a, lambda k, v: ~F.coalesce(F.map_contains_key(b, k), F.lit(False)))
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_concat(rest, b))

    return reduce(both, [_map(call, x) for x in o])


@scalar("object_construct")
def object_construct(call, *c):
    pairs = F.array(*[F.struct(k.alias("key"), v.cast("string").alias("value") if len({str(call.type_of(x)) for x in c[1::2]}) > 1 else v.alias("value")) for k, v in zip(c[::2], c[1::2], strict=True)])
    return F.map_from_entries(F.filter(pairs, lambda e: e["key"].isNotNull() & e["value"].isNotNull()))


def _names(call, at: int, rest):
    return rest[0] if len(rest) == 1 and call.is_array(rest[0]) else F.array(*rest)


@scalar("erase")
def erase(call, o, *keys):
    names = _names(call, 1, keys)
    return F.map_filter(_map(call, o), lambda k, v: ~F.array_contains(names, k))


@scalar("object_pick")
def object_pick(call, o, *keys):
    names = _names(call, 1, keys)
    return F.map_filter(_map(call, o), lambda k, v: F.array_contains(names, k))
