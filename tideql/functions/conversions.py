"""Conversion, hashing, JSON, metadata and the rest."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import SCALARS, scalar
from .times import moment

SCALARS["bypass"] = lambda call, x: x
SCALARS["isnull"] = lambda call, x: x.isNull()
SCALARS["coalesce"] = lambda call, *c: F.coalesce(*c)
SCALARS["md5"] = lambda call, s: F.md5(s.cast("binary"))
SCALARS["sha1"] = lambda call, s: F.sha1(s.cast("binary"))
for _bits in (256, 384, 512):
    SCALARS[f"sha{_bits}"] = lambda call, s, bits=_bits: F.sha2(s.cast("binary"), bits)
SCALARS["crc32"] = lambda call, s: F.lower(F.hex(F.crc32(s.cast("binary"))))
SCALARS["newuuid"] = lambda call: F.uuid() if hasattr(F, "uuid") else F.expr("uuid()")
SCALARS["hex2dec"] = lambda call, s: F.conv(F.regexp_replace(F.lower(s), "^0x", ""), 16, 10).cast("bigint")
SCALARS["dec2hex"] = lambda call, n: F.concat(F.lit("0x"), F.lower(F.hex(n.cast("bigint"))))
SCALARS["props"] = lambda call, name: F.lit(call.properties.get(call.values[0]))
SCALARS["rule_id"] = lambda call: F.lit(call.properties.get("rule_id")).cast("string")
SCALARS["rule_start"] = lambda call: F.lit(call.properties.get("rule_start")).cast("bigint")
SCALARS["window_start"] = lambda call: F.unix_millis(call.window["start"])
SCALARS["window_end"] = lambda call: F.unix_millis(call.window["end"])
SCALARS["window_trigger"] = lambda call: F.unix_millis(call.window["end"])
SCALARS["event_time"] = lambda call: F.unix_millis(call.window["end"] if call.window is not None else call.time)
SCALARS["delay"] = lambda call, ms, x: x


@scalar("chr")
def code_point(call, x):
    return F.ascii(x) if call.is_text(x) else x.cast("int")


@scalar("cast")
def cast(call, x, kind):
    to = {"bigint": "bigint", "float": "double", "string": "string", "boolean": "boolean", "datetime": "timestamp", "bytea": "binary"}[call.values[1]]
    if to == "timestamp":
        return moment(call, x)
    if to == "bigint" and call.is_text(x):
        return x.try_cast("double").cast("bigint")
    return x.cast(to) if to == "binary" else x.try_cast(to)


@scalar("encode")
def encode(call, s, how):
    if call.values[1] != "base64":
        raise ValueError("encode knows base64 only")
    return F.regexp_replace(F.base64(s.cast("binary")), r"\r?\n", "")


@scalar("decode")
def decode(call, s, how):
    if call.values[1] != "base64":
        raise ValueError("decode knows base64 only")
    return F.unbase64(s)


def packers():
    out = {"zlib": (zlib.compress, zlib.decompress), "gzip": (lambda b: gzip.compress(b, mtime=0), gzip.decompress), "flate": (lambda b: zlib.compress(b, wbits=-15), lambda b: zlib.decompress(b, wbits=-15))}
    try:
        import zstandard

        out["zstd"] = (lambda b: zstandard.ZstdCompressor().compress(b), lambda b: zstandard.ZstdDecompressor().decompressobj().decompress(b))
    except ModuleNotFoundError:
        pass
    return out


def _packer(which: int):
    def build(call, x, how):
        name = call.values[1]
        if name not in packers():
            raise ValueError(f"no such compression: {name}")

        def run(s: pd.Series) -> pd.Series:
            f = packers()[name][which]
            return s.map(lambda b: None if b is None else f(bytes(b)))

        return F.pandas_udf(run, "binary")(x.cast("binary"))

    return build


SCALARS["compress"], SCALARS["decompress"] = _packer(0), _packer(1)


@scalar("to_json")
def to_json(call, x):
    if isinstance(call.type_of(x), (T.StructType, T.MapType, T.ArrayType)):
        return F.to_json(x)
    return F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r'^\{"v":(.*)\}$', 1)


@scalar("parse_json")
def parse_json(call, s, schema=None):
    """A text's value: a variant, or with a second argument a value of that type."""
    return F.try_parse_json(s) if schema is None else F.from_json(s, call.values[1])


def _text(call, o):
    return o if call.is_text(o) else F.to_json(o)


SCALARS["json_path_query"] = lambda call, o, p: F.get_json_object(_text(call, o), call.values[1])
SCALARS["json_path_query_first"] = lambda call, o, p: F.coalesce(F.get(F.from_json(F.get_json_object(_text(call, o), call.values[1]), "array<string>"), F.lit(0)), F.get_json_object(_text(call, o), call.values[1]))
SCALARS["json_path_exists"] = lambda call, o, p: F.get_json_object(_text(call, o), call.values[1]).isNotNull()


@scalar("meta", "mqtt")
def meta(call, key):
    return F.lit(None).cast("string") if call.meta is None else F.try_element_at(call.meta, key)


@scalar("get_keyed_state")
def get_keyed_state(call, key, kind, default):
    """From a map of the engine's properties, ``keyed_state``; bounded like any literal."""
    known = call.properties.get("keyed_state", {})
    to = {"bigint": "bigint", "float": "double", "string": "string", "boolean": "boolean", "datetime": "timestamp"}[call.values[1]]
    if not known:
        return default.cast(to)
    table = F.create_map(*[F.lit(str(x)) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key.cast("string")).try_cast(to), default.cast(to))
