"""Functions of the extension set: geohash, echo, countPlusOne.  ``install`` adds them to the library."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from .registry import AGGREGATES, SCALARS

#: Fixed value: the digits of the public geohash base 32.
DIGITS = "0123456789bcdefghjkmnpqrstuvwxyz"
STEPS = {"North": (1, 0), "NorthEast": (1, 1), "East": (0, 1), "SouthEast": (-1, 1), "South": (-1, 0), "SouthWest": (-1, -1), "West": (0, -1), "NorthWest": (1, -1)}


def bits(lat: float, lon: float, n: int) -> int:
    """The first ``n`` halvings, longitude first, as one number."""
    low, high, out = [-180.0, -90.0], [180.0, 90.0], 0
    for i in range(n):
        k, x = i % 2, (lat if i % 2 else lon)
        mid = (low[k] + high[k]) / 2
        out = out * 2 + (x >= mid)
        (low if x >= mid else high)[k] = mid
    return out


def box(value: int, n: int) -> tuple[float, float, float, float]:
    """Least and greatest latitude and longitude of a cell."""
    low, high = [-180.0, -90.0], [180.0, 90.0]
    for i in range(n):
        k = i % 2
        (low if value >> (n - 1 - i) & 1 else high)[k] = (low[k] + high[k]) / 2
    return low[1], high[1], low[0], high[0]


def text(value: int, n: int) -> str:
    return "".join(DIGITS[value >> 5 * i & 31] for i in reversed(range(n // 5)))


def number(code: str) -> int:
    out = 0
    for c in code.lower():
        out = out * 32 + DIGITS.index(c)
    return out


def neighbour(value: int, n: int, step: tuple[int, int]) -> int:
    a, b, c, d = box(value, n)
    lat, lon = (a + b) / 2 + step[0] * (b - a), (c + d) / 2 + step[1] * (d - c)
    return bits(max(-90 + (b - a) / 2, min(90 - (b - a) / 2, lat)), (lon + 540) % 360 - 180, n)


def _udf(returns: str, one):
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(x) for x in row) else one(*row) for row in zip(*columns, strict=True)], dtype=object)

    # The number of arguments is known when the function is called.
    return lambda call, *c: F.pandas_udf(_arity(run, len(c)), returns)(*c)


def _arity(run, n: int):
    if n == 1:
        return lambda a: run(a)
    return lambda a, b: run(a, b)


_BOX = "min_lat double, max_lat double, min_lng double, max_lng double"


def install() -> None:
    SCALARS["geohashencode"] = _udf("string", lambda lat, lon: text(bits(lat, lon, 60), 60))
    SCALARS["geohashencodeint"] = _udf("bigint", lambda lat, lon: _signed(bits(lat, lon, 64)))
    centre = lambda b: {"latitude": (b[0] + b[1]) / 2, "longitude": (b[2] + b[3]) / 2}
    SCALARS["geohashdecode"] = _struct("latitude double, longitude double", lambda code: centre(box(number(code), 5 * len(code))))
    SCALARS["geohashdecodeint"] = _struct("latitude double, longitude double", lambda v: centre(box(int(v) % (1 << 64), 64)))
    names = ["min_lat", "max_lat", "min_lng", "max_lng"]
    SCALARS["geohashboundingbox"] = _struct(_BOX, lambda code: dict(zip(names, box(number(code), 5 * len(code)), strict=True)))
    SCALARS["geohashboundingboxint"] = _struct(_BOX, lambda v: dict(zip(names, box(int(v) % (1 << 64), 64), strict=True)))
    SCALARS["geohashneighbor"] = _udf("string", lambda code, way: text(neighbour(number(code), 5 * len(code), STEPS[way]), 5 * len(code)))
    SCALARS["geohashneighborint"] = _udf("bigint", lambda v, way: _signed(neighbour(int(v) % (1 << 64), 64, STEPS[way])))
    SCALARS["geohashneighbors"] = _udf("array<string>", lambda code: [text(neighbour(number(code), 5 * len(code), s), 5 * len(code)) for s in STEPS.values()])
    SCALARS["geohashneighborsint"] = _udf("array<bigint>", lambda v: [_signed(neighbour(int(v) % (1 << 64), 64, s)) for s in STEPS.values()])
    SCALARS["echo"] = lambda call, x: x
    AGGREGATES["countplusone"] = lambda call, x: F.count(x) + 1


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def _struct(schema: str, one):
    def run(a: pd.Series) -> pd.DataFrame:
        fields = [f.split()[0] for f in schema.split(", ")]
        return pd.DataFrame([dict.fromkeys(fields) if pd.isna(x) else one(x) for x in a], columns=fields)

    run.__annotations__ = {"a": pd.Series, "return": pd.DataFrame}
    return lambda call, c: F.pandas_udf(run, schema)(c)


install()
