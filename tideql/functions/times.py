"""Date and time functions.  A time is a timestamp, milliseconds since 1970, or a text."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import SCALARS, scalar

_UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}


def moment(call, x):
    kind = call.type_of(x)
    if isinstance(kind, T.NumericType):
        return F.timestamp_millis(x.cast("bigint"))
    return x.cast("timestamp")


def nanoseconds(text: str) -> int:
    """The length of a duration such as -1h30m."""
    sign, parts = (-1 if text.startswith("-") else 1), re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", text)
    if "".join(a + b for a, b in parts) != text.lstrip("+-"):
        raise ValueError(f"not a duration: {text!r}")
    return sign * round(sum(float(a) * _UNITS[b] for a, b in parts))


def _part(f):
    return lambda call, x: f(moment(call, x)).cast("bigint")


for _name, _f in {"day_of_month": F.dayofmonth, "day": F.dayofmonth, "day_of_year": F.dayofyear, "hour": F.hour, "minute": F.minute, "month": F.month, "second": F.second}.items():
    SCALARS[_name] = _part(_f)
SCALARS["day_of_week"] = _part(lambda t: F.dayofweek(t) - 1)
SCALARS["microsecond"] = _part(lambda t: F.unix_micros(t) % 1_000_000)
SCALARS["day_name"] = lambda call, x: F.date_format(moment(call, x), "EEEE")
SCALARS["month_name"] = lambda call, x: F.date_format(moment(call, x), "MMMM")
SCALARS["last_day"] = lambda call, x: F.date_format(F.last_day(moment(call, x)), "yyyy-MM-dd")
SCALARS["format_time"] = lambda call, x, f: F.date_format(moment(call, x), call.values[1])
SCALARS["date_diff"] = lambda call, a, b: ((F.unix_micros(moment(call, b)) - F.unix_micros(moment(call, a))) * 1000).cast("bigint")
SCALARS["from_days"] = lambda call, n: F.when(n != 0, F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), n.cast("int") - 1), "yyyy-MM-dd"))
SCALARS["from_unix_time"] = lambda call, s: F.when(s != 0, F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd HH:mm:ss"))
SCALARS["to_seconds"] = lambda call, x: F.unix_seconds(moment(call, x))
SCALARS["convert_tz"] = lambda call, x, zone: F.from_utc_timestamp(moment(call, x), zone)
SCALARS["tstamp"] = lambda call: F.unix_millis(F.current_timestamp())


@scalar("date_calc")
def date_calc(call, x, duration):
    micros = F.unix_micros(moment(call, x)) + F.lit(nanoseconds(call.values[1]) // 1000)
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd HH:mm:ss")


def _now(form):
    def build(call, digits=None):
        n = call.values[0] if digits is not None else 0
        return F.date_format(F.current_timestamp(), form + ("." + "S" * n if n else ""))

    return build


for _name in ("now", "current_timestamp", "local_time", "local_timestamp"):
    SCALARS[_name] = _now("yyyy-MM-dd HH:mm:ss")
SCALARS["cur_time"] = SCALARS["current_time"] = _now("HH:mm:ss")
SCALARS["cur_date"] = SCALARS["current_date"] = lambda call: F.date_format(F.current_date(), "yyyy-MM-dd")
