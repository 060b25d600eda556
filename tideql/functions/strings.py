"""String functions.  Places are counted from 0."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import SCALARS, scalar

_WHITE = r"[\s\u0085   -     　]+"

SCALARS["concat"] = lambda call, *c: F.concat_ws("", *[x.cast("string") for x in c])
SCALARS["endswith"] = lambda call, s, x: F.coalesce(F.endswith(s, x), F.lit(False))
SCALARS["startswith"] = lambda call, s, x: F.coalesce(F.startswith(s, x), F.lit(False))
SCALARS["indexof"] = lambda call, s, x: F.coalesce(F.call_function("instr", s, x) - 1, F.lit(-1)).cast("bigint")
SCALARS["lower"] = lambda call, s: F.lower(s)
SCALARS["upper"] = lambda call, s: F.upper(s)
#: Not up to a width: so many blanks are added.
SCALARS["lpad"] = lambda call, s, n: F.concat(F.repeat(F.lit(" "), n.cast("int")), s)
SCALARS["rpad"] = lambda call, s, n: F.concat(s, F.repeat(F.lit(" "), n.cast("int")))
SCALARS["ltrim"] = lambda call, s: F.regexp_replace(s, f"^{_WHITE}", "")
SCALARS["rtrim"] = lambda call, s: F.regexp_replace(s, f"{_WHITE}$", "")
SCALARS["trim"] = lambda call, s: F.regexp_replace(s, f"^{_WHITE}|{_WHITE}$", "")
SCALARS["numbytes"] = lambda call, s: F.coalesce(F.octet_length(s), F.lit(0)).cast("bigint")
SCALARS["regexp_matches"] = lambda call, s, r: F.coalesce(F.regexp_like(s, r), F.lit(False))
SCALARS["regexp_replace"] = lambda call, s, r, x: F.regexp_replace(s, r, x)
SCALARS["regexp_substr"] = lambda call, s, r: F.when(s.isNotNull(), F.coalesce(F.regexp_substr(s, r), F.lit("")))
SCALARS["reverse"] = lambda call, s: F.reverse(s)


@scalar("length")
def length(call, x):
    n = F.size(x) if call.is_array(x) or call.is_map(x) else F.char_length(x.cast("string"))
    return F.coalesce(F.when(x.isNotNull(), n), F.lit(0)).cast("bigint")


@scalar("substring")
def substring(call, s, start, stop=None):
    """From ``start`` up to ``stop``, which is left out."""
    start = start.cast("int")
    n = F.greatest(F.lit(0), stop.cast("int") - start) if stop is not None else F.char_length(s)
    return F.substring(s, start + 1, n)


@scalar("split_value")
def split_value(call, s, sep, at):
    at = at.cast("int")
    return F.split_part(s, sep, F.when(at >= 0, at + 1).otherwise(at))


@scalar("format")
def fixed(call, x, digits, locale=None):
    n = call.values[1]
    text = F.format_string(f"%.{n}f", F.round(x.cast("double"), n))
    if locale is None:
        return text
    grouped = F.format_number(F.round(x.cast("double"), n), n)
    lang = str(call.values[2]).replace("-", "_").split("_")[0]
    if lang in ("de", "es", "it", "nl", "pt"):
        return F.translate(grouped, ",.", ".,")
    if lang == "fr":
        return F.translate(grouped, ",.", " ,")
    return grouped
