"""Mathematical functions.  A result that is not a number is null."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import SCALARS, scalar


def _real(f):
    def build(call, *c):
        x = f(*[a.cast("double") for a in c])
        return F.when(~F.isnan(x), x)

    return build


for _name in ("acos", "asin", "atan", "atan2", "cos", "cosh", "exp", "sin", "sinh", "tan", "tanh", "cot", "radians", "degrees"):
    SCALARS[_name] = _real(getattr(F, _name))
SCALARS["ln"] = _real(F.ln)
SCALARS["sqrt"] = _real(F.sqrt)
SCALARS["power"] = SCALARS["pow"] = _real(F.pow)
SCALARS["mod"] = _real(lambda a, b: F.try_mod(a, b))
SCALARS["abs"] = lambda call, x: F.abs(x)
SCALARS["bitand"] = lambda call, a, b: a.bitwiseAND(b)
SCALARS["bitor"] = lambda call, a, b: a.bitwiseOR(b)
SCALARS["bitxor"] = lambda call, a, b: a.bitwiseXOR(b)
SCALARS["bitnot"] = lambda call, a: F.bitwise_not(a)
SCALARS["ceil"] = SCALARS["ceiling"] = lambda call, x: F.ceil(x.cast("double")).cast("double")
SCALARS["floor"] = lambda call, x: F.floor(x.cast("double")).cast("double")
SCALARS["pi"] = lambda call: F.pi()
SCALARS["rand"] = lambda call: F.rand()
SCALARS["sign"] = lambda call, x: F.signum(x.cast("double")).cast("bigint")
SCALARS["round"] = lambda call, x, d=None: F.round(x.cast("double"), call.values[1] if d is not None else 0)
#: In spite of the name, half away from zero.
SCALARS["trunc"] = lambda call, x, d: F.round(x.cast("double"), call.values[1])


@scalar("log")
def log(call, a, b=None):
    """Base 10 with one argument; the base comes first with two."""
    x = F.log10(a.cast("double")) if b is None else F.ln(b.cast("double")) / F.ln(a.cast("double"))
    return F.when(~F.isnan(x), x)


@scalar("conv")
def conv(call, s, low, high):
    return F.conv(s.cast("string"), call.values[1], call.values[2])
