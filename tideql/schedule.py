"""When a rule with a schedule is to run."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

_UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600}
_LIMITS = [(0, 59), (0, 23), (1, 31), (1, 12), (0, 6)]


def seconds(text: str) -> float:
    """A duration such as 1h30m or 10s."""
    parts = re.findall(r"([\d.]+)(ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"not a duration: {text!r}")
    return sum(float(n) * _UNITS[u] for n, u in parts)


def _fits(field: str, value: int, low: int, high: int) -> bool:
    for part in field.split(","):
        span, _, step = part.partition("/")
        a, _, z = span.partition("-")
        first = low if a == "*" else int(a)
        last = high if a == "*" or (step and not z) else int(z or a)
        if first <= value <= last and (value - first) % int(step or 1) == 0:
            return True
    return False


def matches(cron: str, at: datetime) -> bool:
    """Whether a minute fits minute, hour, day, month and weekday (0: Sunday); of day and weekday one is enough where both are given."""
    fields = cron.split()
    if len(fields) != 5:
        raise ValueError(f"not a cron expression: {cron!r}")
    minute, hour, day, month, weekday = (_fits(f, v, *limit) for f, v, limit in zip(fields, (at.minute, at.hour, at.day, at.month, at.isoweekday() % 7), _LIMITS, strict=True))
    days = day or weekday if fields[2] != "*" and fields[4] != "*" else day and weekday
    return minute and hour and month and days


def due(options: dict, now: float) -> bool:
    """Whether a rule runs at a time (seconds of UTC) by its ``cron``, ``duration`` and ``cronDatetimeRange``."""
    at = datetime.fromtimestamp(now, UTC)
    spans = options.get("cronDatetimeRange") or []
    inside = not spans or any(_time(s["begin"]) <= at <= _time(s["end"]) for s in spans)
    if not options.get("cron"):
        return inside
    length = seconds(options["duration"])
    minute = at.replace(second=0, microsecond=0)
    steps = int(length // 60) + 1
    return inside and any(matches(options["cron"], m) and (at - m).total_seconds() < length for m in (minute - timedelta(minutes=i) for i in range(steps)))


def _time(text: str) -> datetime:
    found = datetime.fromisoformat(text)
    return found if found.tzinfo else found.replace(tzinfo=UTC)
