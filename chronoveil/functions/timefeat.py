"""Calendar features of a timestamp column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fields(ts: Column, quarter_hour: bool = False) -> dict[str, Column]:
    """Month, day, weekday (Monday = 0), hour and minute (or quarter of the hour)."""
    minute = F.minute(ts)
    return {
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "weekday": F.weekday(ts),
        "hour": F.hour(ts),
        "minute": F.floor(minute / 15).cast("int") if quarter_hour else minute,
    }


def _unit(x: Column, shift: int, span: int) -> Column:
    return (x - shift) / F.lit(float(span)) - F.lit(0.5)


# Each feature maps its calendar field to [-0.5, 0.5].
FEATURES = {
    "second": lambda ts: _unit(F.second(ts), 0, 59),
    "minute": lambda ts: _unit(F.minute(ts), 0, 59),
    "hour": lambda ts: _unit(F.hour(ts), 0, 23),
    "dow": lambda ts: _unit(F.weekday(ts), 0, 6),
    "dom": lambda ts: _unit(F.dayofmonth(ts), 1, 30),
    "doy": lambda ts: _unit(F.dayofyear(ts), 1, 365),
    "month": lambda ts: _unit(F.month(ts), 1, 11),
    "week": lambda ts: _unit(F.weekofyear(ts), 1, 52),
}

# Fixed lists: features used at each sampling frequency, coarsest frequency first.
BY_FREQ = {
    "Y": [],
    "A": [],
    "Q": ["month"],
    "M": ["month"],
    "W": ["dom", "week"],
    "D": ["dow", "dom", "doy"],
    "B": ["dow", "dom", "doy"],
    "H": ["hour", "dow", "dom", "doy"],
    "T": ["minute", "hour", "dow", "dom", "doy"],
    "S": ["second", "minute", "hour", "dow", "dom", "doy"],
}


def by_frequency(ts: Column, freq: str) -> Column:
    """Array of the features for a frequency code such as ``H`` or ``15T``."""
    code = freq.lstrip("0123456789").upper().replace("MIN", "T")[:1]
    if code not in BY_FREQ:
        raise ValueError(f"unsupported frequency {freq!r}; use one of {sorted(BY_FREQ)}")
    return F.array(*[FEATURES[name](ts) for name in BY_FREQ[code]])
