"""Reproducible randomness as Column expressions.

A draw is a pure function of (seed, role, identifiers), so a task that is re-run after an executor loss gives the
same numbers, which ``rand()`` over a shuffled input does not. ``md5`` is portable to other engines and is the
default; ``xxhash64`` is several times faster and has the same distribution. A public seed is for tests: a private
release needs a secret one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS_52 = float(2 ** 52)
BITS_53 = float(2 ** 53)


def uniform(seed: int | str, *parts: Column | str | int, method: str = "md5") -> Column:
    """Uniform double in [0, 1). String arguments are literal role tags, columns are identifiers."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    if method == "md5":
        text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols])
        head = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10)
        return head.cast("bigint").cast("double") / F.lit(BITS_52)
    if method == "xxhash64":
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(str(seed)), *cols), 11)
        return bits.cast("double") / F.lit(BITS_53)
    raise ValueError(f"unknown hash method {method!r}")


def open_unit(u: Column) -> Column:
    """Shift a draw to the open interval (0, 1) so that its logarithm is finite."""
    return u + F.lit(1.0 / BITS_53)


def laplace(u: Column, scale: Column | float) -> Column:
    """Inverse-CDF Laplace noise from one uniform."""
    centred = open_unit(u) - F.lit(0.5)
    b = scale if isinstance(scale, Column) else F.lit(float(scale))
    return -b * F.signum(centred) * F.ln(F.lit(1.0) - F.lit(2.0) * F.abs(centred))


def gaussian(u1: Column, u2: Column) -> Column:
    """Standard normal by Box-Muller from two uniforms."""
    return F.sqrt(F.lit(-2.0) * F.ln(open_unit(u1))) * F.cos(F.lit(2.0 * math.pi) * u2)


def pick(u: Column, low: Column, size: Column) -> Column:
    """Uniform integer in [low, low + size)."""
    return (low + F.floor(u * size)).cast("bigint")
