"""Expressions on ARRAY<DOUBLE> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(squared_norm(v))


def p_norm(v: Column, p: float) -> Column:
    if p == 2:
        return l2_norm(v)
    summed = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.pow(F.abs(x), F.lit(float(p))))
    return F.pow(summed, F.lit(1.0 / p))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(v: Column, factor: Column) -> Column:
    return F.transform(v, lambda x: x * factor)


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def var_pop(v: Column) -> Column:
    m = mean(v)
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)) / F.size(v)


def logsumexp(v: Column) -> Column:
    top = F.array_max(v)
    return top + F.ln(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))


def argmax(v: Column) -> Column:
    """0-based index of the largest entry, the first on ties."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("bigint")
