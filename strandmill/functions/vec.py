"""Column arithmetic on numeric arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(x: Column | str) -> Column:
    return _c(x).cast("array<double>")


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def sub(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def scale(a: Column | str, k: Column | float) -> Column:
    return F.transform(_c(a), lambda x: x * k)


def total(a: Column | str) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def sqdist(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def norm(a: Column | str) -> Column:
    return F.sqrt(total(F.transform(_c(a), lambda x: x * x)))


def rounded(a: Column | str, digits: int = 6) -> Column:
    """Rounded, with negative zero as zero."""
    return F.transform(_c(a), lambda x: F.round(x, digits) + 0.0)


def one_hot(token: Column | str, size: int) -> Column:
    """1.0 at the token's place, 0.0 elsewhere; a token outside 0 to size - 1 has no place."""
    t = _c(token)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == t).cast("double"))


def interleave(weights: Column | str, vectors: Column | str) -> Column:
    """p_1, c_1..., p_2, c_2...: each weight before its vector, in one array."""
    return F.flatten(F.zip_with(_c(weights), _c(vectors), lambda p, c: F.concat(F.array(p), c)))


def finite(x: Column | str) -> Column:
    c = _c(x).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
