"""Numbers, arrays, bytes and seeds on columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of a two-sided 95 % interval.
Z95 = 1.959963984540054


def rate(passed: Column, eligible: Column, empty: float | None = 0.0) -> Column:
    """passed / eligible; ``empty`` where nothing is eligible (0.0 in core reports, null in contract reports)."""
    return F.when(eligible == 0, F.lit(empty).cast("double")).otherwise(passed.cast("double") / eligible)


def wilson(k: Column, n: Column) -> Column:
    """struct<low, high>: the Wilson 95 % interval of k out of n, in [0, 1]; null for n = 0."""
    n, p = n.cast("double"), F.try_divide(k.cast("double"), n.cast("double"))
    z2 = Z95 * Z95
    centre = (p + F.lit(z2) / (2 * n)) / (1 + F.lit(z2) / n)
    half = F.lit(Z95) * F.sqrt(p * (1 - p) / n + F.lit(z2) / (4 * n * n)) / (1 + F.lit(z2) / n)
    bound = lambda x: F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    return F.struct(bound(centre - half).alias("low"), bound(centre + half).alias("high"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays as doubles; arrays of different length are an error."""
    both = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    total = F.aggregate(both, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different dimension"))).otherwise(total)


def l2_squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays of one length."""
    both = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    total = F.aggregate(both, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different dimension"))).otherwise(total)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1.0 where a vector is zero."""
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms == 0, 1.0).otherwise(1 - dot(a, b) / norms)


def is_close(a: Column, b: Column, rel: float = 1e-9) -> Column:
    """Float equality with a relative tolerance; NaN equals nothing."""
    near = F.abs(a - b) <= F.lit(rel) * F.greatest(F.abs(a), F.abs(b))
    return F.when(F.isnan(a) | F.isnan(b), False).otherwise((a == b) | near)


def seed31(c: Column) -> Column:
    """Seed of 31 bits from the first four bytes of the SHA-256, big-endian."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit((1 << 31) - 1))


def seed64(c: Column) -> Column:
    """Unsigned seed from the first eight bytes of the SHA-256, big-endian."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def byte_pattern(kind: Column, n: Column) -> Column:
    """Hex text of ``n`` bytes: zero, repeat_a5, pulse_start (first byte ff) or pulse_end (last byte ff)."""
    zeros = lambda k: F.repeat(F.lit("00"), F.greatest(k, F.lit(0)).cast("int"))
    return (
        F.when(n <= 0, "")
        .when(kind == "zero", zeros(n))
        .when(kind == "repeat_a5", F.repeat(F.lit("a5"), n.cast("int")))
        .when(kind == "pulse_start", F.concat(F.lit("ff"), zeros(n - 1)))
        .when(kind == "pulse_end", F.concat(zeros(n - 1), F.lit("ff")))
    )


def hex_bytes(c: Column) -> Column:
    """Bytes of lowercase hex text of even length; null for anything else."""
    return F.when(c.rlike("^(?:[0-9a-f]{2})*$"), F.unhex(c))


def range_ok(start: Column, end: Column, size: Column) -> Column:
    """Whether a half-open range is valid and lies within ``size``."""
    return (start >= 0) & (start < end) & (end <= size)


def changed_ranges(before: Column, after: Column) -> Column:
    """array<struct<start, end>>: maximal half-open runs of bytes in which two hex texts of one length differ.

    A run starts at a changed byte whose neighbour before it is unchanged, and
    ends likewise; the n-th start belongs to the n-th end.
    """
    n = (F.greatest(F.length(before), F.length(after)) / 2).cast("int")
    at = lambda c, i: F.substr(c, (2 * i + 1).cast("int"), F.lit(2))
    differs = lambda i: (i >= 0) & (i < n) & (at(before, i) != at(after, i))
    span = F.when(n > 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(span, lambda i: differs(i) & ~differs(i - 1))
    ends = F.filter(span, lambda i: differs(i - 1) & ~differs(i))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end")))


def backoff(base: float, most: float, attempts: int) -> Column:
    """array<double>: delays before each further attempt, doubling from ``base`` up to ``most``."""
    return F.array(*(F.lit(min(base * 2.0**i, most)) for i in range(attempts)))


def strict_equal(a: object, b: object) -> bool:
    """Type-strict recursive equality of JSON values: true is not 1, 1 is not 1.0, floats are close, NaN equals nothing."""
    if type(a) is not type(b):
        return False
    if isinstance(a, float):
        return math.isclose(a, b)
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(strict_equal(v, b[k]) for k, v in a.items())
    if isinstance(a, list):
        return len(a) == len(b) and all(map(strict_equal, a, b))
    return a == b
