"""Order statistics on sorted arrays and robust statistics as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, where ``then`` uses it several times."""
    return F.transform(F.array(value), then)[0]


def type8(values: Column, q: float) -> Column:
    """Hyndman-Fan type 8 quantile of an ascending array: h = (n + 1/3) q + 1/3."""
    n = F.size(values)
    h = (n + F.lit(1.0) / 3) * q + F.lit(1.0) / 3
    i = F.floor(h).cast("int")
    inner = F.element_at(values, F.greatest(i, F.lit(1))) + (h - i) * (F.element_at(values, F.least(i + 1, n)) - F.element_at(values, F.greatest(i, F.lit(1))))
    return F.when(n == 0, None).when(h >= n, F.element_at(values, n)).when(h <= 1, F.element_at(values, 1)).otherwise(inner)


def median_of(values: Column) -> Column:
    """Median of an ascending array."""
    n = F.size(values)
    return F.when(n == 0, None).otherwise((F.element_at(values, F.floor((n + 1) / 2).cast("int")) + F.element_at(values, F.floor((n + 2) / 2).cast("int"))) / 2)


def mad(values: Column) -> Column:
    """1.4826 times the median absolute deviation of an ascending array."""
    return let(median_of(values), lambda m: let(F.array_sort(F.transform(values, lambda v: F.abs(v - m))), lambda d: 1.4826 * median_of(d)))


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c with the product unrounded, as processors fuse it: the product's rounding error (Dekker's, by halves of 26 bits) is added back."""
    high = lambda x: x * 134217729.0 - (x * 134217729.0 - x)
    ah, bh, p = high(a), high(b), a * b
    error = (a - ah) * (b - bh) - (((p - ah * bh) - (a - ah) * bh) - ah * (b - bh))
    s = p + c
    lost = (p - (s - (s - p))) + (c - (s - p))
    return s + F.nanvl(lost + error, F.lit(0.0))  # infinite values have no rounding error


def quantile(values: Column, q: float) -> Column:
    """The ``q`` quantile of a sorted array without nulls, between its two places' values as the SQL's quantile_cont has it to the last bit; null if empty."""
    at = (F.size(values) - 1) * F.lit(q)
    d = at - F.floor(at)
    low, high = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
    between = lambda s: F.when(s["d"] == 0, s["low"]).otherwise(fused(s["low"], 1 - s["d"], s["high"] * s["d"]))
    return F.when(F.size(values) > 0, let(F.struct(low.alias("low"), high.alias("high"), d.alias("d")), between))
