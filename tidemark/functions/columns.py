"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-8


def series() -> WindowSpec:
    """One series' rows in date order."""
    return Window.partitionBy("symbol").orderBy("date")


def last_rows(n: int) -> WindowSpec:
    """The current row and the ``n - 1`` before it."""
    return series().rowsBetween(-(n - 1), 0)


def next_rows(n: int) -> WindowSpec:
    """The ``n`` rows after the current one."""
    return series().rowsBetween(1, n)


def so_far() -> WindowSpec:
    return series().rowsBetween(Window.unboundedPreceding, 0)


def full(value: Column, of: Column, n: int) -> Column:
    """``value`` over the last ``n`` rows, null until all of them hold ``of``."""
    w = last_rows(n)
    return F.when(F.count(of).over(w) == n, value.over(w))


def complete(value: Column, of: Column, n: int) -> Column:
    """``value`` over the next ``n`` rows, null unless all of them are there."""
    w = next_rows(n)
    return F.when(F.count(of).over(w) == n, value.over(w))


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null, though ``least`` and ``greatest`` skip it."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def clip01(x: Column) -> Column:
    return clip(x, 0.0, 1.0)


def at_least(x: Column, low: float = EPS) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def quantiles(x: Column, at: list[float]) -> Column:
    """Exact, linearly interpolated."""
    return F.percentile(x, F.array(*map(F.lit, at)))


def average_rank(x: Column, within: list[str] | None = None) -> Column:
    """Rank of ``x`` among the non-null values of its group, ties at their mean."""
    keys = within or ["symbol"]
    present = x.isNull()
    w, tied = Window.partitionBy(*keys, present).orderBy(x), Window.partitionBy(*keys, x)
    return F.when(x.isNotNull(), F.rank().over(w) + (F.count(x).over(tied) - 1) / 2)


def percentile_rank(x: Column, within: list[str] | None = None) -> Column:
    keys = within or ["symbol"]
    return average_rank(x, keys) / F.count(x).over(Window.partitionBy(*keys))


def equal_buckets(row_number: Column, n: Column, buckets: int) -> Column:
    """Quantile bucket, from 0, of the row of that rank among ``n`` distinct ranks."""
    above = (F.lit(buckets) * (row_number - 1) + n - 2) / F.greatest(n - 1, F.lit(1))
    return F.greatest(F.floor(above).cast("long") - 1, F.lit(0).cast("long"))


def double_sha256_display(data: Column) -> Column:
    """Double SHA-256 of bytes in byte-reversed order, as chain hashes are shown."""
    once = F.unhex(F.sha2(data, 256))
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex(F.unhex(F.sha2(once, 256))), F.lit("(..)"), F.lit(1))), ""))


def little_endian(data: Column) -> Column:
    """Unsigned integer of up to 7 little-endian bytes."""
    return F.conv(F.array_join(F.reverse(F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1))), ""), 16, 10).cast("long")


def little_endian_hex(value: Column, width: int) -> Column:
    """Hex of the ``width`` little-endian bytes of a non-negative integer."""
    return F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(value), 2 * width, "0"), F.lit("(..)"), F.lit(1))), "")


def compact_size_hex(value: Column) -> Column:
    """Hex of a compact-size integer."""
    tags = ((65536, "FD", 2), (4294967296, "FE", 4))
    wide = F.concat(F.lit("FF"), little_endian_hex(value, 8))
    for bound, tag, width in reversed(tags):
        wide = F.when(value < bound, F.concat(F.lit(tag), little_endian_hex(value, width))).otherwise(wide)
    return F.when(value < 253, little_endian_hex(value, 1)).otherwise(wide)


def compact_size(data: Column) -> Column:
    """Value of a compact-size integer at the start of ``data``."""
    first = F.conv(F.hex(F.substring(data, 1, 1)), 16, 10).cast("int")
    wide = F.when(first < 253, 0).when(first == 253, 2).when(first == 254, 4).otherwise(8)
    return F.when(wide == 0, first.cast("long")).otherwise(little_endian(F.substring(data, F.lit(2), wide)))


def compact_size_length(value: Column) -> Column:
    return F.when(value < 253, 1).when(value < 65536, 3).when(value < 4294967296, 5).otherwise(9)


def zero_padded(value: Column, width: int = 20) -> Column:
    return F.lpad(value.cast("string"), width, "0")
