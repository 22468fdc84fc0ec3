"""Numbers and sentences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fixed(value: Column, decimals: Column, unit: Column) -> Column:
    size = F.abs(value)
    whole = F.floor(size)
    frac = size - whole
    # 56 bits hold every fraction from 1/16 up exactly, 60 bits the smaller ones that can round up
    scale = F.when(frac < 0.0625, F.lit(2**60)).otherwise(F.lit(2**56))
    scaled = F.floor(frac * scale.cast("double")).cast("long") * unit
    rest = scaled % scale
    part = ((scaled - rest) / scale).cast("long")
    half = (scale / 2).cast("long")
    up = (rest > half) | ((rest == half) & (part % 2 == 1))
    digits = whole.cast("long") * unit + part + F.when(up, 1).otherwise(0)
    text = F.concat(
        F.when(value < 0, "-").otherwise(""), F.floor(digits / unit).cast("string"), F.lit("."),
        F.lpad((digits % unit).cast("string"), decimals, F.lit("0")),
    )
    # from 1e13 on a double has few or no digits after the point, and those print exactly
    large = F.lit(None).cast("string")
    for n in range(1, 7):
        large = F.when(decimals == n, F.format_string(f"%.{n}f", value)).otherwise(large)
    return F.when(size < 1e13, text).when(F.isnan(value) | (size == float("inf")), value.cast("string")).otherwise(large)


def _let(value: Column, then) -> Column:
    """Evaluate ``value`` once and use it many times."""
    return F.transform(F.array(value), then)[0]


def fixed(value: Column, decimals: int) -> Column:
    """Fixed-point text of a double, rounded on its exact binary value, ties to even.

    ``format_string`` rounds the shortest decimal rendering up instead, so 0.125 would read 0.13. The
    fraction is scaled to a whole number of bits and rounded with whole numbers.
    """
    return _let(value.cast("double"), lambda v: _fixed(v, F.lit(decimals), F.lit(10**decimals).cast("long")))


def humanize(value: Column) -> Column:
    """1234567 -> '1.23M': B and M with two decimals, K with one, else two."""

    def scale(v: Column) -> Column:
        def row(divisor: float, decimals: int, suffix: str) -> Column:
            return F.struct(
                (v / F.lit(divisor)).alias("x"), F.lit(decimals).alias("d"),
                F.lit(10**decimals).cast("long").alias("u"), F.lit(suffix).alias("s"),
            )

        size = F.abs(v)
        return F.when(size >= 1e9, row(1e9, 2, "B")).when(size >= 1e6, row(1e6, 2, "M")).when(
            size >= 1e3, row(1e3, 1, "K")
        ).otherwise(row(1.0, 2, ""))

    scaled = _let(value.cast("double"), scale)
    return _let(scaled, lambda r: F.concat(_fixed(r["x"], r["d"], r["u"]), r["s"]))


def signed(value: Column, decimals: int = 1) -> Column:
    unit = F.lit(10**decimals).cast("long")
    return _let(
        value.cast("double"),
        lambda v: F.concat(F.when(v >= 0, "+").otherwise(""), _fixed(v, F.lit(decimals), unit)),
    )


def money(value: Column) -> Column:
    """Two-decimal amounts as exact decimals, so that sums do not depend on row order."""
    return value.cast("decimal(18,2)")


def exact_sum(value: Column, scale: int = 2) -> Column:
    """Order-independent sum of amounts with ``scale`` decimals, as a double."""
    return F.sum(value.cast(f"decimal(18,{scale})")).cast("double")
