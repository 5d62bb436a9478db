"""Decimal and rounding columns with the results of exact decimal arithmetic on printed doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact(value: Column, precision: int = 28, scale: int = 18) -> Column:
    """The decimal that a double prints as (0.1 is 0.1, not its binary value)."""
    return value.cast("double").cast("string").cast(f"decimal({precision},{scale})")


def price(value: Column) -> Column:
    return exact(value, 10, 2)


def cents(value: Column) -> Column:
    """Half-up to 0.01, as a double."""
    return F.round(value, 2).cast("double")


def correctly_rounded(value: Column, digits: int) -> Column:
    """A double rounded by its binary value, half to even; as a double."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit("")).cast("double")


def material_cost(quantity: Column, unit_price: Column) -> Column:
    return cents(exact(quantity) * price(unit_price))


def labor_hours(quantity: Column, rate: Column) -> Column:
    """Null where the rate is not positive; rate_error tells why."""
    return F.when(rate > 0, correctly_rounded(quantity / F.when(rate > 0, rate), 2))


def rate_error(rate: Column) -> Column:
    return F.when(rate <= 0, "productivity rate must be positive")


def labor_cost(hours: Column, hourly: Column) -> Column:
    return cents(exact(hours, 20, 8) * price(hourly))


def total_cost(material: Column, labor: Column, *others: Column) -> Column:
    """The sum of the parts that are there, half-up to 0.01."""
    parts = [F.coalesce(exact(c, 20, 4), F.lit(0).cast("decimal(20,4)")) for c in (material, labor, *others)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return cents(total)
