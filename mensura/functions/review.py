"""What a reviewer may do with measured items, and where an item stands on its sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def can_reject(tier: Column) -> Column:
    """Measured items cannot be rejected; items without a tier can."""
    return ~F.coalesce(tier == "MEASURED", F.lit(False))


def corrected(quantity: Column, new: Column) -> Column:
    """The corrected quantity where it is positive, else the one that was there."""
    return F.when(new > 0, new).otherwise(quantity)


def overlay_of(items: DataFrame, overlays: DataFrame) -> DataFrame:
    """The items (id) with x, y, width and height of the first overlay (by ord) of the same id, 0 where there is none or
    where it lacks the value."""
    sides = ["x", "y", "width", "height"]
    first = overlays.groupBy("id").agg(F.min_by(F.struct(*sides), "ord").alias("__o"))
    return items.join(first, "id", "left").select(*[items[c] for c in items.columns], *[F.coalesce(F.col(f"__o.{c}"), F.lit(0.0)).alias(c) for c in sides])
