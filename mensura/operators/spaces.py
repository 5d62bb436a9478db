"""Labelled spaces: names and stated areas of the texts nearest to each measured polygon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.operators.spatial import nearest_of_all

#: How a text states an area: a number and a unit of square metres.
AREA = r"(?i)^\s*(\d+(?:[.,]\d+)?)\s*(?:m2|m²|sqm|sq\.?\s?m\.?)\s*$"


def label_spaces(spaces: DataFrame, texts: DataFrame, tolerance: float = 0.05, group: str = "sheet") -> DataFrame:
    """The spaces (group, space_id, x, y: the centroid, area) with name, stated_area and status.  Every text (group, text_id, x, y,
    text) belongs to the space whose centroid is nearest, however far (ties to the smaller space); of a space's texts the nearest
    that states an area and the nearest other one count (ties to the smaller text).  Geometry measures, text confirms: CONFIRMED
    where the stated area is within the tolerance of the measured one, CONTRADICTED where it is not, UNSTATED without one."""
    stated = F.replace(F.regexp_extract("text", AREA, 1), F.lit(","), F.lit(".")).try_cast("double")
    written = texts.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select(group, "text_id", "x", "y", "text", stated.alias("stated"))
    near = nearest_of_all(written, spaces.select(group, F.col("space_id").alias("target_id"), "x", "y"), group)
    told = near.join(written.select(group, "text_id", "text", "stated"), [group, "text_id"])
    order = F.struct("distance", "text_id")
    name = F.min_by("text", F.when(F.col("stated").isNull(), order)).alias("name")
    area = F.min_by("stated", F.when(F.col("stated").isNotNull(), order)).alias("stated_area")
    found = told.groupBy(group, F.col("target_id").alias("space_id")).agg(name, area)
    labelled = spaces.join(found, [group, "space_id"], "left")
    close = F.abs(F.col("stated_area") - F.col("area")) <= tolerance * F.col("area")
    return labelled.withColumn("status", F.when(F.col("stated_area").isNull(), "UNSTATED").when(close, "CONFIRMED").otherwise("CONTRADICTED"))
