"""Schedules written as scattered text runs: runs are put together in reading order, then searched with a table of patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mensura.functions import texts
from mensura.operators.spatial import box_clusters


def patterns(spark: SparkSession) -> DataFrame:
    """rank, shape, pattern, unit of the known shapes of schedule entries; a pattern's three groups are label, unit and value.  A
    table, so that a project can have shapes of its own; it is edited by hand and small."""
    rows = [(k, shape, p, "cm" if shape == "slope" else None) for k, (shape, p) in enumerate(texts.SCHEDULE_SHAPES.items())]
    return spark.createDataFrame(rows, "rank int, shape string, pattern string, unit string")


def assembled(runs: DataFrame, reach: float, group: str = "sheet") -> DataFrame:
    """group, block, text, parts of text runs (group, ord, text, x0, y0, x1, y1): runs that chains of gaps of at most `reach` connect are
    one block (the smallest ord of them), read line by line from the top and from the left within a line.  A run starts a
    new line where its middle lies below the bottom of what the line has so far; runs are joined by one space, empty ones left out."""
    given = runs.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    placed = box_clusters(given, reach, group).withColumnRenamed("label", "block")
    down = W.partitionBy(group, "block").orderBy("y0", "x0", "ord")
    middle, bottom = (F.col("y0") + F.col("y1")) / 2, F.max("y1").over(down.rowsBetween(W.unboundedPreceding, -1))
    starts = placed.withColumn("starts", F.coalesce(middle > bottom, F.lit(False)).cast("int"))
    lines = starts.withColumn("line", F.sum("starts").over(down.rowsBetween(W.unboundedPreceding, 0)))
    read = F.array_sort(F.collect_list(F.struct("line", "x0", "ord", F.trim("text").alias("text"))))
    whole = lines.groupBy(group, "block").agg(F.array_join(F.transform(read, lambda r: r["text"]), " ").alias("text"), F.count(F.lit(1)).alias("parts"))
    return whole


def entries(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """The rows with position, shape, label, unit, value: every match of every pattern in `text`, by shape and place (`position`
    counts from 0 within a shape)."""
    met = blocks.crossJoin(F.broadcast(known))  # the patterns are few, and edited by hand
    groups = [F.expr(f"regexp_extract_all(text, pattern, {k})") for k in (1, 2, 3)]
    found = met.withColumns({"labels": groups[0], "units": groups[1], "values": groups[2]})
    each = F.posexplode(F.arrays_zip("labels", "units", "values")).alias("position", "m")
    matched = found.select(*blocks.columns, "shape", F.col("unit").alias("fixed"), each)
    return matched.select(*blocks.columns, "shape", "position", F.trim("m.labels").alias("label"), F.coalesce("fixed", F.trim("m.units")).alias("unit"), F.trim("m.values").alias("value"))
