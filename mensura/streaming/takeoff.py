"""Structured Streaming forms: priced lines of arriving items, catalog files as they land, review counts by window.

The batch operators are used as they are on each stream; state is kept by Spark (windows with a watermark) or in
per-batch folders that a repeated batch overwrites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from mensura.functions import confidence
from mensura.operators import catalog
from mensura.sources import rules


def priced_lines(items: DataFrame, latest: DataFrame) -> DataFrame:
    """Priced lines of a stream of items (item_id, layer, amount) against a static price list."""
    spark = items.sparkSession
    mapped = items.join(F.broadcast(rules.layers(spark)), "layer")
    return catalog.priced(catalog.expanded(mapped, rules.bom(spark)), latest)


def review_counts(measured: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts of statuses by event-time window (ts); rows later than the watermark are left out of closed windows."""
    tier = confidence.status(F.col("source"), F.col("rule_version"))
    staged = measured.withColumn("status", F.coalesce(tier, F.lit("none"))).withWatermark("ts", late)
    counts = staged.groupBy(F.window("ts", window), "status").agg(F.count(F.lit(1)).alias("reviewed"))
    return counts.select(F.col("window.start").alias("start"), "status", "reviewed")


def import_catalog(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Validates arriving catalog rows; each micro-batch writes its good rows and its errors to folders of its own,
    overwriting what an earlier attempt at the same batch left."""

    def write(batch: DataFrame, number: int) -> None:
        checked = catalog.validated(batch).persist()
        checked.filter("reason IS NULL").write.mode("overwrite").parquet(f"{folder}/accepted/batch={number}")
        checked.filter("reason IS NOT NULL").write.mode("overwrite").parquet(f"{folder}/rejected/batch={number}")
        checked.unpersist()

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
