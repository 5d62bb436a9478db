"""Review: the time it takes without the pauses, and corrections as an append-only log.  All of it works on batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

#: Kinds of corrections, and which part of an item's state each one sets.
SETS, REJECTS, ACCEPTS = "set", "reject", "accept"


def review_sessions(decisions: DataFrame, pause: str = "30 minutes", late: str | None = None) -> DataFrame:
    """sheet, tier, reviewer, started, ended, decided of every session: decisions (sheet, tier, reviewer, ts) at most a pause apart.
    late: how late rows of a stream may come; a stream's sessions are emitted once no row can extend them."""
    timed = decisions.filter("ts IS NOT NULL")
    timed = timed if late is None else timed.withWatermark("ts", late)
    grouped = timed.groupBy(F.session_window("ts", pause).alias("session"), "sheet", "tier", "reviewer")
    found = grouped.agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("decided"))
    return found.select("sheet", "tier", "reviewer", "started", "ended", "decided")


def review_time(sessions: DataFrame) -> DataFrame:
    """sheet, tier, sessions, decided, busy_us, mean_us: the time spent within sessions, in all and for each decision after a
    session's first one (null where no session has a second)."""
    busy = F.unix_micros("ended") - F.unix_micros("started")
    told = sessions.groupBy("sheet", "tier").agg(F.count(F.lit(1)).alias("sessions"), F.sum("decided").alias("decided"), F.sum(busy).alias("busy_us"))
    steps = F.col("decided") - F.col("sessions")
    return told.withColumn("mean_us", F.when(steps > 0, F.col("busy_us") / F.when(steps > 0, steps)))


def record_corrections(corrections: DataFrame, folder: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Appends a stream of corrections (correction_id, item_id, kind, quantity, ts) to the log.  What is sent again within the
    watermark is written once; rows that come late are written, too: the log has no order but that of ts."""
    unique = corrections.withWatermark("ts", late).dropDuplicatesWithinWatermark(["correction_id"])

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return unique.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def corrected_items(items: DataFrame, log: DataFrame, as_of: str | None = None) -> DataFrame:
    """The items (item_id, quantity, ...) with corrected_quantity, rejected and corrections as of a time (all of the log where none is
    given): nothing is overwritten, the log is replayed in the order of ts and correction_id.  'set' gives a quantity,
    'reject' and 'accept' decide about the item; corrections told twice count once, those of unknown items not at all."""
    known = log.filter("ts IS NOT NULL AND item_id IS NOT NULL")
    known = known if as_of is None else known.filter(F.col("ts") <= F.lit(as_of).cast("timestamp"))
    order = F.struct("ts", "correction_id")
    # two copies of a correction have one place in the order, so the last values need no step that removes copies
    quantity = F.max_by("quantity", F.when(F.col("kind") == SETS, order)).alias("set_quantity")
    decided = F.max_by("kind", F.when(F.col("kind").isin(REJECTS, ACCEPTS), order)).alias("decision")
    state = known.groupBy("item_id").agg(quantity, decided, F.countDistinct("correction_id").alias("corrections"))
    joined = items.join(state, "item_id", "left")
    return joined.select(*items.columns, F.coalesce("set_quantity", "quantity").alias("corrected_quantity"), F.coalesce(F.col("decision") == REJECTS, F.lit(False)).alias("rejected"), F.coalesce("corrections", F.lit(0)).alias("corrections"))
