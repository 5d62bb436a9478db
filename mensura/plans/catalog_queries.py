"""Registered queries of the stored catalog and of review: replayed imports, scoped prices, sessions, corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.operators import catalog, reviewing, scopes
from mensura.plans.proxies import cte, streamed, view
from mensura.plans.queries import ORACLES, _known, registered
from mensura.streaming import catalog_state


def _replayed(spark: SparkSession, rows: DataFrame, kind: str, existing: DataFrame | None) -> DataFrame:
    """What the catalog holds when a stream of good rows has passed."""
    folder = catalog_state.scratch(spark)
    changed = catalog_state.changes(rows.withColumn("file", F.lit("import")).withColumnRenamed("seq", "row"), kind, existing)
    catalog_state.store(changed, f"{folder}/changes", f"{folder}/state").awaitTermination()
    held = catalog_state.current(spark, f"{folder}/changes", kind, existing)
    return held.withColumns({c: F.col(c).cast("string") for c in ("effective_from", "effective_to")})


@registered("import_replayed", ORACLES["import_upsert"])
def import_replayed(spark: SparkSession, d: str) -> DataFrame:
    """The rows of import_upsert by keyed state: the file's rows pass as a stream over the catalog stored before."""
    good = catalog.accepted_prices(catalog.validated(streamed(spark, d, "imported_materials")))
    return _replayed(spark, good, "prices", _known(spark, d).drop("seq"))


@registered("import_labor_replayed", ORACLES["import_labor"])
def import_labor_replayed(spark: SparkSession, d: str) -> DataFrame:
    """The rows of import_labor by keyed state."""
    good = catalog.accepted_labor(catalog.validated(streamed(spark, d, "imported_labor")))
    return _replayed(spark, good.withColumn("effective_to", F.col("effective_to").cast("date")), "labor", None)


@registered("price_in_scope", f"""WITH {cte("scoped_prices", "scoped_requests")},
met AS (SELECT a.ask_id, p.unit_price, p.seq AS price_seq, row_number() OVER (PARTITION BY a.ask_id ORDER BY p.company IS NULL, p.region IS NULL, p.supplier IS NULL, p.effective_from DESC NULLS LAST, p.seq DESC) AS n
  FROM scoped_requests a JOIN scoped_prices p ON p.material_name = a.material_name AND (p.company IS NULL OR p.company = a.company) AND (p.region IS NULL OR p.region = a.region) AND (p.supplier IS NULL OR p.supplier = a.supplier)
  AND (p.effective_from IS NULL OR p.effective_from <= a.asked_on) AND (p.effective_to IS NULL OR a.asked_on < p.effective_to))
SELECT a.ask_id, a.material_name, m.unit_price, CAST(coalesce(m.price_seq, -1) AS BIGINT) AS price_seq FROM scoped_requests a LEFT JOIN met m ON m.ask_id = a.ask_id AND m.n = 1""")
def price_in_scope(spark: SparkSession, d: str) -> DataFrame:
    """The price in force for every order line's material, company, region and supplier on its day."""
    asked = view(spark, d, "scoped_requests").withColumnRenamed("asked_on", "on")
    return scopes.in_scope(view(spark, d, "scoped_prices"), asked).select("ask_id", "material_name", "unit_price", F.coalesce("price_seq", F.lit(-1)).cast("long").alias("price_seq"))


_SESSIONS = f"""WITH {cte("decisions")}, steps AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 43200000000 THEN 0 ELSE 1 END AS opens FROM decisions WINDOW w AS (PARTITION BY sheet, tier, reviewer ORDER BY ts)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY sheet, tier, reviewer ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM steps),
sessions AS (SELECT sheet, tier, reviewer, k, count(*) AS decided, epoch_us(max(ts)) - epoch_us(min(ts)) AS busy FROM numbered GROUP BY ALL)
SELECT sheet, tier, count(*) AS sessions, CAST(sum(decided) AS BIGINT) AS decided, CAST(sum(busy) AS BIGINT) AS busy_us, CASE WHEN sum(decided) > count(*) THEN CAST(sum(busy) AS DOUBLE) / CAST(sum(decided) - count(*) AS DOUBLE) END AS mean_us FROM sessions GROUP BY sheet, tier"""


@registered("review_sessions", _SESSIONS)
def review_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The review time of each sheet and tier, pauses of more than half a day left out."""
    decisions = view(spark, d, "decisions").withColumn("ts", F.col("ts").cast("timestamp"))
    return reviewing.review_time(reviewing.review_sessions(decisions, "12 hours"))


@registered("corrected_items", f"""WITH {cte("corrections")}, told AS (SELECT DISTINCT * FROM corrections WHERE ts <= TIMESTAMP '2024-01-20 12:00:00'),
state AS (SELECT item_id, arg_max(quantity, (ts, correction_id)) FILTER (WHERE kind = 'set') AS quantity, arg_max(kind, (ts, correction_id)) FILTER (WHERE kind <> 'set') AS decision, count(DISTINCT correction_id) AS corrections FROM told GROUP BY item_id)
SELECT p_partkey AS item_id, CAST(p_size AS DOUBLE) AS quantity, coalesce(s.quantity, CAST(p_size AS DOUBLE)) AS corrected_quantity, coalesce(s.decision = 'reject', false) AS rejected, CAST(coalesce(s.corrections, 0) AS BIGINT) AS corrections FROM part LEFT JOIN state s ON s.item_id = p_partkey""")
def corrected_items(spark: SparkSession, d: str) -> DataFrame:
    """Items as they stood at noon of a day, from the log of their corrections."""
    items = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("item_id"), F.col("p_size").cast("double").alias("quantity"))
    log = view(spark, d, "corrections").withColumn("ts", F.col("ts").cast("timestamp"))
    return reviewing.corrected_items(items, log, "2024-01-20 12:00:00")
