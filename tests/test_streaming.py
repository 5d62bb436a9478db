"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from mensura.operators import catalog
from mensura.plans import boq
from mensura.plans.proxies import view
from mensura.streaming import takeoff

SF = "/root/testdata/sf0.001"


def drained(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def landed(spark, df, path, parts=3):
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_priced_lines(spark, tmp_path):
    items, prices = view(spark, SF, "items"), view(spark, SF, "prices")
    latest = catalog.latest_price(prices.filter("material_name IS NOT NULL"))
    got = drained(takeoff.priced_lines(landed(spark, items, str(tmp_path / "items")), latest), "priced", "append")
    want = boq.counted_lines(spark, items, prices)
    columns = ["item_id", "material_name", "quantity", "total_cost", "unpriced"]
    assert got.select(columns).exceptAll(want.select(columns)).isEmpty() and got.count() == want.count()


def test_review_counts(spark, tmp_path):
    rows = view(spark, SF, "measured").withColumn("ts", F.col("ts").cast("timestamp"))
    got = drained(takeoff.review_counts(landed(spark, rows, str(tmp_path / "m"), 1)), "reviews", "complete")
    assert got.agg(F.sum("reviewed")).first()[0] == rows.count()


def test_import_catalog(spark, tmp_path):
    rows = view(spark, SF, "imported")
    folder = str(tmp_path / "out")
    takeoff.import_catalog(landed(spark, rows, str(tmp_path / "in")), folder, str(tmp_path / "checkpoint")).awaitTermination()
    want = catalog.import_report(catalog.validated(rows)).first()
    assert spark.read.parquet(f"{folder}/accepted").count() == want["successful"]
    assert spark.read.parquet(f"{folder}/rejected").count() == want["failed"]
