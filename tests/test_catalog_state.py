"""The stored catalog as a stream: files in any order, landed twice, restarted, equal a batch import in the order of names."""

import datetime
import shutil

import pytest
from pyspark.sql import functions as F

from mensura.operators import catalog
from mensura.streaming import catalog_state

D = datetime.date
PRICES = {
    "2024-01.csv": "material_name,unit,unit_price,effective_from,effective_to\nconduit,m,1.5,2024-01-01,\nclamp,ea,2,,\nbad,ea,x,,\n,ea,1,,\n",
    "2024-02.csv": "material_name,unit,unit_price,effective_from\nconduit,m,1.75,2024-02-01\nbox,ea,0.5,soon\nconduit,m,1.8,2024-02-02\n",
    "2024-03.csv": "unit_price,material_name,unit\n9,clamp,ea\n",
    "rates-1.csv": "rate_name,productivity_rate,hourly_rate,category,effective_from\ncrew,2,40,wiring,2024-01-01\n",
    "rates-2.csv": "rate_name,productivity_rate,hourly_rate,category\ncrew,3,45,\nfitter,1,50,pipes\n",
}
EXISTING = [("conduit", "USD", 1.0, D(2020, 1, 1), None), ("panel", "USD", 300.0, None, None)]
WANT_PRICES = [("box", "USD", 0.5, None, None), ("clamp", "USD", 9.0, None, None), ("conduit", "USD", 1.8, D(2024, 2, 2), None), ("panel", "USD", 300.0, None, None)]
WANT_RATES = [("crew", 3.0, 45.0, "wiring", D(2024, 1, 1), None), ("fitter", 1.0, 50.0, "pipes", None, None)]


def existing(spark):
    return spark.createDataFrame(EXISTING, "material_name string, currency string, unit_price double, effective_from date, effective_to date")


def held(spark, out):
    prices = catalog_state.current(spark, f"{out}/prices", "prices", existing(spark))
    rates = catalog_state.current(spark, f"{out}/labor", "labor")
    return sorted(map(tuple, prices.collect())), sorted(map(tuple, rates.collect()))


def land(spark, tmp, names, as_name=None):
    """Lands files, then imports what is new."""
    (tmp / "in").mkdir(exist_ok=True)
    for n in names:
        (tmp / "in" / (as_name or n)).write_text(PRICES[n])
    for q in catalog_state.import_files(spark, str(tmp / "in"), str(tmp / "out"), str(tmp / "state"), {"prices": existing(spark)}).values():
        q.awaitTermination()


@pytest.mark.parametrize("order", [["2024-01.csv", "rates-1.csv", "2024-02.csv", "rates-2.csv", "2024-03.csv"], ["2024-03.csv", "rates-2.csv", "2024-02.csv", "2024-01.csv", "rates-1.csv"]])
def test_files_in_any_order(spark, tmp_path, order):
    for n in order:  # each import is a restart from the stored state
        land(spark, tmp_path, [n])
    assert held(spark, tmp_path / "out") == (WANT_PRICES, WANT_RATES)


def test_files_that_land_twice_change_nothing(spark, tmp_path):
    land(spark, tmp_path, list(PRICES))
    before = spark.read.parquet(str(tmp_path / "out" / "prices")).count()
    (tmp_path / "in" / "again").mkdir()
    shutil.copy(tmp_path / "in" / "2024-02.csv", tmp_path / "in" / "again" / "2024-02.csv")
    q = catalog_state.import_files(spark, str(tmp_path / "in" / "*"), str(tmp_path / "out"), str(tmp_path / "state"), {"prices": existing(spark)})
    for x in q.values():
        x.awaitTermination()
    assert held(spark, tmp_path / "out") == (WANT_PRICES, WANT_RATES)
    assert spark.read.parquet(str(tmp_path / "out" / "prices")).count() == before


def test_changes_are_told_once(spark, tmp_path):
    land(spark, tmp_path, ["2024-01.csv", "2024-02.csv"])
    told = spark.read.parquet(str(tmp_path / "out" / "prices"))
    assert sorted((r.material_name, r.change) for r in told.collect()) == [("box", "insert"), ("clamp", "insert"), ("conduit", "update")]


def test_stream_equals_batch_upsert(spark, tmp_path):
    """Many rows over few keys, cut into files that land in a shuffled order."""
    rows = spark.range(400).select(F.concat(F.lit("m"), (F.col("id") * 7 % 23).cast("string")).alias("material_name"), F.lit("USD").alias("currency"), (F.col("id") * 1.5).alias("unit_price"), F.lit(None).cast("date").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"), F.format_string("f%02d", F.col("id") % 8).alias("file"), F.col("id").alias("row"))
    order = [5, 0, 7, 2, 2, 1, 6, 3, 4]
    for k, n in enumerate(order):
        rows.filter(F.col("file") == f"f{n:02d}").coalesce(1).write.parquet(str(tmp_path / "in" / f"part-{k}"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in" / "*"))
        catalog_state.store(catalog_state.changes(stream, "prices"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = catalog_state.current(spark, str(tmp_path / "out"), "prices")
    ranked = rows.withColumn("seq", F.dense_rank().over(catalog.W.orderBy("file", "row"))).drop("file", "row")
    want = catalog.upsert_prices(rows.limit(0).withColumn("seq", F.lit(0).cast("long")).drop("file", "row"), ranked)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect())) and got.count() == 23
