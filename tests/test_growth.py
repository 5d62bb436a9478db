"""Rows that pass through a query's joins when many rows meet under one key."""

import datetime
import pathlib
import random

from pyspark.sql import functions as F

import __spark_entry__
from mensura.operators import scopes, spatial
from mensura.operators.spatial import checkpoint_folder
from mensura.plans.proxies import view


def most_rows(df):
    """The most rows that an operator of the executed plan has put out."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()

    def walk(node):
        metric = node.metrics().get("numOutputRows")
        own = [metric.get().value()] if metric.isDefined() else []
        if node.nodeName() == "AdaptiveSparkPlan":
            inner = [node.executedPlan()]
        elif node.nodeName().endswith("QueryStage"):
            inner = [node.plan()]
        else:
            inner = [node.children().apply(k) for k in range(node.children().size())]
        return max([*own, *map(walk, inner)], default=0)

    return walk(df._jdf.queryExecution().executedPlan())


def test_price_in_scope_pairs_no_price_with_a_request(spark):
    rng = random.Random(4)
    day = lambda: datetime.date(1999, 1, 1) + datetime.timedelta(days=rng.randint(0, 900))
    prices = [("m", None, None, None, float(k), day(), None, k) for k in range(2000)]
    asked = [(k, "m", "A", None, "X", day()) for k in range(1500)]
    got = scopes.in_scope(
        spark.createDataFrame(prices, "material_name string, company string, region string, supplier string, unit_price double, effective_from date, effective_to date, seq long"),
        spark.createDataFrame(asked, "ask_id long, material_name string, company string, region string, supplier string, on date"),
    )
    assert most_rows(got) < 4 * (len(prices) + len(asked))
    want = {a[0]: max(((p[5], p[7]) for p in prices if p[5] <= a[5]), default=(None, None))[1] for a in asked}
    assert {r.ask_id: r.price_seq for r in got.collect()} == want


def stored(spark):
    return {p for p in pathlib.Path(checkpoint_folder(spark).removeprefix("file:")).rglob("*") if p.is_file()}


def test_runs_in_order_store_no_rounds(spark):
    before = stored(spark)
    found = __spark_entry__.queries()["route_path_order"](spark, __spark_entry__.SMOKE)
    assert found.count() > 100 and stored(spark) == before


def test_faces_of_sheets_store_rings_only(spark):
    before = stored(spark)
    found = __spark_entry__.queries()["polygon_faces"](spark, __spark_entry__.SMOKE)
    count = found.count()
    folders = {p.parent for p in stored(spark) - before}
    assert count > 500 and len(folders) <= 6
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan


def test_few_texts_stand_around_many_targets(spark):
    rng = random.Random(9)
    targets = [("s", k, rng.random() * 100, rng.random() * 100) for k in range(6000)]
    texts = [("s", k, rng.random() * 100, rng.random() * 100) for k in range(50)] + [("s", 50, 500.0, 50.0), ("t", 51, 1.0, 1.0)]
    got = spatial.nearest_of_all(spark.createDataFrame(texts, "sheet string, text_id long, x double, y double"), spark.createDataFrame(targets, "sheet string, target_id long, x double, y double"))
    want = {t: min(((x - a) ** 2 + (y - b) ** 2, k) for _, k, a, b in targets)[1] for s, t, x, y in texts if s == "s"}
    assert {r.text_id: r.target_id for r in got.collect()} == want


def test_nearest_meets_few_of_many_targets_in_reach(spark):
    rng = random.Random(6)
    place = lambda: (rng.gauss(0, 10), rng.gauss(0, 10))
    copied = [place() for _ in range(300)]
    targets = [(k, *copied[k % 300]) for k in range(3000)]
    texts = [(k, *place()) for k in range(500)] + [(500, 90.0, 0.0), (501, 50.0, 5.0), (502, float("nan"), 0.0), (503, None, 0.0)]
    got = spatial.nearest(spark.createDataFrame(texts, "text_id long, x double, y double"), spark.createDataFrame(targets, "target_id long, x double, y double"), 50.0)
    assert most_rows(got) < 30_000
    want = {}
    for k, x, y in texts[:502]:
        d2, target = min(((x - a) * (x - a) + (y - b) * (y - b), t) for t, a, b in targets)
        if d2 <= 2500.0:
            want[k] = target
    assert {r.text_id: r.target_id for r in got.collect()} == want and 500 not in want


def test_near_boxes_stay_spread_over_tasks(spark):
    boxes = [("s", k, float(k % 40), 0.0, float(k % 40 + 3), 2.0) for k in range(400)]
    found = spatial.near_boxes(spark.createDataFrame(boxes, "layer string, ord long, x0 double, y0 double, x1 double, y1 double"), 0.0)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_routes_stay_spread_over_tasks(spark):
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert view(spark, __spark_entry__.SMOKE, "items").rdd.getNumPartitions() == tasks
    assert __spark_entry__.queries()["route_measure"](spark, __spark_entry__.SMOKE).rdd.getNumPartitions() == tasks


def test_spaces_stay_spread_and_broadcast_no_orders(spark):
    found = __spark_entry__.queries()["space_volume"](spark, __spark_entry__.SMOKE)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_spaces_of_many_rows_take_more_tasks(spark, tmp_path):
    orders, tasks = 400_000, spark.conf.get("spark.sql.shuffle.partitions")
    corners = F.array(*[F.struct(F.lit(k).alias("l_linenumber"), F.lit(x).alias("l_quantity")) for k, x in ((1, 1.0), (2, 5.0), (3, 7.0), (4, 2.0))])
    lines = spark.range(orders).select(F.col("id").alias("l_orderkey"), F.lit(1).cast("long").alias("l_partkey"), F.lit(1.0).alias("l_extendedprice"), F.inline(corners))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(orders).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey")).write.parquet(str(tmp_path / "orders.parquet"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        found = __spark_entry__.queries()["space_volume"](spark, str(tmp_path))
        per_task = found.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("routes"), F.min("area").alias("least"), F.max("area").alias("most")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
    assert sum(r.routes for r in per_task) == orders and {(r.least, r.most) for r in per_task} == {(9.0, 9.0)}
    assert max(r.routes for r in per_task) < 0.6 * orders
