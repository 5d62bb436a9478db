"""Polylines and route lengths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.functions.numbers import correctly_rounded
from mensura.functions.texts import scale_denominator
from mensura.operators.spatial import keep_first, spread


def points_of(items: Column) -> Column:
    """The points of drawing items array<struct<op, pts>>: a rectangle gives its four corners, quads give none, all
    else gives its points, control points included."""
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))

    def of(item: Column) -> Column:
        a, b = item["pts"][0], item["pts"][1]
        corners = F.array(corner(a["x"], a["y"]), corner(b["x"], a["y"]), corner(b["x"], b["y"]), corner(a["x"], b["y"]))
        return F.when(item["op"] == "re", corners).when(item["op"] == "qu", F.array().cast("array<struct<x:double,y:double>>")).otherwise(item["pts"])

    return F.flatten(F.transform(items, of))


def raw_length(points: Column) -> Column:
    """The sum of the distances of consecutive points, added up in order."""
    step = lambda k: F.hypot(points[k]["x"] - points[k - 1]["x"], points[k]["y"] - points[k - 1]["y"])
    return F.when(F.size(points) < 2, 0.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1))), F.lit(0.0), lambda acc, k: acc + step(k)))


def length(points: Column, scale: Column) -> Column:
    return correctly_rounded(raw_length(points) * scale_denominator(scale), 3)


def measure_routes(clusters: DataFrame, paths: DataFrame, route_layers: list[str], order: str = "sorted", tolerance: float = 1e-6) -> DataFrame:
    """Lengths of clusters (cluster_id, ord, scale, members: array<string>) over paths (id, layer, points).  The first
    member's layer must be a route layer; of clusters with the same members the first counts.  order='sorted': all members'
    points are pooled and sorted; order='path': members are chained at ends that meet (run_order), and the lengths of the
    polylines added up, so that a run's length does not depend on how its members are listed or drawn."""
    counted = clusters.filter(~((F.col("cluster_id") == -1) & (F.size("members") <= 1)))
    known = spread(paths.select("id", "layer", "points"), "id")
    # the first member's layer decides, before any points move
    first = counted.select("ord", F.try_element_at("members", F.lit(1)).alias("id")).join(known.select("id", "layer"), "id").filter(F.col("layer").isin(route_layers)).select("ord", "layer")
    chosen = counted.join(first, "ord")
    members = spread(chosen.select("ord", F.explode("members").alias("id")).join(known.select("id", "points"), "id").select("ord", "id", "points"), "ord")
    if order == "path":
        lines = run_order(members, "ord", tolerance).withColumn("points", F.flatten("polylines"))
        routes = chosen.join(lines, "ord").select(*[c for c in clusters.columns], "layer", "points", "polylines")
        measured = routes.withColumn("length_m", path_length(F.col("polylines"), F.col("scale")))
    else:
        pooled = members.select("ord", F.explode("points").alias("p")).groupBy("ord").agg(F.array_sort(F.collect_list("p")).alias("points"))
        routes = chosen.join(pooled, "ord").filter(F.size("points") >= 2).select(*[c for c in clusters.columns], "layer", "points")
        measured = routes.withColumn("length_m", length(F.col("points"), F.col("scale")))
    return keep_first(measured, F.array_join(F.array_sort("members"), ","), [F.col("ord")])


def _chained(a: list, b: list) -> list[list[int]]:
    """Polylines of lines from node a to node b, as halves in order: 2k is line k as drawn, 2k + 1 backwards."""
    start = [n for pair in zip(a, b) for n in pair]
    at: dict[tuple, list[int]] = {}
    for h, n in enumerate(start):
        at.setdefault(n, []).append(h)
    meets = {h: other for pair in at.values() if len(pair) == 2 for h, other in (pair, pair[::-1])}
    order = sorted(range(len(start)), key=lambda h: (start[h], h))
    seen, out = [False] * len(a), []
    # a chain is walked from its smaller end; what is left has no ends
    for h in [h for h in order if h not in meets] + order:
        line = []
        while h is not None and not seen[h >> 1]:
            seen[h >> 1] = True
            line.append(h)
            h = meets.get(h ^ 1)
        if line:
            out.append(line)
    return sorted(out, key=lambda line: (start[line[0]], line[0]))


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with `halves`: _chained for the members of each row."""
    for batch in batches:
        members = batch.column("members")
        flat, offsets = members.flatten(), members.offsets.to_pylist()
        # nulls count as smallest, as in Spark
        whole = lambda name: [(v is not None, v or 0) for v in flat.field(name).to_pylist()]
        a, b = ([*zip(whole(f"{p}x"), whole(f"{p}y"))] for p in "ab")
        found = [_chained(a[i - offsets[0] : j - offsets[0]], b[i - offsets[0] : j - offsets[0]]) for i, j in zip(offsets, offsets[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.list_(pa.int32())))], names=[*batch.schema.names, "halves"])


def run_order(members: DataFrame, group: str = "ord", tolerance: float = 1e-6, also: tuple[str, ...] = ()) -> DataFrame:
    """group, polylines: the members (group, id, points in their own order) of every run chained end to end; of the columns `also`,
    which a run's members have in common, one value each.

    Ends that round to the same multiple of `tolerance` meet.  Two ends that meet alone are joined; where three or more
    meet, polylines end.  Each polyline starts at its smaller end (x, then y, then id), a closed one there where its cut gives the
    smallest start; members of fewer than two points have no ends and are left out.

    A run's members are brought together once, as its result is one row, and chained there in linear time by the nodes of their
    ends; their points stay in the JVM's row and in Arrow."""
    whole = lambda v: F.round(v / tolerance).cast("long")
    first, last = F.col("points")[0], F.try_element_at("points", F.lit(-1))
    ends = [whole(p[c]).alias(f"{n}{c}") for n, p in (("a", first), ("b", last)) for c in "xy"]
    lines = members.filter(F.col(group).isNotNull() & (F.size("points") >= 2)).select(F.col(group).alias("g"), F.struct(F.lit(0), *also).alias("also"), F.struct("id", *ends, "points").alias("member"))
    runs = lines.groupBy("g").agg(F.first("also").alias("also"), F.array_sort(F.collect_list("member")).alias("members"))
    runs = runs.mapInArrow(_in_order, T.StructType([*runs.schema.fields, T.StructField("halves", T.ArrayType(T.ArrayType(T.IntegerType())))]))
    points = lambda h: F.get("members", F.shiftright(h, 1))["points"]
    oriented = lambda h: F.when(h % 2 == 0, points(h)).otherwise(F.reverse(points(h)))
    found = runs.select("g", "also", F.transform("halves", lambda line: F.flatten(F.transform(line, oriented))).alias("polylines"))
    return found.select(F.col("g").alias(group), *[F.col(f"also.{c}").alias(c) for c in also], "polylines")


def path_length(polylines: Column, scale: Column) -> Column:
    """The lengths of a run's polylines, added up."""
    total = F.aggregate(F.transform(polylines, raw_length), F.lit(0.0), lambda a, b: a + b)
    return correctly_rounded(total * scale_denominator(scale), 3)
