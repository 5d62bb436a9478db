"""Polygons from line segments: a planar subdivision made of joins, windows and pointer doubling.

1. Coordinates are rounded to multiples of `snap` and held as whole numbers, so that meeting is equality and products are exact.
2. Segments that share a cell of a grid (its side is the group's mean length, so cells are linear in the segments) are cut where
   they cross, touch or overlap; a cut is decided exactly, its place is rounded to the grid of `snap`.
3. Every edge becomes two half-edges.  At each node they are ordered by angle; a half-edge is followed by the one just before
   its twin in that order, which walks around the face on its left.
4. Faces are the cycles of these links.  Edges with one face on both sides (ends that lead nowhere, bridges) bound nothing: they
   go, and the faces are walked again.
5. Cycles that run clockwise are the outlines of connected parts; a ray downwards from such a part's leftmost node
   finds the face that it lies in as a hole.

Groups of at most WHOLE segments are dealt to tasks first, about CHUNK segments a task: steps 2 to 4 need no other exchange for them,
nothing is stored but the rings, and a small helper follows the links.  Segments of a larger group go by cells, segments and nodes
through exchanges of their own, and its cycles are labelled by pointer doubling.

Segments without a group, with ends that are null or not finite, or shorter than `snap` give no edge; repeated and overlapping ones count once.  Whole-number
coordinates must stay under 2**30.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mensura.operators.chains import cycles, followed, ranks
from mensura.operators.spatial import kept

#: Segments of a group that one task takes whole, and segments that a task gets.
WHOLE, CHUNK = 50_000, 20_000


def _whole(name: str, snap: float) -> Column:
    return F.round(F.col(name).cast("double") / snap).cast("long").alias(name)


def _point(x: str, y: str) -> Column:
    return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))


def _ordered(lines: DataFrame) -> DataFrame:
    """Distinct lines of some length, from the smaller end to the larger."""
    a, b = _point("x0", "y0"), _point("x1", "y1")
    turned = lines.filter(a != b).select("chunk", "g", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return turned.select("chunk", "g", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1")).distinct()


def _segments(segments: DataFrame, group: str, snap: float) -> DataFrame:
    """g, x0, y0, x1, y1 on the grid."""
    ends = ("x0", "y0", "x1", "y1")
    finite = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf"))
    return segments.filter(F.col(group).isNotNull()).filter(finite("x0") & finite("y0") & finite("x1") & finite("y1")).select(F.col(group).alias("g"), *[_whole(c, snap) for c in ends])


def _dealt(given: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """chunk, g, x0, y0, x1, y1: distinct segments of the groups that a task takes whole, dealt to tasks by chunk, and those of larger
    groups, where there are any, with a chunk that is no task's."""
    sizes = given.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    tasks = max(int(given.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((total or 0) / CHUNK))
    small, large = given, None
    if (most or 0) > WHOLE:
        names = F.broadcast(sizes.filter(F.col("n") > WHOLE).select("g"))  # one for each WHOLE segments at most
        small, large = given.join(names, "g", "left_anti"), _ordered(given.join(names, "g", "left_semi").withColumn("chunk", F.lit(-1).cast("long")))
    return _ordered(small.withColumn("chunk", F.pmod(F.xxhash64("g"), F.lit(tasks))).repartition(tasks, "chunk")), large


def _extent() -> Column:
    return F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))


def _sided(lines: DataFrame, whole: bool) -> DataFrame:
    """The lines with side: the mean extent of a group's lines."""
    side = lambda mean: F.greatest(F.lit(1), F.ceil(mean)).cast("long")
    if whole:
        return lines.withColumn("side", side(F.avg(_extent()).over(W.partitionBy("chunk", "g"))))
    return lines.join(F.broadcast(lines.groupBy("g").agg(side(F.avg(_extent())).alias("side"))), "g")  # large groups only


def _in_cells(sized: DataFrame) -> DataFrame:
    """The segments in each grid cell that they pass: columns first, then the rows of the part within a column."""
    columns = sized.withColumn("cx", F.explode(F.sequence(F.floor(F.col("x0") / F.col("side")), F.floor(F.col("x1") / F.col("side")))))
    at = lambda x: F.col("y0") + (x - F.col("x0")) * (F.col("y1") - F.col("y0")) / F.greatest(F.col("x1") - F.col("x0"), F.lit(1))
    upright = F.col("x0") == F.col("x1")
    left, right = F.greatest("x0", F.col("cx") * F.col("side")), F.least("x1", (F.col("cx") + 1) * F.col("side"))
    one, two = F.when(upright, F.col("y0")).otherwise(at(left)), F.when(upright, F.col("y1")).otherwise(at(right))
    row = lambda y: F.floor(y / F.col("side"))
    return columns.withColumn("cy", F.explode(F.sequence(row(F.least(one, two) - 1), row(F.greatest(one, two) + 1)))).drop("side")


def _cut(lines: DataFrame, whole: bool) -> DataFrame:
    """chunk, g, x0, y0, x1, y1: distinct edges between neighbouring cuts, from the smaller end to the larger."""
    ends_ = ("x0", "y0", "x1", "y1")
    # the segments of a cell meet in one row; each is met by itself, which lays down its ends, and by those after it
    cells = _in_cells(_sided(lines, whole)).groupBy("chunk", "g", "cx", "cy").agg(F.sort_array(F.collect_list(F.struct(*ends_))).alias("all"))
    ones = cells.select("chunk", "g", "all", F.posexplode("all").alias("i", "a"))
    pairs = ones.select("chunk", "g", "i", "a", F.posexplode("all").alias("j", "b")).filter("i <= j")
    met = pairs.select("chunk", "g", "i", "j", "a.*", *[F.col(f"b.{k}").alias(f"o_{k}") for k in ends_])
    c = F.col
    rx, ry, sx, sy = c("x1") - c("x0"), c("y1") - c("y0"), c("o_x1") - c("o_x0"), c("o_y1") - c("o_y0")
    qx, qy = c("o_x0") - c("x0"), c("o_y0") - c("y0")
    met = met.withColumns({"d": rx * sy - ry * sx, "t": qx * sy - qy * sx, "u": qx * ry - qy * rx})
    sign = F.signum("d").cast("long")
    inside = lambda n: (n * sign >= 0) & (n * sign <= F.abs("d"))
    own, foreign = [c(k) for k in ends_], [c(f"o_{k}") for k in ends_]
    place = lambda s, x, y: F.struct(*[v.alias(k) for k, v in zip(("ax", "ay", "bx", "by"), s)], x.cast("long").alias("x"), y.cast("long").alias("y"))
    x, y = F.round(c("x0") + rx * (c("t") / c("d"))), F.round(c("y0") + ry * (c("t") / c("d")))
    crossing = F.array(place(own, x, y), place(foreign, x, y))
    # on one line: an end of either counts where it lies within the other
    between = lambda px, py, x0, y0, x1, y1: (F.struct(px.alias("x"), py.alias("y")) > F.struct(x0.alias("x"), y0.alias("y"))) & (F.struct(px.alias("x"), py.alias("y")) < F.struct(x1.alias("x"), y1.alias("y")))
    ends = [F.when(between(px, py, *foreign), place(foreign, px, py)) for px, py in (own[:2], own[2:])] + [F.when(between(px, py, *own), place(own, px, py)) for px, py in (foreign[:2], foreign[2:])]
    cuts = F.when(c("i") == c("j"), F.array(place(own, *own[:2]), place(own, *own[2:])))
    cuts = cuts.when((c("d") != 0) & inside(c("t")) & inside(c("u")), crossing).when((c("d") == 0) & (c("t") == 0) & (c("u") == 0), F.array_compact(F.array(*ends)))
    points = met.select("chunk", "g", F.explode(cuts).alias("c")).select("chunk", "g", "c.*").distinct()
    along = W.partitionBy("chunk", "g", "ax", "ay", "bx", "by").orderBy("x", c("y") * F.when(c("by") < c("ay"), -1).otherwise(1))
    pieces = points.select("chunk", "g", c("x").alias("x0"), c("y").alias("y0"), F.lead("x").over(along).alias("x1"), F.lead("y").over(along).alias("y1")).filter("x1 IS NOT NULL")
    return _ordered(pieces)


def cut(segments: DataFrame, group: str, snap: float) -> DataFrame:
    """g, x0, y0, x1, y1: distinct edges between neighbouring cuts, from the smaller end to the larger."""
    small, large = _dealt(_segments(segments, group, snap))
    found = _cut(small, True).drop("chunk")
    return found if large is None else found.unionByName(_cut(large, False).drop("chunk"))


def _half_edges(edges: DataFrame) -> DataFrame:
    """chunk, g, h, x0, y0, x1, y1, next of both half-edges of each edge (chunk, g, e, x0, y0, x1, y1); h is 2e or 2e + 1."""
    ways = F.array(F.struct(F.lit(0).alias("way"), "x0", "y0", "x1", "y1"), F.struct(F.lit(1).alias("way"), F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("x0").alias("x1"), F.col("y0").alias("y1")))
    half = edges.select("chunk", "g", "e", F.explode(ways).alias("w")).select("chunk", "g", (F.col("e") * 2 + F.col("w.way")).alias("h"), "w.x0", "w.y0", "w.x1", "w.y1")
    around = W.partitionBy("chunk", "g", "x0", "y0").orderBy(F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")), "h")
    whole = around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    turned = half.withColumn("before", F.coalesce(F.lag("h").over(around), F.last("h").over(whole)))
    # what comes before a half-edge is what follows its twin
    twin = F.col("h").bitwiseXOR(F.lit(1).cast("long")).alias("h")
    return turned.select("chunk", "g", twin, F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("before").alias("next"))


def _bounding(half: pa.Table) -> pa.Table:
    """The half-edges of whole groups that bound faces, with label and after of their cycles."""
    h, links = half["h"].to_numpy(), half["next"].to_numpy()
    order = np.argsort(h)
    at = lambda ids: order[np.searchsorted(h, ids, sorter=order)]
    following, twin = at(links), at(h ^ 1)
    label, after = followed(h, following)
    bridge = label == label[twin]
    if bridge.any():
        around = following.copy()
        while (skip := bridge[following] & ~bridge).any():
            following[skip] = around[twin[following[skip]]]
        stays = np.flatnonzero(~bridge)
        place = np.cumsum(~bridge) - 1
        half, h, following = half.take(pa.array(stays)), h[stays], place[following[stays]]
        label, after = followed(h, following)
    return half.select(["g", "h", "x0", "y0", "x1", "y1"]).append_column("label", pa.array(label)).append_column("after", pa.array(after))


def _ranked(half: pa.Table) -> pa.Table:
    """The half-edges of one cycle, which meet in a row of the result, with after."""
    h = half["h"].to_numpy()
    order = np.argsort(h)
    after = followed(h, order[np.searchsorted(h, half["next"].to_numpy(), sorter=order)])[1]
    return half.select(["g", "h", "x0", "y0", "x1", "y1", "label"]).append_column("after", pa.array(after))


def _walked(edges: DataFrame) -> DataFrame:
    """g, h, x0, y0, x1, y1, next, label of both half-edges of each edge of large groups."""
    half = kept(_half_edges(edges))
    return half.join(cycles(half.select(F.col("h").alias("node"), "next")).withColumnRenamed("node", "h"), "h")


def _half(lines: DataFrame, whole: bool) -> DataFrame:
    """g, h, x0, y0, x1, y1 of the half-edges that bound faces, label (the smallest h of their cycle) and after (how many follow up to
    that one)."""
    edges = _cut(lines, whole)
    names = ["g", "h", "x0", "y0", "x1", "y1"]
    schema = edges.select("g", *[F.lit(0).cast("long").alias(c) for c in (*names[1:], "label", "after")]).schema
    if whole:
        numbered = edges.withColumn("e", F.col("chunk") * F.lit(2**36) + F.row_number().over(W.partitionBy("chunk").orderBy("g", "x0", "y0", "x1", "y1")))
        return _half_edges(numbered).groupBy("chunk").applyInArrow(_bounding, schema)
    edges = kept(edges.select((-1 - F.monotonically_increasing_id()).alias("e"), "*"))
    half = kept(_walked(edges))
    both = half.groupBy(F.shiftright("h", 1).alias("e")).agg(F.min("label").alias("one"), F.max("label").alias("two"))
    if not both.filter("one = two").isEmpty():
        half = kept(_walked(edges.join(both.filter("one != two").select("e"), "e")))
    return half.select(*names, "next", "label").groupBy("label").applyInArrow(_ranked, schema)


def _rings(half: DataFrame) -> DataFrame:
    """g, label, twice (the area, negative for outlines of parts), mx, my, vertices, extent (the sum of its edges'), first (x0, y0, h,
    after of the leftmost corner), corners (after, x, y) of each cycle."""
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    turn = (wide("x0") * wide("y1") - wide("x1") * wide("y0")).cast("decimal(38,0)")
    cx, cy = ((wide("x0") + wide("x1")).cast("double") * turn.cast("double")), ((wide("y0") + wide("y1")).cast("double") * turn.cast("double"))
    least = F.min(F.struct("x0", "y0", "h", "after")).alias("first")
    corners = F.collect_list(F.struct(F.col("after").cast("int").alias("after"), F.col("x0").cast("int").alias("x"), F.col("y0").cast("int").alias("y"))).alias("corners")
    rings = half.groupBy("g", "label").agg(F.sum(turn).alias("twice"), F.sum(cx).alias("mx"), F.sum(cy).alias("my"), F.count(F.lit(1)).alias("vertices"), F.sum(_extent()).alias("extent"), least, corners)
    # in order from the leftmost corner; corners take least room as two lists of numbers
    ordered = F.reverse(F.sort_array("corners"))
    start = (F.col("vertices") - 1 - F.col("first.after")).cast("int")
    turned = F.concat(F.slice(F.col("corners"), start + 1, F.col("vertices").cast("int")), F.slice(F.col("corners"), F.lit(1), start))
    rings = rings.withColumn("corners", ordered).withColumn("corners", turned)
    return rings.withColumns({"xs": F.col("corners.x"), "ys": F.col("corners.y")}).drop("corners")


def _outer_faces(rings: DataFrame) -> DataFrame:
    """label (of an outline), face: the face that the part lies in, where there is one.  A ray goes down from the part's leftmost
    node, just right of it, to the nearest edge; what is above that edge is a face, or the outline of another part of the same face."""
    outlines = rings.filter("twice < 0").select("g", "label", F.col("first.x0").alias("x"), F.col("first.y0").alias("y"))
    # a part that is alone lies in no face
    mean = F.ceil(F.sum("extent") / F.sum("vertices")).cast("long")
    sides = rings.groupBy("g").agg(F.greatest(F.lit(1), mean).alias("side"), F.count(F.when(F.col("twice") < 0, True)).alias("parts")).filter("parts > 1").drop("parts")
    ahead = lambda c: F.concat(F.slice(c, 2, F.size(c)), F.slice(c, 1, 1))
    drawn = rings.join(sides, "g").select("g", "side", F.col("label").alias("above"), F.inline(F.arrays_zip(F.col("xs").alias("x0"), F.col("ys").alias("y0"), ahead("xs").alias("x1"), ahead("ys").alias("y1"))))
    flat = drawn.filter("x0 < x1")
    bins = flat.select("g", "x0", "y0", "x1", "y1", "above", F.explode(F.sequence(F.floor(F.col("x0") / F.col("side")), F.floor(F.col("x1") / F.col("side")))).alias("bin"))
    rays = outlines.join(sides, "g").select("g", "label", "x", "y", F.floor(F.col("x") / F.col("side")).alias("bin"))
    slope = (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))
    height = F.col("y0") + (F.col("x") - F.col("x0")) * slope
    below = rays.join(bins, ["g", "bin"]).filter((F.col("x0") <= F.col("x")) & (F.col("x") < F.col("x1")) & (height < F.col("y")))
    hit = below.groupBy("label").agg(F.max_by("above", F.struct(height.alias("height"), slope.alias("slope"))).alias("above"))
    told = kept(outlines.select("label").join(hit, "label", "left").join(outlines.select(F.col("label").alias("above"), F.lit(True).alias("outline")), "above", "left"))
    chained = ranks(told.select(F.col("label").alias("node"), F.when(F.col("outline"), F.col("above")).alias("next")))
    ends = told.filter("outline IS NULL AND above IS NOT NULL").select(F.col("label").alias("last"), F.col("above").alias("face"))
    return chained.join(ends, "last").select(F.col("node").alias("label"), "face")


def faces(segments: DataFrame, group: str = "sheet", snap: float = 1e-3) -> DataFrame:
    """group, area, vertices, holes (their number), x, y (the centroid), ring (the outline's corners, counter-clockwise from the
    leftmost) of every bounded face of the segments (group, x0, y0, x1, y1); holes are taken off area and centroid."""
    small, large = _dealt(_segments(segments, group, snap))
    half = _half(small, True)
    rings = kept(_rings(half if large is None else half.unionByName(_half(large, False))))
    inside = _outer_faces(rings)
    holes = rings.join(inside, "label").groupBy(F.col("face").alias("label")).agg(F.sum("twice").alias("h_twice"), F.sum("mx").alias("h_mx"), F.sum("my").alias("h_my"), F.count(F.lit(1)).alias("holes"))
    shells = rings.filter("twice > 0").join(holes, "label", "left")
    ring = F.transform(F.arrays_zip("xs", "ys"), lambda p: F.struct((p["xs"] * snap).alias("x"), (p["ys"] * snap).alias("y"))).alias("ring")
    twice = (F.col("twice") + F.coalesce("h_twice", F.lit(0))).cast("double")
    moment = lambda n: (F.col(n) + F.coalesce(F.col(f"h_{n}"), F.lit(0.0))) / (3 * twice) * snap
    return shells.select(F.col("g").alias(group), (twice / 2 * snap * snap).alias("area"), F.col("vertices").cast("int").alias("vertices"), F.coalesce("holes", F.lit(0)).cast("int").alias("holes"), moment("mx").alias("x"), moment("my").alias("y"), ring)


def spaces(found: DataFrame, least: float, most: float | None = None) -> DataFrame:
    """The faces of at least some area, and at most another."""
    kept_ = found.filter(F.col("area") >= least)
    return kept_ if most is None else kept_.filter(F.col("area") <= most)
