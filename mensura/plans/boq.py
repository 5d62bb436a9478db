"""From drawing records to priced bill-of-quantities lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.functions import texts
from mensura.operators import catalog, routes, spatial
from mensura.sources import records as records_
from mensura.sources import rules


def counted_lines(spark: SparkSession, items: DataFrame, prices: DataFrame) -> DataFrame:
    """Priced lines of items (item_id, layer, amount) whose layer names an assembly."""
    mapped = items.join(F.broadcast(rules.layers(spark)), "layer")
    lines = catalog.expanded(mapped, rules.bom(spark))
    return catalog.priced(lines, catalog.latest_price(prices.filter("material_name IS NOT NULL")))


def sheet_scales(spans: DataFrame, patterns: list[str] = texts.STRICT) -> DataFrame:
    """sheet, scale: what the first text that names a scale says, by page and place on it; else the default."""
    page = F.coalesce("page_number", F.lit(0)) if "page_number" in spans.columns else F.lit(0)
    hit = texts.first_scale(F.col("text"), patterns)
    placed = spans.select("sheet", F.struct(page.alias("page"), "ord").alias("at"), hit.alias("hit"))
    found = F.min_by("hit.scale", F.when(F.col("hit").isNotNull(), F.col("at")))
    return placed.groupBy("sheet").agg(F.coalesce(found, F.lit(texts.DEFAULT_SCALE)).alias("scale"))


def clustered(spark: SparkSession, paths: DataFrame, eps: float = 5.0, layers: list[str] | None = None) -> DataFrame:
    """The cluster records (sheet, layer, label, single, num_paths, members, ...) of the paths (sheet, ord, id, layer, x0..y1) on some
    layers, those of the layer map where none are given: each layer of each sheet for itself."""
    names = rules.layers(spark).select("layer") if layers is None else spark.createDataFrame([(n,) for n in layers], "layer string")
    mapped = paths.join(F.broadcast(names), "layer", "left_semi")
    cx, cy = spatial.centroid(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    place = F.to_json(F.struct("sheet", "layer"))
    labelled = spatial.dbscan(mapped.withColumn("cx", cx).withColumn("cy", cy).withColumn("place", place), eps, group="place")
    placed = F.from_json("place", "sheet string, layer string")
    return spatial.kept(spatial.cluster_records(labelled, group="place").withColumn("p", placed).select("*", "p.sheet", "p.layer").drop("p", "place"))


def route_assembly(routes_: DataFrame, layers: DataFrame) -> DataFrame:
    """The routes (layer, ...) with the assembly that their layer names or, where the layer map has none, their type does (the
    layer's name in lower case, joined by underscores); routes of other than route assemblies go."""
    named = routes_.join(F.broadcast(layers), "layer", "left")
    kind = F.replace(F.lower("layer"), F.lit(" "), F.lit("_"))
    return named.withColumn("assembly_type", F.coalesce("assembly_type", kind)).filter(F.col("assembly_type").isin(*rules.ROUTE_ASSEMBLIES))


def parsed(spark: SparkSession, paths: DataFrame, spans: DataFrame, groups: DataFrame, eps: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """What a drawing file gives before anything is measured: one row per sheet (sheet, scale, drawing_count, text_span_count, layers:
    map of name to status and count, cluster_count) and the cluster records.  Sheets are those of any of the three tables: paths
    (sheet, ord, id, layer, x0..y1), spans (sheet, page_number, ord, text), layer groups (sheet, name, status, count, ordinal)."""
    records = clustered(spark, paths, eps, rules.clustered_layers())
    n = lambda df, name: df.groupBy("sheet").agg(F.count(F.lit(1)).alias(name))
    registry = records_.layer_registry(groups, "sheet").groupBy("sheet").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("status", "count")))).alias("layers"))
    sheets = paths.select("sheet").union(spans.select("sheet")).union(groups.select("sheet")).distinct()
    for part in (sheet_scales(spans, texts.LOOSE), n(paths, "drawing_count"), n(spans, "text_span_count"), registry, n(records, "cluster_count")):
        sheets = sheets.join(part, "sheet", "left")
    # a sheet without layer groups has the default layer only
    default = F.create_map(F.lit("default"), F.struct(F.lit("ON").alias("status"), F.lit(0).cast("long").alias("count")))
    counts = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("drawing_count", "text_span_count", "cluster_count")}
    return sheets.withColumns({"scale": F.coalesce("scale", F.lit(texts.DEFAULT_SCALE)), "layers": F.coalesce("layers", default)} | counts), records


def run(spark: SparkSession, paths: DataFrame, spans: DataFrame, prices: DataFrame, eps: float = 5.0) -> DataFrame:
    """The whole dataflow over paths (sheet, ord, id, layer, x0..y1, points) and text spans (sheet, page_number, ord, text):
    each sheet's clusters by layer, its routes at its own scale, its counted components, then materials and prices.  Layers of
    runs count both ways.  Paths of a sheet without texts are measured at the default scale; ids are unique."""
    layers = rules.layers(spark)
    mapped = paths.join(F.broadcast(layers.select("layer")), "layer", "left_semi")
    records = clustered(spark, paths, eps)
    clusters = records.join(sheet_scales(spans), "sheet", "left").withColumn("scale", F.coalesce("scale", F.lit(texts.DEFAULT_SCALE)))
    clusters = clusters.drop("layer").withColumn("cluster_id", F.when(F.col("label") < 0, -1).otherwise(0)).withColumn("ord", F.col("first_ord") * 2 + F.col("single").cast("int"))
    route_layers = [n for n, a in rules.layer_rows() if a in rules.ROUTE_ASSEMBLIES]
    measured = route_assembly(routes.measure_routes(clusters, mapped, route_layers), layers)
    runs = measured.select("sheet", "ord", "assembly_type", F.col("length_m").alias("amount"), "members", F.lit("route").alias("origin"))
    counted = spatial.components_counted(records, layers)
    counted = counted.select("sheet", (F.col("first_ord") * 2 + F.col("single").cast("int")).alias("ord"), "assembly_type", F.col("count").cast("double").alias("amount"), "members", F.lit("component").alias("origin"))
    lines = catalog.expanded(runs.unionByName(counted), rules.bom(spark))
    out = catalog.priced(lines, catalog.latest_price(prices.filter("material_name IS NOT NULL")))
    return out.select("sheet", "origin", F.col("ord").alias("line_order"), "position", "assembly_type", "material_name", "quantity", "unit_price", "total_cost", "unpriced", F.lit("MEASURED").alias("confidence_status"), F.array_join("members", ",").alias("source_path_ids"))
