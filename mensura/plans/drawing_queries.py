"""Registered queries of what a drawing file gives: parsed sheets, first pages, legends by page height, shape records, raster scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.functions import confidence, texts, uploads
from mensura.operators import spatial
from mensura.plans import boq
from mensura.plans.proxies import cte, view
from mensura.plans.queries import _ALL_LAYERS, _LAYERS, _LOOSE_HITS, _PARSED, _SHAPES, _STATUS, _parsed, registered
from mensura.sources import rules

_SHEETS = f"""WITH RECURSIVE {cte("sheet_paths", "spans", "sheet_layers")}, {_LOOSE_HITS}, listed AS (SELECT DISTINCT layer FROM (VALUES {_ALL_LAYERS}) AS t(k, layer)),
points AS (SELECT sheet, layer, ord, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM sheet_paths WHERE layer IN (SELECT layer FROM listed)),
near AS (SELECT p.ord AS a, q.ord AS b FROM points p JOIN points q ON p.sheet = q.sheet AND p.layer = q.layer AND p.ord <> q.ord AND (p.cx - q.cx) * (p.cx - q.cx) + (p.cy - q.cy) * (p.cy - q.cy) <= 25),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
labelled AS (SELECT p.sheet, p.layer, p.ord, (SELECT CASE WHEN count(*) > 0 THEN least(min(b), p.ord) END FROM reach r WHERE r.a = p.ord) AS label FROM points p),
records AS (SELECT sheet, layer, CASE WHEN count(*) < 2 THEN count(*) ELSE count(DISTINCT label) + count(*) FILTER (WHERE label IS NULL) + CASE WHEN count(*) FILTER (WHERE label IS NULL) > 0 THEN 1 ELSE 0 END END AS n FROM labelled GROUP BY sheet, layer),
sheets AS (SELECT sheet FROM sheet_paths UNION SELECT sheet FROM spans UNION SELECT sheet FROM sheet_layers)
SELECT sheet, coalesce((SELECT min_by(s, ord) FILTER (WHERE s <> '') FROM hits h WHERE h.sheet = t.sheet), '1:100') AS scale, (SELECT count(*) FROM sheet_paths p WHERE p.sheet = t.sheet) AS drawing_count, (SELECT count(*) FROM spans p WHERE p.sheet = t.sheet) AS text_span_count,
  (SELECT count(DISTINCT name) + CASE WHEN count(*) FILTER (WHERE name = 'default') > 0 THEN 0 ELSE 1 END FROM sheet_layers g WHERE g.sheet = t.sheet) AS layer_count, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM records r WHERE r.sheet = t.sheet) AS cluster_count FROM sheets t"""


@registered("parsed_sheets", _SHEETS)
def parsed_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Each sheet's scale, layers and counts of drawings, texts and clusters, before anything is measured."""
    sheets, _ = boq.parsed(spark, view(spark, d, "sheet_paths"), view(spark, d, "spans"), view(spark, d, "sheet_layers"))
    return sheets.select("sheet", "scale", "drawing_count", "text_span_count", F.size("layers").cast("long").alias("layer_count"), "cluster_count")


@registered("route_assembly", f"WITH {cte('drawn_routes')} SELECT * FROM (SELECT route_id, r.layer, coalesce(m.assembly_type, replace(lower(r.layer), ' ', '_')) AS assembly_type FROM drawn_routes r LEFT JOIN {_LAYERS} m ON m.layer = r.layer) WHERE assembly_type IN ('cable_tray', 'conduit')")
def route_assembly(spark: SparkSession, d: str) -> DataFrame:
    """The assemblies of routes by the layer map, else by their type."""
    return boq.route_assembly(view(spark, d, "drawn_routes"), rules.layers(spark)).select("route_id", "layer", "assembly_type")


_FIRST = """facts AS (SELECT upload_id, count(*) FILTER (WHERE page_number = 1 AND kind = 'vector') AS vectors, count(*) FILTER (WHERE page_number = 1 AND kind = 'image') AS images, coalesce(bool_or(page_number = 1 AND is_text), false) AS has_text FROM page_objects GROUP BY upload_id)"""


@registered("upload_first_page", f"WITH {cte('page_objects')}, {_FIRST} SELECT *, CASE WHEN vectors < 100 AND images > 0 AND NOT has_text THEN 'raster' ELSE 'vector' END AS status, NOT (vectors > 10000 AND has_text OR vectors < 100 AND images > 0 AND NOT has_text) AS ambiguous FROM facts")
def upload_first_page(spark: SparkSession, d: str) -> DataFrame:
    """What kind of drawing an upload is, by the objects of its first page."""
    return uploads.classified(view(spark, d, "page_objects"), "upload_id")


@registered("legend_map_by_height", _PARSED + f", {cte('page_sizes')} SELECT p.page, e[1] AS name, min_by(e[2], p.ord) AS description FROM parsed p JOIN page_sizes z ON z.page = p.page WHERE e IS NOT NULL AND y0 < 0.20 * height GROUP BY p.page, e[1]")
def legend_map_by_height(spark: SparkSession, d: str) -> DataFrame:
    """The legend in the top fifth of each page, whatever the page's height."""
    placed = _parsed(spark, d).filter("e IS NOT NULL").join(view(spark, d, "page_sizes"), "page")
    top = placed.filter(texts.in_top(F.col("y0"), F.col("height")))
    return top.groupBy("page", F.col("e.name").alias("name")).agg(F.min_by("e.description", "ord").alias("description"))


@registered("shape_cluster_records", _SHAPES + " SELECT label, false AS single, count(*) AS num_paths, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM labelled GROUP BY label HAVING (SELECT count(*) FROM labelled) > 1 UNION ALL SELECT label, true, 1, x0, y0, x1, y1 FROM labelled WHERE label < 0")
def shape_cluster_records(spark: SparkSession, d: str) -> DataFrame:
    """Detected shapes as records: clusters, what stands alone as one record, and each of its shapes as one more."""
    cx, cy = spatial.centroid(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    shapes = view(spark, d, "paths").filter("layer IS NULL OR layer = 'lighting'").withColumn("layer", F.lit("shapes")).withColumn("cx", cx).withColumn("cy", cy)
    return spatial.cluster_records(spatial.dbscan(shapes, 30.0)).select("label", "single", "num_paths", "x0", "y0", "x1", "y1")


@registered("raster_scores", _STATUS + " SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 0.5 ELSE 0.6 END::DOUBLE AS score, status FROM tiers WHERE source = 'raster'")
def raster_scores(spark: SparkSession, d: str) -> DataFrame:
    """The scores of measurements from scanned sheets, some with a base of their own, beside their status."""
    scanned = view(spark, d, "measured").filter("source = 'raster'")
    base = F.when(F.col("user_id") % 3 == 0, 0.5)
    return scanned.select("event_id", confidence.raster_score(base).alias("score"), confidence.status(F.col("source"), F.col("rule_version")).alias("status"))
