"""What a drawing file gives, first pages, route assemblies and legends, on small cases."""

from pyspark.sql import functions as F

from mensura.functions import confidence, texts, uploads
from mensura.plans import boq
from mensura.sources import rules


def test_parsed_sheets(spark):
    box = lambda sheet, n, layer, x: (sheet, n, f"p{n}", layer, x, 0.0, x + 1, 1.0)
    paths = [box("s", 1, "AC", 0.0), box("s", 2, "AC", 3.0), box("s", 3, "AC", 50.0), box("s", 4, "AC", 90.0), box("s", 5, "DB", 0.0), box("s", 6, "walls", 0.0), box("t", 7, None, 0.0)]
    spans = [("s", 1, 2, "12:50"), ("s", 1, 1, "title"), ("s", 0, 9, "2.5:20"), ("u", 1, 1, "no scale")]
    groups = [("s", "AC", "ON", 4, 1), ("s", "AC", "OFF", 5, 2), ("t", "default", "OFF", 1, 1)]
    sheets, records = boq.parsed(spark, spark.createDataFrame(paths, "sheet string, ord long, id string, layer string, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(spans, "sheet string, page_number int, ord long, text string"), spark.createDataFrame(groups, "sheet string, name string, status string, count long, ordinal long"))
    got = {r.sheet: (r.scale, r.drawing_count, r.text_span_count, {k: tuple(v) for k, v in r.layers.items()}, r.cluster_count) for r in sheets.collect()}
    assert got == {
        "s": ("2.5:20", 6, 3, {"AC": ("OFF", 5), "default": ("ON", 0)}, 5),
        "t": ("1:100", 1, 0, {"default": ("OFF", 1)}, 0),
        "u": ("1:100", 0, 1, {"default": ("ON", 0)}, 0),
    }
    # AC: a cluster of two, the noise as one record and as two; DB: a single path
    assert sorted((r.layer, r.label, r.single, sorted(r.members)) for r in records.collect()) == [("AC", -1, False, ["p3", "p4"]), ("AC", -1, True, ["p3"]), ("AC", -1, True, ["p4"]), ("AC", 1, False, ["p1", "p2"]), ("DB", -1, True, ["p5"])]


def test_routes_by_layer_map_then_by_type(spark):
    rows = [("CONDUIT",), ("Cable Tray",), ("conduit",), ("PIPE",), ("LIGHTING",), (None,)]
    got = boq.route_assembly(spark.createDataFrame(rows, "layer string"), rules.layers(spark))
    assert sorted(map(tuple, got.collect())) == [("CONDUIT", "conduit"), ("Cable Tray", "cable_tray"), ("conduit", "conduit")]


def test_first_page_decides(spark):
    rows = [("a", 1, "image", False), ("a", 2, "vector", True), ("b", 2, "image", False), ("c", 1, "image", None), ("c", 1, "vector", True)]
    got = {r.upload: (r.vectors, r.images, r.has_text, r.status, r.ambiguous) for r in uploads.classified(spark.createDataFrame(rows, "upload string, page_number int, kind string, is_text boolean"), "upload").collect()}
    assert got == {"a": (0, 1, False, "raster", False), "b": (0, 0, False, "vector", True), "c": (1, 1, True, "vector", True)}


def test_top_of_a_page_and_raster_scores(spark):
    df = spark.createDataFrame([(99.0, 500.0, 0.4), (100.0, 500.0, None)], "y0 double, height double, base double")
    got = df.select(texts.in_top(F.col("y0"), F.col("height")), confidence.raster_score(F.col("base")), confidence.raster_score()).collect()
    assert list(map(tuple, got)) == [(True, 0.4, 0.6), (False, 0.6, 0.6)]
