"""Literal anchors and invariants of the take-off operators, and every oracle at the smallest scale."""

import datetime
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from mensura.functions import confidence, numbers, texts
from mensura.operators import catalog, routes, spatial
from mensura.plans import queries
from mensura.sources import records, rules

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_costs(spark):
    assert one(spark, numbers.material_cost(F.lit(5.0), F.lit(3.50))) == 17.50
    assert one(spark, numbers.material_cost(F.lit(0.1), F.lit(10.05))) == 1.01
    assert one(spark, numbers.labor_hours(F.lit(6.0), F.lit(3.0))) == 2.0
    assert one(spark, numbers.labor_hours(F.lit(6.0), F.lit(0.0))) is None
    assert one(spark, numbers.labor_cost(F.lit(2.0), F.lit(45.0))) == 90.0
    assert one(spark, numbers.total_cost(*map(F.lit, (17.50, 50.0, 10.0, 2.0, 5.0)))) == 84.50
    assert one(spark, numbers.total_cost(F.lit(30.0), F.lit(90.0), F.lit(None), F.lit(None))) == 120.0
    assert one(spark, numbers.correctly_rounded(F.lit(1888.407 * 0.2), 3)) == 377.681


@pytest.mark.parametrize("text,scale", [("ELECTRICAL.SCALE 1:100", "1:100"), ("DRAWING.SCALE 1:50", "1:50"), ("NO SCALE HERE", None), ("at 12:30", None)])
def test_scales(spark, text, scale):
    hit = one(spark, texts.first_scale(F.lit(text), texts.STRICT))
    assert (hit and hit["scale"]) == scale


def test_scale_review(spark):
    ask = lambda *t: spark.createDataFrame([(x,) for x in t], "text string").agg(texts.needs_review(F.col("text")).alias("x")).first()["x"]
    assert ask("NO SCALE HERE", None, "") and not ask("x", "at 1:50") and ask() and not ask("1/4\"=1'-0\"x 1:20")


def test_loose_scales_take_clock_times(spark):
    assert one(spark, texts.first_scale(F.lit("at 12:30"), texts.LOOSE))["scale"] == "12:30"


@pytest.mark.parametrize("scale,meters,n", [("1:100", 1000.0, 2), ("1:50", 500.0, 2), ("1:100", 0.0, 1), ("none", 10.0, 2)])
def test_lengths(spark, scale, meters, n):
    points = F.array(*[F.struct(F.lit(10.0 * k).alias("x"), F.lit(0.0).alias("y")) for k in range(n)])
    assert one(spark, routes.length(points, F.lit(scale))) == meters


def test_points_of_items(spark):
    schema = "items array<struct<op:string,pts:array<struct<x:double,y:double>>>>"
    df = spark.createDataFrame([([("re", [(0.0, 0.0), (2.0, 1.0)]), ("l", [(5.0, 5.0), (6.0, 6.0)]), ("qu", [(9.0, 9.0), (8.0, 8.0)])],)], schema)
    got = [tuple(p) for p in df.select(routes.points_of(F.col("items")).alias("p")).first()["p"]]
    assert got == [(0, 0), (2, 0), (2, 1), (0, 1), (5, 5), (6, 6)]


def test_confidence(spark):
    score = lambda s, raster, v: one(spark, confidence.score(F.lit(s), F.lit(raster), F.lit(v)))
    assert (score("MEASURED", False, None), score("MEASURED", True, None), score("DERIVED", False, "1.0.0"), score("DERIVED", False, "2"), score("ASSUMED", False, None)) == (1.0, 0.6, 0.8, 0.7, 0.3)
    assert one(spark, confidence.status(F.lit("formula"), F.lit(""))) is None
    assert one(spark, confidence.status(F.lit("anything"), F.lit(None))) == "ASSUMED"


@pytest.mark.parametrize("text,entry", [("card_reader: Card Reader", ("card_reader", "card reader")), ("Main door (door)", ("door", "main door")), ("fire_door2b", ("fire_door2b", "Fire_Door2B")), ("SCALE: 1:100", None), ("two words", None), ("", None), ("bad name: x", None)])
def test_legend_entries(spark, text, entry):
    got = one(spark, texts.legend_entry(F.lit(text)))
    assert (got and tuple(got)) == entry


def test_unpriced_lines_stay(spark):
    lines = spark.createDataFrame([("Cable", 10.0), ("UnknownMaterial", 10.0)], "material_name string, raw_quantity double")
    prices = spark.createDataFrame([("Cable", 5.50)], "material_name string, unit_price double")
    got = {r["material_name"]: r for r in catalog.priced(lines, prices).collect()}
    assert (got["Cable"]["total_cost"], got["Cable"]["unpriced"]) == (55.0, False)
    unknown = got["UnknownMaterial"]
    assert (unknown["unit_price"], unknown["total_cost"], unknown["unpriced"], unknown["note"]) == (None, 0.0, True, catalog.UNPRICED_NOTE)


def test_upserts(spark):
    d = datetime.date
    existing = spark.createDataFrame([("a", "USD", 1.0, d(2020, 1, 1), 9)], "material_name string, currency string, unit_price double, effective_from date, seq long")
    incoming = spark.createDataFrame([("a", "USD", 2.0, d(2019, 1, 1), 1), ("a", "USD", 3.0, None, 2), ("a", "EUR", 4.0, None, 1)], existing.schema)
    got = {(r["material_name"], r["currency"]): (r["unit_price"], r["effective_from"]) for r in catalog.upsert_prices(existing, incoming).collect()}
    assert got == {("a", "USD"): (3.0, None), ("a", "EUR"): (4.0, None)}


def test_catalog_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("\ufeffmaterial_name,unit,unit_price\n Conduit ,m,2.50\nCable Tray Section,m,1.80\n,m,1\nX,m,abc\nY,m,12d\nZ,m,1_000\n", encoding="utf-8")
    checked = catalog.validated(records.read_catalog_csv(spark, str(tmp_path / "c.csv")))
    assert tuple(catalog.import_report(checked).first()) == (3, 3)
    assert {(r["row"], r["reason"]) for r in checked.filter("reason IS NOT NULL").collect()} == {(4, "missing material_name"), (5, "invalid unit_price format: 'abc'"), (6, "invalid unit_price format: '12d'")}


def test_an_imported_file_ends_in_the_catalog(spark, tmp_path):
    (tmp_path / "prices.csv").write_text("material_name,unit,unit_price,category,source\nConduit,m,2.50,electrical,test\nCable Tray Section,m,1.80,electrical,test\n")
    checked = catalog.validated(records.read_catalog_csv(spark, str(tmp_path / "prices.csv")))
    assert tuple(catalog.import_report(checked).first()) == (2, 0)
    none = spark.createDataFrame([], "material_name string, currency string, unit_price double, effective_from date, effective_to date, seq long")
    prices = catalog.upsert_prices(none, catalog.accepted_prices(checked)).withColumn("seq", F.lit(0))
    materials = prices.select(F.col("material_name").alias("name"), F.lit("ea").alias("unit"), F.lit(None).cast("string").alias("category"))
    listed = catalog.listing(materials, prices).collect()
    assert [(r["name"], r["latest_unit_price"]) for r in listed] == [("Cable Tray Section", 1.8), ("Conduit", 2.5)]
    line = spark.createDataFrame([("Conduit", 4.0)], "material_name string, raw_quantity double")
    assert catalog.priced(line, catalog.latest_price(prices)).first()["total_cost"] == 10.0


def test_a_header_decides_what_a_file_holds(spark):
    rows = spark.createDataFrame([(2, "a", "ea", "1", "")], "row int, material_name string, unit string, unit_price string, Rate_Name string")
    assert catalog.validated(rows).first()["reason"] == "missing rate_name"
    assert catalog.validated(rows.withColumnRenamed("Rate_Name", "rate_name"), by="cells").first()["reason"] is None
    other = catalog.validated(spark.createDataFrame([(2, "a")], "row int, name string")).first()
    assert (other["kind"], other["reason"]) == (None, catalog.UNKNOWN_KIND)
    prices = spark.createDataFrame([(k, "m", "ea", x, day) for k, (x, day) in enumerate([("1.5f", ""), ("nan", ""), ("-2.", "2024-02-30"), (" 3 ", "2024-02-29"), ("1__0", ""), ("1e3", "20240229")])], "row int, material_name string, unit string, unit_price string, effective_from string")
    got = {r["row"]: (r["reason"], r["parsed"]["unit_price"], r["parsed"]["effective_from"]) for r in catalog.validated(prices).collect()}
    assert [got[k][0] is None for k in range(6)] == [False, False, True, True, False, True]
    assert got[1][0] == " unexpected error: unit_price out of range: nan" and got[2][1:] == (-2.0, None) and got[3][1:] == (3.0, datetime.date(2024, 2, 29)) and got[5][1:] == (1000.0, None)
    assert len(one(spark, catalog.error_text(F.repeat(F.lit("x"), F.lit(500))))) == len(" unexpected error: ") + 100


def test_labor_upsert_keeps_what_is_not_given(spark):
    d = datetime.date
    rows = [("a", 1.0, 2.0, "c", d(2020, 1, 1), None, 1), ("a", 3.0, 4.0, "", None, d(2021, 1, 1), 2)]
    got = catalog.upsert_labor(spark.createDataFrame(rows, "name string, productivity_rate double, hourly_rate double, category string, effective_from date, effective_to date, seq long")).first()
    assert tuple(got) == ("a", 3.0, 4.0, "c", d(2020, 1, 1), d(2021, 1, 1))


def test_catalog_xlsx(spark, tmp_path):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda r, x: f'<c r="{r}" t="s"><v>{x}</v></c>'
    for name, price in (("a", "2.5"), ("b", "0")):
        with zipfile.ZipFile(tmp_path / f"{name}.xlsx", "w") as f:
            f.writestr("xl/workbook.xml", f"<workbook {ns}><bookViews><workbookView activeTab='1'/></bookViews></workbook>")
            f.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>material_name</t></si><si><t> unit</t></si><si><r><t>unit_</t></r><r><t>price</t></r></si><si><t>Conduit</t></si></sst>")
            f.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData/></worksheet>")
            rows = f"<row>{cell('A1', 0)}{cell('B1', 1)}{cell('C1', 2)}</row><row>{cell('A2', 3)}<c r='C2'><v>{price}</v></c></row><row><c r='B3' t='inlineStr'><is><t>m</t></is></c></row>"
            f.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
    got = records.read_catalog_xlsx(spark, str(tmp_path / "*.xlsx"))
    assert got.columns == ["row", "material_name", "unit", "unit_price"]
    assert sorted(map(tuple, got.collect())) == [(2, "Conduit", "", ""), (2, "Conduit", "", "2.5"), (3, "", "m", ""), (3, "", "m", "")]


def test_a_database_table(spark, tmp_path):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    df = spark.range(100).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS price")
    df.write.format("jdbc").options(url=url, dbtable="prices", driver=driver).save()
    got = records.read_table(spark, url, "prices", "id", (10, 90), 4, driver=driver)
    assert got.rdd.getNumPartitions() == 4 and sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    assert records.read_table(spark, url, "prices", driver=driver).count() == 100


def test_yaml_files(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "tray.yaml").write_text("name: cable_tray\nrule_version: 1.0.0\nbom: {section: 1.0, hanger: 0.1}\nlabor: {installation_hours: 1.5, hourly_rate: 45}\nwaste_factor: 0.2\n")
    (tmp_path / "rules" / "bare rule.yml").write_text("# to be filled in\n")
    heads, lines = rules.read_yaml_rules(spark, str(tmp_path / "rules"))
    assert sorted(map(tuple, heads.collect())) == [("bare rule", "unknown", 0.0, None, 0.1), ("cable_tray", "1.0.0", 1.5, 45.0, 0.2)]
    assert sorted(map(tuple, lines.collect())) == [("cable_tray", 0, "section", 1.0), ("cable_tray", 1, "hanger", 0.1)]
    (tmp_path / "map.yaml").write_text("layer_mapping:\n- {assembly: switch, layers: [A, B]}\n- {assembly: conduit, layers: [B, C]}\n- {assembly: none}\n")
    assert [tuple(r) for r in rules.read_yaml_layers(spark, str(tmp_path / "map.yaml")).orderBy("position").collect()] == [(0, "A", "switch"), (1, "B", "switch"), (2, "C", "conduit")]
    (tmp_path / "map.yaml").write_text("")
    assert rules.read_yaml_layers(spark, str(tmp_path / "map.yaml")).count() == 0


def test_rules_that_are_not_there(spark):
    asked = spark.createDataFrame([("switch", ""), ("nothing", ""), ("switch", "no_such"), (None, None)], "component_type string, rule_name string")
    got = {(r["component_type"], r["rule_name"]): r for r in catalog.assembly_outcomes(asked, rules.rules(spark), rules.bom(spark)).collect()}
    assert [tuple(m) for m in got["switch", ""]["materials"]] == [("switch", 1.0, "ea")] and got["switch", ""]["error"] is None
    missed = got["nothing", ""]
    assert (missed["materials"], missed["labor_hours"], missed["waste_factor"], missed["rule_version"], missed["error"]) == ([], 0.0, 0.10, "unknown", "Assembly rule '' not found")
    assert got["switch", "no_such"]["error"] == "Assembly rule 'no_such' not found" and got[None, None]["error"] == "Assembly rule '' not found"


def test_rules_are_stored_once_and_replaced_by_version(spark):
    none = spark.createDataFrame([], "name string, rule_version string, formula_or_bom map<string,double>")
    first = catalog.persisted_rules(none, rules.rules(spark), rules.bom(spark))
    again = catalog.persisted_rules(first, rules.rules(spark), rules.bom(spark))
    held = lambda df: {r["name"]: (r["rule_version"], r["formula_or_bom"]) for r in df.collect()}
    assert held(first) == held(again) and held(first)["cable_tray"] == ("1.0.0", rules.ASSEMBLIES["cable_tray"][0]) and again.count() == len(rules.ASSEMBLIES)
    old = spark.createDataFrame([("switch", "0.1", {"x": 1.0}), ("conduit", "1.0.0", {"y": 1.0}), ("mine", "7", {"z": 1.0})], none.schema)
    after = held(catalog.persisted_rules(old, rules.rules(spark), rules.bom(spark)))
    assert after["switch"] == ("1.0.0", {"switch": 1.0}) and after["conduit"] == ("1.0.0", {"y": 1.0}) and after["mine"] == ("7", {"z": 1.0})


def test_links_connect_what_all_pairs_connect(spark):
    import random

    rng = random.Random(3)
    rows = [(k, rng.choice("AB"), rng.randint(0, 60) / 2, rng.randint(0, 60) / 2) for k in range(400)] + [(400 + k, "C", 1.0, 1.0) for k in range(300)]
    points = spark.createDataFrame(rows, "ord long, layer string, cx double, cy double")
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, la, ax, ay) in enumerate(rows):
        for b, lb, bx, by in rows[i + 1 :]:
            if la == lb and (ax - bx) ** 2 + (ay - by) ** 2 <= 1.0:
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    sizes = {}
    for k in parent:
        sizes[root(k)] = sizes.get(root(k), 0) + 1
    got = {r["ord"]: r["label"] for r in spatial.dbscan(points, 1.0).collect()}
    assert got == {k: root(k) if sizes[root(k)] > 1 else -1 for k in parent}
    assert spatial.links(points.filter("layer = 'C'"), 1.0).count() == 2 * 299  # linear, where all pairs are 89,700


def test_boxes_are_met_in_one_cell(spark):
    import random

    rng = random.Random(4)
    rows = [(k, "L", x, y, x + rng.randint(0, 30), y + rng.randint(0, 9)) for k, (x, y) in enumerate((float(rng.randint(-50, 50)), float(rng.randint(-50, 50))) for _ in range(120))]
    boxes = spark.createDataFrame([(k, g, x, y, float(u), float(v)) for k, g, x, y, u, v in rows], "ord long, layer string, x0 double, y0 double, x1 double, y1 double")
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and max(a[2] - b[4], b[2] - a[4], 0) ** 2 + max(a[3] - b[5], b[3] - a[5], 0) ** 2 <= 9)
    assert sorted((r["a"], r["b"]) for r in spatial.near_boxes(boxes, 3.0).collect()) == want


def test_sheets_have_their_own_scales_and_clusters(spark):
    line = lambda k, sheet, x: (k, f"p{k}", sheet, "CONDUIT", x, 0.0, x + 1, 0.0, [(x, 0.0), (x + 1, 0.0)])
    paths = spark.createDataFrame([line(0, "s", 0.0), line(1, "s", 2.0), line(2, "t", 0.0), line(3, "t", 2.0)], "ord long, id string, sheet string, layer string, x0 double, y0 double, x1 double, y1 double, points array<struct<x:double,y:double>>")
    spans = spark.createDataFrame([("s", 2, 1, "1:10"), ("s", 1, 9, "SCALE 1:50"), ("t", 1, 1, "1:2")], "sheet string, page_number int, ord long, text string")
    prices = spark.createDataFrame([], "material_name string, unit_price double, effective_from date, seq long")
    from mensura.plans import boq

    got = {(r["sheet"], r["origin"]): (r["quantity"], r["source_path_ids"]) for r in boq.run(spark, paths, spans, prices).filter("material_name = 'conduit_pipe'").collect()}
    assert got == {("s", "route"): (150.0, "p0,p1"), ("t", "route"): (6.0, "p2,p3"), ("s", "component"): (1.0, "p0,p1"), ("t", "component"): (1.0, "p2,p3")}


def test_review(spark):
    from mensura.functions import review

    assert [one(spark, review.can_reject(F.lit(t))) for t in ("MEASURED", "DERIVED", None)] == [False, True, True]
    assert [one(spark, review.corrected(F.lit(5.0), F.lit(x))) for x in (7.0, 0.0, -1.0)] == [7.0, 5.0, 5.0]


@pytest.mark.parametrize("text,entry", [("Load (kg): 630", ("labelled", "Load", "kg", "630")), ("%8 - 450cm", ("slope", "8", "cm", "450")), ("PK-B07", ("numbered", "PK", "B", "07")), ("no entry", None), (None, None)])
def test_schedule_entries(spark, text, entry):
    got = one(spark, texts.schedule_entry(F.lit(text).cast("string")))
    assert (got and tuple(got)) == entry


def test_rule_links_are_inserted_once(spark):
    first = catalog.rule_links(rules.rules(spark), rules.bom(spark), spark.createDataFrame([], "assembly_type string, material_name string"))
    tray = {r["material_name"]: r["quantity"] for r in first.filter("assembly_type = 'cable_tray'").collect()}
    assert tray == {"cable_tray_section": 1.0, "tray_fitting": 0.2, "support_hanger": 0.1, "Labor": 1.5}
    assert catalog.rule_links(rules.rules(spark), rules.bom(spark), first.select("assembly_type", "material_name")).count() == 0


def test_noise_gives_one_record_more(spark):
    rows = [(k, f"p{k}", "L", 100.0 * k, 0.0, 100.0 * k, 0.0) for k in range(3)] + [(3, "p3", "L", 201.0, 0.0, 201.0, 0.0)]
    points = spark.createDataFrame(rows, "ord long, id string, layer string, x0 double, y0 double, x1 double, y1 double").withColumn("cx", F.col("x0")).withColumn("cy", F.col("y0"))
    labelled = spatial.dbscan(points, 5.0)
    assert {r["id"]: r["label"] for r in labelled.collect()} == {"p0": -1, "p1": -1, "p2": 2, "p3": 2}
    got = sorted((r["label"], tuple(r["members"])) for r in spatial.cluster_records(labelled).collect())
    assert got == [(-1, ("p0",)), (-1, ("p0", "p1")), (-1, ("p1",)), (2, ("p2", "p3"))]


def test_a_long_chain_is_one_cluster(spark):
    points = spark.range(120).select(F.col("id").alias("ord"), F.lit("L").alias("layer"), (F.col("id") * 4.0).alias("cx"), F.lit(0.0).alias("cy"))
    assert spatial.dbscan(points, 4.0).select("label").distinct().collect()[0][0] == 0


def test_pipeline_invariants(spark):
    rows = queries.QUERIES["e2e_boq"](spark, SF).collect()
    assert rows
    assert all(r["source_path_ids"] and r["confidence_status"] in confidence.STATUSES for r in rows)
    assert all(r["assembly_type"] in rules.ASSEMBLIES and (not r["unpriced"] or r["total_cost"] == 0.0) for r in rows)


def _oracle(name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return db.execute(queries.ORACLES[name]).df()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), _oracle(name)
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False, name=None)))
    assert plain(got) == plain(want)


def test_model_tables_and_keys(spark):
    from mensura.sources import schemas

    tables = {n: spark.createDataFrame([], c) for n, c in schemas.TABLES.items()}
    assert {r["rows"] for r in schemas.violations(tables).collect()} == {0}
    tables["prices"] = spark.createDataFrame([("1", "m", None, "USD", None, None)] * 2, schemas.TABLES["prices"])
    got = {r["rule"]: r["rows"] for r in schemas.violations(tables).collect() if r["rows"]}
    assert got == {"prices: id unique": 1, "prices.material_id in materials": 2}


def test_boq_json_keeps_nulls(spark, tmp_path):
    from mensura.sources import sinks

    line = spark.createDataFrame([("switch", "switch", 1.0, None, 0.0, True, "MEASURED", ["p1"])], "assembly_type string, material_name string, quantity double, unit_price double, total_cost double, unpriced boolean, confidence_status string, source_path_ids array<string>")
    sinks.write_boq(line, str(tmp_path / "boq"))
    assert spark.read.text(str(tmp_path / "boq")).first()["value"] == '{"assembly_type":"switch","material_name":"switch","quantity":1.0,"unit_price":null,"total_cost":0.0,"unpriced":true,"confidence_status":"MEASURED","source_path_ids":["p1"]}'
