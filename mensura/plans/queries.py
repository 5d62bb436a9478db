"""The registered queries of the take-off and costing operators, and the DuckDB statements they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.functions import confidence, numbers, review, shapes, texts, uploads
from mensura.operators import catalog, legends, routes, spatial
from mensura.plans import boq
from mensura.plans.proxies import cte, view
from mensura.sources import records, rules, schemas, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
EPS = 5.0


def registered(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


_BOM = rules.values_sql(rules.bom_rows(), ["assembly_type", "position", "material_name", "bom_quantity"])
_RULES = rules.values_sql(rules.rule_rows(), ["assembly_type", "rule_version", "installation_hours", "hourly_rate", "waste_factor"])
_LAYERS = rules.values_sql(rules.layer_rows(), ["layer", "assembly_type"])
_LATEST = "latest AS (SELECT material_name, unit_price FROM (SELECT *, row_number() OVER (PARTITION BY material_name ORDER BY effective_from DESC NULLS LAST, seq DESC) AS n FROM prices WHERE material_name IS NOT NULL) WHERE n = 1)"
_COST = "CAST(round(CAST(CAST({q} AS VARCHAR) AS DECIMAL(28,18)) * CAST({p} AS DECIMAL(10,2)), 2) AS DOUBLE)"
_UNIT = "CASE WHEN lower({m}) LIKE '%cable%' OR lower({m}) LIKE '%conduit%' THEN 'm' ELSE 'ea' END"

# --- bill of quantities -------------------------------------------------------------------------------------------

_LINES = f"""WITH {cte("items", "prices")}, {_LATEST},
lines AS (SELECT i.item_id, b.assembly_type, b.material_name, b.bom_quantity * i.amount AS raw FROM items i JOIN {_LAYERS} m ON i.layer = m.layer JOIN {_BOM} b ON b.assembly_type = m.assembly_type),
priced AS (SELECT item_id, assembly_type, lines.material_name, CAST(printf('%.3f', raw) AS DOUBLE) AS quantity, unit_price,
  CASE WHEN unit_price IS NULL THEN 0.0 ELSE {_COST.format(q="raw", p="unit_price")} END AS total_cost, unit_price IS NULL AS unpriced, 'MEASURED' AS confidence_status
  FROM lines LEFT JOIN latest ON lines.material_name = latest.material_name)"""


def _priced_items(spark: SparkSession, d: str) -> DataFrame:
    return boq.counted_lines(spark, view(spark, d, "items"), view(spark, d, "prices"))


@registered("boq_priced", _LINES + " SELECT * FROM priced")
def boq_priced(spark: SparkSession, d: str) -> DataFrame:
    return _priced_items(spark, d).select("item_id", "assembly_type", "material_name", "quantity", "unit_price", "total_cost", "unpriced", F.lit("MEASURED").alias("confidence_status"))


@registered("boq_unpriced_gap", _LINES + " SELECT material_name, count(*) AS lines, count(DISTINCT item_id) AS items FROM priced WHERE unpriced GROUP BY material_name")
def boq_unpriced_gap(spark: SparkSession, d: str) -> DataFrame:
    return _priced_items(spark, d).filter("unpriced").groupBy("material_name").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("item_id").alias("items"))


@registered("boq_totals", _LINES + " SELECT assembly_type, material_name, count(*) AS lines, CAST(sum(CAST(total_cost AS DECIMAL(18,2))) AS DOUBLE) AS total_cost FROM priced GROUP BY ALL")
def boq_totals(spark: SparkSession, d: str) -> DataFrame:
    total = F.sum(F.col("total_cost").cast("decimal(18,2)")).cast("double").alias("total_cost")
    return _priced_items(spark, d).groupBy("assembly_type", "material_name").agg(F.count(F.lit(1)).alias("lines"), total)


# --- costs --------------------------------------------------------------------------------------------------------

_ID = "l_orderkey, l_linenumber"


def _lineitem(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet")


@registered("material_cost", f"SELECT {_ID}, {_COST.format(q='l_quantity', p='l_extendedprice')} AS cost FROM lineitem")
def material_cost(spark: SparkSession, d: str) -> DataFrame:
    return _lineitem(spark, d).select("l_orderkey", "l_linenumber", numbers.material_cost(F.col("l_quantity"), F.col("l_extendedprice")).alias("cost"))


@registered("labor_hours", f"SELECT {_ID}, CASE WHEN l_suppkey % 7 > 0 THEN CAST(printf('%.2f', l_quantity / (l_suppkey % 7)) AS DOUBLE) END AS hours, CASE WHEN l_suppkey % 7 <= 0 THEN 'productivity rate must be positive' END AS error FROM lineitem")
def labor_hours(spark: SparkSession, d: str) -> DataFrame:
    rate = F.col("l_suppkey") % 7
    return _lineitem(spark, d).select("l_orderkey", "l_linenumber", numbers.labor_hours(F.col("l_quantity"), rate).alias("hours"), numbers.rate_error(rate).alias("error"))


@registered("labor_cost", f"SELECT {_ID}, CAST(round(CAST(CAST(l_quantity / 4 AS VARCHAR) AS DECIMAL(20,8)) * CAST(45.25 AS DECIMAL(10,2)), 2) AS DOUBLE) AS cost FROM lineitem")
def labor_cost(spark: SparkSession, d: str) -> DataFrame:
    return _lineitem(spark, d).select("l_orderkey", "l_linenumber", numbers.labor_cost(F.col("l_quantity") / 4, F.lit(45.25)).alias("cost"))


_D4 = "CAST(CAST({0} AS VARCHAR) AS DECIMAL(20,4))"


@registered("total_cost", f"SELECT {_ID}, CAST(round({_D4.format('l_extendedprice')} + {_D4.format('l_quantity')} + {_D4.format('l_tax')} + coalesce({_D4.format('nullif(l_discount, 0)')}, 0), 2) AS DOUBLE) AS total FROM lineitem")
def total_cost(spark: SparkSession, d: str) -> DataFrame:
    parts = [F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_tax"), F.nullif(F.col("l_discount"), F.lit(0.0))]
    return _lineitem(spark, d).select("l_orderkey", "l_linenumber", numbers.total_cost(*parts).alias("total"))


# --- catalog ------------------------------------------------------------------------------------------------------


@registered("latest_price", f"WITH {cte('prices')}, {_LATEST} SELECT * FROM latest")
def latest_price(spark: SparkSession, d: str) -> DataFrame:
    return catalog.latest_price(view(spark, d, "prices").filter("material_name IS NOT NULL"))


@registered("catalog_listing", f"WITH {cte('prices')}, {_LATEST} SELECT m.material_name AS name, {_UNIT.format(m='m.material_name')} AS unit, latest.unit_price AS latest_unit_price FROM (SELECT DISTINCT material_name FROM {_BOM} UNION SELECT material_name FROM prices WHERE material_name IS NOT NULL) m LEFT JOIN latest ON m.material_name = latest.material_name ORDER BY name")
def catalog_listing(spark: SparkSession, d: str) -> DataFrame:
    prices = view(spark, d, "prices").filter("material_name IS NOT NULL")
    names = rules.bom(spark).select("material_name").union(prices.select("material_name")).distinct()
    materials = names.select(F.col("material_name").alias("name"), texts.unit_of(F.col("material_name")).alias("unit"), F.lit(None).cast("string").alias("category"))
    return catalog.listing(materials, prices).select("name", "unit", "latest_unit_price")


@registered("price_upsert", f"""WITH {cte("prices")}, known AS (SELECT material_name, currency, min_by(unit_price, seq) AS unit_price, min_by(effective_from, seq) AS effective_from FROM (SELECT material_name, currency, unit_price, coalesce(effective_from, DATE '1900-01-01') AS effective_from, seq FROM prices WHERE material_name IS NOT NULL) GROUP BY ALL),
late AS (SELECT material_name, currency, unit_price * 2 AS unit_price, effective_from, row_number() OVER (PARTITION BY material_name, currency ORDER BY seq DESC) AS n FROM prices WHERE material_name IS NOT NULL AND effective_from IS NOT NULL)
SELECT k.material_name, k.currency, coalesce(l.unit_price, k.unit_price) AS unit_price, CASE WHEN l.material_name IS NULL THEN k.effective_from ELSE l.effective_from END::VARCHAR AS effective_from
FROM known k LEFT JOIN late l ON l.n = 1 AND k.material_name = l.material_name AND k.currency = l.currency""")
def price_upsert(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "prices").filter("material_name IS NOT NULL")
    since = F.coalesce("effective_from", F.lit("1900-01-01").cast("date"))
    known = p.groupBy("material_name", "currency").agg(F.min_by(F.struct("unit_price", since.alias("effective_from")), "seq").alias("r"), F.min("seq").alias("seq"))
    known = known.select("material_name", "currency", "r.unit_price", "r.effective_from", "seq")
    incoming = p.filter("effective_from IS NOT NULL").select("material_name", "currency", (F.col("unit_price") * 2).alias("unit_price"), "effective_from", "seq")
    return catalog.upsert_prices(known, incoming).withColumn("effective_from", F.col("effective_from").cast("string"))


@registered("labor_upsert", f"WITH {cte('labor')} SELECT name, max_by(productivity_rate, seq) AS productivity_rate, max_by(hourly_rate, seq) AS hourly_rate, max_by(category, seq) FILTER (WHERE category <> '') AS category FROM labor GROUP BY name")
def labor_upsert(spark: SparkSession, d: str) -> DataFrame:
    return catalog.upsert_labor(view(spark, d, "labor"))


@registered("labor_listing", f"WITH {cte('labor')} SELECT seq, name, nullif(productivity_rate, 0) AS productivity_rate, nullif(hourly_rate, 0) AS hourly_rate FROM labor ORDER BY name")
def labor_listing(spark: SparkSession, d: str) -> DataFrame:
    none = lambda c: F.nullif(F.col(c), F.lit(0.0)).alias(c)
    return view(spark, d, "labor").select("seq", "name", none("productivity_rate"), none("hourly_rate")).orderBy("name")


_NUMBER = r"[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?"


def _reason(kind: str, needed: list[str], numbers: list[str]) -> str:
    """The WHEN branches of one kind of rows."""
    out = [f"WHEN kind = '{kind}' AND {c} = '' THEN 'missing {c}'" for c in needed]
    for c in numbers:
        out.append(f"WHEN kind = '{kind}' AND regexp_full_match({c}, '(?i)[+-]?(inf|infinity|nan)') THEN ' unexpected error: {c} out of range: ' || {c}")
        out.append(f"WHEN kind = '{kind}' AND NOT regexp_full_match({c}, '{_NUMBER}') THEN 'invalid {c} format: ''' || {c} || ''''")
    return " ".join(out)


_MATERIAL, _LABOR = _reason("material", ["material_name", "unit", "unit_price"], ["unit_price"]), _reason("labor", ["rate_name", "productivity_rate", "hourly_rate"], ["productivity_rate", "hourly_rate"])
_FILES = f"""WITH {cte("imported_materials", "imported_labor")}, materials AS (SELECT *, CASE {_MATERIAL} END AS reason FROM (SELECT *, 'material' AS kind FROM imported_materials)),
labor AS (SELECT *, CASE {_LABOR} END AS reason FROM (SELECT *, 'labor' AS kind FROM imported_labor)), checked AS (SELECT kind, row, reason FROM materials UNION ALL SELECT kind, row, reason FROM labor)"""
_MIXED = f"""WITH {cte("imported")}, kinds AS (SELECT *, CASE WHEN rate_name <> '' OR productivity_rate <> '' THEN 'labor' WHEN material_name <> '' OR unit_price <> '' THEN 'material' END AS kind FROM imported),
checked AS (SELECT *, CASE WHEN kind IS NULL THEN 'could not determine row type — expected material_name or rate_name column' {_MATERIAL} {_LABOR} END AS reason FROM kinds)"""
_REPORT = " SELECT count(*) FILTER (WHERE reason IS NULL) AS successful, count(*) FILTER (WHERE reason IS NOT NULL) AS failed FROM checked"
_DAY = "CASE WHEN regexp_full_match({0}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast({0} AS DATE) END"
_GOOD = f"good AS (SELECT material_name, 'USD' AS currency, CAST(replace(unit_price, '_', '') AS DOUBLE) AS unit_price, {_DAY.format('effective_from')} AS effective_from, {_DAY.format('effective_to')} AS effective_to, row AS seq FROM materials WHERE reason IS NULL)"


def _checked_files(spark: SparkSession, d: str) -> DataFrame:
    """Both files, each checked by its own header."""
    both = [catalog.validated(view(spark, d, name)) for name in ("imported_materials", "imported_labor")]
    return both[0].unionByName(both[1], allowMissingColumns=True)


@registered("import_report", _FILES + _REPORT)
def import_report(spark: SparkSession, d: str) -> DataFrame:
    return catalog.import_report(_checked_files(spark, d))


@registered("import_errors", _FILES + " SELECT kind, row, reason FROM checked WHERE reason IS NOT NULL")
def import_errors(spark: SparkSession, d: str) -> DataFrame:
    return _checked_files(spark, d).filter("reason IS NOT NULL").select("kind", "row", "reason")


@registered("import_report_by_cells", _MIXED + _REPORT)
def import_report_by_cells(spark: SparkSession, d: str) -> DataFrame:
    return catalog.import_report(catalog.validated(view(spark, d, "imported"), by="cells"))


@registered("import_errors_by_cells", _MIXED + " SELECT row, reason FROM checked WHERE reason IS NOT NULL")
def import_errors_by_cells(spark: SparkSession, d: str) -> DataFrame:
    return catalog.validated(view(spark, d, "imported"), by="cells").filter("reason IS NOT NULL").select("row", "reason")


_KNOWN = "known AS (SELECT 'material ' || CAST(p_partkey % 90 AS VARCHAR) AS material_name, 'USD' AS currency, min_by(CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS DOUBLE), p_partkey) AS unit_price FROM part GROUP BY ALL)"


def _known(spark: SparkSession, d: str) -> DataFrame:
    """A catalog before the import: some of its materials come again in the file."""
    part = spark.read.parquet(f"{d}/part.parquet")
    name = F.concat(F.lit("material "), (F.col("p_partkey") % 90).cast("string"))
    price = F.min_by(F.col("p_retailprice").cast("decimal(10,2)").cast("double"), "p_partkey").alias("unit_price")
    rows = part.groupBy(name.alias("material_name")).agg(price).withColumn("currency", F.lit("USD"))
    return rows.withColumns({c: F.lit(None).cast("date") for c in ("effective_from", "effective_to")}).withColumn("seq", F.lit(0).cast("long"))


def _imported(spark: SparkSession, d: str) -> DataFrame:
    return catalog.upsert_prices(_known(spark, d), catalog.accepted_prices(catalog.validated(view(spark, d, "imported_materials"))))


@registered("import_upsert", f"{_FILES}, {_GOOD}, {_KNOWN}, last AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY material_name, currency ORDER BY seq DESC) = 1) SELECT coalesce(l.material_name, k.material_name) AS material_name, coalesce(l.currency, k.currency) AS currency, coalesce(l.unit_price, k.unit_price) AS unit_price, CAST(l.effective_from AS VARCHAR) AS effective_from, CAST(l.effective_to AS VARCHAR) AS effective_to FROM known k FULL JOIN last l ON k.material_name = l.material_name AND k.currency = l.currency")
def import_upsert(spark: SparkSession, d: str) -> DataFrame:
    text = {c: F.col(c).cast("string") for c in ("effective_from", "effective_to")}
    return _imported(spark, d).withColumns(text)


@registered("import_listing", f"{_FILES}, {_GOOD}, {_KNOWN}, last AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY material_name ORDER BY seq DESC) = 1), names AS (SELECT material_name FROM known UNION SELECT material_name FROM good) SELECT sha256('material|' || n.material_name) AS id, n.material_name AS name, 'ea' AS unit, CAST(NULL AS VARCHAR) AS category, coalesce(l.unit_price, k.unit_price) AS latest_unit_price FROM names n LEFT JOIN known k ON k.material_name = n.material_name LEFT JOIN last l ON l.material_name = n.material_name")
def import_listing(spark: SparkSession, d: str) -> DataFrame:
    prices = _imported(spark, d).withColumn("seq", F.lit(0))
    materials = prices.select(F.col("material_name").alias("name"), F.lit("ea").alias("unit"), F.lit(None).cast("string").alias("category")).distinct()
    return catalog.listing(materials, prices)


@registered("import_labor", f"{_FILES} SELECT rate_name AS name, max_by(CAST(productivity_rate AS DOUBLE), row) AS productivity_rate, max_by(CAST(hourly_rate AS DOUBLE), row) AS hourly_rate, max_by(category, row) FILTER (WHERE category <> '') AS category, CAST(max_by({_DAY.format('effective_from')}, row) FILTER (WHERE {_DAY.format('effective_from')} IS NOT NULL) AS VARCHAR) AS effective_from, CAST(NULL AS VARCHAR) AS effective_to FROM labor WHERE reason IS NULL GROUP BY rate_name")
def import_labor(spark: SparkSession, d: str) -> DataFrame:
    rates = catalog.upsert_labor(catalog.accepted_labor(catalog.validated(view(spark, d, "imported_labor"))))
    return rates.withColumns({c: F.col(c).cast("string") for c in ("effective_from", "effective_to")})


@registered("labor_catalog", f"{_FILES}, rates AS (SELECT rate_name AS name, max_by(CAST(productivity_rate AS DOUBLE), row) AS productivity_rate, max_by(CAST(hourly_rate AS DOUBLE), row) AS hourly_rate, max_by(category, row) FILTER (WHERE category <> '') AS category, CAST(max_by({_DAY.format('effective_from')}, row) FILTER (WHERE {_DAY.format('effective_from')} IS NOT NULL) AS VARCHAR) AS effective_from FROM labor WHERE reason IS NULL GROUP BY rate_name) SELECT sha256('labor|' || name) AS id, name, nullif(productivity_rate, 0) AS productivity_rate, nullif(hourly_rate, 0) AS hourly_rate, category, effective_from FROM rates")
def labor_catalog(spark: SparkSession, d: str) -> DataFrame:
    return catalog.labor_listing(catalog.upsert_labor(catalog.accepted_labor(catalog.validated(view(spark, d, "imported_labor")))))


@registered("price_sets", f"WITH {cte('prices')} SELECT material_name, currency, unit_price FROM prices WHERE material_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY material_name, currency ORDER BY effective_from DESC NULLS LAST, seq DESC) = 1")
def price_sets(spark: SparkSession, d: str) -> DataFrame:
    return catalog.latest_price(view(spark, d, "prices").filter("material_name IS NOT NULL"), "currency")


@registered("apply_assembly", f"""WITH {cte("requests")}, asked AS (SELECT *, CASE WHEN coalesce(rule_name, '') <> '' THEN rule_name ELSE component_type END AS wanted FROM requests),
parts AS (SELECT assembly_type, string_agg(material_name || '/' || {_UNIT.format(m="material_name")}, ',' ORDER BY position) AS materials, sum(bom_quantity) AS quantity FROM {_BOM} GROUP BY assembly_type)
SELECT request_id, component_type, rule_name, coalesce(p.materials, '') AS materials, round(coalesce(p.quantity, 0), 6) AS quantity, coalesce(r.installation_hours, 0.0) AS labor_hours, coalesce(r.waste_factor, 0.10)::DOUBLE AS waste_factor, coalesce(r.rule_version, 'unknown') AS rule_version,
  CASE WHEN r.assembly_type IS NULL THEN 'Assembly rule ''' || coalesce(rule_name, '') || ''' not found' END AS error FROM asked a LEFT JOIN {_RULES} r ON r.assembly_type = a.wanted LEFT JOIN parts p ON p.assembly_type = a.wanted""")
def apply_assembly(spark: SparkSession, d: str) -> DataFrame:
    out = catalog.assembly_outcomes(view(spark, d, "requests"), rules.rules(spark), rules.bom(spark))
    shown = F.array_join(F.transform("materials", lambda m: F.concat(m["material_name"], F.lit("/"), m["unit"])), ",")
    quantity = F.round(F.aggregate("materials", F.lit(0.0), lambda n, m: n + m["quantity"]), 6)
    return out.withColumn("quantity", quantity).withColumn("materials", shown)


@registered("rule_persist_versions", f"""WITH {cte("stored_rules")}, parts AS (SELECT assembly_type, count(*) AS n, sum(bom_quantity) AS q FROM {_BOM} GROUP BY assembly_type)
SELECT coalesce(s.name, r.assembly_type) AS name, coalesce(r.rule_version, s.rule_version) AS rule_version, CASE WHEN r.rule_version IS DISTINCT FROM s.rule_version AND r.rule_version IS NOT NULL THEN p.n ELSE 1 END AS materials,
  round(CASE WHEN r.rule_version IS DISTINCT FROM s.rule_version AND r.rule_version IS NOT NULL THEN p.q ELSE s.old_quantity END, 6) AS quantity FROM stored_rules s FULL JOIN {_RULES} r ON r.assembly_type = s.name LEFT JOIN parts p ON p.assembly_type = r.assembly_type""")
def rule_persist_versions(spark: SparkSession, d: str) -> DataFrame:
    stored = view(spark, d, "stored_rules").select("name", "rule_version", F.create_map(F.lit("old_part"), F.col("old_quantity")).alias("formula_or_bom"))
    after = catalog.persisted_rules(stored, rules.rules(spark), rules.bom(spark))
    values = F.map_values("formula_or_bom")
    return after.select("name", "rule_version", F.size("formula_or_bom").cast("long").alias("materials"), F.round(F.aggregate(values, F.lit(0.0), lambda n, x: n + x), 6).alias("quantity"))


@registered("bom_json", "SELECT 'order ' || CAST(l_orderkey AS VARCHAR) AS name, count(DISTINCT l_partkey) AS materials, round(sum(l_quantity), 6) AS quantity FROM lineitem GROUP BY l_orderkey")
def bom_json(spark: SparkSession, d: str) -> DataFrame:
    """Bills of materials, an assembly for each order, written as JSON and read back."""
    none = spark.createDataFrame([], "name string, rule_version string, formula_or_bom map<string,double>")
    name = F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("assembly_type")
    material = F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("material_name")
    bom = _lineitem(spark, d).groupBy(name, material).agg(F.sum("l_quantity").alias("bom_quantity"))
    stored = catalog.persisted_rules(none, bom.select("assembly_type", F.lit("1.0.0").alias("rule_version")).distinct(), bom)
    back = stored.select("name", F.to_json("formula_or_bom").alias("j")).select("name", F.from_json("j", "map<string,double>").alias("bom"))
    return back.select("name", F.size("bom").cast("long").alias("materials"), F.round(F.aggregate(F.map_values("bom"), F.lit(0.0), lambda n, x: n + x), 6).alias("quantity"))


@registered("assembly_material_links", f"SELECT 'order ' || CAST(o_orderkey AS VARCHAR) AS assembly, p_name AS material, {_UNIT.format(m='p_name')} AS unit, l_quantity AS quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey")
def assembly_material_links(spark: SparkSession, d: str) -> DataFrame:
    """Assemblies (orders), links (their lines) and materials (parts), joined both ways of the M:N relation."""
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    assemblies = t("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"))
    materials = t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), texts.unit_of(F.col("p_name")).alias("unit"))
    links = t("lineitem").select(F.col("l_orderkey").alias("assembly_id"), F.col("l_partkey").alias("material_id"), F.col("l_quantity").alias("quantity"))
    return catalog.assembly_materials(assemblies, links, materials)


@registered("unit_inference", f"SELECT name, {_UNIT.format(m='name')} AS unit, count(*) AS uses FROM (SELECT p_name AS name FROM part UNION ALL SELECT material_name FROM {_BOM}) GROUP BY name")
def unit_inference(spark: SparkSession, d: str) -> DataFrame:
    names = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("name")).union(rules.bom(spark).select("material_name"))
    return names.groupBy("name", texts.unit_of(F.col("name")).alias("unit")).agg(F.count(F.lit(1)).alias("uses"))


@registered("rule_bom_explode", f"WITH {cte('items')} SELECT m.assembly_type, b.material_name, count(*) AS lines, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount, r.rule_version, r.waste_factor, r.installation_hours FROM items i JOIN {_LAYERS} m ON i.layer = m.layer JOIN {_BOM} b ON b.assembly_type = m.assembly_type JOIN {_RULES} r ON r.assembly_type = m.assembly_type GROUP BY ALL")
def rule_bom_explode(spark: SparkSession, d: str) -> DataFrame:
    mapped = view(spark, d, "items").join(F.broadcast(rules.layers(spark)), "layer")
    lines = catalog.expanded(mapped, rules.bom(spark)).join(F.broadcast(rules.rules(spark)), "assembly_type")
    keys = ["assembly_type", "material_name", "rule_version", "waste_factor", "installation_hours"]
    return lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount"))


@registered("rule_persist_links", f"WITH {cte('prices')}, links AS (SELECT assembly_type, material_name, bom_quantity AS quantity, {_UNIT.format(m='material_name')} AS unit FROM {_BOM} UNION ALL SELECT assembly_type, 'Labor', installation_hours, 'hr' FROM {_RULES} WHERE hourly_rate IS NOT NULL) SELECT * FROM links l WHERE NOT EXISTS (SELECT 1 FROM prices p WHERE p.material_name = l.material_name AND p.currency = 'EUR' AND l.assembly_type = 'conduit')")
def rule_persist_links(spark: SparkSession, d: str) -> DataFrame:
    existing = view(spark, d, "prices").filter("currency = 'EUR'").select(F.lit("conduit").alias("assembly_type"), "material_name").distinct()
    return catalog.rule_links(rules.rules(spark), rules.bom(spark), existing)


@registered("layer_assembly_map", f"WITH {cte('items')} SELECT item_id, i.layer, m.assembly_type FROM items i LEFT JOIN {_LAYERS} m ON i.layer = m.layer")
def layer_assembly_map(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "items").join(F.broadcast(rules.layers(spark)), "layer", "left").select("item_id", "layer", "assembly_type")


@registered("unmapped_layers", f"WITH {cte('items')} SELECT coalesce(layer, 'default') AS layer, count(*) AS items FROM items i WHERE NOT EXISTS (SELECT 1 FROM {_LAYERS} m WHERE m.layer = i.layer) GROUP BY 1")
def unmapped_layers(spark: SparkSession, d: str) -> DataFrame:
    left = view(spark, d, "items").join(F.broadcast(rules.layers(spark)), "layer", "left_anti")
    return left.groupBy(F.coalesce("layer", F.lit("default")).alias("layer")).agg(F.count(F.lit(1)).alias("items"))


@registered("price_as_of", f"WITH {cte('prices')}, asked AS (SELECT l_orderkey * 10 + l_linenumber AS ask_id, p.material_name, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN prices p ON p.seq = l_partkey WHERE p.material_name IS NOT NULL), fits AS (SELECT a.ask_id, a.material_name, p.unit_price, row_number() OVER (PARTITION BY ask_id ORDER BY p.effective_from DESC NULLS LAST, p.seq DESC) AS n FROM asked a JOIN (SELECT material_name, effective_from, max(seq) AS seq, max_by(unit_price, seq) AS unit_price FROM prices GROUP BY ALL) p ON a.material_name = p.material_name AND (p.effective_from IS NULL OR p.effective_from <= a.day)) SELECT ask_id, material_name, unit_price FROM fits WHERE n = 1")
def price_as_of(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "prices").filter("material_name IS NOT NULL")
    asked = _lineitem(spark, d).join(p, F.col("l_partkey") == F.col("seq")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ask_id"), "material_name", F.col("l_shipdate").cast("date").alias("on"))
    daily = p.groupBy("material_name", "effective_from").agg(F.max_by("unit_price", "seq").alias("unit_price"), F.max("seq").alias("seq"))
    return catalog.price_as_of(daily, asked)


# --- scales, uploads, layers --------------------------------------------------------------------------------------


def _first_in_order(spark: SparkSession, d: str, patterns: list[str]) -> DataFrame:
    spans = view(spark, d, "spans").select("sheet", "ord", texts.first_scale(F.col("text"), patterns).alias("hit"))
    found = F.min_by("hit.scale", F.when(F.col("hit").isNotNull(), F.col("ord")))
    return spans.groupBy("sheet").agg(F.coalesce(found, F.lit(texts.DEFAULT_SCALE)).alias("scale"), F.bool_or(F.col("hit").isNotNull()).alias("detected"))


_HIT = "SELECT sheet, coalesce(min_by(s, ord) FILTER (WHERE s <> ''), '1:100') AS scale, bool_or(s <> '') AS detected FROM hits GROUP BY sheet"
# the strict patterns, the loose ones, and those that settle a sheet's scale, in DuckDB's quoting
_FEET = "\\bSCALE\\s+1=(\\d+)''''''-0\"\\b"
_INCHES = "\\b(1/4|1/2|1/8)\"=1''-0\"\\b"
_STRICT_HITS = f"hits AS (SELECT sheet, ord, coalesce(nullif(regexp_extract(text, '\\bELECTRICAL\\.SCALE\\s+(1:\\d+)\\b', 1), ''), nullif(regexp_extract(text, '{_FEET}', 1), ''), regexp_extract(text, '\\b(1:\\d+)\\b', 1)) AS s FROM spans)"
_LOOSE_HITS = f"hits AS (SELECT sheet, ord, coalesce(nullif(regexp_extract(text, '\\b(\\d+\\.\\d+:\\d+)\\b', 1), ''), nullif(regexp_extract(text, '\\b(\\d+:\\d+)\\b', 1), ''), regexp_extract(text, '{_INCHES}', 1)) AS s FROM spans)"


@registered("scale_detect", f"WITH {cte('spans')}, {_STRICT_HITS} {_HIT}")
def scale_detect(spark: SparkSession, d: str) -> DataFrame:
    return _first_in_order(spark, d, texts.STRICT)


@registered("scale_detect_loose", f"WITH {cte('spans')}, {_LOOSE_HITS} {_HIT}")
def scale_detect_loose(spark: SparkSession, d: str) -> DataFrame:
    return _first_in_order(spark, d, texts.LOOSE)


@registered("scale_needs_review", f"WITH {cte('spans')} SELECT sheet, NOT bool_or(regexp_matches(text, '{_INCHES}') OR regexp_matches(text, '\\b1:\\d+\\b')) AS needs_review, count(*) FILTER (WHERE text = 'NO SCALE HERE') AS without FROM spans GROUP BY sheet")
def scale_needs_review(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "spans").groupBy("sheet").agg(texts.needs_review(F.col("text")).alias("needs_review"), F.count_if(F.col("text") == "NO SCALE HERE").alias("without"))


@registered("schedule_entries", f"WITH {cte('schedules')} SELECT ord, CASE ord % 5 WHEN 0 THEN 'labelled' WHEN 1 THEN 'slope' ELSE 'numbered' END AS shape, CASE ord % 5 WHEN 0 THEN 'Load' WHEN 1 THEN regexp_extract(text, '%([0-9.]+) ', 1) ELSE 'PK' END AS label, CASE ord % 5 WHEN 0 THEN 'kg' WHEN 1 THEN 'cm' ELSE regexp_extract(text, '-([A-Z])', 1) END AS unit, regexp_extract(text, '([0-9]+)(cm)?$', 1) AS value FROM schedules WHERE ord % 5 < 3")
def schedule_entries(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "schedules").select("ord", texts.schedule_entry(F.col("text")).alias("e")).filter("e IS NOT NULL").select("ord", "e.*")


@registered("upload_classify", f"WITH {cte('uploads')}, counted AS (SELECT upload_id, CASE kind WHEN 0 THEN few ELSE drawings END AS drawings, images, has_text FROM uploads) SELECT upload_id, CASE WHEN drawings > 10000 AND has_text = 1 THEN 'vector' WHEN drawings < 100 AND images > 0 AND has_text = 0 THEN 'raster' ELSE 'vector' END AS status, NOT (drawings > 10000 AND has_text = 1 OR drawings < 100 AND images > 0 AND has_text = 0) AS ambiguous FROM counted")
def upload_classify(spark: SparkSession, d: str) -> DataFrame:
    u = view(spark, d, "uploads").withColumn("n", F.when(F.col("kind") == 0, F.col("few")).otherwise(F.col("drawings")))
    facts = F.col("n"), F.col("images"), F.col("has_text") == 1
    return u.select("upload_id", uploads.status(*facts).alias("status"), uploads.ambiguous(*facts).alias("ambiguous"))


@registered("upload_counters", "SELECT l_orderkey AS upload_id, count(*) FILTER (WHERE l_returnflag <> 'R') AS vectors, count(*) FILTER (WHERE l_returnflag = 'R') AS images, bool_or(l_linestatus = 'O') AS has_text FROM lineitem GROUP BY l_orderkey")
def upload_counters(spark: SparkSession, d: str) -> DataFrame:
    """Objects of an upload by kind, and whether it has text, with lines for objects."""
    kind, text = F.when(F.col("l_returnflag") == "R", "image").otherwise("vector"), F.col("l_linestatus") == "O"
    return uploads.counters(_lineitem(spark, d).select(F.col("l_orderkey").alias("upload_id"), kind.alias("kind"), text.alias("is_text")), "upload_id")


@registered("upload_unread", f"WITH {cte('uploads')}, counted AS (SELECT upload_id, CASE WHEN upload_id % 7 = 0 THEN NULL WHEN kind = 0 THEN few ELSE drawings END AS drawings, images, has_text FROM uploads) SELECT upload_id, CASE WHEN drawings IS NULL OR (drawings < 100 AND images > 0 AND has_text = 0) THEN 'raster' ELSE 'vector' END AS status FROM counted")
def upload_unread(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh file could not be read."""
    u = view(spark, d, "uploads").withColumn("n", F.when(F.col("upload_id") % 7 != 0, F.when(F.col("kind") == 0, F.col("few")).otherwise(F.col("drawings"))))
    return u.select("upload_id", uploads.status(F.col("n"), F.col("images"), F.col("has_text") == 1).alias("status"))


@registered("pages_in_order", f"WITH {cte('spans')} SELECT sheet, page_number, ordinal, CAST(row_number() OVER (PARTITION BY sheet ORDER BY page_number, ordinal) - 1 AS INTEGER) AS position FROM (SELECT sheet, ord % 3 + 1 AS page_number, ord AS ordinal FROM spans)")
def pages_in_order(spark: SparkSession, d: str) -> DataFrame:
    paged = view(spark, d, "spans").select("sheet", (F.col("ord") % 3 + 1).alias("page_number"), F.col("ord").alias("ordinal"))
    return records.in_page_order(paged)


@registered("layer_status", f"WITH {cte('items')} SELECT layer, status, count(*) AS items FROM (SELECT coalesce(i.layer, 'default') AS layer, coalesce(m.assembly_type, 'UNMAPPED') AS status FROM items i LEFT JOIN {_LAYERS} m ON i.layer = m.layer) GROUP BY layer, status")
def layer_status(spark: SparkSession, d: str) -> DataFrame:
    named = view(spark, d, "items").join(F.broadcast(rules.layers(spark)), "layer", "left")
    return named.groupBy(F.coalesce("layer", F.lit("default")).alias("layer"), F.coalesce("assembly_type", F.lit("UNMAPPED")).alias("status")).agg(F.count(F.lit(1)).alias("items"))


_ELECTRICAL = ", ".join(f"'{x}'" for x in texts.ELECTRICAL_LAYERS)


@registered("electrical_layers", f"WITH {cte('items')} SELECT l_orderkey, string_agg(layer, ',' ORDER BY pos) AS layers FROM items WHERE layer IN ({_ELECTRICAL}) GROUP BY l_orderkey")
def electrical_layers(spark: SparkSession, d: str) -> DataFrame:
    kept = view(spark, d, "items").filter(F.col("layer").isin(texts.ELECTRICAL_LAYERS))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "layer"))), lambda x: x["layer"])
    return kept.groupBy("l_orderkey").agg(F.array_join(ordered, ",").alias("layers"))


_ALL_LAYERS = ", ".join(f"({k}, '{n}')" for k, n in enumerate([*[n for names in rules.LAYERS.values() for n in names], *rules.OLDER_LAYERS]))


@registered("mapped_layer_list", f"WITH {cte('items')}, listed AS (SELECT CAST(row_number() OVER (ORDER BY min(k)) - 1 AS INTEGER) AS position, layer FROM (VALUES {_ALL_LAYERS}) AS t(k, layer) GROUP BY layer) SELECT position, l.layer, count(i.item_id) AS items, count(DISTINCT i.l_orderkey) AS sheets FROM listed l LEFT JOIN items i ON i.layer = l.layer GROUP BY ALL")
def mapped_layer_list(spark: SparkSession, d: str) -> DataFrame:
    """The layers that are clustered, in their order, with what the sheets have on them."""
    listed = spark.createDataFrame(list(enumerate(rules.clustered_layers())), "position int, layer string")
    found = view(spark, d, "items").groupBy("layer").agg(F.count("item_id").alias("items"), F.countDistinct("l_orderkey").alias("sheets"))
    return listed.join(found, "layer", "left").select("position", "layer", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("sheets", F.lit(0)).alias("sheets"))


@registered("layer_filter", f"WITH {cte('paths')} SELECT id, coalesce(layer, 'default') AS layer FROM paths WHERE coalesce(layer, 'default') IN ('default', 'POWER')")
def layer_filter(spark: SparkSession, d: str) -> DataFrame:
    return spatial.on_layer(view(spark, d, "paths"), ["default", "POWER"]).select("id", F.coalesce("layer", F.lit("default")).alias("layer"))


@registered("layer_registry", f"WITH {cte('layer_groups')}, last AS (SELECT name, max_by(status, ordinal) AS status, max_by(count, ordinal) AS count FROM layer_groups GROUP BY name) SELECT * FROM last UNION ALL SELECT 'default', 'ON', 0 WHERE NOT EXISTS (SELECT 1 FROM last WHERE name = 'default')")
def layer_registry(spark: SparkSession, d: str) -> DataFrame:
    return records.layer_registry(view(spark, d, "layer_groups"))


@registered("span_flatten", "SELECT conv_id AS page_number, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS b, 0 AS l, 0 AS s, text, coalesce(role, 'unknown') AS font, 12.0::DOUBLE AS size FROM conversations")
def span_flatten(spark: SparkSession, d: str) -> DataFrame:
    span = F.struct("text", F.col("role").alias("font"), F.lit(None).cast("double").alias("size"))
    talk = spark.read.parquet(f"{d}/conversations.parquet")
    block = F.struct("turn", "role", "text", F.array(F.struct(F.array(span).alias("spans"))).alias("lines"))
    pages = talk.groupBy(F.col("conv_id").alias("page_number")).agg(F.transform(F.array_sort(F.collect_list(block)), lambda b: F.struct(b["lines"].alias("lines"))).alias("blocks"))
    return records.flatten_spans(pages)


# --- clusters and routes ------------------------------------------------------------------------------------------

_POINTS = f"{cte('paths')}, points AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM paths WHERE layer IN (SELECT layer FROM {_LAYERS}))"
_REACH = f"""near AS (SELECT p.layer, p.ord AS a, q.ord AS b FROM points p JOIN points q ON p.layer = q.layer AND p.ord <> q.ord AND (p.cx - q.cx) * (p.cx - q.cx) + (p.cy - q.cy) * (p.cy - q.cy) <= {EPS * EPS}),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
labelled AS (SELECT p.*, coalesce((SELECT CASE WHEN count(*) > 0 THEN least(min(b), p.ord) END FROM reach r WHERE r.a = p.ord), -1) AS label, count(*) OVER (PARTITION BY layer) AS n FROM points p)"""
_RECORDS = f"""WITH RECURSIVE {_POINTS}, {_REACH}, records AS (
  SELECT layer, label, count(*) AS num_paths, string_agg(id, ',' ORDER BY ord) AS members, string_agg(id, ',' ORDER BY id) AS member_key, min_by(cx, ord) AS cx, min_by(cy, ord) AS cy, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, min(ord) AS first_ord, false AS single FROM labelled WHERE n >= 2 GROUP BY layer, label
  UNION ALL SELECT layer, label, 1, id, id, cx, cy, x0, y0, x1, y1, ord, true FROM labelled WHERE label < 0)"""


def _points(spark: SparkSession, d: str) -> DataFrame:
    mapped = view(spark, d, "paths").join(F.broadcast(rules.layers(spark).select("layer")), "layer", "left_semi")
    cx, cy = spatial.centroid(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return mapped.withColumn("cx", cx).withColumn("cy", cy)


def _records(spark: SparkSession, d: str) -> DataFrame:
    return spatial.cluster_records(spatial.dbscan(_points(spark, d), EPS))


@registered("path_centroids", f"WITH {cte('paths')} SELECT id, coalesce(layer, 'default') AS layer, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM paths")
def path_centroids(spark: SparkSession, d: str) -> DataFrame:
    cx, cy = spatial.centroid(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return view(spark, d, "paths").select("id", F.coalesce("layer", F.lit("default")).alias("layer"), cx.alias("cx"), cy.alias("cy"))


@registered("eps_neighbors", f"WITH RECURSIVE {_POINTS}, {_REACH} SELECT layer, a, b FROM near")
def eps_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return spatial.near(_points(spark, d), EPS)


@registered("dbscan_clusters", f"WITH RECURSIVE {_POINTS}, {_REACH} SELECT layer, ord, label FROM labelled")
def dbscan_clusters(spark: SparkSession, d: str) -> DataFrame:
    return spatial.dbscan(_points(spark, d), EPS).select("layer", "ord", "label")


@registered("dbscan_min_points", f"""WITH RECURSIVE {_POINTS}, near AS (SELECT p.ord AS a, q.ord AS b FROM points p JOIN points q ON p.layer = q.layer AND p.ord <> q.ord AND (p.cx - q.cx) * (p.cx - q.cx) + (p.cy - q.cy) * (p.cy - q.cy) <= 400),
core AS (SELECT a FROM near GROUP BY a HAVING count(*) + 1 >= 4), links AS (SELECT a, b FROM near WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
labels AS (SELECT c.a AS ord, least(c.a, coalesce((SELECT min(b) FROM reach r WHERE r.a = c.a), c.a)) AS label FROM core c)
SELECT p.layer, p.ord, coalesce(l.label, (SELECT min(k.label) FROM near n JOIN labels k ON n.b = k.ord WHERE n.a = p.ord), -1) AS label FROM points p LEFT JOIN labels l ON p.ord = l.ord""")
def dbscan_min_points(spark: SparkSession, d: str) -> DataFrame:
    return spatial.dbscan(_points(spark, d), 20.0, 4).select("layer", "ord", "label")


@registered("cluster_noise_records", _RECORDS + " SELECT layer, label, single, num_paths, first_ord FROM records WHERE label < 0")
def cluster_noise_records(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).filter("label < 0").select("layer", "label", "single", "num_paths", "first_ord")


@registered("cluster_envelopes", _RECORDS + " SELECT layer, label, single, num_paths, members, cx, cy, x0, y0, x1, y1 FROM records")
def cluster_envelopes(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("layer", "label", "single", "num_paths", F.array_join("members", ",").alias("members"), "cx", "cy", "x0", "y0", "x1", "y1")


_COUNTED = _RECORDS + f", counted AS (SELECT m.assembly_type, r.layer, members, row_number() OVER (PARTITION BY member_key ORDER BY single, first_ord) AS k FROM records r JOIN {_LAYERS} m ON r.layer = m.layer)"


@registered("component_count", _COUNTED + " SELECT assembly_type, layer, members, 1 AS count FROM counted WHERE k = 1")
def component_count(spark: SparkSession, d: str) -> DataFrame:
    return spatial.components_counted(_records(spark, d), rules.layers(spark)).select("assembly_type", "layer", F.array_join("members", ",").alias("members"), "count")


@registered("component_totals", _COUNTED + " SELECT assembly_type, count(*) AS total FROM counted WHERE k = 1 GROUP BY assembly_type")
def component_totals(spark: SparkSession, d: str) -> DataFrame:
    counted = spatial.components_counted(_records(spark, d), rules.layers(spark))
    return counted.groupBy("assembly_type").agg(F.sum("count").alias("total"))


@registered("shape_clusters", f"""WITH RECURSIVE {cte("paths")}, points AS (SELECT 'shapes' AS layer, ord, id, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM paths WHERE layer IS NULL OR layer = 'lighting'),
near AS (SELECT p.ord AS a, q.ord AS b FROM points p JOIN points q ON p.ord <> q.ord AND (p.cx - q.cx) * (p.cx - q.cx) + (p.cy - q.cy) * (p.cy - q.cy) <= 900),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a)
SELECT ord, coalesce((SELECT CASE WHEN count(*) > 0 THEN least(min(b), p.ord) END FROM reach r WHERE r.a = p.ord), -1) AS label FROM points p""")
def shape_clusters(spark: SparkSession, d: str) -> DataFrame:
    cx, cy = spatial.centroid(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    shapes = view(spark, d, "paths").filter("layer IS NULL OR layer = 'lighting'").withColumn("layer", F.lit("shapes")).withColumn("cx", cx).withColumn("cy", cy)
    return spatial.dbscan(shapes, 30.0).select("ord", "label")


@registered("box_clusters", f"""WITH RECURSIVE {cte("sheet_paths")}, near AS (SELECT p.ord AS a, q.ord AS b FROM sheet_paths p JOIN sheet_paths q ON p.sheet = q.sheet AND p.ord <> q.ord
  AND greatest(p.x0 - q.x1, q.x0 - p.x1, 0) ** 2 + greatest(p.y0 - q.y1, q.y0 - p.y1, 0) ** 2 <= 36),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a)
SELECT p.sheet, p.ord, least(p.ord, coalesce((SELECT min(b) FROM reach r WHERE r.a = p.ord), p.ord)) AS label FROM sheet_paths p""")
def box_clusters(spark: SparkSession, d: str) -> DataFrame:
    return spatial.box_clusters(view(spark, d, "sheet_paths"), 6.0, group="sheet").select("sheet", "ord", "label")


_SHAPES = f"""WITH RECURSIVE {cte("paths")}, points AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM paths WHERE layer IS NULL OR layer = 'lighting'),
near AS (SELECT p.ord AS a, q.ord AS b FROM points p JOIN points q ON p.ord <> q.ord AND (p.cx - q.cx) * (p.cx - q.cx) + (p.cy - q.cy) * (p.cy - q.cy) <= 900),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
labelled AS (SELECT p.*, coalesce((SELECT CASE WHEN count(*) > 0 THEN least(min(b), p.ord) END FROM reach r WHERE r.a = p.ord), -1) AS label FROM points p)"""


@registered("shape_cluster_boxes", _SHAPES + " SELECT label, count(*) AS num_paths, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM labelled WHERE label >= 0 GROUP BY label UNION ALL SELECT label, 1, x0, y0, x1, y1 FROM labelled WHERE label < 0")
def shape_cluster_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Detected shapes as records: clusters, and each shape that stands alone."""
    cx, cy = spatial.centroid(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    shapes_ = view(spark, d, "paths").filter("layer IS NULL OR layer = 'lighting'").withColumn("layer", F.lit("shapes")).withColumn("cx", cx).withColumn("cy", cy)
    return spatial.cluster_records(spatial.dbscan(shapes_, 30.0), noise="singletons").select("label", "num_paths", "x0", "y0", "x1", "y1")


@registered("item_points", f"WITH {cte('paths')} SELECT id, CASE ord % 3 WHEN 0 THEN 4 WHEN 1 THEN 0 ELSE 2 END AS n_points, CASE ord % 3 WHEN 0 THEN abs(x1 - x0) + abs(y1 - y0) + abs(x1 - x0) WHEN 1 THEN 0.0 ELSE sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) END::DOUBLE AS raw_length FROM paths")
def item_points(spark: SparkSession, d: str) -> DataFrame:
    """Drawing items (rectangles, quads, lines) as points, and the length of the polyline through them."""
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    op = F.when(F.col("ord") % 3 == 0, "re").when(F.col("ord") % 3 == 1, "qu").otherwise("l")
    items = F.array(F.struct(op.alias("op"), F.array(at("x0", "y0"), at("x1", "y1")).alias("pts")))
    drawn = view(spark, d, "paths").select("id", items.alias("items")).withColumn("points", routes.points_of(F.col("items")))
    return drawn.select("id", F.size("points").alias("n_points"), routes.raw_length(F.col("points")).alias("raw_length"))


@registered("record_ids", f"WITH {cte('paths')} SELECT ord, sha256(concat_ws('|', layer, CAST(ord AS VARCHAR))) AS record_id FROM paths")
def record_ids(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "paths").select("ord", records.record_id("layer", "ord").alias("record_id"))


_LENGTHS = f"""WITH {cte("vertices")}, lines AS (SELECT route_id, scale, list(struct_pack(x := x, y := y) ORDER BY x, y) AS p FROM vertices GROUP BY route_id, scale),
lengths AS (SELECT route_id, scale, len(p) AS points, CASE WHEN len(p) < 2 THEN 0.0 ELSE CAST(printf('%.3f', list_reduce(list_transform(range(2, len(p) + 1), lambda k: sqrt((p[k].x - p[k-1].x) * (p[k].x - p[k-1].x) + (p[k].y - p[k-1].y) * (p[k].y - p[k-1].y))), lambda a, b: a + b) * CAST(split_part(scale, ':', 2) AS DOUBLE)) AS DOUBLE) END AS length_m FROM lines)"""


def _polylines(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "vertices").groupBy("route_id", "scale").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("points"))


@registered("polyline_length", _LENGTHS + " SELECT route_id, points AS n_points, length_m FROM lengths")
def polyline_length(spark: SparkSession, d: str) -> DataFrame:
    return _polylines(spark, d).select("route_id", F.size("points").cast("long").alias("n_points"), routes.length(F.col("points"), F.col("scale")).alias("length_m"))


_ROUTED = f"""{_LENGTHS}, {cte("items")}, firsts AS (SELECT l_orderkey AS route_id, layer FROM items WHERE pos = 1)
SELECT l.route_id, f.layer, m.assembly_type, l.length_m FROM lengths l JOIN firsts f ON l.route_id = f.route_id JOIN {_LAYERS} m ON m.layer = f.layer WHERE m.assembly_type IN ('cable_tray', 'conduit') AND l.points >= 2"""


@registered("route_measure", _ROUTED)
def route_measure(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "vertices")
    name = lambda route: F.concat(F.col(route).cast("string"), F.lit("-"), F.col("pos").cast("string")).alias("id")
    members = F.transform(F.array_sort(F.collect_list(F.struct("pos", name("route_id")))), lambda m: m["id"])
    clusters = v.groupBy(F.col("route_id").alias("ord")).agg(F.first("scale").alias("scale"), members.alias("members")).withColumn("cluster_id", F.lit(0))
    # a route's places are numbered in both views, so that an id has one row in each
    one = spatial.spread(v.select(name("route_id"), F.array(F.struct("x", "y")).alias("points")), "id")
    paths = one.join(view(spark, d, "items").select(name("l_orderkey"), "layer"), "id")
    wanted = [n for n, a in rules.layer_rows() if a in rules.ROUTE_ASSEMBLIES]
    measured = routes.measure_routes(clusters, paths, wanted).join(F.broadcast(rules.layers(spark)), "layer")
    return measured.select(F.col("ord").alias("route_id"), "layer", "assembly_type", "length_m")


@registered("dedup_keep_first", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey) ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS n FROM lineitem) WHERE n = 1")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    key = F.array_join(F.array_sort(F.array("l_partkey", "l_suppkey")), ",")
    return spatial.keep_first(_lineitem(spark, d), key, [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_extendedprice")]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@registered("nearest_target", f"WITH {cte('paths')}, c AS (SELECT ord, layer, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM paths), d AS (SELECT t.ord AS text_id, g.ord AS target_id, (t.x - g.x) * (t.x - g.x) + (t.y - g.y) * (t.y - g.y) AS d2 FROM c t JOIN c g ON g.layer = 'POWER' AND (t.x - g.x) * (t.x - g.x) + (t.y - g.y) * (t.y - g.y) <= 2500) SELECT text_id, target_id, distance FROM (SELECT text_id, target_id, sqrt(d2) AS distance, row_number() OVER (PARTITION BY text_id ORDER BY d2, target_id) AS n FROM d) WHERE n = 1")
def nearest_target(spark: SparkSession, d: str) -> DataFrame:
    cx, cy = spatial.centroid(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    c = view(spark, d, "paths").select("ord", "layer", cx.alias("x"), cy.alias("y"))
    return spatial.nearest(c.select(F.col("ord").alias("text_id"), "x", "y"), c.filter("layer = 'POWER'").select(F.col("ord").alias("target_id"), "x", "y"), 50.0)


# --- confidence ---------------------------------------------------------------------------------------------------

_STATUS = f"""WITH {cte("measured")}, tiers AS (SELECT *, CASE WHEN source IN ('vector', 'raster') THEN 'MEASURED' WHEN source IN ('assembly_rule', 'formula') THEN CASE WHEN coalesce(rule_version, '') <> '' THEN 'DERIVED' END ELSE 'ASSUMED' END AS status FROM measured)"""


def _tiers(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "measured").withColumn("status", confidence.status(F.col("source"), F.col("rule_version")))


@registered("confidence_status", _STATUS + " SELECT event_id, status, CASE WHEN source IN ('assembly_rule', 'formula') AND coalesce(rule_version, '') = '' THEN 'rule_version is required' END AS error, coalesce(status IN ('MEASURED', 'DERIVED', 'ASSUMED'), false) AS valid FROM tiers")
def confidence_status(spark: SparkSession, d: str) -> DataFrame:
    error = confidence.status_error(F.col("source"), F.col("rule_version"))
    return _tiers(spark, d).select("event_id", "status", error.alias("error"), confidence.is_valid(F.col("status")).alias("valid"))


@registered("confidence_score", _STATUS + " SELECT event_id, CASE status WHEN 'MEASURED' THEN CASE WHEN source = 'raster' THEN 0.6 ELSE 1.0 END WHEN 'DERIVED' THEN CASE WHEN rule_version = '1.0.0' THEN 0.8 ELSE 0.7 END WHEN 'ASSUMED' THEN 0.3 ELSE 0.5 END::DOUBLE AS score FROM tiers")
def confidence_score(spark: SparkSession, d: str) -> DataFrame:
    return _tiers(spark, d).select("event_id", confidence.score(F.col("status"), F.col("source") == "raster", F.col("rule_version")).alias("score"))


@registered("pipeline_status", _STATUS + " SELECT event_id, status, CASE status WHEN 'MEASURED' THEN 1.0 WHEN 'DERIVED' THEN CASE WHEN rule_version = '1.0.0' THEN 0.8 ELSE 0.7 END WHEN 'ASSUMED' THEN 0.3 ELSE 0.5 END::DOUBLE AS score, CASE status WHEN 'MEASURED' THEN 'Measured/green' WHEN 'DERIVED' THEN 'Derived/purple' ELSE 'Assumed/red' END AS display FROM tiers")
def pipeline_status(spark: SparkSession, d: str) -> DataFrame:
    score = confidence.pipeline_score(F.col("source"), F.col("rule_version"))
    return _tiers(spark, d).select("event_id", "status", score.alias("score"), confidence.display(F.col("status")).alias("display"))


@registered("status_counts", _STATUS + " SELECT user_id, count(*) AS total, count(*) FILTER (WHERE status = 'MEASURED') AS measured, count(*) FILTER (WHERE status = 'DERIVED') AS derived, count(*) FILTER (WHERE status = 'ASSUMED') AS assumed, coalesce(bool_or(status = 'ASSUMED'), false) AS bulk_enabled FROM tiers GROUP BY user_id")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    n = lambda tier: F.count_if(F.col("status") == tier)
    return _tiers(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), n("MEASURED").alias("measured"), n("DERIVED").alias("derived"), n("ASSUMED").alias("assumed"), (n("ASSUMED") > 0).alias("bulk_enabled"))


@registered("overlay_lookup", f"WITH {cte('paths', 'overlays')}, first AS (SELECT * FROM overlays QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1) SELECT p.id, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(width, 0) AS width, coalesce(height, 0) AS height FROM (SELECT id FROM paths) p LEFT JOIN first f ON f.id = p.id")
def overlay_lookup(spark: SparkSession, d: str) -> DataFrame:
    return review.overlay_of(view(spark, d, "paths").select("id"), view(spark, d, "overlays"))


@registered("review_actions", _STATUS + " SELECT event_id, status IS DISTINCT FROM 'MEASURED' AS can_reject, CASE WHEN event_id % 5 - 2 > 0 THEN event_id % 5 - 2 ELSE 100 END AS quantity FROM tiers")
def review_actions(spark: SparkSession, d: str) -> DataFrame:
    new = F.col("event_id") % 5 - 2
    return _tiers(spark, d).select("event_id", review.can_reject(F.col("status")).alias("can_reject"), review.corrected(F.lit(100).cast("long"), new).alias("quantity"))


# --- scanned sheets -----------------------------------------------------------------------------------------------

_VALID = "regexp_full_match({0}, '[\\p{{L}}\\p{{N}}_]{{2,40}}')"
_PARSED = f"""WITH {cte("ocr")}, low AS (SELECT *, lower(trim(text)) AS t FROM ocr),
cut AS (SELECT *, trim(split_part(t, ':', 1)) AS nm, CASE WHEN strpos(t, ':') > 0 THEN trim(substr(t, strpos(t, ':') + 1)) ELSE '' END AS ds, trim(regexp_extract(t, '\\(([^)]+)\\)', 1)) AS inside, trim(regexp_extract(t, '^(.*?)\\([^)]+\\)', 1)) AS pre FROM low),
parsed AS (SELECT *, CASE WHEN t = '' OR contains(t, 'scale') OR contains(t, '1:') OR contains(t, 'drawing') OR contains(t, 'project') THEN NULL
  WHEN strpos(t, ':') > 0 AND {_VALID.format("nm")} AND ds <> '' THEN [nm, ds] WHEN inside <> '' AND {_VALID.format("inside")} AND pre <> '' THEN [inside, pre]
  WHEN {_VALID.format("t")} THEN [t, array_to_string(list_transform(string_split(t, '_'), lambda w: upper(w[1]) || w[2:]), '_')] END AS e FROM cut),
legend AS (SELECT page, e[1] AS name, min_by(e[2], ord) AS description, min(ord) AS ord FROM parsed WHERE e IS NOT NULL AND y0 < 200 GROUP BY page, e[1])"""


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "ocr").withColumn("e", texts.legend_entry(F.col("text")))


def _legend(spark: SparkSession, d: str) -> DataFrame:
    top = _parsed(spark, d).filter("e IS NOT NULL AND y0 < 0.20 * 1000")
    return top.groupBy("page", F.col("e.name").alias("name")).agg(F.min_by("e.description", "ord").alias("description"), F.min("ord").alias("ord"))


@registered("legend_parse", _PARSED + " SELECT ord, e[1] AS name, e[2] AS description FROM parsed WHERE e IS NOT NULL")
def legend_parse(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).filter("e IS NOT NULL").select("ord", "e.name", "e.description")


@registered("legend_map", _PARSED + " SELECT page, name, description FROM legend")
def legend_map(spark: SparkSession, d: str) -> DataFrame:
    return _legend(spark, d).select("page", "name", "description")


@registered("legend_match", _PARSED + """, symbols AS (SELECT p_partkey AS symbol_id, p_brand AS page, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN split_part(p_name, ' ', 2) ELSE 'X ' || replace(p_name, ' ', '_') END AS symbol FROM part),
found AS (SELECT symbol_id, symbol, name AS legend_key, description, lower(symbol) = name AS same, row_number() OVER (PARTITION BY symbol_id ORDER BY CASE WHEN lower(symbol) = name THEN 0 ELSE 1 END, legend.ord) AS n FROM symbols JOIN legend USING (page) WHERE contains(name, lower(symbol)) OR contains(lower(symbol), name))
SELECT symbol_id, symbol, legend_key, description, CASE WHEN same THEN 'exact_match' ELSE 'substring_match' END AS method, CASE WHEN same THEN 1.0 ELSE 0.7 END::DOUBLE AS confidence FROM found WHERE n = 1""")
def legend_match(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    symbol = F.when(F.col("p_partkey") % 3 == 0, name).when(F.col("p_partkey") % 3 == 1, F.split_part("p_name", F.lit(" "), F.lit(2))).otherwise(F.concat(F.lit("X "), name))
    symbols = part.select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("page"), symbol.alias("symbol"))
    return legends.matched(symbols, _legend(spark, d)).drop("page")


@registered("legend_best_text", f"""WITH {cte("ocr")}, scored AS (SELECT *, (confidence / 100) * (1 - y0 / 2000) AS score FROM ocr WHERE regexp_matches(lower(text), 'legend|symbol|key|table|note|scale') OR len(regexp_split_to_array(trim(text), '\\s+')) BETWEEN 3 AND 20)
SELECT page, text, score FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, ord) AS n FROM scored) WHERE n = 1""")
def legend_best_text(spark: SparkSession, d: str) -> DataFrame:
    score = (F.col("confidence") / 100) * (1 - F.col("y0") / 2000)
    found = view(spark, d, "ocr").filter(texts.is_legend_candidate(F.col("text"))).withColumn("score", score)
    return found.groupBy("page").agg(F.max_by(F.struct("text", "score"), F.struct("score", -F.col("ord"))).alias("m")).select("page", "m.text", "m.score")


@registered("ocr_normalize", f"WITH {cte('ocr')} SELECT ord, trim(text) AS text, CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END AS confidence, y0 AS top, y0 + 12.0 AS bottom FROM ocr WHERE trim(text) <> ''")
def ocr_normalize(spark: SparkSession, d: str) -> DataFrame:
    corners = F.array(F.col("y0") + 12.0, F.col("y0"), F.col("y0") + 5.0)
    c = F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence"))
    return view(spark, d, "ocr").filter(F.trim("text") != "").select("ord", F.trim("text").alias("text"), c.alias("confidence"), F.array_min(corners).alias("top"), F.array_max(corners).alias("bottom"))


@registered("approx_segments", f"WITH {cte('paths')}, b AS (SELECT ord, layer, greatest(CAST(trunc(x0) AS BIGINT), 0) AS l, greatest(CAST(trunc(y0) AS BIGINT), 0) AS t, least(CAST(trunc(x1) AS BIGINT), 300) AS r, least(CAST(trunc(y1) AS BIGINT), 300) AS u FROM paths) SELECT ord, coalesce(layer, 'unknown') AS class, greatest(r - l, 0) * greatest(u - t, 0) AS pixels, CASE WHEN layer IS NULL THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END * 0.7::DOUBLE AS confidence FROM b")
def approx_segments(spark: SparkSession, d: str) -> DataFrame:
    whole = lambda c: F.col(c).cast("long")
    low, high = lambda c: F.greatest(whole(c), F.lit(0)), lambda c: F.least(whole(c), F.lit(300))
    side = lambda a, b: F.greatest(high(b) - low(a), F.lit(0))
    c = F.when(F.col("layer").isNull(), 0.5).otherwise(0.8) * 0.7
    return view(spark, d, "paths").select("ord", F.coalesce("layer", F.lit("unknown")).alias("class"), (side("x0", "x1") * side("y0", "y1")).alias("pixels"), c.alias("confidence"))


# --- projects and estimates ---------------------------------------------------------------------------------------

_CHAIN = "FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey"


def _chain(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    return t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))


@registered("fk_chain", f"SELECT r_name, n_name, count(DISTINCT c_custkey) AS drawings, count(DISTINCT o_orderkey) AS sheets, count(*) AS measurements {_CHAIN} GROUP BY r_name, n_name")
def fk_chain(spark: SparkSession, d: str) -> DataFrame:
    return _chain(spark, d).groupBy("r_name", "n_name").agg(F.countDistinct("c_custkey").alias("drawings"), F.countDistinct("o_orderkey").alias("sheets"), F.count(F.lit(1)).alias("measurements"))


_DEC = "CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DOUBLE)"


@registered("estimate_totals", f"SELECT c_custkey, {_DEC.format('l_extendedprice')} AS material, {_DEC.format('l_quantity')} AS labor, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) + CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total {_CHAIN} GROUP BY c_custkey")
def estimate_totals(spark: SparkSession, d: str) -> DataFrame:
    money = lambda c: F.col(c).cast("decimal(18,2)")
    return _chain(spark, d).groupBy("c_custkey").agg(F.sum(money("l_extendedprice")).cast("double").alias("material"), F.sum(money("l_quantity")).cast("double").alias("labor"), F.sum(money("l_extendedprice") + money("l_quantity")).cast("double").alias("total"))


@registered("review_metrics", _STATUS + " SELECT user_id, coalesce(status, 'none') AS tier, count(*) AS reviewed, CAST(max(epoch_us(ts)) - min(epoch_us(ts)) AS BIGINT) AS span_us FROM tiers GROUP BY user_id, status")
def review_metrics(spark: SparkSession, d: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return _tiers(spark, d).groupBy("user_id", F.coalesce("status", F.lit("none")).alias("tier")).agg(F.count(F.lit(1)).alias("reviewed"), (F.max(us) - F.min(us)).alias("span_us"))


@registered("review_pace", _STATUS + " SELECT user_id, count(*) AS reviewed, CASE WHEN count(*) > 1 THEN (max(epoch_us(ts)) - min(epoch_us(ts))) / (count(*) - 1) END::DOUBLE AS mean_us FROM tiers GROUP BY user_id")
def review_pace(spark: SparkSession, d: str) -> DataFrame:
    """The mean time between a reviewer's decisions."""
    us, n = F.unix_micros(F.col("ts").cast("timestamp")), F.count(F.lit(1))
    return _tiers(spark, d).groupBy("user_id").agg(n.alias("reviewed"), F.when(n > 1, (F.max(us) - F.min(us)) / F.when(n > 1, n - 1)).alias("mean_us"))


@registered("quality_gate", f"WITH {cte('items')} SELECT l_orderkey, count(DISTINCT layer) AS layers, count(*) FILTER (WHERE layer IS NULL) AS untagged, CASE WHEN count(DISTINCT layer) < 3 OR count(*) FILTER (WHERE layer IS NULL) > 0.9 * count(*) THEN 'degraded_vector' ELSE 'layered_vector' END AS source_quality FROM items GROUP BY l_orderkey")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    untagged, n = F.count_if(F.col("layer").isNull()), F.count(F.lit(1))
    poor = (F.countDistinct("layer") < 3) | (untagged > 0.9 * n)
    return view(spark, d, "items").groupBy("l_orderkey").agg(F.countDistinct("layer").alias("layers"), untagged.alias("untagged"), F.when(poor, "degraded_vector").otherwise("layered_vector").alias("source_quality"))


@registered("integrity_checks", "SELECT 'orders: key unique' AS rule, count(*) - count(DISTINCT o_orderkey) AS rows FROM orders UNION ALL SELECT 'part: name unique', count(*) - count(DISTINCT p_name) FROM part UNION ALL SELECT 'lineitem in orders', count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)) FROM lineitem UNION ALL SELECT 'labels in documents', count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)) FROM labels l")
def integrity_checks(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    checks = [schemas.repeated(t("orders"), ["o_orderkey"], "orders: key unique"), schemas.repeated(t("part"), ["p_name"], "part: name unique"), schemas.orphans(t("lineitem"), "l_orderkey", t("orders"), "o_orderkey", "lineitem in orders"), schemas.orphans(t("labels"), "doc_id", t("documents"), "doc_id", "labels in documents")]
    return checks[0].union(checks[1]).union(checks[2]).union(checks[3])


@registered("layer_classify", f"WITH {cte('items')} SELECT CASE WHEN layer IS NULL THEN 'unclassified' WHEN regexp_matches(layer, '(?i)light|switch|socket|power|^db$|^e-') THEN 'electrical' WHEN regexp_matches(layer, '(?i)tray|conduit') THEN 'containment' WHEN regexp_matches(layer, '(?i)access|security|^ac$') THEN 'security' WHEN regexp_matches(layer, '(?i)wall|door') THEN 'architecture' ELSE 'unclassified' END AS class, count(*) AS items FROM items GROUP BY 1")
def layer_classify(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "items").groupBy(shapes.layer_class(F.col("layer")).alias("class")).agg(F.count(F.lit(1)).alias("items"))


@registered("space_volume", f"""WITH {cte("vertices")}, lines AS (SELECT route_id, list(struct_pack(x := x, y := y) ORDER BY pos) AS p FROM vertices GROUP BY route_id),
areas AS (SELECT route_id, CASE WHEN len(p) < 3 THEN 0.0 ELSE abs(list_reduce(list_transform(range(1, len(p) + 1), lambda k: p[k].x * p[k % len(p) + 1].y - p[k % len(p) + 1].x * p[k].y), lambda a, b: a + b)) / 2 END AS area FROM lines)
SELECT route_id, area, CAST(printf('%.3f', area * 0.2::DOUBLE * (1 + 0.1::DOUBLE)) AS DOUBLE) AS volume FROM areas""")
def space_volume(spark: SparkSession, d: str) -> DataFrame:
    at = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    spaces = view(spark, d, "vertices").groupBy("route_id").agg(at.alias("p")).withColumn("area", shapes.area(F.col("p")))
    return spaces.select("route_id", "area", numbers.correctly_rounded(shapes.volume(F.col("area"), F.lit(0.2), F.lit(0.1)), 3).alias("volume"))


@registered("boq_json", _LINES + """ SELECT assembly_type, count(*) AS lines, count(*) FILTER (WHERE unpriced) AS unpriced, CAST(sum(CAST(total_cost AS DECIMAL(18,2))) AS DOUBLE) AS total_cost FROM priced GROUP BY assembly_type""")
def boq_json(spark: SparkSession, d: str) -> DataFrame:
    """Lines written as JSON and read back with the schema of a line."""
    lines = _priced_items(spark, d).withColumn("confidence_status", F.lit("MEASURED")).withColumn("source_path_ids", F.array(F.col("item_id").cast("string")))
    back = sinks.as_json(lines).select(F.from_json("value", "assembly_type string, total_cost double, unpriced boolean").alias("r")).select("r.*")
    return back.groupBy("assembly_type").agg(F.count(F.lit(1)).alias("lines"), F.count_if("unpriced").alias("unpriced"), F.sum(F.col("total_cost").cast("decimal(18,2)")).cast("double").alias("total_cost"))


_E2E = f"""WITH RECURSIVE {cte("sheet_paths", "spans", "prices")}, {_LATEST}, {_STRICT_HITS}, scales AS ({_HIT}),
points AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM sheet_paths WHERE layer IN (SELECT layer FROM {_LAYERS})),
near AS (SELECT p.ord AS a, q.ord AS b FROM points p JOIN points q ON p.sheet = q.sheet AND p.layer = q.layer AND p.ord <> q.ord AND (p.cx - q.cx) * (p.cx - q.cx) + (p.cy - q.cy) * (p.cy - q.cy) <= 100),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
labelled AS (SELECT p.*, coalesce((SELECT CASE WHEN count(*) > 0 THEN least(min(b), p.ord) END FROM reach r WHERE r.a = p.ord), -1) AS label, count(*) OVER (PARTITION BY sheet, layer) AS n FROM points p),
records AS (SELECT sheet, layer, label, list(id ORDER BY ord) AS members, string_agg(id, ',' ORDER BY id) AS member_key, min(ord) * 2 AS line_order, false AS single FROM labelled WHERE n >= 2 GROUP BY sheet, layer, label
  UNION ALL SELECT sheet, layer, label, [id], id, ord * 2 + 1, true FROM labelled WHERE label < 0),
members AS (SELECT line_order, unnest(members) AS id FROM records WHERE NOT (label < 0 AND len(members) <= 1)),
corners AS (SELECT line_order, unnest([struct_pack(x := x0, y := y0), struct_pack(x := x1, y := y1)]) AS v FROM members JOIN points USING (id)),
drawn AS (SELECT line_order, list(v ORDER BY v.x, v.y) AS p FROM corners GROUP BY line_order),
lengths AS (SELECT line_order, list_reduce(list_transform(range(2, len(p) + 1), lambda k: sqrt((p[k].x - p[k-1].x) * (p[k].x - p[k-1].x) + (p[k].y - p[k-1].y) * (p[k].y - p[k-1].y))), lambda a, b: a + b) AS raw FROM drawn),
routed AS (SELECT r.*, m.assembly_type, CAST(printf('%.3f', raw * coalesce(try_cast(split_part(coalesce(s.scale, '1:100'), ':', 2) AS DOUBLE), 1.0)) AS DOUBLE) AS amount FROM records r JOIN lengths l ON l.line_order = r.line_order JOIN {_LAYERS} m ON m.layer = r.layer LEFT JOIN scales s ON s.sheet = r.sheet WHERE m.assembly_type IN ('cable_tray', 'conduit')
  QUALIFY row_number() OVER (PARTITION BY member_key ORDER BY r.line_order) = 1),
counted AS (SELECT r.*, m.assembly_type, 1.0::DOUBLE AS amount FROM records r JOIN {_LAYERS} m ON m.layer = r.layer QUALIFY row_number() OVER (PARTITION BY member_key ORDER BY single, line_order) = 1),
measured AS (SELECT 'route' AS origin, * FROM routed UNION ALL SELECT 'component', * FROM counted),
lines AS (SELECT t.*, b.position, b.material_name, b.bom_quantity * t.amount AS raw FROM measured t JOIN {_BOM} b ON b.assembly_type = t.assembly_type)
SELECT sheet, origin, line_order, position, assembly_type, lines.material_name, CAST(printf('%.3f', raw) AS DOUBLE) AS quantity, unit_price, CASE WHEN unit_price IS NULL THEN 0.0 ELSE {_COST.format(q="raw", p="unit_price")} END AS total_cost,
  unit_price IS NULL AS unpriced, 'MEASURED' AS confidence_status, array_to_string(members, ',') AS source_path_ids FROM lines LEFT JOIN latest ON latest.material_name = lines.material_name"""


@registered("e2e_boq", _E2E)
def e2e_boq(spark: SparkSession, d: str) -> DataFrame:
    """Two sheets of different scale."""
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    paths = view(spark, d, "sheet_paths").withColumn("points", F.array(at("x0", "y0"), at("x1", "y1")))
    return boq.run(spark, paths, view(spark, d, "spans"), view(spark, d, "prices"), 10.0)


# further queries register themselves
from mensura.plans import catalog_queries, drawing_queries, geometry_queries  # noqa: E402, F401
