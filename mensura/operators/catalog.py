"""Catalog import, upserts, listings and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mensura.functions import numbers, texts
from mensura.operators import scopes

# Notes and messages of reports, and what stands in where a rule or a currency is not given.
UNPRICED_NOTE = "Material price not found in catalog — flag for review"
UNKNOWN_KIND = "could not determine row type — expected material_name or rate_name column"
DEFAULT_WASTE, UNKNOWN_VERSION, CURRENCY = 0.10, "unknown", "USD"
# Columns that tell a file's kind, those that a row needs, and those that are numbers.
LABOR_COLUMNS, MATERIAL_COLUMNS = ("rate_name", "productivity_rate"), ("material_name", "unit_price")
NEEDED = {"material": ["material_name", "unit", "unit_price"], "labor": ["rate_name", "productivity_rate", "hourly_rate"]}
NUMBERS = {"material": ["unit_price"], "labor": ["productivity_rate", "hourly_rate"]}
_NUMBER = r"^\s*[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"
_ENDLESS = r"^(?i)\s*[+-]?(inf|infinity|nan)\s*$"


def latest_price(prices: DataFrame, *scope: str) -> DataFrame:
    """material_name, the columns of the scope (a price set: region, supplier, currency), unit_price: by effective_from, undated
    rows last, ties to the later row (seq)."""
    newest = F.max_by("unit_price", F.struct(F.col("effective_from").isNotNull(), "effective_from", "seq"))
    return prices.groupBy("material_name", *scope).agg(newest.alias("unit_price"))


def priced(lines: DataFrame, latest: DataFrame) -> DataFrame:
    """BOQ lines (material_name, raw_quantity) with unit price, cost and the unpriced flag; no line is lost."""
    joined = lines.join(latest, "material_name", "left")
    missing = F.col("unit_price").isNull()
    cost = F.when(missing, 0.0).otherwise(numbers.material_cost(F.col("raw_quantity"), F.col("unit_price")))
    return joined.withColumn("quantity", numbers.correctly_rounded(F.col("raw_quantity"), 3)).withColumn("total_cost", cost).withColumn("unpriced", missing).withColumn("note", F.when(missing, UNPRICED_NOTE))


def expanded(items: DataFrame, bom: DataFrame) -> DataFrame:
    """One line per item (assembly_type, amount) and material of its assembly."""
    return items.join(F.broadcast(bom), "assembly_type").withColumn("raw_quantity", F.col("bom_quantity") * F.col("amount"))


def assembly_outcomes(requests: DataFrame, rules: DataFrame, bom: DataFrame) -> DataFrame:
    """The requests (component_type, rule_name) with what their rule gives: materials (name, quantity, unit, in the rule's
    order), labor_hours, waste_factor, rule_version; a rule that is not there gives no materials and an error.  The
    rule is named by rule_name or, where that is empty, by component_type.  Rule folders are edited by hand and small."""
    line = F.struct("position", "material_name", F.col("bom_quantity").alias("quantity"), texts.unit_of(F.col("material_name")).alias("unit"))
    plain = lambda x: F.struct(x["material_name"].alias("material_name"), x["quantity"].alias("quantity"), x["unit"].alias("unit"))
    materials = bom.groupBy("assembly_type").agg(F.transform(F.array_sort(F.collect_list(line)), plain).alias("materials"))
    known = rules.join(materials, "assembly_type", "left").select(F.col("assembly_type").alias("__rule"), "materials", "installation_hours", F.col("waste_factor").alias("__waste"), F.col("rule_version").alias("__version"))
    given = F.coalesce("rule_name", F.lit(""))
    asked = requests.withColumn("__asked", F.when(given != "", given).otherwise(F.col("component_type")))
    found, missed = asked.join(F.broadcast(known), F.col("__asked") == F.col("__rule"), "left"), F.col("__rule").isNull()
    none = F.array().cast("array<struct<material_name:string,quantity:double,unit:string>>")
    return found.select(
        *[requests[c] for c in requests.columns], F.coalesce("materials", none).alias("materials"), F.coalesce("installation_hours", F.lit(0.0)).alias("labor_hours"),
        F.coalesce("__waste", F.lit(DEFAULT_WASTE)).alias("waste_factor"), F.when(missed, UNKNOWN_VERSION).otherwise(F.col("__version")).alias("rule_version"),
        F.when(missed, F.concat(F.lit("Assembly rule '"), given, F.lit("' not found"))).alias("error"),
    )


def _number(text: Column) -> Column:
    """The double that a text spells: digits (with single underscores between them), point, exponent, sign; else null."""
    return F.when(text.rlike(_NUMBER), F.replace(F.trim(text), F.lit("_"), F.lit("")).try_cast("double"))


def error_text(message: Column) -> Column:
    """What a row's report says about an error that no rule foresees: 100 characters of it."""
    return F.concat(F.lit(" unexpected error: "), F.substring(message, 1, 100))


def validated(rows: DataFrame, by: str = "header") -> DataFrame:
    """Catalog rows with `kind`, `reason` (null: the row is good) and `parsed` (numbers, and dates, null where they are not of
    the form yyyy-mm-dd).  by='header': a file's columns tell its kind, labor before material, whatever the cells hold;
    by='file': so does the `header` (names in lower case) that each row carries from its own file; by='cells': each row's own
    non-blank cells do.  Columns that are absent count as blank."""
    lower = {c.lower() for c in rows.columns}
    value = lambda n: F.col(f"`{n}`").cast("string") if n in rows.columns else F.lit(None).cast("string")
    blank = lambda n: F.coalesce(value(n), F.lit("")) == ""
    if by == "header":
        kind = F.lit("labor" if lower & set(LABOR_COLUMNS) else "material" if lower & set(MATERIAL_COLUMNS) else None).cast("string")
    elif by == "file":
        has = lambda names: F.arrays_overlap("header", F.array(*map(F.lit, names)))
        kind = F.when(has(LABOR_COLUMNS), "labor").when(has(MATERIAL_COLUMNS), "material")
    else:
        some = lambda names: ~(blank(names[0]) & blank(names[1]))
        kind = F.when(some(LABOR_COLUMNS), "labor").when(some(MATERIAL_COLUMNS), "material")
    reason = F.when(F.col("kind").isNull(), UNKNOWN_KIND)
    for name, needed in NEEDED.items():
        for c in needed:
            reason = reason.when((F.col("kind") == name) & blank(c), f"missing {c}")
        for c in NUMBERS[name]:
            endless = value(c).rlike(_ENDLESS)
            reason = reason.when((F.col("kind") == name) & endless, error_text(F.concat(F.lit(f"{c} out of range: "), value(c))))
            reason = reason.when((F.col("kind") == name) & _number(value(c)).isNull(), F.concat(F.lit(f"invalid {c} format: '"), value(c), F.lit("'")))
    day = lambda n: F.when(value(n).rlike(r"^\d{4}-\d{2}-\d{2}$"), value(n).try_cast("date")).alias(n)
    parsed = F.struct(*[_number(value(c)).alias(c) for c in NUMBERS["material"] + NUMBERS["labor"]], day("effective_from"), day("effective_to"), value("category").alias("category"))
    return rows.withColumn("kind", kind).withColumn("reason", reason).withColumn("parsed", parsed)


def import_report(checked: DataFrame) -> DataFrame:
    """successful, failed."""
    return checked.agg(F.count_if(F.col("reason").isNull()).alias("successful"), F.count_if(F.col("reason").isNotNull()).alias("failed"))


def accepted_prices(checked: DataFrame, *more: str) -> DataFrame:
    """Good material rows of validated() as prices; row numbers give their order.  more: further columns that stay."""
    good = checked.filter("reason IS NULL AND kind = 'material'")
    return good.select("material_name", F.lit(CURRENCY).alias("currency"), "parsed.unit_price", "parsed.effective_from", "parsed.effective_to", F.col("row").cast("long").alias("seq"), *more)


def accepted_labor(checked: DataFrame, *more: str) -> DataFrame:
    """Good labor rows of validated() as rates."""
    good = checked.filter("reason IS NULL AND kind = 'labor'")
    return good.select(F.col("rate_name").alias("name"), "parsed.productivity_rate", "parsed.hourly_rate", "parsed.category", "parsed.effective_from", "parsed.effective_to", F.col("row").cast("long").alias("seq"), *more)


def upsert_prices(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per (material_name, currency): the incoming row of the largest seq, else the existing one."""
    both = existing.withColumn("new", F.lit(0)).unionByName(incoming.withColumn("new", F.lit(1)), allowMissingColumns=True)
    kept = [c for c in ("unit_price", "effective_from", "effective_to") if c in both.columns]
    last = F.max_by(F.struct(*kept), F.struct("new", "seq")).alias("r")
    return both.groupBy("material_name", "currency").agg(last).select("material_name", "currency", "r.*")


def upsert_labor(rows: DataFrame) -> DataFrame:
    """One row per name over rows in seq order: rates are always overwritten, the category and the dates only by ones that
    are given."""
    given = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col("seq"))
    optional = [F.max_by(c, given(c)).alias(c) for c in ("category", "effective_from", "effective_to") if c in rows.columns]
    return rows.groupBy("name").agg(F.max_by("productivity_rate", "seq").alias("productivity_rate"), F.max_by("hourly_rate", "seq").alias("hourly_rate"), *optional)


def listing(materials: DataFrame, prices: DataFrame) -> DataFrame:
    """id, name, unit, category, latest_unit_price of all materials (name, unit, category), by name."""
    latest = latest_price(prices).withColumnRenamed("material_name", "name")
    listed = materials.join(latest, "name", "left").withColumn("id", F.sha2(F.concat(F.lit("material|"), "name"), 256))
    return listed.select("id", "name", "unit", "category", F.col("unit_price").alias("latest_unit_price")).orderBy("name")


def labor_listing(rates: DataFrame) -> DataFrame:
    """id, name, productivity_rate, hourly_rate (null where they are 0), category, effective_from (ISO text) of all rates, by name."""
    none = lambda c: F.nullif(F.col(c), F.lit(0.0)).alias(c)
    key = F.sha2(F.concat(F.lit("labor|"), "name"), 256).alias("id")
    return rates.select(key, "name", none("productivity_rate"), none("hourly_rate"), "category", F.col("effective_from").cast("string").alias("effective_from")).orderBy("name")


def persisted_rules(existing: DataFrame, rules: DataFrame, bom: DataFrame) -> DataFrame:
    """Assemblies (name, rule_version, formula_or_bom) after rules have been stored: new ones are added, and where the
    version differs version and bill of materials are replaced; all others stay as they are."""
    lines = bom.groupBy(F.col("assembly_type").alias("name")).agg(F.map_from_entries(F.collect_list(F.struct("material_name", "bom_quantity"))).alias("new_bom"))
    fresh = rules.select(F.col("assembly_type").alias("name"), F.col("rule_version").alias("new_version")).join(lines, "name", "left")
    replaced = F.col("new_version").isNotNull() & ~F.col("new_version").eqNullSafe(F.col("rule_version"))
    pick = lambda new, old: F.when(replaced, F.col(new)).otherwise(F.col(old)).alias(old)
    return existing.join(fresh, "name", "full").select("name", pick("new_version", "rule_version"), pick("new_bom", "formula_or_bom"))


def assembly_materials(assemblies: DataFrame, links: DataFrame, materials: DataFrame) -> DataFrame:
    """assembly, material, unit, quantity of every link (assembly_id, material_id, quantity)."""
    a = assemblies.select(F.col("id").alias("assembly_id"), F.col("name").alias("assembly"))
    m = materials.select(F.col("id").alias("material_id"), F.col("name").alias("material"), "unit")
    return links.join(a, "assembly_id").join(m, "material_id").select("assembly", "material", "unit", "quantity")


def rule_links(rules: DataFrame, bom: DataFrame, existing: DataFrame) -> DataFrame:
    """Links (assembly_type, material_name, quantity, unit) to insert for rules: their materials and, where there is an
    hourly rate, Labor in hours; links that exist are left as they are."""
    material = bom.select("assembly_type", "material_name", F.col("bom_quantity").alias("quantity"), texts.unit_of(F.col("material_name")).alias("unit"))
    labor = rules.filter("hourly_rate IS NOT NULL").select("assembly_type", F.lit("Labor").alias("material_name"), F.col("installation_hours").alias("quantity"), F.lit("hr").alias("unit"))
    return material.unionByName(labor).join(existing, ["assembly_type", "material_name"], "left_anti")


def price_as_of(prices: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (ask_id, material_name, on) with the newest price that is in force on that day; undated prices come before all
    dated ones, and those of later seq count among prices of one day; of repeated ask ids the newest price counts.  A price
    holds until the day of the material's next one, so a request meets one interval (scopes.in_scope)."""
    daily = prices.groupBy("material_name", "effective_from").agg(F.max("seq").alias("seq"), F.max_by("unit_price", "seq").alias("unit_price"))
    until = F.lead("effective_from").over(W.partitionBy("material_name").orderBy(F.col("effective_from").asc_nulls_first()))
    none = {c: F.lit(None).cast("string") for c in scopes.SCOPE}
    told = scopes.in_scope(daily.withColumn("effective_to", until).withColumns(none), asked.select("ask_id", "material_name", "on").withColumns(none))
    since = daily.select("material_name", F.col("seq").alias("price_seq"), "effective_from")
    dated = told.filter("price_seq IS NOT NULL").join(since, ["material_name", "price_seq"])
    newest = F.max_by(F.struct("material_name", "unit_price"), F.struct(F.col("effective_from").isNotNull(), "effective_from", "price_seq")).alias("r")
    return dated.groupBy("ask_id").agg(newest).select("ask_id", "r.material_name", "r.unit_price")
