"""The relational model of projects, geometry, estimates and catalog: schemas, keys, and checks of the keys.

Spark enforces no constraints, so keys are checked by queries: `violations` counts rows that break a primary, unique or
foreign key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TIER = "confidence_status string, confidence_score double"
TABLES: dict[str, str] = {
    "projects": "id string, name string, owner string, consultant string, currency string",
    "drawings": "id string, project_id string, discipline string, sheet_number string",
    "drawing_revisions": "id string, drawing_id string, revision string, issued_date date, source_path_type string",
    "sheets": "id string, drawing_id string, name string, page_number int, scale string",
    "components": f"id string, sheet_id string, component_type string, source_layer string, x double, y double, {_TIER}",
    "routes": f"id string, sheet_id string, route_type string, length_m double, {_TIER}",
    "spaces": f"id string, sheet_id string, name string, area_m2 double, {_TIER}",
    "measurements": "id string, component_id string, route_id string, space_id string, source_sheet string, source_region string, measurement_type string, raw_value double, final_value double, confidence_status string, calculation_method string, rule_version string",
    "boq_items": "id string, measurement_id string, estimate_id string, quantity double, unit_cost double, total_cost double",
    "estimates": "id string, project_id string, total_material_cost double, total_labor_cost double, total_cost double",
    "assemblies": "id string, name string, rule_version string, formula_or_bom map<string,double>",
    "materials": "id string, name string, unit string, category string",
    "prices": "id string, material_id string, unit_price decimal(12,2), currency string, effective_from date, effective_to date",
    "labor_rates": "id string, name string, productivity_rate double, hourly_rate double, category string, effective_from date, effective_to date",
    "assembly_materials": "assembly_id string, material_id string, quantity double",
}
UNIQUE = {**{t: ["id"] for t in TABLES if t != "assembly_materials"}, "assembly_materials": ["assembly_id", "material_id"]}
ALSO_UNIQUE = [("assemblies", ["name"]), ("labor_rates", ["name"])]
FOREIGN = [
    ("drawings", "project_id", "projects"), ("drawing_revisions", "drawing_id", "drawings"), ("sheets", "drawing_id", "drawings"),
    ("components", "sheet_id", "sheets"), ("routes", "sheet_id", "sheets"), ("spaces", "sheet_id", "sheets"),
    ("measurements", "component_id", "components"), ("measurements", "route_id", "routes"), ("measurements", "space_id", "spaces"),
    ("boq_items", "measurement_id", "measurements"), ("boq_items", "estimate_id", "estimates"), ("estimates", "project_id", "projects"),
    ("prices", "material_id", "materials"), ("assembly_materials", "assembly_id", "assemblies"), ("assembly_materials", "material_id", "materials"),
]


def create(spark: SparkSession, database: str) -> None:
    """Empty tables of the model in a database; those that exist are left alone."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def drop(spark: SparkSession, database: str) -> None:
    for name in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")


def repeated(df: DataFrame, columns: list[str], rule: str) -> DataFrame:
    """rule, rows: how many rows share a key with an earlier one."""
    extra = df.groupBy(*columns).agg((F.count(F.lit(1)) - 1).alias("extra"))
    return extra.agg(F.lit(rule).alias("rule"), F.coalesce(F.sum("extra"), F.lit(0)).alias("rows"))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str, rule: str) -> DataFrame:
    """rule, rows: how many rows name a parent that is not there."""
    lost = child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("__key")), F.col(column) == F.col("__key"), "left_anti")
    return lost.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("rows"))


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """rule, rows for every key of the model among the given tables."""
    checks = [repeated(tables[t], c, f"{t}: {', '.join(c)} unique") for t, c in [*UNIQUE.items(), *ALSO_UNIQUE] if t in tables]
    checks += [orphans(tables[c], k, tables[p], "id", f"{c}.{k} in {p}") for c, k, p in FOREIGN if c in tables and p in tables]
    return reduce(DataFrame.unionByName, checks)
