"""Assembly rules and the layer map, as constants and as YAML files, and as small DataFrames."""

from __future__ import annotations

import os
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

# The bill of materials of each assembly, its installation hours, hourly rate and waste factor.
ASSEMBLIES: dict[str, tuple[dict[str, float], float, float | None, float]] = {
    "access_control_door": ({"card_reader": 1.0, "magnetic_lock": 1.0, "push_button": 1.0, "door_controller": 0.5}, 2.5, None, 0.10),
    "cable_tray": ({"cable_tray_section": 1.0, "tray_fitting": 0.2, "support_hanger": 0.1}, 1.5, 45.0, 0.10),
    "conduit": ({"conduit_pipe": 1.0, "conduit_fitting": 0.05, "clamp": 0.1}, 2.0, 45.0, 0.10),
    "distribution_board": ({"panel_board": 1.0, "disconnect_switch": 1.0, "circuit_breakers": 12.0, "busbars": 1.0, "terminal_blocks": 24.0}, 8.0, 45.0, 0.15),
    "lighting_outlet": ({"lighting_unit": 1.0, "lampholder": 1.0, "wiring": 0.4}, 0.3, 45.0, 0.10),
    "power_outlet": ({"power_outlet": 1.0}, 0.3, 45.0, 0.10),
    "socket_outlet": ({"socket_outlet": 1.0, "box": 1.0, "cover_plate": 1.0, "wiring": 0.3}, 0.2, 45.0, 0.10),
    "switch": ({"switch": 1.0}, 0.5, 45.0, 0.10),
}
RULE_VERSION = "1.0.0"
# The layers of each assembly, in order; the first entry that names a layer counts.
LAYERS: dict[str, list[str]] = {
    "lighting_outlet": ["E-lt-fix-nm-clg", "LIGHTING", "LIGHTING FIXTURES", "LIGHT"],
    "switch": ["SWITCHES", "SWITCH"],
    "socket_outlet": ["SOCKET", "SOCKET_OUTLET", "SOCKETS"],
    "power_outlet": ["POWER", "POWER_OUTLET"],
    "distribution_board": ["DISTRIBUTION_BOARD", "DB"],
    "access_control_door": ["access control", "ACCESS_CONTROL", "AC", "SECURITY", "CARD_READER"],
    "cable_tray": ["NORMAL TRAY", "CABLE_TRAY", "CABLE TRAY"],
    "conduit": ["CONDUIT", "CONDUIT_RUN"],
}
ROUTE_ASSEMBLIES = ("cable_tray", "conduit")
# Older names of access-control layers, which are clustered too.
OLDER_LAYERS = ["AC", "ACCESS_CONTROL", "SECURITY", "CARD_READER"]

BOM_SCHEMA = "assembly_type string, position int, material_name string, bom_quantity double"
RULE_SCHEMA = "assembly_type string, rule_version string, installation_hours double, hourly_rate double, waste_factor double"
LAYER_SCHEMA = "layer string, assembly_type string"


def bom_rows() -> list[tuple[str, int, str, float]]:
    return [(a, k, m, q) for a, (bom, *_) in ASSEMBLIES.items() for k, (m, q) in enumerate(bom.items())]


def rule_rows() -> list[tuple]:
    return [(a, RULE_VERSION, hours, rate, waste) for a, (_, hours, rate, waste) in ASSEMBLIES.items()]


def layer_rows() -> list[tuple[str, str]]:
    return [(n, a) for _, n, a in _first_entries(list(LAYERS.items())) if a]


def bom(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(bom_rows(), BOM_SCHEMA)


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rule_rows(), RULE_SCHEMA)


def layers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(layer_rows(), LAYER_SCHEMA)


def _documents(spark: SparkSession, path: str) -> list[tuple[str, dict]]:
    """(file name, content) of the YAML files at a path, by name, through Spark's reader, so that any store will do.  Rule
    files are edited by hand and few, so the driver parses them."""
    import yaml

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{yaml,yml}").load(path).select("path", "content").collect()
    name = lambda path: os.path.splitext(os.path.basename(unquote(path)))[0]
    return sorted(((name(r["path"]), yaml.safe_load(bytes(r["content"]).decode()) or {}) for r in files), key=lambda x: x[0])


def read_yaml_rules(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rules, bom) of a folder with one YAML file per assembly, with defaults for what a file leaves out; a file without a
    byte is no rule."""
    heads, lines = [], []
    number = lambda x: None if x is None else float(x)
    for key, rule in _documents(spark, folder):
        name, labor = rule.get("name", key), rule.get("labor") or {}
        heads.append((name, str(rule.get("rule_version", "unknown")), number(labor.get("installation_hours", 0.0)), number(labor.get("hourly_rate")), float(rule.get("waste_factor", 0.10))))
        lines += [(name, k, m, float(q)) for k, (m, q) in enumerate((rule.get("bom") or {}).items())]
    return spark.createDataFrame(heads, RULE_SCHEMA), spark.createDataFrame(lines, BOM_SCHEMA)


def read_yaml_layers(spark: SparkSession, path: str) -> DataFrame:
    """position, layer, assembly_type of a layer map (a list `layer_mapping` of assembly and layers): a layer's first entry
    counts; an empty file has none."""
    entries = [e for _, content in _documents(spark, path) for e in content.get("layer_mapping") or []]
    return spark.createDataFrame(_first_entries([(e.get("assembly"), e.get("layers") or []) for e in entries]), f"position int, {LAYER_SCHEMA}")


def _first_entries(entries: list[tuple[str | None, list[str]]]) -> list[tuple[int, str, str | None]]:
    """position, layer, assembly of entries in order; later entries of a layer are left out."""
    first: dict[str, str | None] = {}
    for assembly, names in entries:
        for n in names:
            first.setdefault(n, assembly)
    return [(k, n, a) for k, (n, a) in enumerate(first.items())]


def clustered_layers() -> list[str]:
    """The layers that are clustered, in order: those of the map, then older names of access control, each once."""
    return [n for _, n, _ in _first_entries([*LAYERS.items(), (None, OLDER_LAYERS)])]


def values_sql(rows: list[tuple], names: list[str]) -> str:
    """The rows as a SQL subquery."""
    lit = lambda x: "NULL" if x is None else f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS t({', '.join(names)}))"
