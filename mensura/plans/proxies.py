"""Views that give the star-schema tables the shape of drawing and catalog records.

Each view is one SQL statement that Spark and DuckDB both read, so that a query and its check have the same input; `@1`
and `@2` stand for the first two elements of an array.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

from mensura.operators.spatial import spread

_LAYERS = ["LIGHTING", "SWITCHES", "SOCKET", "POWER", "DB", "AC", "CABLE_TRAY", "CONDUIT", "lighting", None, "WALLS", "E-lt-fix-nm-clg"]
_MATERIALS = "card_reader magnetic_lock push_button door_controller cable_tray_section tray_fitting support_hanger conduit_pipe conduit_fitting clamp panel_board disconnect_switch circuit_breakers busbars lighting_unit lampholder wiring power_outlet socket_outlet box".split()


def _choice(expr: str, values: list[str | None]) -> str:
    return "CASE " + expr + " " + " ".join(f"WHEN {k} THEN " + ("CAST(NULL AS STRING)" if v is None else f"'{v}'") for k, v in enumerate(values)) + " END"


VIEWS = {
    # counted items on layers, some unmapped, some without a layer
    "items": f"SELECT l_orderkey * 10 + l_linenumber AS item_id, {_choice(f'(l_suppkey % {len(_LAYERS)})', _LAYERS)} AS layer, l_quantity AS amount, l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey) AS pos FROM {{lineitem}}",
    "paths": f"SELECT vec_id AS ord, 'p' || CAST(vec_id AS STRING) AS id, {_choice('label', _LAYERS)} AS layer, CAST(embedding[@1] AS DOUBLE) * 1000 - 2.5 AS x0, CAST(embedding[@2] AS DOUBLE) * 1000 - 1.5 AS y0, CAST(embedding[@1] AS DOUBLE) * 1000 + 2.5 AS x1, CAST(embedding[@2] AS DOUBLE) * 1000 + 1.5 AS y1 FROM {{embeddings}}".replace("{{", "{").replace("}}", "}"),
    "spans": "SELECT p_brand AS sheet, p_partkey AS ord, CASE WHEN p_partkey % 13 = 5 THEN 'SCALE 1=' || CAST(p_size AS STRING) || REPEAT(CHR(39), 3) || '-0' || CHR(34) || 'x' WHEN p_partkey % 13 = 6 THEN 'at 1/4' || CHR(34) || '=1' || CHR(39) || '-0' || CHR(34) || 'x' ELSE CASE p_size % 6 WHEN 0 THEN 'ELECTRICAL.SCALE 1:' || CAST(p_size AS STRING) WHEN 1 THEN 'DRAWING.SCALE 1:' || CAST(p_size AS STRING) WHEN 2 THEN 'at 12:' || CAST(p_size AS STRING) || ' h' WHEN 3 THEN p_name WHEN 4 THEN 'ratio 2.5:' || CAST(p_size AS STRING) ELSE 'NO SCALE HERE' END END AS text FROM {part}",
    "prices": f"SELECT {_choice(f'(p_partkey % {len(_MATERIALS) + 3})', _MATERIALS)} AS material_name, CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS DOUBLE) AS unit_price, CASE WHEN p_size % 9 = 0 THEN CAST(NULL AS DATE) ELSE CAST('20' || CAST(10 + p_size % 13 AS STRING) || '-0' || CAST(1 + p_size % 9 AS STRING) || '-15' AS DATE) END AS effective_from, CASE WHEN p_partkey % 7 = 0 THEN 'EUR' ELSE 'USD' END AS currency, p_partkey AS seq FROM {{part}}".replace("{{", "{").replace("}}", "}"),
    "labor": "SELECT s_suppkey AS seq, 'rate ' || CAST(s_suppkey % 40 AS STRING) AS name, CAST(s_suppkey % 7 AS DOUBLE) AS productivity_rate, CAST(CAST(abs(s_acctbal) AS DECIMAL(10,2)) AS DOUBLE) AS hourly_rate, CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN CAST(NULL AS STRING) ELSE 'crew ' || CAST(s_nationkey AS STRING) END AS category FROM {supplier}",
    "vertices": "SELECT o.o_orderkey AS route_id, '1:' || CAST(50 * (1 + o.o_custkey % 4) AS STRING) AS scale, l.l_quantity AS x, CAST(l.l_linenumber AS DOUBLE) AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey) AS pos FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey",
    "measured": "SELECT event_id, CASE event_type WHEN 'view' THEN 'vector' WHEN 'click' THEN 'raster' WHEN 'purchase' THEN 'assembly_rule' WHEN 'signup' THEN 'formula' ELSE 'default' END AS source, CASE event_id % 4 WHEN 0 THEN '1.0.0' WHEN 1 THEN '2.1.0' WHEN 2 THEN '' ELSE CAST(NULL AS STRING) END AS rule_version, user_id, ts FROM {events}",
    "imported": "SELECT CAST(p_partkey + 1 AS BIGINT) AS row, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END AS material_name, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE 'ea' END AS unit, CASE WHEN p_partkey % 11 = 0 AND p_partkey % 2 = 0 THEN '' WHEN p_partkey % 17 = 0 THEN 'n/a' WHEN p_partkey % 19 = 0 THEN '' ELSE CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS STRING) END AS unit_price, '' AS rate_name, '' AS productivity_rate, '' AS hourly_rate FROM {part} UNION ALL SELECT CAST(1000000 + s_suppkey AS BIGINT), '', '', '', CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END, CASE WHEN s_suppkey % 7 = 0 THEN 'fast' ELSE CAST(s_suppkey AS STRING) END, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '45' END FROM {supplier}",
    # catalog files: one of materials, one of labor rates, with numbers and dates that are none
    "imported_materials": "SELECT CAST(p_partkey + 1 AS BIGINT) AS row, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'material ' || CAST(p_partkey % 50 AS STRING) END AS material_name, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE 'ea' END AS unit, CASE WHEN p_partkey % 17 = 0 THEN 'n/a' WHEN p_partkey % 19 = 0 THEN '' WHEN p_partkey % 23 = 0 THEN '12d' WHEN p_partkey % 29 = 0 THEN '1.5f' WHEN p_partkey % 31 = 0 THEN '1_000' WHEN p_partkey % 37 = 0 THEN 'nan' WHEN p_partkey % 41 = 0 THEN '+2.5e1' WHEN p_partkey % 43 = 0 THEN '.5' ELSE CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS STRING) END AS unit_price, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '2024-02-30' WHEN 2 THEN 'soon' ELSE '20' || CAST(10 + p_size % 13 AS STRING) || '-07-15' END AS effective_from, CASE WHEN p_size % 3 = 0 THEN '2031-01-31' ELSE '' END AS effective_to FROM {part}",
    "imported_labor": "SELECT CAST(1 + s_suppkey AS BIGINT) AS row, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'crew ' || CAST(s_suppkey % 20 AS STRING) END AS rate_name, CASE WHEN s_suppkey % 7 = 0 THEN 'fast' ELSE CAST(s_suppkey AS STRING) END AS productivity_rate, CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 8 = 0 THEN '4 5' ELSE '45' END AS hourly_rate, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'c' || CAST(s_nationkey AS STRING) END AS category, CASE WHEN s_suppkey % 4 = 1 THEN '2024-05-0' || CAST(1 + s_suppkey % 9 AS STRING) ELSE 'never' END AS effective_from FROM {supplier}",
    # prices of companies, regions and suppliers, open to all where null, with days of validity
    "scoped_prices": "SELECT 'part ' || CAST(p_partkey % 97 AS STRING) AS material_name, CASE WHEN p_partkey % 3 = 0 THEN 'company ' || CAST(p_partkey % 4 AS STRING) END AS company, CASE WHEN p_partkey % 5 < 2 THEN 'region ' || CAST(k.n_regionkey AS STRING) END AS region, CASE WHEN p_partkey % 7 = 1 THEN 'supplier ' || CAST(p_size % 6 AS STRING) END AS supplier, CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS DOUBLE) + k.n_nationkey AS unit_price, CASE WHEN p_size % 11 = 0 THEN CAST(NULL AS DATE) ELSE CAST('199' || CAST(1 + p_size % 8 AS STRING) || '-0' || CAST(1 + k.n_nationkey % 9 AS STRING) || '-10' AS DATE) END AS effective_from, CASE WHEN p_partkey % 4 = 3 THEN CAST(NULL AS DATE) ELSE CAST('199' || CAST(2 + p_partkey % 8 AS STRING) || '-0' || CAST(1 + p_size % 9 AS STRING) || '-10' AS DATE) END AS effective_to, p_partkey * 10 + k.n_nationkey AS seq FROM {part} JOIN {nation} k ON k.n_nationkey < 4",
    "scoped_requests": "SELECT l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey) AS ask_id, 'part ' || CAST(l_partkey % 101 AS STRING) AS material_name, 'company ' || CAST(l_suppkey % 4 AS STRING) AS company, 'region ' || CAST(l_orderkey % 5 AS STRING) AS region, CASE WHEN l_linenumber < 3 THEN 'supplier ' || CAST(l_suppkey % 6 AS STRING) END AS supplier, CAST(l_shipdate AS DATE) AS asked_on FROM {lineitem}",
    "requests": f"SELECT p_partkey AS request_id, {_choice('(p_partkey % 10)', ['access_control_door', 'cable_tray', 'conduit', 'distribution_board', 'lighting_outlet', 'power_outlet', 'socket_outlet', 'switch', 'fountain', None])} AS component_type, CASE p_size % 4 WHEN 0 THEN 'switch' WHEN 1 THEN 'no_such_rule' WHEN 2 THEN '' ELSE CAST(NULL AS STRING) END AS rule_name FROM {{part}}".replace("{{", "{").replace("}}", "}"),
    "stored_rules": f"SELECT coalesce({_choice('n_nationkey', ['access_control_door', 'cable_tray', 'conduit', 'switch'])}, 'own ' || n_name) AS name, CASE n_nationkey % 2 WHEN 0 THEN '1.0.0' ELSE '0.9.0' END AS rule_version, CAST(n_nationkey + 1 AS DOUBLE) AS old_quantity FROM {{nation}}".replace("{{", "{").replace("}}", "}"),
    "sheet_paths": f"SELECT vec_id AS ord, 'p' || CAST(vec_id AS STRING) AS id, CASE vec_id % 2 WHEN 0 THEN 'Brand#11' ELSE 'Brand#12' END AS sheet, {_choice('label', _LAYERS)} AS layer, CAST((vec_id * 7919) % 400 AS DOUBLE) * 2 AS x0, CAST((vec_id * 104729) % 300 AS DOUBLE) * 2 AS y0, CAST((vec_id * 7919) % 400 AS DOUBLE) * 2 + 1 AS x1, CAST((vec_id * 104729) % 300 AS DOUBLE) * 2 + 2 AS y1 FROM {{embeddings}}".replace("{{", "{").replace("}}", "}"),
    # rooms of 40 parts a sheet: four walls each, and a partition from corner to wall
    "wall_segments": "SELECT sheet, CASE k WHEN 1 THEN x + w WHEN 2 THEN x + w WHEN 4 THEN CASE WHEN odd = 1 THEN x + w ELSE x END ELSE x END AS x0, CASE k WHEN 2 THEN y + h WHEN 3 THEN y + h ELSE y END AS y0, CASE k WHEN 0 THEN x + w WHEN 1 THEN x + w WHEN 4 THEN CASE WHEN odd = 1 THEN x + w - least(w, h) ELSE x + least(w, h) END ELSE x END AS x1, CASE k WHEN 0 THEN y WHEN 3 THEN y WHEN 4 THEN y + least(w, h) ELSE y + h END AS y1 FROM (SELECT 'S' || CAST(CAST(floor(p_partkey / 40) AS BIGINT) AS STRING) AS sheet, CAST((p_partkey * 7919) % 61 AS DOUBLE) AS x, CAST((p_partkey * 104729) % 47 AS DOUBLE) AS y, CAST(2 + p_size % 17 AS DOUBLE) AS w, CAST(1 + p_size % 11 AS DOUBLE) AS h, p_partkey % 2 AS odd, k.n_nationkey AS k FROM {part} JOIN {nation} k ON k.n_nationkey < 5) r",
    # a name or an area in each of those rooms; some sheets' texts lie far outside of the walls
    "room_texts": "SELECT 'S' || CAST(CAST(floor(p_partkey / 40) AS BIGINT) AS STRING) AS sheet, p_partkey AS text_id, CAST((p_partkey * 7919) % 61 AS DOUBLE) + CAST(2 + p_size % 17 AS DOUBLE) / 2 + CASE WHEN p_partkey % 50 = 7 THEN 900 ELSE 0 END AS x, CAST((p_partkey * 104729) % 47 AS DOUBLE) + CAST(1 + p_size % 11 AS DOUBLE) / 2 + 0.25 AS y, CASE p_partkey % 3 WHEN 0 THEN CAST((2 + p_size % 17) * (1 + p_size % 11) AS STRING) || '.5 m2' WHEN 1 THEN CAST(2 + p_size % 9 AS STRING) || ',25 m2' ELSE p_name END AS text FROM {part}",
    # boxes that a detector might give, many of them of one thing
    "detections": "SELECT 'S' || CAST(CAST(floor(p_partkey / 100) AS BIGINT) AS STRING) AS sheet, p_partkey AS ord, CAST(p_partkey * 37 % 50 AS DOUBLE) / 64 AS score, CAST(p_partkey * 7919 % 12 AS DOUBLE) * 3 + CAST(p_size % 3 AS DOUBLE) AS x0, CAST(p_partkey * 31 % 5 AS DOUBLE) * 4 + CAST(p_size % 2 AS DOUBLE) AS y0, CAST(p_partkey * 7919 % 12 AS DOUBLE) * 3 + CAST(p_size % 3 AS DOUBLE) + 6 + CAST(p_size % 5 AS DOUBLE) AS x1, CAST(p_partkey * 31 % 5 AS DOUBLE) * 4 + CAST(p_size % 2 AS DOUBLE) + 7 + CAST(p_size % 4 AS DOUBLE) AS y1 FROM {part}",
    # schedule entries in three runs on two lines each, the runs of an entry next to each other
    "schedule_runs": "SELECT 'S' || CAST(CAST(floor(p_partkey / 60) AS BIGINT) AS STRING) AS sheet, p_partkey * 3 + CASE k.n_nationkey WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS ord, p_partkey AS entry, p_size * 10 AS load, CASE p_size % 2 WHEN 0 THEN 'A' ELSE 'B' END AS letter, 10 + p_size AS number, CASE k.n_nationkey WHEN 0 THEN 'Load' WHEN 1 THEN ' (kg): ' || CAST(p_size * 10 AS STRING) ELSE 'slots PK-' || CASE p_size % 2 WHEN 0 THEN 'A' ELSE 'B' END || CAST(11 + p_size AS STRING) || ', PK-' || CASE p_size % 2 WHEN 0 THEN 'A' ELSE 'B' END || CAST(12 + p_size AS STRING) END AS text, CAST(p_partkey % 60 AS DOUBLE) * 200 + CASE k.n_nationkey WHEN 1 THEN 23 ELSE 0 END AS x0, CASE k.n_nationkey WHEN 0 THEN 100 WHEN 1 THEN 101 ELSE 112 END AS y0, CAST(p_partkey % 60 AS DOUBLE) * 200 + CASE k.n_nationkey WHEN 0 THEN 20 WHEN 1 THEN 60 ELSE 80 END AS x1, CASE k.n_nationkey WHEN 0 THEN 110 WHEN 1 THEN 111 ELSE 122 END AS y1 FROM {part} JOIN {nation} k ON k.n_nationkey < 3",
    # decisions of reviewers, and a log of corrections with some told twice
    "decisions": "SELECT 'sheet ' || CAST(user_id % 40 AS STRING) AS sheet, CASE event_type WHEN 'view' THEN 'MEASURED' WHEN 'click' THEN 'MEASURED' WHEN 'purchase' THEN 'DERIVED' ELSE 'ASSUMED' END AS tier, user_id AS reviewer, ts FROM {events}",
    "corrections": "SELECT event_id AS correction_id, event_id % 500 AS item_id, CASE event_type WHEN 'purchase' THEN 'reject' WHEN 'signup' THEN 'accept' ELSE 'set' END AS kind, CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(NULL AS DOUBLE) ELSE value END AS quantity, ts FROM {events} UNION ALL SELECT event_id, event_id % 500, 'set', value, ts FROM {events} WHERE event_id % 7 = 0 AND event_type NOT IN ('purchase', 'signup')",
    "sheet_layers": "SELECT p_brand AS sheet, CASE WHEN p_partkey % 9 = 4 AND p_brand < 'Brand#3' THEN 'default' ELSE p_type END AS name, CASE WHEN p_size % 2 = 0 THEN 'ON' ELSE 'OFF' END AS status, CAST(p_size AS BIGINT) AS count, p_partkey AS ordinal FROM {part}",
    "drawn_routes": "SELECT o_orderkey AS route_id, CASE o_orderkey % 9 WHEN 0 THEN 'CONDUIT' WHEN 1 THEN 'Conduit' WHEN 2 THEN 'Cable Tray' WHEN 3 THEN 'NORMAL TRAY' WHEN 4 THEN 'PIPE' WHEN 5 THEN 'LIGHTING' WHEN 6 THEN CAST(NULL AS STRING) WHEN 7 THEN 'cable_tray' ELSE 'CONDUIT RUN' END AS layer FROM {orders}",
    "page_objects": "SELECT l_orderkey AS upload_id, 1 + l_linenumber % 2 AS page_number, CASE WHEN l_returnflag = 'R' THEN 'image' ELSE 'vector' END AS kind, l_linestatus = 'O' AS is_text FROM {lineitem}",
    "page_sizes": "SELECT p_brand AS page, CAST(400 + 60 * (count(*) % 13) AS DOUBLE) AS height FROM {part} GROUP BY p_brand",
    "overlays": "SELECT 'p' || CAST(p_partkey % 400 AS STRING) AS id, p_partkey AS ord, CAST(p_size AS DOUBLE) AS x, CASE WHEN p_size % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(p_size * 2 AS DOUBLE) END AS y, CAST(10 AS DOUBLE) AS width, CAST(p_size % 3 AS DOUBLE) AS height FROM {part}",
    "schedules": "SELECT p_partkey AS ord, CASE p_partkey % 5 WHEN 0 THEN 'Load (kg): ' || CAST(p_size * 10 AS STRING) WHEN 1 THEN 'ramp %' || CAST(p_size % 9 AS STRING) || '.5 - ' || CAST(p_size AS STRING) || 'cm' WHEN 2 THEN 'slot PK-' || CASE p_size % 2 WHEN 0 THEN 'A' ELSE 'B' END || CAST(10 + p_size % 80 AS STRING) WHEN 3 THEN p_name ELSE CAST(NULL AS STRING) END AS text FROM {part}",
    "ocr": "SELECT p_partkey AS ord, p_brand AS page, CASE p_partkey % 6 WHEN 0 THEN replace(p_name, ' ', '_') || ': ' || p_type WHEN 1 THEN p_type || ' (' || replace(p_name, ' ', '_') || ')' WHEN 2 THEN replace(p_name, ' ', '_') WHEN 3 THEN 'Scale 1:' || CAST(p_size AS STRING) WHEN 4 THEN 'Legend of ' || p_name ELSE p_name END AS text, CAST(p_size * 20 AS DOUBLE) AS y0, CAST(p_partkey % 101 AS DOUBLE) AS confidence FROM {part}",
    "uploads": "SELECT o.o_orderkey AS upload_id, count(*) * 4000 AS drawings, CAST(sum(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS images, count(*) * 40 AS few, max(CASE WHEN l.l_linestatus = 'O' THEN 1 ELSE 0 END) AS has_text, max(o.o_custkey % 3) AS kind FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey",
    "layer_groups": "SELECT p_type AS name, CASE WHEN p_size % 2 = 0 THEN 'ON' ELSE 'OFF' END AS status, CAST(p_size AS BIGINT) AS count, p_partkey AS ordinal FROM {part}",
}

# tables that a view's windows and joins meet by a key, and what is grouped after them; none of them is small enough to broadcast
SPREAD = {"items": {"lineitem": "l_orderkey"}, "vertices": {"lineitem": "l_orderkey", "orders": "o_orderkey"}}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name].replace("@1", "0").replace("@2", "1")
    tables = {t: spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")) for t in set(re.findall(r"\{(\w+)\}", text))}
    met = SPREAD.get(name, {})
    rows = sum(tables[t].count() for t in met)  # from the footers of the files
    tables |= {t: spread(tables[t], key, rows=rows).hint("merge") for t, key in met.items()}
    return spark.sql(text, **tables)


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over its tables as streams (for views that need no state).  A stream takes a folder or a pattern, not a file."""
    text = VIEWS[name].replace("@1", "0").replace("@2", "1")
    paths = {t: os.path.join(sf_dir, f"{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **{t: spark.readStream.schema(spark.read.parquet(p).schema).parquet(f"{p}*") for t, p in paths.items()})


def cte(*names: str) -> str:
    """The views as common table expressions for DuckDB."""
    plain = lambda n: re.sub(r"\{(\w+)\}", r"\1", VIEWS[n]).replace("@1", "1").replace("@2", "2")
    return ", ".join(f"{n} AS ({plain(n)})" for n in names)
