"""Boxes, clusters, nearest spaces, detections, schedules and review against plain versions."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from mensura.operators import reviewing, schedules, spaces, spatial

BOXES = "layer string, ord long, x0 double, y0 double, x1 double, y1 double"


def some_boxes(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        x, y, size = rng.randint(0, 60), rng.randint(0, 60), rng.choice([0, 0, 1, 2, 5, 30])
        out.append((rng.choice("ab"), k, float(x), float(y), float(x + rng.randint(0, size)), float(y + rng.randint(0, size))))
    return out


def apart(p, q):
    dx, dy = max(p[2] - q[4], q[2] - p[4], 0), max(p[3] - q[5], q[3] - p[5], 0)
    return dx * dx + dy * dy


@pytest.mark.parametrize("reach", [0.0, 1.0, 2.5])
def test_near_boxes(spark, reach):
    rows = some_boxes(160, 3) + [("a", 500, -5000.0, -5000.0, 5000.0, 5000.0), ("b", 501, 3.0, 3.0, 3.0, 3.0), ("b", 502, 3.0, 3.0, 3.0, 3.0)]
    got = list(map(tuple, spatial.near_boxes(spark.createDataFrame(rows, BOXES), reach).collect()))
    want = {(p[0], p[1], q[1]) for p in rows for q in rows if p[1] != q[1] and p[0] == q[0] and apart(p, q) <= reach * reach}
    assert set(got) == want and len(got) == len(want)


def test_frames_and_touching_boxes_stay_small(spark):
    """A sheet's frame is a few rows, and boxes that must touch exactly are no special case."""
    rows = [("a", 0, 0.0, 0.0, 10_000.0, 10_000.0), ("a", 1, 0.0, 0.0, 1.0, 1.0), ("a", 2, 1.0, 0.0, 2.0, 1.0), ("a", 3, 20_000.0, 0.0, 20_001.0, 1.0)]
    boxes = spark.createDataFrame(rows, BOXES)
    assert {(r.a, r.b) for r in spatial.near_boxes(boxes, 0.0).collect()} == {(0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1)}
    assert [r.label for r in spatial.box_clusters(boxes, 6.0).orderBy("ord").collect()] == [0, 0, 0, 3]


def plain_dbscan(points, eps, min_pts):
    near = {p[1]: [q[1] for q in points if q[0] == p[0] and (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 <= eps * eps] for p in points}
    core = {k for k, v in near.items() if len(v) >= min_pts}
    label = {}
    for k in sorted(core):
        if k not in label:
            todo = [k]
            while todo:
                x = todo.pop()
                if label.setdefault(x, k) == k:
                    todo += [y for y in near[x] if y in core and y not in label]
    for k in near:
        if k not in core:
            label[k] = min((label[y] for y in near[k] if y in core), default=-1)
    return label


@pytest.mark.parametrize("min_pts", [2, 3, 5])
def test_dbscan_equals_plain(spark, min_pts):
    rng = random.Random(min_pts)
    points = [(rng.choice("ab"), k, rng.gauss(rng.choice([0, 40, 90]), 9), rng.gauss(0, 9)) for k in range(260)] + [("a", 1000 + k, 200.0, 200.0) for k in range(30)] + [("a", 1100, 203.0, 200.0)]
    got = spatial.dbscan(spark.createDataFrame(points, "layer string, ord long, cx double, cy double"), 4.0, min_pts)
    assert {r.ord: r.label for r in got.collect()} == plain_dbscan(points, 4.0, min_pts)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(100, 400)]
    star = [(1000, k) for k in range(1001, 1400)]
    edges = spark.createDataFrame([*chain, *((b, a) for a, b in star), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in spatial.components(edges).collect()}
    assert got == {**{k: 100 for k in range(100, 401)}, **{k: 1000 for k in range(1000, 1400)}, 7: 7}


def test_keep_first_keeps_all_columns(spark):
    df = spark.createDataFrame([(1, 2, "x", 5), (1, 1, "y", 6), (2, 9, "z", 7)], "__key long, __n long, n string, row long")
    got = spatial.keep_first(df, F.col("__key"), [F.col("__n")])
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [(1, 1, "y", 6), (2, 9, "z", 7)]


PLACES = "sheet string, {0} long, x double, y double"


def test_nearest_equals_plain(spark):
    rng = random.Random(6)
    targets = [(rng.choice("st"), k, float(rng.randint(0, 40)), float(rng.randint(0, 40))) for k in range(60)] + [("far", 900, 0.0, 0.0), ("s", 901, None, 1.0)]
    texts = [(rng.choice("st"), k, float(rng.randint(-20, 60)), rng.random() * 40) for k in range(150)] + [("s", 500, 1e6, -1e6), ("t", 501, 0.0, 1e5), ("far", 502, 5.0, 5.0), ("none", 503, 0.0, 0.0), ("s", 504, None, 0.0)]
    got = spatial.nearest_of_all(spark.createDataFrame(texts, PLACES.format("text_id")), spark.createDataFrame(targets, PLACES.format("target_id")))
    want = {}
    for s, i, x, y in texts:
        near = [((x - a) ** 2 + (y - b) ** 2, k) for g, k, a, b in targets if g == s and a is not None and x is not None]
        if near:
            want[i] = min(near)
    assert {r.text_id: r.target_id for r in got.collect()} == {i: k for i, (_, k) in want.items()}
    assert all(math.isclose(r.distance, want[r.text_id][0] ** 0.5) for r in got.collect())
    none = spatial.nearest_of_all(spark.createDataFrame([], PLACES.format("text_id")), spark.createDataFrame(targets, PLACES.format("target_id")))
    assert none.columns == ["sheet", "text_id", "target_id", "distance"] and none.count() == 0


def test_labelled_spaces(spark):
    rooms = [("s", 1, 0.0, 0.0, 20.0), ("s", 2, 50.0, 0.0, 30.0), ("s", 3, 0.0, 90.0, 5.0)]
    texts = [("s", 1, 1.0, 0.0, "Lobby"), ("s", 2, 5.0, 0.0, "corridor"), ("s", 3, 0.0, 3.0, "20,5 m²"), ("s", 4, 51.0, 1.0, " 12 SQM "), ("s", 5, 500.0, 0.0, "note"), ("s", 6, 0.0, 91.0, " "), ("s", 7, 0.0, 92.0, None)]
    got = spaces.label_spaces(spark.createDataFrame(rooms, "sheet string, space_id long, x double, y double, area double"), spark.createDataFrame(texts, "sheet string, text_id long, x double, y double, text string"))
    assert sorted((r.space_id, r.name, r.stated_area, r.status) for r in got.collect()) == [(1, "Lobby", 20.5, "CONFIRMED"), (2, "note", 12.0, "CONTRADICTED"), (3, None, None, "UNSTATED")]


DETECTIONS = "sheet string, ord long, score double, x0 double, y0 double, x1 double, y1 double"


def test_suppression_equals_greedy(spark):
    rng = random.Random(8)
    rows = []
    for k in range(220):
        x, y = rng.randint(0, 25), rng.randint(0, 25)
        rows.append((rng.choice("st"), k, rng.choice([0.25, 0.5, 0.5, 0.75, rng.random()]), float(x), float(y), float(x + rng.randint(0, 9)), float(y + rng.randint(1, 9))))
    rows += [("s", 900 + k, 0.5, 100.0 + k, 0.0, 110.0 + k, 10.0) for k in range(12)]  # a chain of ties

    def over(p, q):
        w, h = max(min(p[5], q[5]) - max(p[3], q[3]), 0), max(min(p[6], q[6]) - max(p[4], q[4]), 0)
        area = lambda b: (b[5] - b[3]) * (b[6] - b[4])
        return w * h > 0.4 * (area(p) + area(q) - w * h)

    stay = []
    for p in sorted(rows, key=lambda p: (-p[2], p[1])):
        if not any(q[0] == p[0] and over(p, q) for q in stay):
            stay.append(p)
    got = spatial.suppressed(spark.createDataFrame(rows, DETECTIONS), 0.4)
    assert sorted(r.ord for r in got.collect()) == sorted(p[1] for p in stay) and len(stay) < len(rows)
    assert spatial.suppressed(spark.createDataFrame([], DETECTIONS)).count() == 0


# --- schedules -----------------------------------------------------------------------------------------------------


def test_entries_over_several_runs(spark):
    runs = [("s", 3, "630", 30.0, 0.5, 40.0, 10.0), ("s", 1, "Load ", 0.0, 0.0, 12.0, 10.0), ("s", 2, "(kg):", 14.0, 1.0, 28.0, 11.0), ("s", 4, "PK-A12", 0.0, 13.0, 20.0, 22.0), ("s", 5, "PK-B07 %8 - 120 cm", 22.0, 13.0, 60.0, 22.0)]
    runs += [("s", 9, "Load (kg):", 500.0, 0.0, 520.0, 10.0), ("s", 10, "400", 700.0, 0.0, 710.0, 10.0), ("s", 11, None, 0.0, 5.0, 1.0, 6.0), ("t", 12, "slot PK-C55", 0.0, 0.0, 9.0, 9.0)]
    blocks = schedules.assembled(spark.createDataFrame(runs, "sheet string, ord long, text string, x0 double, y0 double, x1 double, y1 double"), 4.0)
    assert sorted(map(tuple, blocks.collect())) == [("s", 1, "Load (kg): 630 PK-A12 PK-B07 %8 - 120 cm", 5), ("s", 9, "Load (kg):", 1), ("s", 10, "400", 1), ("t", 12, "slot PK-C55", 1)]
    found = schedules.entries(blocks, schedules.patterns(spark))
    assert sorted((r.block, r.shape, r.position, r.label, r.unit, r.value) for r in found.collect()) == [(1, "labelled", 0, "Load", "kg", "630"), (1, "numbered", 0, "PK", "A", "12"), (1, "numbered", 1, "PK", "B", "07"), (1, "slope", 0, "8", "cm", "120"), (12, "numbered", 0, "PK", "C", "55")]
    own = spark.createDataFrame([(0, "level", r"(EL)()\s*([+-]\d+)", "m")], "rank int, shape string, pattern string, unit string")
    texts = spark.createDataFrame([(1, "EL +3 and EL -12"), (2, None), (3, "")], "ord long, text string")
    assert sorted((r.ord, r.position, r.unit, r.value) for r in schedules.entries(texts, own).collect()) == [(1, 0, "m", "+3"), (1, 1, "m", "-12")]


# --- review --------------------------------------------------------------------------------------------------------

NOON = datetime.datetime(2024, 1, 1, 12)
DECISIONS = "sheet string, tier string, reviewer long, ts timestamp"


def decisions(n=150, seed=2):
    rng = random.Random(seed)
    return [(rng.choice("st"), rng.choice(["MEASURED", "ASSUMED"]), rng.randint(1, 3), NOON + datetime.timedelta(seconds=rng.randint(0, 40_000))) for _ in range(n)]


def plain_sessions(rows, pause):
    out, keys = [], sorted({r[:3] for r in rows})
    for key in keys:
        times = sorted(r[3] for r in rows if r[:3] == key)
        start = last = times[0]
        n = 1
        for t in times[1:]:
            if (t - last).total_seconds() <= pause:
                n += 1
            else:
                out.append((*key, start, last, n))
                start, n = t, 1
            last = t
        out.append((*key, start, last, n))
    return sorted(out)


def test_sessions_leave_pauses_out(spark):
    rows = decisions() + [("s", "ASSUMED", 9, NOON), ("s", "ASSUMED", 9, NOON + datetime.timedelta(minutes=30)), ("s", "ASSUMED", 9, NOON + datetime.timedelta(minutes=60, seconds=1))]
    df = spark.createDataFrame(rows + [("s", "MEASURED", 1, None)], DECISIONS)
    sessions = reviewing.review_sessions(df, "30 minutes")
    want = plain_sessions(rows, 1800)
    assert sorted(map(tuple, sessions.collect())) == want
    for r in reviewing.review_time(sessions).collect():
        mine = [w for w in want if w[:2] == (r.sheet, r.tier)]
        busy = sum((w[4] - w[3]).total_seconds() for w in mine)
        assert (r.sessions, r.decided, r.busy_us) == (len(mine), sum(w[5] for w in mine), int(busy * 1e6))
        assert r.mean_us == pytest.approx(busy * 1e6 / (r.decided - r.sessions))


def test_sessions_of_a_stream(spark, tmp_path):
    """Closed sessions of a stream equal those of a batch; the row that comes last closes all."""
    rows = sorted(decisions(seed=3), key=lambda r: r[3])
    closing = ("end", "END", 0, NOON + datetime.timedelta(days=3))
    for k in range(3):
        part = rows[k * 50 : (k + 1) * 50]
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, DECISIONS).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    spark.createDataFrame([closing], DECISIONS).coalesce(1).write.parquet(str(tmp_path / "in" / "9"))
    stream = spark.readStream.schema(DECISIONS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = reviewing.review_sessions(stream, "30 minutes", late="12 hours")
    q = out.writeStream.format("memory").queryName("review").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("review").collect())) == plain_sessions(rows, 1800)


CORRECTIONS = "correction_id long, item_id long, kind string, quantity double, ts timestamp"


def corrections(seed=4):
    rng = random.Random(seed)
    rows = []
    for k in range(120):
        kind = rng.choice(["set", "set", "reject", "accept"])
        rows.append((k, rng.randint(1, 12), kind, float(rng.randint(0, 9)) if kind == "set" else None, NOON + datetime.timedelta(minutes=rng.randint(0, 50))))
    return rows + [(500, 99, "set", 1.0, NOON), (501, 1, "set", 1.0, None)]


def folded(items, log, until):
    state = {i: [q, False, 0] for i, q in items}
    for n, item, kind, quantity, ts in sorted({r for r in log if r[4] is not None and r[4] <= until}, key=lambda r: (r[4], r[0])):
        if item in state:
            s = state[item]
            s[2] += 1
            if kind == "set":
                s[0] = quantity
            else:
                s[1] = kind == "reject"
    return {i: tuple(s) for i, s in state.items()}


def test_corrections_equal_a_fold(spark):
    items, log = [(i, float(i)) for i in range(1, 16)], corrections()
    table = spark.createDataFrame(items, "item_id long, quantity double")
    told = spark.createDataFrame(log + log[::3], CORRECTIONS)
    for minutes in (-1, 0, 7, 25, 1000):
        until = NOON + datetime.timedelta(minutes=minutes)
        got = reviewing.corrected_items(table, told, str(until))
        assert {r.item_id: (r.corrected_quantity, r.rejected, r.corrections) for r in got.collect()} == folded(items, log, until)
    assert {r.item_id: (r.corrected_quantity, r.rejected, r.corrections) for r in reviewing.corrected_items(table, told).collect()} == folded(items, log, datetime.datetime.max)


def test_a_log_is_written_once(spark, tmp_path):
    """Rows that are sent again within the watermark are in the log once, late ones are in it, and earlier files are not touched."""
    log = [r for r in corrections() if r[4] is not None]
    late, rest = log[:20], log[20:]
    for k, part in enumerate([rest[:60], rest[50:] + rest[:10], late + rest[:5]]):
        spark.createDataFrame(part, CORRECTIONS).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
        stream = spark.readStream.schema(CORRECTIONS).parquet(str(tmp_path / "in" / "*"))
        reviewing.record_corrections(stream, str(tmp_path / "log"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "log")).drop("batch")
    assert sorted(map(repr, map(tuple, got.select("correction_id", "item_id", "kind", "quantity", "ts").collect()))) == sorted(map(repr, log))
