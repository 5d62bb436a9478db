"""Polygons, runs in their order, legend matches and scoped prices against plain versions."""

import datetime
import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura.operators import chains, legends, polygons, routes, scopes

SEGMENTS = "sheet string, x0 double, y0 double, x1 double, y1 double"

# --- lists and cycles ----------------------------------------------------------------------------------------------


def test_ranks_and_cycles(spark):
    rng = random.Random(2)
    names = rng.sample(range(1000), 90)
    lists, cuts = [], [0, 1, 3, 40, 41, 90]
    for a, b in zip(cuts, cuts[1:]):
        lists.append(names[a:b])
    links = [(n, after) for part in lists for n, after in zip(part, [*part[1:], None])]
    rng.shuffle(links)
    got = {r.node: (r.last, r.after) for r in chains.ranks(spark.createDataFrame(links, "node long, next long")).collect()}
    assert got == {n: (part[-1], len(part) - 1 - k) for part in lists for k, n in enumerate(part)}
    closed = [(n, part[(k + 1) % len(part)]) for part in lists for k, n in enumerate(part)]
    got = {r.node: r.label for r in chains.cycles(spark.createDataFrame(closed, "node long, next long")).collect()}
    assert got == {n: min(part) for part in lists for n in part}


# --- polygons ------------------------------------------------------------------------------------------------------


def plain_faces(segments):
    """Areas, corners and holes of the bounded faces, with exact fractions, walking one face after the other."""
    lines = {tuple(sorted([(a, b), (c, d)])) for a, b, c, d in segments if (a, b) != (c, d)}
    cuts = {s: set(s) for s in lines}
    for s, t in itertools.combinations(lines, 2):
        (ax, ay), (bx, by), (cx, cy), (dx, dy) = *s, *t
        d = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
        if d:
            u, v = Fraction((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx), d), Fraction((cx - ax) * (by - ay) - (cy - ay) * (bx - ax), d)
            if 0 <= u <= 1 and 0 <= v <= 1:
                p = (ax + u * (bx - ax), ay + u * (by - ay))
                cuts[s].add(p)
                cuts[t].add(p)
        elif (cx - ax) * (by - ay) == (cy - ay) * (bx - ax):
            cuts[s] |= {p for p in t if s[0] < p < s[1]}
            cuts[t] |= {p for p in s if t[0] < p < t[1]}
    edges = {e for s in lines for e in zip(sorted(cuts[s]), sorted(cuts[s])[1:])}

    def walked(edges):
        half = [*edges, *((b, a) for a, b in edges)]
        around = {}
        for a, b in half:
            around.setdefault(a, []).append(b)
        for a, bs in around.items():
            bs.sort(key=lambda b: math.atan2(b[1] - a[1], b[0] - a[0]))
        face, rings = {}, []
        for h in half:
            if h not in face:
                ring = []
                while h not in face:
                    face[h] = len(rings)
                    ring.append(h)
                    a, b = h
                    bs = around[b]
                    h = (b, bs[bs.index(a) - 1])
                rings.append(ring)
        return face, rings

    face, rings = walked(edges)
    face, rings = walked({(a, b) for a, b in edges if face[a, b] != face[b, a]})
    twice = [sum(a[0] * b[1] - b[0] * a[1] for a, b in r) for r in rings]

    def inside(p, ring):
        """Whether a point just right of p lies within a ring, edges below it counted."""
        n = 0
        for a, b in ring:
            lo, hi = sorted((a, b))
            if lo[0] <= p[0] < hi[0] and lo[1] + Fraction(hi[1] - lo[1]) * (p[0] - lo[0]) / (hi[0] - lo[0]) < p[1]:
                n += 1
        return n % 2 == 1

    area, holes = {k: t for k, t in enumerate(twice) if t > 0}, {k: 0 for k, t in enumerate(twice) if t > 0}
    for k, t in enumerate(twice):
        if t < 0:
            p = min(a for a, _ in rings[k])
            around = [j for j in area if inside(p, rings[j])]
            if around:
                j = min(around, key=lambda j: twice[j])
                area[j] += t
                holes[j] += 1
    return sorted((float(area[k]) / 2, len(rings[k]), holes[k], tuple(map(float, min(a for a, _ in rings[k])))) for k in area)


def rectangle(x, y, w, h):
    return [(x, y, x + w, y), (x + w, y, x + w, y + h), (x, y + h, x + w, y + h), (x, y, x, y + h)]


def drawings():
    """Sheets of walls: random rectangles and lines on even coordinates that cross on whole ones, islands in rooms in islands, ends
    that lead nowhere, bridges, doubled and overlapping walls."""
    rng = random.Random(4)
    sheets = {}
    for n in range(6):
        out = []
        for _ in range(rng.randint(1, 14)):
            out += rectangle(2 * rng.randint(0, 20), 2 * rng.randint(0, 15), 2 * rng.randint(1, 10), 2 * rng.randint(1, 8))
        for _ in range(6):
            x, y, k, s = 2 * rng.randint(0, 20), 2 * rng.randint(0, 15), 2 * rng.randint(1, 8), rng.choice([-1, 1])
            out.append((x, y, x + k, y + s * k))
            out.append((x, y, x + rng.choice([0, k]), y))
        sheets[f"random {n}"] = out
    sheets["nested"] = [s for k in range(5) for s in rectangle(4 * k, 4 * k, 80 - 8 * k, 60 - 8 * k)] + rectangle(2, 30, 1, 1)
    sheets["islands"] = rectangle(0, 0, 100, 100) + rectangle(10, 10, 10, 10) + rectangle(10, 30, 10, 10) + rectangle(10, 50, 10, 10) + rectangle(12, 52, 2, 2) + [(20, 15, 40, 15), (40, 15, 40, 40)]
    sheets["bridge"] = rectangle(0, 0, 10, 10) + rectangle(20, 0, 10, 10) + [(10, 4, 20, 4), (30, 4, 60, 4)]
    sheets["doubled"] = rectangle(0, 0, 10, 10) * 3 + [(0, 0, 4, 0), (2, 0, 6, 0), (10, 10, 0, 10)]
    sheets["nothing"] = [(0, 0, 0, 0), (1, 1, 5, 5)]
    return sheets


def test_faces_equal_plain(spark):
    sheets = drawings()
    rows = [(name, *map(float, s)) for name, segments in sheets.items() for s in segments] + [("odd", None, 0.0, 1.0, 1.0), ("odd", float("nan"), 0.0, 1.0, 1.0), (None, 0.0, 0.0, 1.0, 1.0)]
    rows = [(n, *s[2:], *s[:2]) if random.Random(k).random() < 0.5 else (n, *s) for k, (n, *s) in enumerate(rows)]
    found = polygons.faces(spark.createDataFrame(rows, SEGMENTS).repartition(3), snap=0.5).collect()
    for name, segments in sheets.items():
        mine = [r for r in found if r.sheet == name]
        assert sorted((r.area, r.vertices, r.holes, (r.ring[0].x, r.ring[0].y)) for r in mine) == plain_faces(segments), name
        for r in mine:  # a ring is closed, runs counter-clockwise, and has the face's area where there are no holes
            shoelace = sum(a.x * b.y - b.x * a.y for a, b in zip(r.ring, [*r.ring[1:], r.ring[0]])) / 2
            assert shoelace == r.area if not r.holes else shoelace > r.area
    assert {r.sheet for r in found} == {n for n in sheets if n != "nothing"}
    square = next(r for r in found if r.sheet == "doubled")
    assert (square.area, square.x, square.y) == (100.0, 5.0, 5.0)
    rooms = polygons.spaces(polygons.faces(spark.createDataFrame([r for r in rows if r[0] == "islands"], SEGMENTS), snap=0.5), 50, 200)
    assert sorted(r.area for r in rooms.collect()) == [96.0, 100.0, 100.0]


def test_faces_of_large_groups_equal_plain(spark, monkeypatch):
    monkeypatch.setattr(polygons, "WHOLE", 12)  # groups of more segments go by exchanges and pointer doubling
    sheets = {n: s for n, s in drawings().items() if n in ("random 3", "nested", "bridge", "doubled", "nothing")}
    rows = [(name, *map(float, s)) for name, segments in sheets.items() for s in segments]
    found = polygons.faces(spark.createDataFrame(rows, SEGMENTS).repartition(3), snap=0.5).collect()
    for name, segments in sheets.items():
        assert sorted((r.area, r.vertices, r.holes, (r.ring[0].x, r.ring[0].y)) for r in found if r.sheet == name) == plain_faces(segments), name
        for r in (r for r in found if r.sheet == name and not r.holes):
            assert sum(a.x * b.y - b.x * a.y for a, b in zip(r.ring, [*r.ring[1:], r.ring[0]])) / 2 == r.area


def test_cycles_followed_in_one_task():
    node, following = np.array([7, 2, 9, 4, 5, 30]), np.array([2, 3, 0, 4, 1, 5])
    label, after = chains.followed(node, following)
    assert label.tolist() == [7, 2, 7, 2, 2, 30] and after.tolist() == [1, 2, 0, 1, 0, 0]
    ring = np.random.default_rng(5).permutation(1000)
    label, after = chains.followed(np.arange(1000), np.roll(ring, -1)[np.argsort(ring)])
    assert set(label) == {0} and sorted(after) == list(range(1000)) and after[0] == 999


def test_no_segments_no_faces(spark):
    assert polygons.faces(spark.createDataFrame([], SEGMENTS)).collect() == []


# --- runs in their order -------------------------------------------------------------------------------------------

MEMBERS = "ord long, id string, points array<struct<x:double,y:double>>"


def lines(df):
    return {r.ord: [[(p.x, p.y) for p in line] for line in r.polylines] for r in df.collect()}


def test_members_in_any_order_give_one_run(spark):
    rng = random.Random(9)
    path = [(0.0, 0.0)]
    for k in range(40):
        path.append((path[-1][0] + rng.randint(1, 5), path[-1][1] + rng.choice([-3.0, 0.0, 3.0])))
    cuts = [0, 1, 4, 9, 10, 22, 40]
    parts = [path[a : b + 1] for a, b in zip(cuts, cuts[1:])]
    rows = []
    for run in range(5):
        members = [(run, f"m{k}", p if rng.random() < 0.5 else p[::-1]) for k, p in enumerate(parts)]
        rng.shuffle(members)
        rows += members
    got = lines(routes.run_order(spark.createDataFrame(rows, MEMBERS)))
    want = [p for part in parts for p in part]
    assert all(len(v) == 1 and v[0] == want for v in got.values()) and len(got) == 5


def test_branches_loops_and_gaps(spark):
    rows = [(1, "a", [(0, 0), (1, 0)]), (1, "b", [(2, 0), (1, 0)]), (1, "c", [(1, 0), (1, 3)])]  # three meet
    rows += [(2, "a", [(1, 0), (0, 0)]), (2, "b", [(1, 1), (1, 0)]), (2, "c", [(1, 1), (0, 0)])]  # closed
    rows += [(3, "o", [(0, 0), (1, 0), (1, 1), (0, 0)]), (3, "p", [(5, 5)])]  # closed in itself; a point
    rows += [(4, "a", [(0, 0), (1, 0)]), (4, "b", [(1.0000001, 0), (2, 0)]), (4, "c", [(2.5, 0), (3, 0)])]  # within tolerance, and not
    rows = [(n, i, [(float(x), float(y)) for x, y in p]) for n, i, p in rows]
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        got = lines(routes.run_order(spark.createDataFrame(rows, MEMBERS).repartition(3)))
        assert got[1] == [[(0, 0), (1, 0)], [(1, 0), (1, 3)], [(1, 0), (2, 0)]] or got[1] == [[(0, 0), (1, 0)], [(1, 0), (2, 0)], [(1, 0), (1, 3)]]
        assert got[2] == [[(0, 0), (1, 0), (1, 0), (1, 1), (1, 1), (0, 0)]]
        assert got[3] == [[(0, 0), (1, 0), (1, 1), (0, 0)]]
        assert [len(x) for x in got[4]] == [4, 2]


def test_lengths_by_path(spark):
    """Sorted points cut corners and jump; in path order the run's own length is measured, however its members are listed."""
    members = {"a": [(0, 0), (4, 0)], "b": [(4, 0), (4, 3)], "c": [(4, 3), (1, 3)]}
    paths = spark.createDataFrame([(i, "CONDUIT", [(float(x), float(y)) for x, y in p]) for i, p in members.items()], "id string, layer string, points array<struct<x:double,y:double>>")
    orders = list(itertools.permutations(members))
    # a cluster for each order; the extra point keeps their sets of members apart
    paths = paths.union(spark.createDataFrame([(f"p{k}", "CONDUIT", [(9.0, 9.0)]) for k in range(len(orders))], paths.schema))
    clusters = spark.createDataFrame([(0, k, "1:100", [*listed, f"p{k}"]) for k, listed in enumerate(orders)], "cluster_id int, ord long, scale string, members array<string>")
    assert [r.length_m for r in routes.measure_routes(clusters, paths, ["CONDUIT"], order="path").collect()] == [1000.0] * 6
    assert 1000.0 not in [r.length_m for r in routes.measure_routes(clusters, paths, ["CONDUIT"]).collect()]


# --- legends -------------------------------------------------------------------------------------------------------


def test_contained_equals_plain(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé_") for _ in range(rng.randint(0, 7)))
    needles, haystacks = ([(rng.choice("PQ"), word()) for _ in range(n)] for n in (150, 120))
    needles += [("P", None), ("P", ""), ("R", "a")]
    got = legends.contained(spark.createDataFrame(needles, "page string, text string"), spark.createDataFrame(haystacks, "page string, text string"))
    want = {(p, a, b) for p, a in needles for q, b in haystacks if p == q and a is not None and a in b}
    rows = list(map(tuple, got.collect()))
    assert set(rows) == want and len(rows) == len(want) > 300


def test_symbols_and_entries(spark):
    entries = [("p", "door_lock", "lock", 1), ("p", "lock", "a lock", 2), ("p", "reader", "a reader", 3), ("q", "lock", "other", 1)]
    symbols = [("p", "LOCK"), ("p", "LOCK"), ("p", "loc"), ("p", "card_reader_2"), ("p", "none"), ("q", "reader"), ("q", None)]
    got = legends.matched(spark.createDataFrame(symbols, "page string, symbol string"), spark.createDataFrame(entries, "page string, name string, description string, ord long"))
    assert sorted(map(tuple, got.collect())) == [("p", "LOCK", "lock", "a lock", "exact_match", 1.0)] * 2 + [("p", "card_reader_2", "reader", "a reader", "substring_match", 0.7), ("p", "loc", "door_lock", "lock", "substring_match", 0.7)]


# --- scoped prices -------------------------------------------------------------------------------------------------

PRICES = "material_name string, company string, region string, supplier string, unit_price double, effective_from date, effective_to date, seq long"
ASKED = "ask_id long, material_name string, company string, region string, supplier string, on date"


def plain_price(prices, ask):
    _, material, *scope, on = ask
    best = None
    for m, *own, price, since, until, seq in prices:
        if m == material and on is not None and all(a is None or a == b for a, b in zip(own, scope)) and (since is None or since <= on) and (until is None or on < until):
            rank = (*(a is not None for a in own), since is not None, since or datetime.date.min, seq)
            best = max(best, (rank, price, seq)) if best else (rank, price, seq)
    return (best[1], best[2]) if best else (None, None)


@pytest.mark.parametrize("seed", [1, 2])
def test_price_in_scope_equals_plain(spark, seed):
    rng = random.Random(seed)
    day = lambda: rng.choice([None, datetime.date(1999, 12, 28) + datetime.timedelta(days=rng.choice([0, 1, 2, 3, 64, 700, rng.randint(0, 3000)]))])
    some = lambda kinds: rng.choice([None, *kinds])
    prices = [(rng.choice("mn"), some("AB"), some("RS"), some("XY"), float(k), day(), day(), k) for k in range(200)]
    prices += [("m", None, None, None, 0.5, None, datetime.date(9999, 12, 31), -1), ("o", None, "R", None, 1.0, datetime.date(2, 1, 1), None, -2)]
    asked = [(k, rng.choice("mno?"), some("AB"), some("RS"), some("XY"), day()) for k in range(300)] + [(0, "m", None, None, None, datetime.date(2000, 1, 1))]
    got = scopes.in_scope(spark.createDataFrame(prices, PRICES), spark.createDataFrame(asked, ASKED).withColumns({c: F.lit("x") for c in ("open", "level")}))
    assert sorted(map(repr, ((r.ask_id, r.unit_price, r.price_seq) for r in got.collect()))) == sorted(repr((a[0], *plain_price(prices, a))) for a in asked)


def test_no_prices(spark):
    got = scopes.in_scope(spark.createDataFrame([], PRICES), spark.createDataFrame([(1, "m", None, None, None, datetime.date(2000, 1, 1))], ASKED))
    assert [(r.ask_id, r.unit_price) for r in got.collect()] == [(1, None)]
