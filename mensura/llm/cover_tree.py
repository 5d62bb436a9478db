"""Exact top-k search by inner product with dual cover trees.

Vectors are dealt to blocks around pivots (a fixed number of vectors, the nearest one counts; blocks that grow too large
are cut by hash), and a cover tree is grown once over each block of candidates and each block of queries: each level's
balls have radii smaller by a fixed factor, and centres further apart than the radius.  For balls (p, r) and (q, s) no
inner product exceeds p.q + |p| s + |q| r + r s.  The roots of the trees bound pairs of blocks: every query block is
searched first in the block whose centre fits it best, which gives each query a worst k-th score, and only blocks
whose bound reaches the least of these are searched afterwards.  There both trees are walked together, best bound first,
and a pair of nodes goes as soon as its bound falls below the worst k-th score held by any query under the query node.
The best k of all blocks are merged by a window over the query.

Scores are exact integers: bounds are taken in double precision with a margin, products in doubles only where every
partial sum stays under 2**53, else in 64-bit integers, else in Python integers; a score (a query's with itself too) that does not
fit a long is an error.  Equal vectors of a block are one point of its tree, with their ids in order.

Vectors that are null or hold null or non-finite components take no part, nor do null ids.  Only vectors of equal
length are compared.  Rows of repeated ids are rows of their own: rows of the query's own id are never its candidates, a
repeated candidate counts each time, and the results of a repeated query id are ranked together.  Ties go to the smaller
id.  Fewer candidates than k give all of them; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import smallest_hashes, stored, table

K, QUERY_EVERY, SCALE = 5, 50, 256
#: Candidates and queries of a block, points of a leaf, the factor between the radii of two levels, and pivots at most.
BLOCK, QUERY_BLOCK, LEAF, SHRINK, PIVOTS = 4096, 1024, 256, 1.3, 256
#: The least long stands for "no k-th score yet".
NONE = -(1 << 63)
KEYS = ["dims", "cell", "cut"]


class Node:
    __slots__ = ("center", "radius", "norm", "members", "children")

    def __init__(self, points: np.ndarray, members: np.ndarray):
        """A ball around the first member, and balls for its parts."""
        self.center = points[members[0]]
        self.norm = float(np.sqrt(self.center @ self.center))
        away = np.sqrt(np.maximum(((points[members] - self.center) ** 2).sum(1), 0))
        self.radius = float(away.max())
        self.members = members
        self.children: list[Node] = []
        if len(members) > LEAF and self.radius > 0:
            reach = self.radius / SHRINK
            parts, rest, near = [], members, away <= reach
            while len(rest):
                parts.append(rest[near])
                rest = rest[~near]
                if len(rest):
                    near = ((points[rest] - points[rest[0]]) ** 2).sum(1) <= reach * reach
            small = [p for p in parts if len(p) <= 2]
            self.children = [Node(points, p) for p in parts if len(p) > 2]
            # points that stand alone at this level share leaves instead of having one each
            if small:
                alone = np.concatenate(small)
                alone = alone[np.argsort(((points[alone] - self.center) ** 2).sum(1), kind="stable")]
                self.children += [Leaf(points, alone[k : k + LEAF]) for k in range(0, len(alone), LEAF)]


class Leaf(Node):
    """A ball that is not divided."""

    def __init__(self, points: np.ndarray, members: np.ndarray):
        self.center = points[members].mean(0)
        self.norm = float(np.sqrt(self.center @ self.center))
        self.radius = float(np.sqrt(((points[members] - self.center) ** 2).sum(1).max()))
        self.members, self.children = members, []


class Block:
    """Vectors with their ids, and the cover tree over them."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, merge: bool):
        """merge: equal vectors become one point."""
        if merge:
            distinct, group = np.unique(vectors, axis=0, return_inverse=True)
            order = np.lexsort((ids, group.ravel()))
            group, ids = group.ravel()[order], ids[order]
            starts = np.searchsorted(group, np.arange(len(distinct)))
            self.vectors, self.ids = distinct, [ids[a:b] for a, b in zip(starts, [*starts[1:], len(ids)])]
        else:
            self.vectors, self.ids = vectors, [ids[k : k + 1] for k in range(len(ids))]
        self.first = np.array([x[0] for x in self.ids], np.int64)
        self.several = np.array([len(x) > 1 for x in self.ids], bool)
        points = self.vectors.astype(float)
        self.longest = float(np.sqrt((points**2).sum(1).max())) if len(points) else 0.0
        self.root = Node(points, np.arange(len(points), dtype=np.int32))


class Search:
    """The k best candidates of every query of a block that reach the worst scores given."""

    def __init__(self, queries: Block, candidates: Block, k: int, worst: np.ndarray | None = None):
        self.q, self.p, self.k = queries, candidates, k
        self.q_points, self.p_points = queries.vectors.astype(float), candidates.vectors.astype(float)
        # no partial sum of a product is larger than the product of the lengths
        self.largest = queries.longest * candidates.longest * (1 + 1e-9)
        self.best = [np.zeros((0, 2), np.int64) for _ in queries.ids]
        self.worst = np.full(len(queries.ids), NONE) if worst is None else worst.copy()
        self._visit(queries.root, candidates.root)

    def _visit(self, q: Node, r: Node) -> None:
        todo = [(bound(q, r), q, r)]
        while todo:
            top, q, r = todo.pop()
            if top < self.worst[q.members].min():
                continue
            if not q.children and not r.children:
                self._score(q.members, r.members)
            elif r.children and (not q.children or r.radius >= q.radius):
                todo += sorted(((bound(q, c), q, c) for c in r.children), key=lambda x: x[0])
            else:
                todo += sorted(((bound(c, r), c, r) for c in q.children), key=lambda x: x[0])

    def _products(self, rows: np.ndarray, members: np.ndarray) -> np.ndarray:
        if self.largest < 2.0**53:
            return (self.q_points[rows] @ self.p_points[members].T).astype(np.int64)
        if self.largest < 2.0**63:
            return self.q.vectors[rows] @ self.p.vectors[members].T
        exact = self.q.vectors[rows].astype(object) @ self.p.vectors[members].T.astype(object)
        if max(abs(x) for x in exact.ravel()) >= 1 << 63:
            raise OverflowError("an inner product does not fit a long")
        return exact.astype(np.int64)

    def _score(self, rows: np.ndarray, members: np.ndarray) -> None:
        scores = self._products(rows, members)
        for i in np.flatnonzero(scores.max(1) >= self.worst[rows]):
            row, own = rows[i], self.q.first[rows[i]]
            least = self.worst[row]
            if len(members) > self.k + 1:  # one of the k + 1 best points may hold the query's own row only
                least = max(least, np.partition(scores[i], -self.k - 1)[-self.k - 1])
            good = np.flatnonzero(scores[i] >= least)
            names, values = self.p.first[members[good]], scores[i, good]
            if self.p.several[members[good]].any():
                held = [x[x != own][: self.k] for x in (self.p.ids[m] for m in members[good])]
                names, values = np.concatenate(held), np.repeat(values, [len(x) for x in held])
            elif own in names:
                names, values = names[names != own], values[names != own]
            rows_of = np.concatenate([self.best[row], np.column_stack([values, names])])
            # by score from the highest, then by id; ~x turns the order of all longs around
            rows_of = rows_of[np.lexsort((rows_of[:, 1], ~rows_of[:, 0]))][: self.k]
            self.best[row] = rows_of
            if len(rows_of) == self.k:
                self.worst[row] = max(self.worst[row], rows_of[-1, 0])


def bound(q: Node, r: Node) -> float:
    """No score of two of the nodes' points is above it; the margins cover rounding."""
    top = q.norm * r.radius + r.norm * q.radius + q.radius * r.radius
    return float(q.center @ r.center) + top * (1 + 1e-6) + 1e-9 * q.norm * r.norm + 1e-6


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of integers as long), dims."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad)
    whole = F.transform(x, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), F.size("embedding").alias("dims"))


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten() if len(values) else pa.array([], pa.int64())
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)


def _placed(rows: DataFrame, pivots: dict[int, np.ndarray], size: int) -> DataFrame:
    """The rows with their block: the cell of the nearest pivot of their length, and a cut of it by hash."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell = batch.column(2).to_numpy(), np.zeros(batch.num_rows, np.int32)
            for d in np.unique(dims):
                around, at = pivots.get(int(d)), np.flatnonzero(dims == d)
                if around is not None and d:
                    x = _matrix(batch.column(1).take(pa.array(at)), len(at)).astype(float)
                    cell[at] = ((around**2).sum(1) - 2 * x @ around.T).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["vec_id", "v", "dims", "cell"])

    celled = rows.select("vec_id", "v", "dims").mapInArrow(nearest, "vec_id long, v array<long>, dims int, cell int")
    cuts = celled.groupBy("dims", "cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("cuts"))
    return celled.join(cuts, ["dims", "cell"]).withColumn("cut", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("cuts")).cast("int")).drop("cuts")


def indexed(rows: DataFrame, pivots: dict[int, np.ndarray], size: int, merge: bool) -> DataFrame:
    """One stored row per block: its tree, and the tree's root as (center, norm, radius)."""

    def grow(part: pa.Table) -> pa.Table:
        block = Block(_matrix(part.column("v"), part.num_rows), part.column("vec_id").to_numpy(), merge)
        key = {k: part.column(k)[0].as_py() for k in KEYS}
        row = key | {"center": block.root.center.tolist(), "norm": block.root.norm, "radius": block.root.radius, "tree": pickle.dumps(block, pickle.HIGHEST_PROTOCOL)}
        return pa.Table.from_pylist([row], schema=pa.schema([(k, pa.int32()) for k in KEYS] + [("center", pa.list_(pa.float64())), ("norm", pa.float64()), ("radius", pa.float64()), ("tree", pa.binary())]))

    schema = "dims int, cell int, cut int, center array<double>, norm double, radius double, tree binary"
    return stored(_placed(rows, pivots, size).groupBy(*KEYS).applyInArrow(grow, schema))


def pairs_of_blocks(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """q_cell, q_cut, dims, cell, cut, fit (the centres' product) and top (the bound) of every query block with every block
    of the same length: rows of blocks, not of vectors, dealt by a part of the block's number."""
    parts = max(1, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    q = queries.select("dims", F.col("cell").alias("q_cell"), F.col("cut").alias("q_cut"), *[F.col(c).alias(f"q_{c}") for c in ("center", "norm", "radius")])
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    p = blocks.select(*KEYS, "center", "norm", "radius").withColumn("part", F.pmod(F.xxhash64(*KEYS), F.lit(parts)).cast("int"))
    fit = F.aggregate(F.zip_with("q_center", "center", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    reach = F.col("q_norm") * F.col("radius") + F.col("norm") * F.col("q_radius") + F.col("q_radius") * F.col("radius")
    met = q.join(p, ["dims", "part"]).withColumn("fit", fit)
    return met.select("q_cell", "q_cut", *KEYS, "fit", (F.col("fit") + reach * (1 + 1e-6) + F.col("q_norm") * F.col("norm") * 1e-9 + 1e-6).alias("top"))


def _searched(pairs: DataFrame, queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """dims, q_cell, q_cut, worst (of each query, packed) once per pair, and query_id, vec_id, score of what was found."""
    groups = queries.select("dims", F.col("cell").alias("q_cell"), F.col("cut").alias("q_cut"), F.col("tree").alias("q_tree"), *(["worst"] if "worst" in queries.columns else [F.lit(None).cast("binary").alias("worst")]))
    tasks = pairs.select("q_cell", "q_cut", *KEYS).join(blocks.select(*KEYS, "tree"), KEYS).join(groups, ["dims", "q_cell", "q_cut"])
    tasks = tasks.repartition(*KEYS, "q_cell", "q_cut").select("dims", "q_cell", "q_cut", "q_tree", "worst", "tree")
    schema = pa.schema([("dims", pa.int32()), ("q_cell", pa.int32()), ("q_cut", pa.int32()), ("worst", pa.binary()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dims, q_cell, q_cut, q_tree, worst, tree = (batch.column(c)[row].as_py() for c in range(6))
                queries_ = pickle.loads(q_tree)
                done = Search(queries_, pickle.loads(tree), k, None if worst is None else np.frombuffer(worst, np.int64))
                lengths = [len(b) for b in done.best]
                found = np.concatenate(done.best) if lengths else np.zeros((0, 2), np.int64)
                empty = [None] * len(found)
                ids = np.repeat(queries_.first, lengths).tolist()
                columns = [[dims, *empty], [q_cell, *empty], [q_cut, *empty], [done.worst.tobytes(), *empty], [None, *ids], [None, *found[:, 1].tolist()], [None, *found[:, 0].tolist()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return tasks.mapInArrow(run, "dims int, q_cell int, q_cut int, worst binary, query_id long, vec_id long, score long")


def plan(queries: DataFrame, candidates: DataFrame, k: int = K) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all pairs of blocks, those searched after the first ones, what was found): rows of usable() on both sides."""
    n, m = candidates.count(), queries.count()
    sample = smallest_hashes(candidates, "vec_id", min(PIVOTS, max(1, -(-n // BLOCK)))).collect()  # at most PIVOTS vectors
    by_length: dict[int, list] = {}
    for r in sample:
        by_length.setdefault(r["dims"], []).append(r["v"])
    pivots = {d: np.array(v, float) for d, v in by_length.items()}
    few = {d: v[: max(1, -(-m // QUERY_BLOCK))] for d, v in pivots.items()}
    q, p = indexed(queries, few, QUERY_BLOCK, False), indexed(candidates, pivots, BLOCK, True)
    pairs = stored(pairs_of_blocks(q, p))
    group = ["dims", "q_cell", "q_cut"]
    home = pairs.groupBy(*group).agg(F.max_by(F.struct("cell", "cut"), F.struct("fit", "cell", "cut")).alias("h")).select(*group, "h.cell", "h.cut")
    first = stored(_searched(home, q, p, k))
    told = first.filter("dims IS NOT NULL").select("dims", F.col("q_cell").alias("cell"), F.col("q_cut").alias("cut"), "worst")
    least = F.udf(lambda b: int(np.frombuffer(b, np.int64).min()), "long")  # one value per query block
    bounds = told.select("dims", F.col("cell").alias("q_cell"), F.col("cut").alias("q_cut"), least("worst").alias("least"))
    rest = pairs.join(home, [*group, "cell", "cut"], "left_anti").join(bounds, group).filter(F.col("top") >= F.col("least"))
    later = _searched(rest, q.join(told, KEYS), p, k)
    return pairs, rest, first.unionByName(later).filter("query_id IS NOT NULL").select("query_id", "vec_id", "score")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score; both sides are rows of usable()."""
    found = plan(queries, candidates, k)[2]
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query's best candidates.  Null and non-finite vectors and null ids take no part, repeated ids are rows of their
    own, an empty table gives no rows."""
    rows = stored(usable(table(spark, sf_dir, "embeddings")))
    return top_k(rows.filter(F.col("vec_id") % QUERY_EVERY == 0), rows)


SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT * FROM v WHERE vec_id % {QUERY_EVERY} = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
WHERE rank <= {K}
"""
