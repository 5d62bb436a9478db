"""Vector code compression: product quantisation by weighted Lloyd rounds over distinct integer parts.

1. Components become integers floor(1024 x); every vector is cut into 4 equal consecutive parts, packed as bytes.
2. Equal parts of a position become one weighted row; nothing later depends on how often a part comes.
3. A round hands the codebooks (4 x 256 entries: their size is bounded) to every task, which assigns its distinct parts to
   their nearest entries and returns one row of weighted sums and counts for each entry in use; Spark adds these up, and
   each entry becomes the floor of its mean.
4. Codes and errors of the distinct parts are joined back to the vectors.

Everything is exact: squared distances are compared in double precision only where every partial result stays under 2**53,
else in Python integers.  Ties go to the lower index.  A component of 2**53 or more, or an error that does not fit a long,
is an error.  Equal entries of a codebook are kept: the lower one takes all.

Null vectors and those with null or non-finite components take no part.  The length of a vector is that of the row with
the smallest id; vectors of another length, or of one that 4 does not divide, cannot share the codebooks and take no part
either.  Rows of repeated ids are rows of their own (their order as first entries follows their parts); a row without an id
is coded, but is no first entry while there are rows with ids.  Fewer than 256 rows give codebooks of as many entries.  An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows of a task whose distances are held at a time.
SLICE = 4096
#: Distinct parts of a task in a round, and tasks at least.
TASK_PARTS, LEAST_TASKS = 50_000, 8
EXACT = 1 << 53


def packed(values: np.ndarray) -> bytes:
    """Integers in the narrowest of three little-endian forms, so that equal parts have equal bytes."""
    most = max(int(values.max(initial=0)), -int(values.min(initial=0)) - 1)
    return values.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // width}").astype(np.int64)


def integer_parts(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """vec_id, label, dims, parts (array of packed parts) of the vectors that take part."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("dims", pa.int32()), ("parts", pa.list_(pa.binary()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, dims, out = [], [], []
            for k, x in enumerate(batch.column(2)):
                if not x.is_valid or x.values.null_count or not len(x.values) or len(x.values) % parts:
                    continue
                values = x.values.to_numpy(zero_copy_only=False).astype(float)
                if not np.isfinite(values).all():
                    continue
                whole = np.floor(SCALE * values)
                if np.abs(whole).max() >= EXACT:
                    raise OverflowError("a component is too large to be coded")
                keep.append(k)
                dims.append(len(values))
                out.append([packed(p) for p in np.split(whole.astype(np.int64), parts)])
            rows = batch.take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(dims, pa.int32()), pa.array(out, schema.types[3])], schema=schema)

    # labels of any type as text, which tells equal ones apart from others
    narrow = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding")
    return narrow.mapInArrow(cut, "vec_id long, label string, dims int, parts array<binary>")


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all entries, exact."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * points.shape[1] < EXACT:
        p, e = points.astype(float), entries.astype(float)
        return (p**2).sum(1)[:, None] - 2 * (p @ e.T) + (e**2).sum(1)[None]
    p, e = points.astype(object), entries.astype(object)
    return (p**2).sum(1)[:, None] - 2 * (p @ e.T) + (e**2).sum(1)[None]


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Index of the nearest entry of every point, the lower one on ties, and the squared distance."""
    index, error = np.empty(len(points), np.int64), []
    for at in range(0, len(points), SLICE):
        away = distances(points[at : at + SLICE], entries)
        best = np.argmin(away, axis=1)
        index[at : at + SLICE] = best
        error += [int(x) for x in away[np.arange(len(best)), best]]
    return index, error


def _by_part(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, rows of the batch, their points)."""
    part = batch.column(0).to_numpy()
    for k in np.unique(part):
        rows = np.flatnonzero(part == k)
        yield int(k), rows, np.array([unpacked(v.as_py(), width) for v in batch.column(1).take(pa.array(rows))])


def _sums(codebooks: np.ndarray) -> callable:
    """(part, entry, n, sums) of a task's distinct parts (part, value, weight); sums are exact integers as decimals."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), object)
        for batch in batches:
            weight = batch.column(2).to_numpy()
            for k, rows, points in _by_part(batch, width):
                index, _ = nearest(points, codebooks[k])
                w = weight[rows]
                np.add.at(count[k], index, w)
                if int(np.abs(points).max()) * int(w.sum()) < 1 << 62:
                    inside = np.zeros((entries, width), np.int64)
                    np.add.at(inside, index, points * w[:, None])
                    total[k] += inside
                else:
                    np.add.at(total[k], index, points.astype(object) * w[:, None].astype(object))
        at = np.argwhere(count > 0)
        rows = [(int(k), int(e), int(count[k, e]), [str(x) for x in total[k, e]]) for k, e in at]
        columns = list(zip(*rows)) if rows else [(), (), (), ()]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["part", "entry", "n", "sums"])

    return run


def lloyd(distinct: DataFrame, codebooks: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (parts x entries x width) after so many weighted rounds over part, value, weight.  What comes to the driver
    is one row of sums for each entry."""
    width = codebooks.shape[2]
    for _ in range(rounds):
        found = distinct.mapInArrow(_sums(codebooks), "part int, entry int, n long, sums array<string>")
        summed = found.select("part", "entry", "n", F.posexplode("sums").alias("at", "x"))
        added = summed.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        after = codebooks.copy()
        for r in added.collect():  # at most parts x entries x width rows
            after[r["part"], r["entry"], r["at"]] = int(r["x"]) // r["n"]
        codebooks = after.reshape(-1, codebooks.shape[1], width)
    return codebooks


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def _coded(codebooks: np.ndarray) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, object)
            for k, rows, points in _by_part(batch, codebooks.shape[2]):
                index, away = nearest(points, codebooks[k])
                code[rows], error[rows] = index, away
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.int32()), pa.array(error.tolist(), pa.int64())], names=["part", "value", "entry", "away"])

    return run


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error of every vector that takes part; the codebooks)."""
    whole = stored(integer_parts(vectors, parts))
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "dims", "parts").limit(entries).collect()  # at most `entries` rows
    told = "vec_id long, label string, code string, error long"
    if not first:
        return vectors.sparkSession.createDataFrame([], told), np.zeros((parts, 0, 0), np.int64)
    dims = first[0]["dims"]
    whole = whole.filter(F.col("dims") == dims)
    if any(r["dims"] != dims for r in first):
        first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(entries).collect()
    codebooks = np.array([[unpacked(r["parts"][k], dims // parts) for r in first] for k in range(parts)])
    numbered = whole.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "parts")
    rows = stored(numbered.select("row", "vec_id", "label", F.posexplode("parts").alias("part", "value")))
    distinct = stored(rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("weight")))
    # a task returns a row of sums for every entry, so it should have many more parts than there are entries
    distinct = distinct.coalesce(max(LEAST_TASKS, distinct.count() // TASK_PARTS))
    codebooks = lloyd(distinct, codebooks, rounds)
    coded = distinct.mapInArrow(_coded(codebooks), "part int, value binary, entry int, away long")
    back = rows.join(coded, ["part", "value"]).groupBy("row").agg(
        F.first("vec_id").alias("vec_id"), F.first("label").alias("label"),
        F.array_sort(F.collect_list(F.struct("part", "entry"))).alias("codes"), F.sum("away").alias("error"),
    )
    hex_ = F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c["entry"]), 2, "0")))
    return back.select("vec_id", "label", F.array_join(hex_, "").alias("code"), "error"), codebooks


def decoded(codes: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """The rows with the vector that their code stands for, as `approximation`."""
    parts = codebooks.shape[0]
    books = codebooks.astype(float) / SCALE

    @F.pandas_udf("array<double>")
    def vector(code: pd.Series) -> pd.Series:
        return code.map(lambda c: np.concatenate([books[k, int(c[2 * k : 2 * k + 2], 16)] for k in range(parts)]).tolist())

    return codes.withColumn("approximation", vector("code"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code and errors.  Null and non-finite vectors take no part, repeated ids are rows of their own, an empty
    table gives no rows."""
    codes, codebooks = compressed(table(spark, sf_dir, "embeddings"))
    codes = stored(codes)
    labels = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    joined = codes.join(labels.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def _sql() -> str:
    rounds = []
    for k in range(1, ROUNDS + 2):
        rounds.append(f"""a{k} AS (SELECT x.vec_id, x.label, x.part, x.v, n.entry, n.away FROM x JOIN (
  SELECT vec_id, part, entry, away FROM (SELECT x.vec_id, x.part, c.entry,
    CAST(list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i]))) AS BIGINT) AS away FROM x JOIN c{k} c USING (part))
  QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY away, entry) = 1) n USING (vec_id, part)),
s{k} AS (SELECT part, entry, pos, CAST(sum(val) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, entry, unnest(v) AS val, generate_subscripts(v, 1) AS pos FROM a{k}) GROUP BY part, entry, pos),
m{k} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS v FROM s{k} GROUP BY part, entry),
c{k + 1} AS (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (part, entry))""")
    last = ROUNDS + 1
    return f"""
WITH w AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, label, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS v FROM w, (SELECT unnest(range({PARTS})) AS part)),
c1 AS (SELECT part, v, entry FROM (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM x) WHERE entry < {ENTRIES}),
{", ".join(rounds)},
coded AS (SELECT vec_id, any_value(label) AS label, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, CAST(sum(away) AS BIGINT) AS error FROM a{last} GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS d FROM c{last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT d FROM book) AS codebooks_sha256 FROM coded
"""


SQL = _sql()
