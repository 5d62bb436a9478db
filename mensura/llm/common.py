"""What several operators share: batches for Python tasks, stored intermediate tables, sampling by hash."""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handed to Python at a time: batches are cut again, so that memory doesn't follow Arrow's row count.
SLICE_CHARS = 4_000_000
SLICE_ROWS = 500
#: Slots of a sieve for each of its keys, and fewest and most of them (32 MB of bits).
SIEVE_SLOTS, LEAST_SLOTS, MOST_SLOTS = 32, 1 << 16, 1 << 28


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where that is unset (tests, local mode)
    a fresh temporary folder is set."""
    name = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if name is None and context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(name)
    return name or context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder, so that they outlive lost executors and are not
    computed again; Spark's cleaner removes the files once nothing refers to them."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def over_batches(df: DataFrame, schema: str, start: Callable[[], Callable[[dict[str, list]], Iterable[tuple]]]) -> DataFrame:
    """mapInArrow with plain Python lists: in every task start() makes a function (with its own caches) that
    turns the columns of a batch into an iterable of result rows."""
    names = [x.split()[0].strip("`") for x in schema.split(",")]
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for part in _sliced(batch):
                rows = list(work({n: c.to_pylist() for n, c in zip(part.schema.names, part.columns)}))
                columns = list(zip(*rows)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)

    return df.mapInArrow(run, schema)


def scored(name: str, start: Callable[[], Callable[[list], Iterable[float]]]) -> Column:
    """A double column made from a text column by a function with caches of its own in every task."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        work = start()
        for batch in batches:
            yield pd.Series([x for at in range(0, len(batch), SLICE_ROWS) for x in work(batch.iloc[at : at + SLICE_ROWS].tolist())], dtype="float64")

    return run(F.col(name))


def sieve(keys: DataFrame) -> Callable[..., Column]:
    """Tells of columns, in the order and of the types of the keys' columns, whether they may be one of the keys: true for all that
    are, and for about one in SIEVE_SLOTS of the others (more once MOST_SLOTS are not enough).  All tasks get bits of the keys'
    hashes, so that wide rows that meet none of the keys need no shuffle."""
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (SIEVE_SLOTS * keys.count()).bit_length()))
    slot = lambda *columns: F.pmod(F.xxhash64(*columns, F.lit(29)), F.lit(slots))
    taken = keys.select((slot(*keys.columns) + 1).alias("slot"))
    parts = taken.groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    bits = np.zeros(slots // 8, np.uint8)
    for r in parts.toLocalIterator():  # MOST_SLOTS bits at most
        bits[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def may(at: pd.Series) -> pd.Series:
        k = at.to_numpy()
        return pd.Series((shared.value[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1)

    return lambda *columns: may(slot(*columns))


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about SLICE_CHARS bytes each."""
    step = max(1, int(batch.num_rows * SLICE_CHARS / max(SLICE_CHARS, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def fold(name: str | Column, k: int) -> Column:
    """crc32 of the id as text, modulo k: what splits labelled rows into learning and held-out rows."""
    return F.crc32(F.col(name).cast("string") if isinstance(name, str) else name.cast("string")) % k


def held_out(name: str, k: int, remainder: int) -> Column:
    """Whether a row is held out; a row without an id is not."""
    return F.coalesce(fold(name, k) == remainder, F.lit(False)).alias("held_out")


def fold_of(doc_id: int, k: int) -> int:
    """The same in Python."""
    return zlib.crc32(str(doc_id).encode()) % k


def smallest_hashes(df: DataFrame, key: str, n: int) -> DataFrame:
    """A sample of at most n rows: those whose key has the smallest hashes.  It covers the whole input evenly, is
    the same for any partitioning, and sorts no more than n rows in a task."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(17)), key).limit(n)


def range_of(value: Column, bounds: list) -> Column:
    """How many of the sorted bounds lie below a value: counted among every w-th bound first, then within w of them,
    so that thousands of ranges stay cheap for each row."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    every = F.lit(bounds[width - 1 :: width])
    below = lambda xs: F.size(F.filter(xs, lambda b: b < value))
    coarse = below(every) * width
    return coarse + below(F.slice(F.lit(bounds), coarse + 1, width))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
