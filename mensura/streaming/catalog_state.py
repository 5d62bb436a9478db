"""The stored catalog as keyed state: files of prices and labor rates land on a stream, and each key's last row is held.

Every row has a version, (file, row): the name of its file and its number there.  State holds for each key the values of
the largest version met so far, so files may land in any order and any number of times: what is held is what a batch import of all files
in the order of their names gives.  Prices are overwritten as a whole; of labor rates the category and the dates are
overwritten by given ones only, each with a version of its own.  A key whose held values change is emitted once per
micro-batch, as they stand after it; a batch's changes are one folder, which a repeated batch overwrites.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from mensura.operators import catalog, spatial
from mensura.sources.workbooks import workbook_rows

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Columns of a stored row by its kind: the key, those that are overwritten together, and those that only given values overwrite.
KEYS = {"prices": ["material_name", "currency"], "labor": ["name"]}
TOGETHER = {"prices": ["unit_price", "effective_from", "effective_to"], "labor": ["productivity_rate", "hourly_rate"]}
GIVEN = {"prices": [], "labor": ["category", "effective_from", "effective_to"]}
TYPES = {"material_name": "string", "currency": "string", "name": "string", "category": "string", "unit_price": "double", "productivity_rate": "double", "hourly_rate": "double", "effective_from": "date", "effective_to": "date"}


def _ddl(columns: list[str]) -> str:
    return ", ".join(f"{c} {TYPES[c]}" for c in columns)


def _groups(kind: str) -> list[list[str]]:
    """Columns that share a version."""
    return [TOGETHER[kind], *([c] for c in GIVEN[kind])]


class LastRow(StatefulProcessor):
    """Holds the last values of a key and emits them where they have changed."""

    def __init__(self, kind: str):
        self.keys, self.groups = KEYS[kind], _groups(kind)
        self.columns = [c for g in self.groups for c in g]
        versions = ", ".join(f"file{k} string, row{k} long" for k in range(len(self.groups)))
        self.stored = StructType.fromDDL(f"{versions}, {_ddl(self.columns)}")  # here, where there is a session

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", self.stored)

    def _read(self) -> tuple[list[tuple | None], dict[str, Any]]:
        if not self.held.exists():
            return [None] * len(self.groups), dict.fromkeys(self.columns)
        *versions, rest = self._split(self.held.get())
        return versions, rest

    def _split(self, stored: tuple) -> list:
        n = 2 * len(self.groups)
        pairs = [None if stored[k] is None else (stored[k], stored[k + 1]) for k in range(0, n, 2)]
        return [*pairs, dict(zip(self.columns, stored[n:]))]

    def _write(self, versions: list[tuple | None], values: dict[str, Any]) -> None:
        flat = [x for v in versions for x in (v or (None, None))]
        self.held.update((*flat, *(values[c] for c in self.columns)))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        versions, values = self._read()
        known, before = any(v is not None for v in versions), dict(values)
        newest = list(versions)
        for row in rows:
            version = (row["file"], row["row"])
            for k, group in enumerate(self.groups):
                if k and row[group[0]] in (None, ""):
                    continue
                if newest[k] is None or version > newest[k]:
                    newest[k] = version
                    values.update({c: row[c] for c in group})
        if newest == versions:
            return
        self._write(newest, values)
        if not known or values != before:
            yield Row(**dict(zip(self.keys, key)), **values, change="update" if known else "insert")

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        values = {c: initialState[c] for c in self.columns}
        # stored rows come before every file
        versions = [("", 0) if k == 0 or values[g[0]] is not None else None for k, g in enumerate(self.groups)]
        self._write(versions, values)

    def close(self) -> None:
        pass


def changes(rows: DataFrame, kind: str, existing: DataFrame | None = None) -> DataFrame:
    """The stream of changed keys over a stream of good rows (the columns of `kind`, file, row); existing is the catalog that
    was stored before."""
    keys, columns = KEYS[kind], [c for g in _groups(kind) for c in g]
    out = StructType.fromDDL(f"{_ddl(keys + columns)}, change string")
    before = None if existing is None else existing.select(*keys, *[F.col(c).cast(TYPES[c]).alias(c) for c in columns]).groupBy(*keys)
    grouped = rows.select(*keys, *columns, F.col("file"), F.col("row").cast("long").alias("row")).groupBy(*keys)
    return grouped.transformWithState(LastRow(kind), out, "Update", "None", initialState=before)


def store(changed: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts writing a stream of changes; state is kept in RocksDB and in the checkpoint folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    conf = changed.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        return changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)


def current(spark: SparkSession, folder: str, kind: str, existing: DataFrame | None = None) -> DataFrame:
    """The catalog as it stands: each key's values after its last change, else the existing ones."""
    keys, columns = KEYS[kind], [c for g in _groups(kind) for c in g]
    written = spark.read.schema(f"{_ddl(keys + columns)}, change string, batch long").parquet(folder)
    rows = written.select(*keys, *columns, "batch")
    if existing is not None:
        before = existing.select(*keys, *[F.col(c).cast(TYPES[c]).alias(c) for c in columns], F.lit(-1).cast("long").alias("batch"))
        rows = rows.unionByName(before)
    last = F.max_by(F.struct(*columns), "batch").alias("r")
    return rows.groupBy(*keys).agg(last).select(*keys, "r.*")


def _csv_rows(content: bytes) -> tuple[list[str], list[dict[str, str]]]:
    reader = csv.reader(io.StringIO(content.decode("utf-8-sig")))
    names = [n.strip() for n in next(reader, [])]
    return names, [{n: v.strip() for n, v in zip(names, line)} for line in reader if line]


def landed_files(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """The rows of CSV files and workbooks as they land in a folder: file, row, header (its names, lower case), cells.
    One task reads a file; catalog files are made by hand."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                names, rows = workbook_rows(content) if path.lower().endswith(".xlsx") else _csv_rows(content)
                header = [n.lower() for n in names if n]
                yield pd.DataFrame({"file": path.rsplit("/", 1)[-1], "row": range(2, len(rows) + 2), "header": [header] * len(rows), "cells": rows})

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_at_once).load(folder)
    return files.select("path", "content").mapInPandas(parse, "file string, row long, header array<string>, cells map<string,string>")


def import_files(spark: SparkSession, folder: str, out: str, checkpoint: str, existing: dict[str, DataFrame] | None = None) -> dict[str, StreamingQuery]:
    """Imports the files that land in a folder: good material rows change the stored prices, good labor rows the rates."""
    names = sorted({c for cs in catalog.NEEDED.values() for c in cs} | {"category", "effective_from", "effective_to"})
    started = {}
    for kind, accepted in (("prices", catalog.accepted_prices), ("labor", catalog.accepted_labor)):
        rows = landed_files(spark, folder)
        wide = rows.select("file", "row", "header", *[F.coalesce(F.try_element_at("cells", F.lit(n)), F.lit("")).alias(n) for n in names])
        good = accepted(catalog.validated(wide, by="file"), "file")
        started[kind] = store(changes(good.withColumnRenamed("seq", "row"), kind, (existing or {}).get(kind)), f"{out}/{kind}", f"{checkpoint}/{kind}")
    return started


def scratch(spark: SparkSession) -> str:
    """A folder of its own below the shared checkpoint folder."""
    return f"{spatial.checkpoint_folder(spark)}/{uuid.uuid4().hex}"
