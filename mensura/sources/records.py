"""Extracted records and catalog files as DataFrames: nested spans, layer registries, CSV and XLSX catalogs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mensura.operators.spatial import kept
from mensura.sources.workbooks import workbook_rows

PATHS_SCHEMA = "sheet string, page_number int, ordinal long, id string, type string, items array<struct<op:string,pts:array<struct<x:double,y:double>>>>, bbox struct<x0:double,y0:double,x1:double,y1:double>, layer string, width double"
SPANS_SCHEMA = "sheet string, page_number int, ordinal long, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, font string, size double"


def record_id(*names: str):
    """A reproducible id of a record."""
    return F.sha2(F.concat_ws("|", *[F.col(n).cast("string") for n in names]), 256)


def flatten_spans(pages: DataFrame) -> DataFrame:
    """Text spans of pages with blocks: array<struct<lines: array<struct<spans: array<struct<text, font, size>>>>>>, in
    page order; fonts and sizes that are missing get their defaults."""
    blocks = pages.select("page_number", F.posexplode("blocks").alias("b", "block"))
    lines = blocks.select("page_number", "b", F.posexplode("block.lines").alias("l", "line"))
    spans = lines.select("page_number", "b", "l", F.posexplode("line.spans").alias("s", "span"))
    return spans.select("page_number", "b", "l", "s", F.col("span.text").alias("text"), F.coalesce("span.font", F.lit("unknown")).alias("font"), F.coalesce("span.size", F.lit(12.0)).alias("size"))


def layer_registry(groups: DataFrame, *by: str) -> DataFrame:
    """name, status, count of every layer (of each sheet, where that is given): the last record of a name counts; `default` is
    added where it is missing."""
    last = groups.groupBy(*by, "name").agg(F.max_by(F.struct("status", "count"), F.struct("ordinal")).alias("r")).select(*by, "name", "r.status", "r.count")
    default = groups.sparkSession.createDataFrame([("default", "ON", 0)], "name string, status string, count long")
    if by:
        default = groups.select(*by).distinct().crossJoin(default)  # one row for each sheet
    return last.unionByName(default.join(last.select(*by, "name"), [*by, "name"], "left_anti"))


def in_page_order(records: DataFrame) -> DataFrame:
    """Records (sheet, page_number, ordinal) with `position`, their number (from 0) within their sheet, page by page.  A sheet
    is one file, so a window holds no more than a file did."""
    order = W.partitionBy("sheet").orderBy("page_number", "ordinal")
    return records.withColumn("position", F.row_number().over(order) - 1)


def read_table(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 1, **options: str) -> DataFrame:
    """A table of a database by JDBC; with a numeric column and its bounds it is read by `parts` tasks, each a range of the
    column's values (rows outside the bounds are read by the first and last)."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column is not None:
        reader = reader.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def read_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """Catalog files with all values as trimmed strings and a `row` number that starts at 2 in each file."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    named = raw.select(*[F.trim(F.col(f"`{c}`")).alias(c.lstrip("\ufeff").strip()) for c in raw.columns])
    order = named.withColumn("__order", F.monotonically_increasing_id()).withColumn("__file", F.input_file_name())
    return order.withColumn("row", F.row_number().over(W.partitionBy("__file").orderBy("__order")) + 1).drop("__order", "__file")


def read_catalog_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The active sheets of workbooks, as read_catalog_csv gives files (empty and zero cells are empty strings), also on stores
    that only Spark reaches.  Each workbook is read once, by one task; the driver gets the column names only, which
    workbooks without rows have, too."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                names, rows = workbook_rows(content)
                yield pd.DataFrame({"row": range(1, len(rows) + 2), "cells": [dict.fromkeys(names, ""), *rows], "names": [names] + [[]] * len(rows)})

    found = kept(spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "row int, cells map<string,string>, names array<string>"))
    names = [r["n"] for r in found.filter("row = 1").select(F.posexplode("names").alias("k", "n")).groupBy("n").agg(F.min("k").alias("k")).orderBy("k", "n").collect()]
    return found.filter("row > 1").select("row", *[F.coalesce(F.try_element_at("cells", F.lit(n)), F.lit("")).alias(n) for n in names])
