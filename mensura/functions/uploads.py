"""What kind of drawing an upload is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# More drawing objects than this make a vector file, fewer than that a scanned one.
MANY, FEW = 10_000, 100


def counters(objects: DataFrame, upload: str, page: int | None = None) -> DataFrame:
    """vectors, images and has_text of every upload, from its objects (kind: vector or image, is_text); with a page, of that one only
    (page_number): an upload whose page is empty has zeros."""
    there = F.lit(True) if page is None else F.coalesce(F.col("page_number") == page, F.lit(False))
    n = lambda kind, name: F.count_if(there & (F.col("kind") == kind)).alias(name)
    return objects.groupBy(upload).agg(n("vector", "vectors"), n("image", "images"), F.coalesce(F.bool_or(there & F.col("is_text")), F.lit(False)).alias("has_text"))


def classified(objects: DataFrame, upload: str) -> DataFrame:
    """The counters of every upload's first page, its status and whether that is ambiguous."""
    facts = F.col("vectors"), F.col("images"), F.col("has_text")
    return counters(objects, upload, page=1).withColumn("status", status(*facts)).withColumn("ambiguous", ambiguous(*facts))


def is_vector(drawings: Column, has_text: Column) -> Column:
    return (drawings > MANY) & has_text


def is_raster(drawings: Column, images: Column, has_text: Column) -> Column:
    return (drawings < FEW) & (images > 0) & ~has_text


def status(drawings: Column, images: Column, has_text: Column) -> Column:
    """vector or raster; what is neither counts as vector, a file that could not be read (null) as raster."""
    unread = drawings.isNull() | images.isNull() | has_text.isNull()
    return F.when(unread | is_raster(drawings, images, has_text), "raster").otherwise("vector")


def ambiguous(drawings: Column, images: Column, has_text: Column) -> Column:
    return ~F.coalesce(is_vector(drawings, has_text) | is_raster(drawings, images, has_text), F.lit(True))
