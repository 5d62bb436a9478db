"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The fields of a bill-of-quantities line.
LINE = ["assembly_type", "material_name", "quantity", "unit_price", "total_cost", "unpriced", "confidence_status", "source_path_ids"]


def as_json(lines: DataFrame) -> DataFrame:
    """One JSON object per line of a bill of quantities, fields in their order, nulls kept."""
    return lines.select(F.to_json(F.struct(*LINE), {"ignoreNullFields": "false"}).alias("value"))


def write_boq(lines: DataFrame, path: str) -> None:
    """JSON lines, in as many files as the lines have partitions."""
    as_json(lines).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet, partitioned by the given columns (sheets, layers) so that later reads can skip the rest."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
