"""Confidence tiers of measurements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATUSES = ("MEASURED", "DERIVED", "ASSUMED")


def status(source: Column, rule_version: Column) -> Column:
    """Null for a derived value without a rule version; status_error tells why."""
    return (
        F.when(source.isin("vector", "raster"), "MEASURED")
        .when(source.isin("assembly_rule", "formula"), F.when(F.coalesce(rule_version, F.lit("")) != "", "DERIVED"))
        .otherwise("ASSUMED")
    )


def status_error(source: Column, rule_version: Column) -> Column:
    return F.when(source.isin("assembly_rule", "formula") & (F.coalesce(rule_version, F.lit("")) == ""), "rule_version is required")


def is_valid(value: Column) -> Column:
    return F.coalesce(value.isin(*STATUSES), F.lit(False))


# fixed value: what a measurement from a scanned sheet scores
RASTER_SCORE = 0.6


def raster_score(base: Column | None = None) -> Column:
    """The score of a measurement from a scanned sheet: the given one, RASTER_SCORE where none is."""
    return F.lit(RASTER_SCORE) if base is None else F.coalesce(base.cast("double"), F.lit(RASTER_SCORE))


def score(tier: Column, raster: Column, rule_version: Column) -> Column:
    return (
        F.when(tier == "MEASURED", F.when(raster, raster_score()).otherwise(1.0))
        .when(tier == "DERIVED", F.when(rule_version == "1.0.0", 0.8).otherwise(0.7))
        .when(tier == "ASSUMED", 0.3)
        .otherwise(0.5)
    )


def pipeline_score(source: Column, rule_version: Column) -> Column:
    """The score that goes with a measurement's source; sheets that were scanned count as measured here."""
    return score(status(source, rule_version), F.lit(False), rule_version)


def display(tier: Column) -> Column:
    """Label and colour of a tier; unknown tiers show as assumed."""
    # fixed values: labels and colours
    return F.when(tier == "MEASURED", "Measured/green").when(tier == "DERIVED", "Derived/purple").otherwise("Assumed/red")
