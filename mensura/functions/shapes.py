"""Areas, volumes and layer classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes of layer names, first match counts; the last takes the rest.
LAYER_CLASSES = [("electrical", "(?i)light|switch|socket|power|^db$|^e-"), ("containment", "(?i)tray|conduit"), ("security", "(?i)access|security|^ac$"), ("architecture", "(?i)wall|door"), ("unclassified", "")]


def layer_class(layer: Column) -> Column:
    out = F.when(layer.isNull(), LAYER_CLASSES[-1][0])
    for name, pattern in LAYER_CLASSES[:-1]:
        out = out.when(layer.rlike(pattern), name)
    return out.otherwise(LAYER_CLASSES[-1][0])


def doubled_area(points: Column) -> Column:
    """Twice the signed area of a polygon array<struct<x,y>>, by the shoelace formula."""
    n = F.size(points)
    term = lambda k: points[k]["x"] * points[(k + 1) % n]["y"] - points[(k + 1) % n]["x"] * points[k]["y"]
    return F.when(n < 3, 0.0).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0.0), lambda acc, k: acc + term(k)))


def area(points: Column) -> Column:
    return F.abs(doubled_area(points)) / 2


def volume(surface: Column, thickness: Column, waste: Column) -> Column:
    return surface * thickness * (1 + waste)
