"""Scales, legends, layers and units in drawing texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of scales, strict (in order of precedence), loose, and those that settle a sheet's scale.
STRICT = [r"\bELECTRICAL\.SCALE\s+(1:\d+)\b", r"\bSCALE\s+1=(\d+)'''-0\"\b", r"\b(1:\d+)\b"]
LOOSE = [r"\b(\d+\.\d+:\d+)\b", r"\b(\d+:\d+)\b", r"\b(1/4|1/2|1/8)\"=1'-0\"\b"]
ARCHITECTURAL = [r"\b(1/4|1/2|1/8)\"=1'-0\"\b", r"\b(1:\d+)\b"]
DEFAULT_SCALE = "1:100"
# Words that make a text a legend candidate, and that rule a legend entry out.
LEGEND_WORDS = ["legend", "symbol", "key", "table", "note", "scale"]
NOT_ENTRIES = ["scale", "1:", "drawing", "project"]
# Layers that mark a drawing as electrical.
ELECTRICAL_LAYERS = ["LIGHTING", "POWER", "SWITCHES", "CONDUIT", "CABLE_TRAY", "DISTRIBUTION_BOARD", "AC", "GROUND"]


def first_scale(text: Column, patterns: list[str]) -> Column:
    """struct(rank, scale) of the first pattern that matches, else null."""
    found = [F.struct(F.lit(k).alias("rank"), F.regexp_extract(text, p, 1).alias("scale")) for k, p in enumerate(patterns)]
    out = F.when(text.rlike(patterns[0]), found[0])
    for p, s in zip(patterns[1:], found[1:]):
        out = out.when(text.rlike(p), s)
    return out


def needs_review(text: Column, patterns: int = 3) -> Column:
    """Over a group of texts: whether none settles the scale; empty and null texts don't."""
    hits = [text.rlike(p) for p in ARCHITECTURAL[:patterns]]
    found = hits[0]
    for h in hits[1:]:
        found = found | h
    return ~F.coalesce(F.bool_or(found), F.lit(False))


def scale_denominator(scale: Column) -> Column:
    """What follows the colon; 1 where there is no number."""
    return F.coalesce(F.try_element_at(F.split(scale, ":"), F.lit(2)).try_cast("double"), F.lit(1.0))


def unit_of(material: Column) -> Column:
    """Metres for what is drawn as a run, else each."""
    return F.when(F.lower(material).contains("cable") | F.lower(material).contains("conduit"), "m").otherwise("ea")


# Shapes of schedule entries: a label with a unit and a value, a slope with a run, a block's letter and number.
SCHEDULE_SHAPES = {"labelled": r"([^():%]+?)\s*\(([^()]+)\)\s*:\s*(\S+)", "slope": r"%\s*(\d+(?:\.\d+)?)()\s*-\s*(\d+(?:\.\d+)?)\s*cm", "numbered": r"\b([A-Z]+)-([A-Z])(\d{2})\b"}


def schedule_entry(text: Column) -> Column:
    """struct(shape, label, unit, value) of the first shape that a schedule text has, else null: what no shape fits is left
    for a reviewer.  A slope's label is its per cent and its unit cm; a numbered one's unit is its letter."""
    out = F.lit(None)
    for shape, pattern in reversed(SCHEDULE_SHAPES.items()):
        part = lambda k, p=pattern: F.trim(F.regexp_extract(text, p, k))
        unit = F.lit("cm") if shape == "slope" else part(2)
        out = F.when(text.rlike(pattern), F.struct(F.lit(shape).alias("shape"), part(1).alias("label"), unit.alias("unit"), part(3).alias("value"))).otherwise(out)
    return out


def is_symbol_name(text: Column) -> Column:
    return text.rlike(r"^[\p{L}\p{N}_]{2,40}$")


def titled(text: Column) -> Column:
    """Capitals after every character that is no letter."""
    parts = F.split(F.lower(text), r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 100_000))), "")


def legend_entry(text: Column) -> Column:
    """struct(name, description) of "name: description", "description (name)" or a lone name; else null."""
    t = F.trim(text)
    low = F.lower(t)
    cut = F.instr(low, ":")
    name, described = F.trim(F.substring_index(low, ":", 1)), F.trim(F.regexp_extract(low, r"^[^:]*:(?s)(.*)$", 1))
    inside, before = F.trim(F.regexp_extract(low, r"\(([^)]+)\)", 1)), F.trim(F.regexp_extract(low, r"^(.*?)\([^)]+\)", 1))
    pair = lambda a, b: F.struct(a.alias("name"), b.alias("description"))
    ruled_out = low.contains(NOT_ENTRIES[0])
    for w in NOT_ENTRIES[1:]:
        ruled_out = ruled_out | low.contains(w)
    return (
        F.when(ruled_out | (low == ""), None)
        .when((cut > 0) & is_symbol_name(name) & (described != ""), pair(name, described))
        .when(low.rlike(r"\([^)]+\)") & is_symbol_name(inside) & (before != ""), pair(inside, before))
        .when(is_symbol_name(low), pair(low, titled(low)))
    )


def is_legend_candidate(text: Column) -> Column:
    words = F.size(F.split(F.trim(text), r"\s+"))
    return F.lower(text).rlike("|".join(LEGEND_WORDS)) | words.between(3, 20)


def in_top(y0: Column, height: Column) -> Column:
    """Whether a text stands in the top fifth of its page, where legends are."""
    return y0 < 0.20 * height
