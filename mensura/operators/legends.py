"""Symbols and a sheet's own legend: matches by containment, found by an index of short runs of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a run.
GRAM = 3


def _grams(text: Column, n: Column) -> Column:
    """The distinct runs of n characters of a text; an empty list where it is shorter."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda k: F.substr(text, k, n)))


def contained(needles: DataFrame, haystacks: DataFrame, group: str = "page") -> DataFrame:
    """group, needle, haystack: every text of the one side (group, text) that is part of a text of the other, in the same group.

    A needle is looked up by that of its runs of characters which the fewest haystacks of the group have, so the rows that meet
    follow what is rare, not the product of the two sides; a needle with a run that no haystack has meets none.  Needles shorter
    than a run are runs of their own, the empty one is part of all."""
    small = needles.select(F.col(group).alias("g"), F.col("text").alias("needle")).filter("needle IS NOT NULL").distinct()
    large = haystacks.select(F.col(group).alias("g"), F.col("text").alias("haystack")).filter("haystack IS NOT NULL").distinct()
    sizes = F.array(*[F.lit(n) for n in range(GRAM + 1)])
    runs = F.flatten(F.transform(sizes, lambda n: F.when(n == 0, F.array(F.lit(""))).otherwise(_grams(F.col("haystack"), n))))
    posted = large.select("g", "haystack", F.explode(runs).alias("gram"))
    often = posted.groupBy("g", "gram").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.length("needle") == 0, F.array(F.lit(""))).otherwise(_grams(F.col("needle"), F.least(F.length("needle"), F.lit(GRAM))))
    asked = small.select("g", "needle", F.explode(own).alias("gram")).join(often, ["g", "gram"], "left")
    rarest = asked.groupBy("g", "needle").agg(F.min(F.struct(F.col("n").isNotNull().alias("known"), "n", "gram")).alias("m")).filter("m.known")
    met = rarest.select("g", "needle", "m.gram").join(posted, ["g", "gram"]).filter(F.col("haystack").contains(F.col("needle")))
    return met.select(F.col("g").alias(group), "needle", "haystack")


def matched(symbols: DataFrame, entries: DataFrame, group: str = "page") -> DataFrame:
    """The symbols (group, symbol) that an entry (group, name, description, ord) of their legend explains, with legend_key,
    description, method and confidence: the entry of the same name whatever the case, else the first whose name contains
    the symbol or is contained in it.  Equal symbols are looked up once."""
    wanted = symbols.select(group, F.lower("symbol").alias("text"))
    keys = entries.select(group, "name", "description", "ord", F.lower("name").alias("key"))
    names = keys.select(group, F.col("key").alias("text"))
    within, around = contained(wanted, names, group), contained(names, wanted, group)
    pairs = within.select(group, F.col("needle").alias("low"), F.col("haystack").alias("key")).union(around.select(group, F.col("haystack").alias("low"), F.col("needle").alias("key"))).distinct()
    same = F.col("low") == F.col("key")
    entry = F.struct(F.col("name").alias("legend_key"), "description", same.alias("same"))
    best = pairs.join(keys, [group, "key"]).groupBy(group, "low").agg(F.min_by(entry, F.struct(~same, "ord")).alias("m"))
    method = F.when(F.col("m.same"), "exact_match").otherwise("substring_match")
    found = symbols.withColumn("low", F.lower("symbol")).join(best, [group, "low"])
    return found.select(*symbols.columns, "m.legend_key", "m.description", method.alias("method"), F.when(F.col("m.same"), 1.0).otherwise(0.7).alias("confidence"))
