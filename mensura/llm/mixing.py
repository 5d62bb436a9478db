"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Each source gets an integer share of a period of `quota` slots.  Block k of a source with share a is released at
floor((k-1) * quota / a) and due at ceil(k * quota / a); an earliest-deadline-first pass over one period gives every
slot to a released block.  As the shares add up to the period, each block lies inside its window, so at any slot a
source deviates from its share by less than one block.  Weights that are given for all sources, as numbers whose
proportions fit a period of SLOTS_PER_SOURCE * quota slots, are met exactly: the period is the sum of those proportions
in whole numbers, and the bound holds against the target weight over the whole mixture.  Other weights (the default ones
are roots) are rounded to a period of `quota` slots, with one slot at least: against the weight itself the deviation
then grows by up to that rounding every period.  The schedule repeats every period, whatever the input's size.  With
more sources than `quota` the period grows to SLOTS_PER_SOURCE slots a source; there, and for exact weights, the slots are
dealt on the driver with a heap.  Rows of a source are numbered by doc_id within ranges of doc_id, so that a source with
most of the rows is numbered by many tasks.

No row is dropped or repeated.  Once a source has run out, its slots stay empty and the rest keep their relative
weights.  A null source is a source of its own; a null doc_id comes first in its source; repeated rows keep
their own places.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import range_of, stored, table

#: Slots in a period, rows in a block, and the power of a source's row count that gives its target weight.
QUOTA, BLOCK_ROWS, POWER = 1000, 16, 0.5
SLOTS_PER_SOURCE = 16
#: Rows of sources x ranges that are broadcast at most; beyond, they are joined by an exchange.
MOST_SHIFTS = 200_000


def _key(source: str) -> Column:
    return F.when(F.col(source).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(source)))


def shares(docs: DataFrame, quota: int = QUOTA, power: float = POWER, weights: dict[str, float] | None = None) -> DataFrame:
    """key, rows, share of every source.  Weights (by source) default to rows ** power.  Each source gets one slot,
    the rest go by weight, what rounding leaves to the largest fractions, ties to the smaller key."""
    counts = docs.groupBy(_key("source").alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    weight = F.pow("rows", F.lit(power)) if power != 0.5 else F.sqrt("rows")
    if weights is not None:
        given = F.create_map(*[F.lit(x) for k, v in weights.items() for x in ("=" + k, float(v))])
        weight = F.coalesce(F.element_at(given, F.col("key")), F.lit(0.0))
    one = W.partitionBy(F.lit(1))  # as many rows as sources, at most one per slot
    spread = counts.withColumn("weight", weight.cast("double"))
    spread = spread.withColumn("weights", F.sort_array(F.collect_list("weight").over(one)))
    total = F.aggregate("weights", F.lit(0.0), lambda a, b: a + b)
    spread = spread.withColumn("n", F.size("weights")).withColumn("exact", F.when(total > 0, (F.lit(quota) - F.col("n")) * (F.col("weight") / total)).otherwise(F.lit(0.0)))
    spread = spread.withColumn("base", F.floor("exact") + 1)
    ranked = W.partitionBy(F.lit(1)).orderBy((F.col("exact") - F.floor("exact")).desc(), "key")
    spread = spread.withColumn("left_over", F.lit(quota) - F.sum("base").over(one)).withColumn("rank", F.row_number().over(ranked))
    extra = F.floor(F.col("left_over") / F.col("n")) + F.when(F.col("rank") <= F.col("left_over") % F.col("n"), 1).otherwise(0)
    share = F.when(F.col("n") > quota, F.raise_error(F.lit(f"more sources than the {quota} slots of a period")).cast("long")).otherwise(F.col("base") + extra)
    return spread.select("key", "rows", share.cast("long").alias("share"))


def schedule(shared: DataFrame, quota: int = QUOTA) -> DataFrame:
    """key, k, slot, release, deadline: the k-th block of each source in one period, by earliest deadline first."""
    row = shared.agg(F.sort_array(F.collect_list(F.struct("key", "share"))).alias("sources")).filter(F.size("sources") > 0)
    q, share = F.lit(quota).cast("long"), lambda i: F.col("sources")[i]["share"]
    due = lambda c, i: F.ceil((c + 1) * q / share(i)).cast("long")

    def step(state: Column, t: Column) -> Column:
        ready = F.transform(state["done"], lambda c, i: F.when(F.floor(c * q / share(i)) <= t, F.struct(due(c, i).alias("due"), i.alias("i"))))
        pick = F.array_min(ready)["i"]
        done = F.transform(state["done"], lambda c, i: c + F.when(i == pick, 1).otherwise(0).cast("long"))
        return F.struct(done.alias("done"), F.concat(state["picks"], F.array(pick)).alias("picks"))

    start = F.struct(F.transform("sources", lambda _: F.lit(0).cast("long")).alias("done"), F.array().cast("array<int>").alias("picks"))
    folded = row.select("sources", F.aggregate(F.sequence(F.lit(0), q - 1), start, step)["picks"].alias("picks"))
    slots = folded.select("sources", F.posexplode("picks").alias("slot", "i")).select(F.col("slot").cast("long"), F.col("sources")[F.col("i")].alias("s"))
    slots = slots.select("slot", F.col("s.key").alias("key"), F.col("s.share").alias("share"))
    return _windows(slots, quota)


def _windows(slots: DataFrame, period: int) -> DataFrame:
    """Slots (slot, key, share) with the number, release and deadline of their block."""
    q = F.lit(period).cast("long")
    slots = slots.withColumn("k", F.row_number().over(W.partitionBy("key").orderBy("slot")).cast("long"))
    release, deadline = F.floor((F.col("k") - 1) * q / F.col("share")), F.ceil(F.col("k") * q / F.col("share"))
    return slots.select("key", "share", "k", "slot", release.alias("release"), deadline.alias("deadline"))


def many_shares(rows: list[tuple[str, int]], period: int, power: float = POWER, weights: dict[str, float] | None = None) -> list[tuple[str, int]]:
    """(key, share) as `shares` deals them, for (key, rows) on the driver, by key."""
    rows = sorted(rows)
    weight = [float(n) ** power for _, n in rows] if weights is None else [float(weights.get(key[1:], 0.0)) if key != "-" else 0.0 for key, _ in rows]
    total = sum(sorted(weight))
    exact = [(period - len(rows)) * (w / total) if total > 0 else 0.0 for w in weight]
    share = [math.floor(x) + 1 for x in exact]
    left = period - sum(share)
    for rank, i in enumerate(sorted(range(len(rows)), key=lambda i: (math.floor(exact[i]) - exact[i], i))):
        share[i] += left // len(rows) + (rank < left % len(rows))
    return [(key, a) for (key, _), a in zip(rows, share)]


def many_slots(shares: list[tuple[str, int]], period: int) -> list[int]:
    """The number of the source of every slot of a period, as `schedule` picks it: released blocks wait in a heap by
    deadline, the next block of a source in another by release."""
    waiting = [(0, i) for i in range(len(shares))]
    done, ready, picks = [0] * len(shares), [], []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[i] + 1) * period // shares[i][1]), i))
        i = heapq.heappop(ready)[1]
        picks.append(i)
        done[i] += 1
        if done[i] < shares[i][1]:
            heapq.heappush(waiting, (done[i] * period // shares[i][1], i))
    return picks


def exact_shares(keys: list[str], weights: dict[str, float], most: int) -> list[tuple[str, int]] | None:
    """(key, share) by key, in exactly the proportions of the weights as they are written in decimals and in the smallest
    whole numbers; None if a source has no weight above 0 or the shares add up to more than `most`."""
    given = {"=" + k: Fraction(str(w)) for k, w in weights.items() if w > 0}
    if not keys or not given.keys() >= set(keys):
        return None
    common = math.lcm(*(given[k].denominator for k in keys))
    whole = {k: int(given[k] * common) for k in keys}
    by = math.gcd(*whole.values())
    return [(k, whole[k] // by) for k in sorted(keys)] if sum(whole.values()) // by <= most else None


def _dealt(spark: SparkSession, shared: list[tuple[str, int]]) -> DataFrame:
    """What `schedule` returns, for shares on the driver; the period is their sum."""
    period = sum(a for _, a in shared)
    slots = [(t, *shared[i]) for t, i in enumerate(many_slots(shared, period))]
    return _windows(spark.createDataFrame(slots, "slot long, key string, share long"), period)


def many(spark: SparkSession, rows: list[tuple[str, int]], period: int, power: float = POWER, weights: dict[str, float] | None = None) -> DataFrame:
    """What `schedule` returns, for more sources than slots."""
    return _dealt(spark, many_shares(rows, period, power, weights))


def numbered(docs: DataFrame, ranges: int | None = None, few: bool = True) -> DataFrame:
    """The rows with `key` and `nth`, their number (from 0) within their source by doc_id.  Rows are numbered
    within ranges of doc_id and then shifted by what earlier ranges hold; with few sources the shifts are broadcast."""
    ranges = ranges or max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(docs.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 1 / (4 * ranges)))) if ranges > 1 else []
    place = range_of(F.col("doc_id"), bounds)
    placed = docs.withColumn("key", _key("source")).withColumn("range", F.when(F.col("doc_id").isNull(), 0).otherwise(place))
    counts = placed.groupBy("key", "range").agg(F.count(F.lit(1)).alias("held"))
    before = F.coalesce(F.sum("held").over(W.partitionBy("key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(W.partitionBy("key", "range").orderBy(F.col("doc_id").asc_nulls_first())) - 1
    shifts = counts.select("key", "range", before.alias("before"))  # sources x ranges
    shifts = F.broadcast(shifts) if few and ranges <= MOST_SHIFTS // QUOTA else shifts  # few: at most QUOTA sources
    return placed.withColumn("within", within).join(shifts, ["key", "range"]).withColumn("nth", F.col("before") + F.col("within")).drop("range", "before", "within")


def mix(docs: DataFrame, quota: int = QUOTA, block_rows: int = BLOCK_ROWS, power: float = POWER, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, source, share, block, slot, release, deadline, position of every row.  `position` orders the mixture:
    by slot, then by number within the block."""
    counts = docs.groupBy(_key("source").alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    few = counts.limit(quota + 1).count() <= quota
    exact = None
    if weights and few:
        exact = exact_shares([r["key"] for r in counts.select("key").collect()], weights, SLOTS_PER_SOURCE * quota)  # at most `quota` sources
    if exact is not None:
        quota = sum(a for _, a in exact)
        plan = stored(_dealt(docs.sparkSession, exact))
    elif few:
        plan = stored(schedule(shares(docs, quota, power, weights), quota))
    else:
        held = [(r["key"], r["rows"]) for r in counts.collect()]
        quota = SLOTS_PER_SOURCE * len(held)
        plan = stored(many(docs.sparkSession, held, quota, power, weights))
    small = F.broadcast if few else lambda df: df  # few: at most SLOTS_PER_SOURCE * quota rows
    rows = numbered(docs.select("doc_id", "source"), few=few).withColumn("block", F.floor(F.col("nth") / block_rows))
    sized = small(plan.select("key", "share").distinct())
    rows = rows.join(sized, "key").withColumn("k", F.col("block") % F.col("share") + 1).withColumn("period", F.floor(F.col("block") / F.col("share")))
    rows = rows.join(small(plan.drop("share")), ["key", "k"])
    at = F.col("period") * quota
    slot = (at + F.col("slot")).alias("slot")
    position = (at + F.col("slot")) * block_rows + F.col("nth") % block_rows
    return rows.select("doc_id", "source", "share", (F.col("block") + 1).alias("block"), slot, (at + F.col("release")).alias("release"), (at + F.col("deadline")).alias("deadline"), position.alias("position"))


def places(docs: DataFrame, **options) -> DataFrame:
    """doc_id, position: the first place of every id in the mixture."""
    return mix(docs, **options).groupBy("doc_id").agg(F.min("position").alias("position"))


def mixed_order(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, with all their columns, in the mixture's order: range-partitioned and sorted by position.
    Rows of one id stand at the first of their places."""
    columns = [docs[c] for c in docs.columns]
    taken = {c.lower() for c in docs.columns}
    own, place = (next(n for n in (name + "_" * k for k in range(len(taken) + 1)) if n not in taken) for name in ("mixed_id", "mixed_position"))
    placed = docs.join(places(docs, **options).toDF(own, place), docs["doc_id"].eqNullSafe(F.col(own)), "left")
    return placed.repartitionByRange(place).sortWithinPartitions(place).select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's place.  A null source is a source, null ids come first in theirs, repeated rows have places of their
    own, an empty table gives no rows."""
    return mix(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE counts AS (
  SELECT CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS key, count(*) AS n FROM documents GROUP BY 1),
totals AS (SELECT list_sum(list(sqrt(n) ORDER BY sqrt(n))) AS w, count(*) AS s FROM counts),
parts AS (SELECT key, ({QUOTA} - s) * (sqrt(n) / w) AS exact, s FROM counts, totals),
based AS (SELECT *, floor(exact) + 1 AS base, row_number() OVER (ORDER BY exact - floor(exact) DESC, key) AS r FROM parts),
shared AS (SELECT key, CAST(base + (({QUOTA} - sum(base) OVER ()) // s) + CASE WHEN r <= ({QUOTA} - sum(base) OVER ()) % s THEN 1 ELSE 0 END AS BIGINT) AS share FROM based),
lists AS (SELECT list(share ORDER BY key) AS a, list(key ORDER BY key) AS names FROM shared),
edf AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(a, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick FROM lists
  UNION ALL
  SELECT t + 1, list_transform(range(1, len(done) + 1), lambda i: done[i] + CASE WHEN i = p THEN 1 ELSE 0 END), p
  FROM (SELECT t, done, list_min(list_transform(list_filter(range(1, len(done) + 1), lambda i: (done[i] * {QUOTA}) // a[i] <= t + 1),
    lambda i: ((done[i] + 1) * {QUOTA} + a[i] - 1) // a[i] * 100000 + i)) % 100000 AS p FROM edf, lists WHERE t < {QUOTA} - 1)),
plan AS (SELECT names[pick] AS key, a[pick] AS share, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) AS k FROM edf, lists WHERE t >= 0),
docs AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS key,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS nth FROM documents),
blocks AS (SELECT d.*, s.share, nth // {BLOCK_ROWS} AS b, (nth // {BLOCK_ROWS}) // s.share AS period, (nth // {BLOCK_ROWS}) % s.share + 1 AS k FROM docs d JOIN shared s USING (key))
SELECT doc_id, source, b.share AS share, b + 1 AS block, period * {QUOTA} + slot AS slot,
  period * {QUOTA} + ((b.k - 1) * {QUOTA}) // b.share AS release, period * {QUOTA} + (b.k * {QUOTA} + b.share - 1) // b.share AS deadline,
  (period * {QUOTA} + slot) * {BLOCK_ROWS} + nth % {BLOCK_ROWS} AS position
FROM blocks b JOIN plan p ON b.key = p.key AND b.k = p.k
"""
