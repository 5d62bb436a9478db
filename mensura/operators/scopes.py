"""Price sets of a scope (company, region, supplier) with days of validity: the price that is in force for a request."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCOPE = ("company", "region", "supplier")
KEY = ("material_name", "open", *SCOPE)
#: Days are counted from 1970 on; a price without a first or last day holds from or to these.
FIRST, LAST = -(1 << 31), (1 << 31) - 1
#: A request is looked up among the changes of its 2**SPAN days.
SPAN = 5


def _day(date: str) -> Column:
    return F.unix_date(F.col(date).cast("date"))


def _in_force(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(key, day, row or None): who is in force from a day on, of rows (key, since, until, ...) sorted by key, start and rank.  A row
    outranks those before it, so that whoever ends no later than it is never in force again: ends fall towards the top of the stack."""
    held: list[tuple] = []
    last: tuple | None = None

    def changes() -> Iterator[tuple]:
        nonlocal held
        key = None
        for row in rows:
            while held and (row[0] != key or held[-1][2] <= row[1]):
                day = held.pop()[2]
                yield key, day, held[-1] if held else None
            key = row[0]
            while held and held[-1][2] <= row[2]:
                held.pop()
            held.append(row)
            yield key, row[1], row
        while held:
            day = held.pop()[2]
            yield key, day, held[-1] if held else None

    for change in changes():
        if last is not None and last[:2] != change[:2]:  # of the changes of a day the last one counts
            yield last
        last = change
    if last is not None:
        yield last


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds: list[pa.DataType] = []

    def rows() -> Iterator[tuple]:
        for b in batches:
            kinds[:] = [*b.schema.types]
            key, rest = zip(*(b.column(k).to_pylist() for k in range(len(KEY)))), [b.column(k).to_pylist() for k in range(len(KEY), b.num_columns)]
            yield from zip(key, *rest)

    def batch(found: list[tuple]) -> pa.RecordBatch:
        columns = [*zip(*((*key, day, r is not None, *(r[3:] if r else (None, None))) for key, day, r in found))]
        types = [*kinds[: len(KEY)], pa.int32(), pa.bool_(), *kinds[len(KEY) + 2 :]]
        names = [*KEY, "day", "held", "unit_price", "price_seq"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    found: list[tuple] = []
    for change in _in_force(rows()):
        if change[1] < LAST:
            found.append(change)
        if len(found) == 10_000:
            yield batch(found)
            found = []
    if found:
        yield batch(found)


def in_scope(prices: DataFrame, asked: DataFrame) -> DataFrame:
    """The requests (ask_id, material_name, company, region, supplier, on) with the unit_price and price_seq in force: of the
    prices (material_name, company, region, supplier, unit_price, effective_from, effective_to, seq) that hold on that day,
    effective_from counted in, effective_to out, and whose scope is the request's or open (null), the most specific one:
    company before region before supplier; then the latest effective_from (undated ones last), then the largest seq.

    1. The prices of a material and scope, sorted by their start, give the days on which another one comes into force.
    2. Each scope that is asked for takes the changes of its at most eight prices' scopes together, in a window by days, and
       lays them down by spans of 2**SPAN days, as far as it is asked for.
    3. A request looks at its own span: an equi-join that leaves one row a request.
    No price is paired with a request, so that work and disk grow with both, not with their product.  A request that no price
    answers stays, without one; a price whose days are none (effective_to not after effective_from) answers none."""
    bits = list(zip(SCOPE, (4, 2, 1)))
    open_ = sum((F.col(c).isNull().cast("int") * b for c, b in bits), F.lit(0)).alias("open")
    since, until = F.coalesce(_day("effective_from"), F.lit(FIRST)).alias("since"), F.coalesce(_day("effective_to"), F.lit(LAST)).alias("until")
    rank = F.coalesce(F.col("seq").cast("long"), F.lit(-(1 << 63))).alias("rank")
    given = prices.filter("material_name IS NOT NULL").select("material_name", open_, *[F.coalesce(c, F.lit("")).alias(c) for c in SCOPE], since, until, "unit_price", "seq", rank)
    best = given.filter("since < until").groupBy(*KEY, "since", "until").agg(F.max_by("unit_price", "rank").alias("unit_price"), F.max_by("seq", "rank").alias("price_seq"), F.max("rank").alias("rank"))
    ordered = best.repartition(*KEY).sortWithinPartitions(*KEY, "since", "rank").drop("rank")
    schema = T.StructType([*[best.schema[c] for c in KEY], T.StructField("day", T.IntegerType()), T.StructField("held", T.BooleanType()), best.schema["unit_price"], best.schema["price_seq"]])
    changes = ordered.mapInArrow(_changes, schema)
    # a request looks only where prices are: at most 8 kinds of scope
    kinds = sorted(r["open"] for r in prices.select(open_).distinct().collect())
    way = lambda m: F.struct(F.lit(m).alias("open"), *[(F.lit("") if m & b else F.col(c)).alias(f"k_{c}") for c, b in bits])
    none = F.array().cast("array<struct<open:int,k_company:string,k_region:string,k_supplier:string>>")
    scope = ("material_name", *SCOPE)
    wanted = asked.filter("material_name IS NOT NULL AND on IS NOT NULL").select(*scope, _day("on").alias("day")).groupBy(*scope).agg(F.min("day").alias("low"), F.max("day").alias("high"))
    wanted = wanted.withColumn("w", F.explode(F.array(*map(way, kinds)) if kinds else none)).select(*scope, "low", "high", "w.*")
    state = F.struct("held", "unit_price", "price_seq").alias("state")
    told = changes.select("material_name", "open", *[F.col(c).alias(f"k_{c}") for c in SCOPE], "day", state)
    met = wanted.join(told, ["material_name", "open", *[f"k_{c}" for c in SCOPE]])
    along = W.partitionBy(*scope).orderBy("day")
    now = [F.last(F.when(F.col("open") == m, F.col("state")), ignorenulls=True).over(along).alias(f"s{m}") for m in kinds]
    known = met.select(*scope, "low", "high", F.col("day").alias("since"), F.coalesce(F.lead("day").over(along), F.lit(LAST)).alias("until"), *now)
    first = F.coalesce(F.lit(None).cast(met.schema["state"].dataType), *[F.when(F.col(f"s{m}.held"), F.col(f"s{m}")) for m in kinds])
    laid = known.select(*scope, F.greatest("since", "low").alias("since"), F.least("until", F.col("high") + 1).alias("until"), first.alias("m")).filter("since < until AND m IS NOT NULL")
    laid = laid.select(*scope, F.explode(F.sequence(F.shiftright("since", SPAN), F.shiftright(F.col("until") - 1, SPAN))).alias("span"), F.struct("since", "until", "m.unit_price", "m.price_seq").alias("m"))
    spans = laid.groupBy(*scope, "span").agg(F.collect_list("m").alias("found"))
    # the request passes as one column, so that no name of its can clash
    rows = asked.select(F.struct(*[asked[f"`{c}`"] for c in asked.columns]).alias("asked"))
    day = F.unix_date(F.col("asked.on").cast("date"))
    same = F.col("asked.material_name") == spans["material_name"]
    for c in SCOPE:
        same &= F.col(f"asked.{c}").eqNullSafe(spans[c])
    joined = rows.join(spans, same & (F.shiftright(day, SPAN) == spans["span"]), "left")
    answer = F.get(F.filter("found", lambda m: (m["since"] <= day) & (day < m["until"])), F.lit(0))
    return joined.select("asked", answer.alias("m")).select("asked.*", "m.unit_price", "m.price_seq")
