"""Exact Jaccard join of documents by word n-grams: a blocked sparse matrix product with size-derived bounds.

1. One pass hashes every text's shingles, identifies its shingle set by 128 bits, and counts shingles in a table of
   counters (quantised; its size follows the input's up to 2**MOST_BITS), which serves only to order shingles from rare
   to frequent: results don't depend on it.
2. Texts with the same set become one class, numbered.  Two sets that reach the threshold share one of the first
   n - ceil(t n) + 1 shingles of each in any fixed order, and their sizes differ by at most the threshold; so the
   rare-first prefixes, cut into size bands, put every pair that can link into one bucket or two buckets of
   neighbouring bands.  A task links each member of a bucket to the first one that it has met itself, and only
   such heads go through the exchange, where they are linked to the smallest head; never pairs.  The connected
   components of those edges are the blocks that the product can be restricted to.
3. Classes of a block meet in one task, or, where a block is large (by shingles, classes or bytes of text), in tasks for
   pairs of sub-blocks of neighbouring size bands (beyond MOST_CUTS of a band they grow WIDER times instead of getting more, so that
   a text goes to fewer tasks, which cut their product into tiles).  Only texts of blocks are shuffled.  A task multiplies the incidence matrix with its transpose in
   column strips, adding up overlaps as integers, and drops pairs whose overlap can no longer reach the bound that their
   sizes set.  It returns only a spanning forest of its links and each class's number of links.
4. Components of the forest give every class the smallest id of its component.

Every row is a document of its own: repeated ids link by their texts only, so rows of one id with different texts can
belong to different components.  Exact copies link with each other.  Empty, blank and null texts have no shingles
and link with nothing.  A row without an id is kept, links with nothing and has no component.  An empty table gives
an empty result; other columns are not read.  Sets are compared by 64-bit shingle hashes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import over_batches, sieve, stored, table
from .graph import components
from .shingles import distinct, mix, shingle_lists

SIZE, NUMERATOR, DENOMINATOR = 4, 85, 100
#: Least and most counters (powers of two, one byte each where they are used), and counters of a part of the table.
LEAST_BITS, MOST_BITS, SKETCH_PART = 18, 26, 18
#: Only shingles in the lowest part of the hash range are counted; longer prefixes fall back on hash order.
COUNTED = 4
#: Shingles (or BYTES_A_SHINGLE bytes of text each) and classes of one side of a task, and columns of a strip of the product.
BLOCK_SHINGLES, BYTES_A_SHINGLE, BLOCK_CLASSES, STRIP = 400_000, 16, 1000, 4096
#: Sub-blocks of a band of a block up to which they keep that size, and how many times larger they may get then.
MOST_CUTS, WIDER = 8, 4
#: The level of a shingle that the counters have met once.
ONCE = 2
#: Buckets whose head a task remembers, and sets that it knows; both are forgotten when full, which costs rows only.
HEADS, KNOWN = 300_000, 300_000


def sketch_bits(size_of_texts: int) -> int:
    """About one counter for each counted shingle (six bytes of text have one)."""
    return min(MOST_BITS, max(LEAST_BITS, (size_of_texts // (6 * COUNTED)).bit_length()))


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h << np.uint64(2)) >> np.uint64(64 - bits)).astype(np.int64)


def _identity(s: np.ndarray, k: int) -> int:
    return int(np.bitwise_xor.reduce(mix(s + np.uint64(k)))) - (1 << 63) if len(s) else 0


def _coded(slots: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending slots and their counts (255 at most: they order shingles only), compressed."""
    return zlib.compress(np.diff(slots, prepend=0).astype(np.uint32).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes(), 1)


def _decoded(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zlib.decompress(data)
    n = len(data) // 5
    return np.cumsum(np.frombuffer(data, np.uint32, n)), np.frombuffer(data, np.uint8, n, 4 * n)


def _scan(size: int, bits: int) -> Callable[[], Callable]:
    """Sets' identities of a batch, and at its end the counts of their low shingles, as parts of the table."""

    def start() -> Callable[[dict[str, list]], Iterable[tuple]]:
        def work(batch: dict[str, list]) -> Iterator[tuple]:
            low = []
            for doc_id, key, held, runs in zip(batch["doc_id"], batch["key"], batch["bytes"], shingle_lists(batch["text"], size)):
                s = distinct(runs)
                yield doc_id, key, held, len(s), _identity(s, 11), _identity(s, 23), None, None
                low.append(s[s < np.uint64((1 << 64) // COUNTED)])
            slots = _slot(np.concatenate(low), bits) if low else np.empty(0, np.int64)
            parts, inside = slots >> SKETCH_PART, slots & ((1 << SKETCH_PART) - 1)
            for part in np.unique(parts):
                found, n = np.unique(inside[parts == part], return_counts=True)
                yield None, None, None, None, None, None, int(part), _coded(found, n)

        return work

    return start


def _summed(parts: DataFrame, spread: int) -> DataFrame:
    """Tables of counts, added up in two steps so that no task reads all of a part."""

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << SKETCH_PART, np.int64)
        for data in frame["counts"]:
            slots, counts = _decoded(data)
            total[slots] += counts
        return pd.DataFrame({"part": [key[0]], "total": [zlib.compress(total.tobytes(), 1)]})

    def again(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(data), np.int64) for data in frame["total"])
        level = np.minimum(2 * np.log2(total + 1), 255).astype(np.uint8)
        return pd.DataFrame({"part": [key[0]], "level": [level.tobytes()]})

    first = parts.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(spread))).groupBy("part", "salt").applyInPandas(add, "part int, total binary")
    return first.groupBy("part").applyInPandas(again, "part int, level binary")


def _band(n: Column, ratio: float) -> Column:
    """The size band: sizes within the threshold of each other are in the same or in neighbouring bands."""
    return F.floor(F.log(n.cast("double")) / float(-np.log(ratio)) + 1e-9).cast("int")


def prefix_length(n: int, numerator: int, denominator: int) -> int:
    return n - (numerator * n + denominator - 1) // denominator + 1


def _prefixes(size: int, numerator: int, denominator: int, levels: np.ndarray) -> Callable[[], Callable]:
    """(shingle, set, band, null) of the first set that a task meets in a bucket, and (any, set, -1, head) for every
    further one; a task that has seen a set does not emit it again.  A shingle that was counted once has no other set to meet."""
    bits = len(levels).bit_length() - 1
    width = -math.log(numerator / denominator)

    def start() -> Callable[[dict[str, list]], Iterable[tuple]]:
        seen: set[int] = set()
        heads: dict[int, dict[int, int]] = {}
        count = 0

        def work(batch: dict[str, list]) -> Iterator[tuple]:
            nonlocal count
            for runs in shingle_lists(batch["text"], size):
                s = distinct(runs)
                if not len(s):
                    continue
                one = _identity(s, 11)
                if one in seen:
                    continue
                seen.add(one)
                p = prefix_length(len(s), numerator, denominator)
                low = s[: np.searchsorted(s, np.uint64((1 << 64) // COUNTED))]
                # low shingles come before the others, so a prefix of them alone is a prefix of the whole order
                level = levels[_slot(low, bits)]
                if len(low) >= p:
                    key = (level.astype(np.uint64) << np.uint64(56)) | (low >> np.uint64(8))
                    chosen = np.argpartition(key, p - 1)[:p]
                    chosen = low[chosen[level[chosen] > ONCE]]
                else:
                    chosen = np.concatenate([low[level > ONCE], s[len(low) : p]])
                band = int(math.log(len(s)) / width + 1e-9)
                mine, near = heads.setdefault(band, {}), set()
                for shingle in chosen.view(np.int64).tolist():
                    head = mine.setdefault(shingle, one)
                    if head == one:
                        count += 1
                        yield shingle, one, band, None
                    else:
                        near.add(head)
                for head in near:
                    yield one, one, -1, head
                if count > HEADS:
                    heads.clear()
                    count = 0
            if len(seen) > KNOWN:
                seen.clear()

        return work

    return start


def _product(a: list[np.ndarray], b: list[np.ndarray] | None, numerator: int, denominator: int) -> list[tuple[int, int]]:
    """Linked pairs (i, j) between two lists of sets (b None: i < j within a): overlaps are added up over strips of
    shared columns; a strip skips sets that no live pair needs."""
    sets = a + (b or [])
    sizes = np.array([len(s) for s in sets])
    rows = np.repeat(np.arange(len(sets)), sizes)
    _, columns, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = df[columns] > 1
    shared = np.flatnonzero(df > 1)
    rank = np.full(len(df), -1)
    rank[shared] = np.arange(len(shared))
    rows, columns = rows[keep], rank[columns[keep]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    m = len(a)
    na, nb = sizes[:m], (sizes[m:] if b is not None else sizes)
    need = -(-numerator * (na[:, None] + nb[None]) // (numerator + denominator))  # the least overlap that links
    live = np.minimum(na[:, None], nb[None]) >= need
    if b is None:
        live &= np.triu(np.ones((m, m), bool), 1)
    left = np.bincount(rows, minlength=len(sets)).astype(np.int64)
    overlap = np.zeros(live.shape, np.int32)
    for at in range(0, len(shared), STRIP):
        lo, hi = np.searchsorted(columns, [at, at + STRIP])
        la, lb = left[:m], (left[m:] if b is not None else left)
        live &= overlap + np.minimum(la[:, None], lb[None]) >= need
        ia, ib = np.flatnonzero(live.any(1)), np.flatnonzero(live.any(0))
        if not len(ia):
            return []
        strip = np.zeros((len(sets), min(STRIP, len(shared) - at)), np.float32)
        strip[rows[lo:hi], columns[lo:hi] - at] = 1
        # at most STRIP ones meet in a strip, which float32 holds exactly
        overlap[np.ix_(ia, ib)] += (strip[:m][ia] @ (strip[m:] if b is not None else strip)[ib].T).astype(np.int32)
        left -= np.bincount(rows[lo:hi], minlength=len(sets))
    linked = live & (overlap >= need)
    return list(zip(*(x.tolist() for x in np.nonzero(linked))))


def _tiles(sets: list[np.ndarray], chosen: np.ndarray) -> list[np.ndarray]:
    """The chosen sets in runs of at most BLOCK_CLASSES sets and about BLOCK_SHINGLES shingles."""
    full = np.cumsum([len(sets[k]) for k in chosen], dtype=np.int64) // BLOCK_SHINGLES
    return [run[at : at + BLOCK_CLASSES] for run in np.split(chosen, np.flatnonzero(np.diff(full)) + 1) for at in range(0, len(run), BLOCK_CLASSES)]


def _cuts(weight: Column, members: Column) -> Column:
    """The number of sub-blocks of a band of a block."""
    plain = F.greatest(F.ceil(weight / BLOCK_SHINGLES), F.ceil(members / BLOCK_CLASSES))
    return F.greatest(F.least(plain, F.lit(MOST_CUTS)), F.ceil(plain / WIDER)).cast("int")


def _links(size: int, numerator: int, denominator: int) -> Callable:
    """For one task: a spanning forest (a, b) of its links, and (a, null, degree) of every linked class."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ids, side, copies = (frame[c].to_numpy() for c in ("class", "side", "copies"))
        sets = [distinct(s).copy() for s in shingle_lists(frame["text"].tolist(), size)]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        lefts = _tiles(sets, left)
        if key[-1] == "across":
            met = [(a, b) for a in lefts for b in _tiles(sets, right)]
        else:
            met = [(a, b if b is not a else None) for k, a in enumerate(lefts) for b in lefts[k:]]
        parent = list(range(len(ids)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        forest, degree = [], np.zeros(len(ids), np.int64)
        for a, b in met:
            others = a if b is None else b
            for i, j in _product([sets[k] for k in a], None if b is None else [sets[k] for k in b], numerator, denominator):
                x, y = a[i], others[j]
                degree[x] += copies[y]
                degree[y] += copies[x]
                p, q = root(x), root(y)
                if p != q:
                    parent[p] = q
                    forest.append((ids[x], ids[y], 0))
        forest += [(ids[k], ids[k], int(degree[k])) for k in np.flatnonzero(degree)]
        return pd.DataFrame(forest, columns=["a", "b", "degree"])

    return run


def linked(docs: DataFrame, size: int = SIZE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """doc_id, key (the text's hash), n_shingles, component_id, n_links of every row; linked when denominator * overlap >=
    numerator * union."""
    spark = docs.sparkSession
    ratio = numerator / denominator
    texts = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("key"))
    held = F.octet_length("text").alias("bytes")
    bits = sketch_bits(texts.select(held).agg(F.sum("bytes")).first()[0] or 0)
    scanned = stored(over_batches(texts.select("doc_id", "text", "key", held), "doc_id long, key long, bytes long, n long, one long, two long, part int, counts binary", _scan(size, bits)))
    rows = scanned.filter("n IS NOT NULL").select("doc_id", "key", "bytes", "n", "one", "two")
    spread = max(1, scanned.rdd.getNumPartitions() // 32)
    levels = np.zeros(1 << bits, np.uint8)
    for r in _summed(scanned.filter("part IS NOT NULL").select("part", "counts"), spread).toLocalIterator():  # a table of at most 2**MOST_BITS bytes
        levels[r["part"] << SKETCH_PART : (r["part"] + 1) << SKETCH_PART] = np.frombuffer(r["level"], np.uint8)
    shared_levels = spark.sparkContext.broadcast(levels)
    del levels  # the driver keeps a file of it only
    # a class's text is that of the row with the smallest id
    first, weight = F.min(F.struct("doc_id", "key", "bytes")).alias("first"), F.greatest("n", F.ceil(F.col("first.bytes") / BYTES_A_SHINGLE))
    classes = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("one", "two", "n").agg(first, F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("class"), "one", "two", "n", F.col("first.doc_id").alias("rep"), F.col("first.key").alias("key"), weight.alias("weight"), "copies"))

    def emit() -> Callable:
        return _prefixes(size, numerator, denominator, shared_levels.value)()

    members = over_batches(texts.filter("doc_id IS NOT NULL").select("text"), "shingle long, one long, band int, head long", emit)
    # one exchange: the smallest head of a row's own band, and that of the band above, from windows over its shingle; edges
    # that tasks have found pass by as band -1
    bands = W.partitionBy("shingle").orderBy("band")
    lowest, above = F.min("one").over(bands.rangeBetween(0, 0)), F.min("one").over(bands.rangeBetween(1, 1))
    headed = members.select("one", "head", lowest.alias("lowest"), above.alias("above")).filter("head IS NOT NULL OR one != lowest OR above IS NOT NULL")
    edge = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    found = F.when(F.col("head").isNotNull(), F.array(edge("one", "head"))).otherwise(F.array(edge("one", "lowest"), edge("lowest", "above")))
    edges = headed.select(F.explode(found).alias("e")).select("e.*").filter("a != b")
    blocks = components(edges).select(F.col("node").alias("one"), F.col("component").alias("block"))

    # classes of a block, dealt to tasks: whole blocks where they are small, else pairs of sub-blocks of size bands
    placed = stored(classes.join(blocks, "one").withColumn("band", _band(F.col("n"), ratio)))
    whole = placed.groupBy("block").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    banded = placed.groupBy("block", "band").agg(F.sum("weight").alias("band_weight"), F.count(F.lit(1)).alias("band_members"))
    banded = banded.select("block", "band", _cuts(F.col("band_weight"), F.col("band_members")).alias("cuts"))
    near = banded.select("block", (F.col("band") - 1).alias("band"), F.col("cuts").alias("cuts_above"))
    near_below = banded.select("block", (F.col("band") + 1).alias("band"), F.col("cuts").alias("cuts_below"))
    banded = banded.join(near, ["block", "band"], "left").join(near_below, ["block", "band"], "left").join(whole, "block")
    dealt = placed.drop("weight").join(banded, ["block", "band"]).withColumn("cut", F.pmod(F.xxhash64("class"), F.col("cuts")).cast("int"))
    task = lambda low, i, high, j, side, kind: F.struct(F.col("block"), low.alias("low"), i.alias("i"), high.alias("high"), j.alias("j"), F.lit(side).alias("side"), F.lit(kind).alias("kind"))
    zero, b, cut, up = F.lit(0), F.col("band"), F.col("cut"), F.col("band") + 1
    upto = lambda n: F.when(n > 0, F.sequence(zero, n - 1)).otherwise(F.array().cast("array<int>"))
    pairs = F.concat(
        F.array(task(b, cut, b, cut, 0, "within")),
        F.transform(F.filter(upto(F.col("cuts")), lambda j: j > cut), lambda j: task(b, cut, b, j, 0, "across")),
        F.transform(F.filter(upto(F.col("cuts")), lambda j: j < cut), lambda j: task(b, j, b, cut, 1, "across")),
        F.transform(upto(F.coalesce("cuts_above", zero)), lambda j: task(b, cut, up, j, 0, "across")),
        F.transform(upto(F.coalesce("cuts_below", zero)), lambda j: task(b - 1, j, b, cut, 1, "across")),
    )
    small = (F.col("weight") <= BLOCK_SHINGLES) & (F.col("members") <= BLOCK_CLASSES)
    tasks = F.when(small, F.array(task(zero, zero, zero, zero, 0, "within"))).otherwise(pairs)
    wanted = dealt.select("class", "copies", F.col("rep").alias("doc_id"), "key", tasks.alias("tasks"))
    may = sieve(placed.join(whole, "block").select("rep", "key"))
    # one row of a text that stands in several; a class's text leaves its place once, for its tasks
    wanted = wanted.join(texts.filter(may("doc_id", "key")), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])
    grouped = wanted.select("class", "copies", "text", F.explode("tasks").alias("t")).select("class", "copies", "text", "t.*").groupBy("block", "low", "i", "high", "j", "kind")
    links = stored(grouped.applyInPandas(_links(size, numerator, denominator), "a long, b long, degree long"))

    merged = components(links.filter("a != b").select("a", "b")).select(F.col("node").alias("class"), "component")
    smallest = merged.join(classes.select("class", "rep"), "class").groupBy("component").agg(F.min("rep").alias("least"))
    degrees = links.groupBy(F.col("a").alias("class")).agg(F.sum("degree").alias("degree"))
    told = classes.join(merged, "class", "left").join(smallest, "component", "left").join(degrees, "class", "left")
    told = told.select("one", "two", "n", F.coalesce("least", "rep").alias("least"), (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).alias("links"))
    full = rows.join(told, ["one", "two", "n"], "left")
    named = lambda c, none: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, none)).otherwise(none)
    return full.select("doc_id", "key", F.col("n").alias("n_shingles"), named("least", F.col("doc_id")).alias("component_id"), named("links", F.lit(0)).cast("long").alias("n_links"))


def join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row."""
    return linked(docs, **options).drop("key")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The rows without those that link, directly or through others, with one of a smaller id; equal rows stay together."""
    gone = stored(linked(docs, **options).filter("component_id < doc_id").select(F.col("doc_id").alias("__gone"), F.col("key").alias("__key")).distinct())
    # only rows that may go are shuffled
    may = sieve(gone)(F.col("doc_id").cast("long"), F.xxhash64("text"))
    asked = docs.filter(may)
    left = asked.join(gone, (asked["doc_id"].cast("long") == gone["__gone"]) & (F.xxhash64(asked["text"]) == gone["__key"]), "left_anti")
    return docs.filter(~may).unionByName(left)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component.  Null and empty texts link with nothing, a row without an id has no component, an empty
    table gives no rows."""
    return join(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM words),
sized AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, s FROM sets),
flat AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, d.n AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id,
  (SELECT count(*) FROM links l WHERE l.a = d.doc_id) AS n_links
FROM sized d LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, d.n
"""
