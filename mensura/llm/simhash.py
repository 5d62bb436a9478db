"""SimHash near-duplicates by an inverted index of positional bytes with count filtering.

1. One pass gives every text a 64-bit fingerprint: a bit is set where more than half of its shingles' XXH64 hashes have it.
2. Two fingerprints that differ in at most 2 bits differ in at most 2 of their 8 bytes, so they share at least 6 positional
   bytes: the guaranteed minimum.  Postings of single positional bytes would hold a 256th of all fingerprints each and make
   a tally for a 32nd of all pairs; the index therefore posts every distinct fingerprint under each choice of 6 positions
   with the bytes there.  Who meets in a posting has tallied the minimum; no other pair can link.  Two bytes are left
   free, so no posting holds more than 65,536 fingerprints, whatever the input.
3. Postings arrive sorted; a task tallies the free bytes and verifies the differing bits: in short postings member by member,
   in long ones by probing the 136 values within 2 bits of a member's free bytes.  It returns a star for every set of members
   that links connect, never all pairs.
4. Connected components of the stars give every fingerprint the smallest id of its component.

Rows are documents of their own, repeated ids too.  Null, empty and blank texts have the fingerprint zero, which links like any
other.  A row without an id links by its text; where no row of a component has an id, the component's id is null.  An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import over_batches, stored, table
from .graph import components

SIZE, SEED, NEAR = 3, 42, 2
BYTES = 8
#: Words hashed at a time, so that working memory does not follow a text's length.
WORDS = 100_000
#: Postings of up to so many members are tallied member by member.
SHORT = 24
#: The share of all rows from which on a fingerprint's rows are salted, and the salts.
HOT, SALTS = 0.001, 64
#: Positions that a posting leaves free: all but the guaranteed minimum of shared positional bytes.
FREE: list[tuple[int, ...]] = [tuple(x) for x in combinations(range(BYTES), NEAR)]


_SPACE = re.compile(rb"[\x09-\x0D ]")


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text (bytes.split cuts at U+0020 and U+0009..U+000D only), some at a time; runs that span two
    pieces are covered by repeating the last words of the one before."""
    step = WORDS * 8
    at, carried = 0, []
    while at < len(data):
        space = _SPACE.search(data, at + step)
        cut = space.start() if space else len(data)
        words = carried + data[at:cut].split()
        at = cut
        if at >= len(data) or len(words) >= SIZE:
            yield words
            words = words[len(words) - SIZE + 1 :]
        carried = words


def shingle_hashes(text: str | None) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of a text, repeats included, some at a time."""
    data, several = (text or "").encode("utf-8", "surrogatepass").lower(), False
    for words in _pieces(data):
        if not words:
            continue
        if len(words) < SIZE:
            if not several:
                yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
            continue
        several = True
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        spans = zip(starts[: len(words) - SIZE + 1].tolist(), ends[SIZE - 1 :].tolist())
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - SIZE + 1)


def fingerprint(text: str | None) -> int:
    """Unsigned; zero where there is no word."""
    counts, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text):
        for at in range(0, len(h), 8192):
            part = h[at : at + 8192]
            counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, BYTES), axis=1).sum(0, dtype=np.int32)
        n += len(h)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprints() -> Callable[[dict[str, list]], Iterable[tuple]]:
    def work(batch: dict[str, list]) -> Iterator[tuple]:
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            print_ = fingerprint(text)
            yield doc_id, print_ - (1 << 64) if print_ >> 63 else print_

    return work


def _free_bits(free: tuple[int, ...]) -> int:
    return sum(0xFF << 8 * p for p in free)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def postings(prints: DataFrame) -> DataFrame:
    """nth (the choice of positions), kept (their bytes, the free ones zero), fp of every distinct fingerprint (fp: long)."""
    keys = [F.struct(F.lit(k).cast("byte").alias("nth"), F.col("fp").bitwiseAND(F.lit(_signed(~_free_bits(f) % (1 << 64)))).alias("kept")) for k, f in enumerate(FREE)]
    return prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.nth", "k.kept", "fp")


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many positional bytes two fingerprints share, given their difference."""
    return (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(1)


def _settled(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member that each of n members reaches by the links (a, b)."""
    least = np.arange(n)
    while True:
        now = least.copy()
        np.minimum.at(now, a, least[b])
        np.minimum.at(now, b, least[a])
        now = now[now]
        if (now == least).all():
            return least
        least = now


def _short(fps: np.ndarray, group: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of many short postings, whose members are compared at every distance."""
    left, right = [], []
    for d in range(1, longest):
        i = np.flatnonzero(group[d:] == group[:-d])
        x = fps[i] ^ fps[i + d]
        i, x = i[tally := shared_bytes(x) >= BYTES - NEAR], x[tally]
        i = i[np.bitwise_count(x) <= NEAR]
        left.append(i)
        right.append(i + d)
    if not left:
        return fps[:0], fps[:0]
    least = _settled(len(fps), np.concatenate(left), np.concatenate(right))
    moved = np.flatnonzero(least != np.arange(len(fps)))
    return fps[moved], fps[least[moved]]


def _long(fps: np.ndarray, free: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Stars of one long posting: a table of its free bytes is probed at every value within reach."""
    low, high = (np.uint64(8 * p) for p in free)
    rest = (((fps >> low) & np.uint64(255)) | (((fps >> high) & np.uint64(255)) << np.uint64(8))).astype(np.int64)
    place = np.full(1 << 16, -1)
    place[rest] = np.arange(len(fps))
    singles = [1 << k for k in range(16)]
    reach = singles + [a | b for a, b in combinations(singles, 2)]
    near = [place[rest ^ m] for m in reach]
    a = np.concatenate([np.flatnonzero(x >= 0) for x in near])
    b = np.concatenate([x[x >= 0] for x in near])
    least = _settled(len(fps), a, b)
    moved = np.flatnonzero(least != np.arange(len(fps)))
    return fps[moved], fps[least[moved]]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the stars of sorted postings; the last posting of a batch waits for the next batch."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def told(nth: np.ndarray, kept: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(fps):
            return
        new = np.ones(len(fps), bool)
        new[1:] = (nth[1:] != nth[:-1]) | (kept[1:] != kept[:-1])
        group = np.cumsum(new) - 1
        sizes = np.bincount(group)
        found = []
        short = (sizes > 1) & (sizes <= SHORT)
        if short.any():
            rows = short[group]
            found.append(_short(fps[rows], group[rows], int(sizes[short].max())))
        firsts = np.flatnonzero(new)
        for g in np.flatnonzero(sizes > SHORT):
            at = firsts[g]
            found.append(_long(fps[at : at + sizes[g]], FREE[nth[at]]))
        for a, b in found:
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    held = [np.empty(0, np.int8), np.empty(0, np.int64), np.empty(0, np.uint64)]
    for batch in batches:
        columns = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
        nth, kept, fps = (np.concatenate(x) for x in zip(held, columns))
        open_ = len(fps)
        if open_:
            last = np.flatnonzero((nth != nth[-1]) | (kept != kept[-1]))
            open_ = int(last[-1]) + 1 if len(last) else 0
        yield from told(nth[:open_], kept[:open_], fps[:open_])
        held = [nth[open_:], kept[open_:], fps[open_:]]
    yield from told(*held)


def links(prints: DataFrame) -> DataFrame:
    """(a, b): stars whose components are those of all fingerprints (distinct, fp: long) within NEAR bits of each other."""
    return postings(prints).repartition("nth", "kept").sortWithinPartitions("nth", "kept").mapInArrow(_stars, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every row."""
    rows = stored(over_batches(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, fp long", _fingerprints))
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    merged = components(links(classes.select("fp"))).select(F.col("node").alias("fp"), "component")
    joined = merged.join(classes, "fp")
    smallest = joined.groupBy("component").agg(F.min("least").alias("smallest"))
    told = classes.join(joined.select("fp", "component").join(smallest, "component"), "fp", "left")
    # a class in a component has that component's smallest id, even a null one of its own
    told = told.select("fp", F.coalesce("smallest", "least").alias("component_id"))
    # rows of a fingerprint that many have are dealt to several tasks; fewer than 1 / HOT fingerprints can be so frequent
    hot = [r["fp"] for r in classes.filter(F.col("copies") > HOT * rows.count()).select("fp").collect()]
    often = F.col("fp").isin(hot) if hot else F.lit(False)
    salted = rows.withColumn("salt", F.when(often, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))).otherwise(0).cast("int"))
    told = told.withColumn("salt", F.explode(F.when(often, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(told, ["fp", "salt"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component.  Null and empty texts have fingerprint zero, repeated ids are rows of
    their own, an empty table gives no rows."""
    return near_duplicates(table(spark, sf_dir, "documents"))
