"""Document fingerprints by Order MinHash.

Every k-mer of a text (KMER code points) is numbered by its occurrence, so that repeats count.  The numbered k-mers
are hashed once; one half of the hash deals them to BINS bins, and each bin keeps its TUPLE smallest (one-permutation
hashing).  The kept k-mers are put back into text order and hashed as a tuple; two bytes of that hash per bin are the
signature.  Texts with few k-mers have empty bins, which take over the nearest filled bin to their right.  Two
signatures agree in a bin when the same k-mers were kept in the same order; the share of agreeing bins, less what
agrees by chance, to the power 1/TUPLE, estimates the shared part of the texts in a way that moved text lowers.

Equal texts have equal fingerprints.  A text shorter than a k-mer is one k-mer; null and empty texts have a
fingerprint of their own, are fully alike to each other and unlike all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import over_batches, range_of, table
from .shingles import mix

KMER, TUPLE, BINS = 8, 2, 128
#: Numbered k-mers that each bin may expect among those looked at first.
_EXPECTED = 8
_STEP = np.uint64(0x9E3779B97F4A7C15)


def signature(text: str | None) -> np.ndarray:
    """BINS numbers of 16 bits."""
    if not text:
        return np.zeros(BINS, np.uint16)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    k = min(KMER, len(points))
    count = len(points) - k + 1
    kmers = points[:count].copy()
    for j in range(1, k):
        kmers *= _STEP
        kmers += points[j : j + count]
    kmers = mix(kmers)
    # occurrence numbers: sorted by k-mer, the position in the low bits keeps text order among equals
    bits = np.uint64(max(1, int(count - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    ordered = np.sort((kmers & ~low) | np.arange(count, dtype=np.uint64))
    place = (ordered & low).astype(np.int64)
    ordered >>= bits
    numbered = mix(kmers[place])
    repeat = np.flatnonzero(ordered[1:] == ordered[:-1]) + 1
    if len(repeat):
        new = np.ones(count, bool)
        new[repeat] = False
        first = np.maximum.accumulate(np.where(new, np.arange(count), 0))
        numbered[repeat] = mix(numbered[repeat] + (repeat - first[repeat]).astype(np.uint64) * _STEP)
    if count > 2 * _EXPECTED * BINS:
        few = np.flatnonzero(numbered < np.uint64(int(2**64 * (_EXPECTED * BINS / count))))
        chosen = _smallest(numbered[few], place[few])
        if chosen is None:
            chosen = _smallest(numbered, place)
    else:
        chosen = _smallest(numbered, place)
    bins, where, filled = chosen if chosen is not None else _partly(numbered, place)
    where = np.sort(where, axis=1)  # back to text order
    tuples = np.zeros(len(bins), np.uint64)
    for j in range(where.shape[1]):
        # a bin with fewer k-mers than TUPLE has -1 in front
        tuples = mix(tuples * _STEP + np.where(where[:, j] < 0, np.uint64(0), kmers[where[:, j]]))
    out = np.zeros(BINS, np.uint16)
    values = (tuples >> np.uint64(40)).astype(np.uint16)
    if filled:
        out[bins] = values
    else:
        nearest = np.searchsorted(bins, np.arange(BINS)) % len(bins)
        away = (bins[nearest] - np.arange(BINS)) % BINS
        out[:] = (mix(tuples[nearest] + away.astype(np.uint64) * _STEP) >> np.uint64(40)).astype(np.uint16)
        out[bins] = values
    return out


def _sorted_bins(numbered: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bins = (numbered & np.uint64(BINS - 1)).astype(np.int64)
    order = np.lexsort((numbered, bins))
    return bins[order], place[order]


def _smallest(numbered: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool] | None:
    """All bins with the places of their TUPLE smallest; None if one has fewer."""
    if len(numbered) < BINS * TUPLE:
        return None
    bins, place = _sorted_bins(numbered, place)
    at = np.searchsorted(bins, np.arange(BINS + 1))
    if (at[1:] - at[:-1]).min() < TUPLE:
        return None
    return np.arange(BINS), place[at[:-1, None] + np.arange(TUPLE)], True


def _partly(numbered: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """The filled bins, with -1 for what they lack."""
    bins, place = _sorted_bins(numbered, place)
    at = np.searchsorted(bins, np.arange(BINS + 1))
    filled = np.flatnonzero(at[1:] > at[:-1])
    where = at[filled, None] + np.arange(TUPLE)
    return filled, np.where(where < at[filled + 1, None], place[np.minimum(where, len(place) - 1)], -1), False


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; 1 for equal signatures."""
    share = float(np.count_nonzero(a == b)) / BINS
    chance = 2.0**-16
    return max(0.0, (share - chance) / (1 - chance)) ** (1 / TUPLE)


def _shown(text: str | None, sign: np.ndarray) -> str:
    return ("" if text else "-") + sign.astype("<u2").tobytes().hex()


def fingerprint(text: str | None) -> str:
    return _shown(text, signature(text))


def _alike(a: str | None, sa: np.ndarray, b: str | None, sb: np.ndarray) -> float:
    return likeness(sa, sb) if bool(a) == bool(b) else 0.0


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much (or all) of the following one's start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame) -> tuple[DataFrame, int]:
    """The rows by descending doc_id in ranges, with columns `range` and `peek`: every range also holds, as its last
    row (peek 1), a copy of the row that follows it, for the lowest range the highest row."""
    spark = docs.sparkSession
    ranges = 4 * max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    bounds = sorted(set(rows.select("doc_id").approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 1 / (4 * ranges)) or []))
    rows = rows.withColumn("range", range_of(F.col("key"), bounds))
    heads = sorted((r["range"], r["head"]) for r in rows.groupBy("range").agg(F.max("key").alias("head")).collect())  # one per range
    targets = [(head, heads[k + 1][0] if k + 1 < len(heads) else heads[0][0]) for k, (_, head) in enumerate(heads)]
    extra = F.broadcast(spark.createDataFrame(targets, "key long, target int"))
    peeks = rows.join(extra, "key").select("doc_id", "text", "key", F.col("target").alias("range"), F.lit(1).alias("peek"))
    return rows.withColumn("peek", F.lit(0)).select("doc_id", "text", "key", "range", "peek").union(peeks), ranges


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.
    Texts move once, to their range; rows with equal ids follow one another in the order of their texts' hashes."""
    ordered, ranges = in_order(docs)
    dealt = ordered.repartition(ranges, "range").sortWithinPartitions("range", "peek", F.desc("key"), F.xxhash64("text"))

    def start() -> Callable[[dict[str, list]], Iterable[tuple]]:
        held: tuple | None = None

        def work(batch: dict[str, list]) -> Iterator[tuple]:
            nonlocal held
            for doc_id, text, place, peek in zip(batch["doc_id"], batch["text"], batch["range"], batch["peek"]):
                text = text or ""
                sign = None
                if held is not None and held[2] == place:
                    sign = signature(text)
                    changed = edited(held[1], text)
                    other = signature(changed)
                    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    yield held[0], len(held[1]), sha, _shown(held[1], held[3]), _shown(changed, other), _alike(held[1], held[3], changed, other), _alike(held[1], held[3], text, sign)
                held = None if peek else (doc_id, text, place, signature(text) if sign is None else sign)

        return work

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return over_batches(dealt.select("doc_id", "text", "range", "peek"), schema, start)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprints.  Null and empty texts have one of their own, null ids come last, rows of equal ids
    follow one another, an empty table gives no rows."""
    return fingerprints(table(spark, sf_dir, "documents"))
