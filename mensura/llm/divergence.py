"""Source divergence audit by a two-pass vocabulary automaton.

1. First pass: exact document frequencies.  A task adds up (language, term) over its documents before Spark sums them; a
   language keeps the terms of at least 30 of its documents.
2. Second pass: a pyahocorasick automaton of the kept terms, each padded with a delimiter on both sides, runs over every
   text, whose other characters have become delimiters, and recounts the occurrences in each source.  A kept vocabulary of up to
   VOCABULARY terms is handed to all tasks at once; a larger one is cut by hash into parts of about that size, each of which
   has a pass of its own, so that a task's memory does not follow the vocabulary.
3. The recounts are sparse postings (language, term, source, share).  The distance of two sources is
   V |a - b| + sum over a's terms (|p - b| - |a - b|) + sum over b's terms (|a - p'| - |a - b|)
   + sum over common terms (|p - p'| - |p - b| - |a - p'| + |a - b|), a and b being their shares of a term that does not occur.
   Sources are dealt to blocks, terms to chunks; a task adds up one pair of blocks over one chunk, touching for each term only the
   sources that have it.

A language or source may be the empty string, which null is read as; null and empty texts have no terms, but their group is
audited.  Repeated ids are documents of their own; ids and other columns are not read.  A language without kept
terms has pairs of value 0 and no term rows; a source that is alone in its language has no pairs.  Ties go to the smaller item.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table

LEAST_DOCUMENTS, TOP_TERMS = 30, 50
UNIT, ADDED = 1_000_000_000, 5
#: Kept terms of an automaton pass, and sums that a task holds before it hands them on.
VOCABULARY, HELD = 300_000, 600_000
#: Sources of a block, and terms of a chunk, of the pair sums.
BLOCK, CHUNK = 128, 4_000
#: Every byte that belongs to no term becomes a space, A-Z become a-z; bytes of other characters stay.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def read(docs: DataFrame) -> DataFrame:
    """text (UTF-8 bytes), lang, source of every document; null is empty."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(empty("text").cast("binary").alias("text"), empty("lang").alias("lang"), empty("source").alias("source"))


def _plain(text: bytes) -> bytes:
    return text.translate(_PLAIN)


def _counted(names: tuple[str, ...], count: Callable[[], Callable[[bytes, tuple], Iterable]], kind: pa.DataType) -> Callable:
    """A function for mapInArrow: counts of (group, term) added up over a task's documents and handed on when HELD are
    held, as rows (names..., term, n); terms are bytes or numbers."""
    schema = pa.schema([*((n, pa.string()) for n in names), ("term", kind), ("n", pa.int64())])

    def told(held: dict[tuple, Counter]) -> Iterator[pa.RecordBatch]:
        for group, counts in held.items():
            terms = pa.array(list(counts), pa.binary() if kind == pa.string() else kind).cast(kind)
            columns = [pa.array([g] * len(terms), pa.string()) for g in group]
            yield pa.RecordBatch.from_arrays([*columns, terms, pa.array(list(counts.values()), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Counter] = {}
        terms_of = count()
        size = 0
        for batch in batches:
            groups = list(zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)))
            texts = batch.column(0)
            for k, group in enumerate(groups):
                mine = held.setdefault(group, Counter())
                before = len(mine)
                mine.update(terms_of(texts[k].as_py(), group))
                size += len(mine) - before
                if size > HELD:
                    yield from told(held)
                    held, size = {}, 0
        yield from told(held)

    return run


def document_frequencies(rows: DataFrame) -> DataFrame:
    """lang, term, df: in how many of a language's documents a term occurs."""

    def start() -> Callable:
        return lambda text, group: set(_plain(text).split())

    counted = rows.select("text", "lang").mapInArrow(_counted(("lang",), start, pa.string()), "lang string, term string, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("df"))


def automaton(terms: list[tuple[int, bytes]]) -> ahocorasick.Automaton:
    """Finds the number of every delimiter-padded term; bytes stand for characters."""
    out = ahocorasick.Automaton()
    for number, t in terms:
        out.add_word(f" {t.decode('latin-1')} ", number)
    out.make_automaton()
    return out


def occurrences(rows: DataFrame, kept: Broadcast) -> DataFrame:
    """lang, source, term (its number), n of the kept terms (numbers and terms by language) that occur."""

    def start() -> Callable:
        of: dict[str, ahocorasick.Automaton] = {}

        def terms_of(text: bytes, group: tuple) -> Iterator[int]:
            lang = group[0]
            if lang not in of:
                of[lang] = automaton(kept.value.get(lang, []))
            if not len(of[lang]):
                return iter(())
            return (number for _, number in of[lang].iter(f" {_plain(text).decode('latin-1')} "))

        return terms_of

    counted = rows.mapInArrow(_counted(("lang", "source"), start, pa.int64()), "lang string, source string, term long, n long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def recounts(rows: DataFrame, kept: DataFrame, vocabulary: int = VOCABULARY) -> DataFrame:
    """lang, source, term, n by as many automaton passes as the kept vocabulary (lang, term, number) has parts."""
    context = rows.sparkSession.sparkContext
    parts = max(1, -(-kept.count() // vocabulary))
    out = None
    for part in range(parts):
        terms: dict[str, list[tuple[int, bytes]]] = {}
        for r in kept.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == part).collect():  # about `vocabulary` rows at most
            terms.setdefault(r["lang"], []).append((r["number"], r["term"].encode()))
        found = occurrences(rows, context.broadcast(terms))
        # terms differ between the passes; each is stored, so that its vocabulary can go
        found = stored(found)
        out = found if out is None else out.union(found)
    return out


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + ADDED) / (total + ADDED * terms)), exact for any counts."""
    over = (count.cast("decimal(20,0)") + ADDED) * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", over, (total + ADDED * terms).cast("decimal(20,0)")).cast("long") + 1


def _pair_sums(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """One pair of blocks over one chunk of terms: the part of each pair's distance that comes from terms that occur.
    Rows of term -1 name the sources with their share of an absent term."""
    lang, i, j = key[0], key[1], key[2]
    names = frame[frame["term"] < 0]
    sides = []
    for side in (0, 1) if i != j else (0,):
        mine = names[names["side"] == side]
        number = {s: k for k, s in enumerate(mine["source"])}
        held = frame[(frame["term"] >= 0) & (frame["side"] == side)]
        sides.append((mine["source"].tolist(), mine["share"].to_numpy(np.int64), held["source"].map(number).to_numpy(np.int64), held["term"].to_numpy(), held["share"].to_numpy(np.int64)))
    (a_names, a, a_at, a_term, a_share), (b_names, b, b_at, b_term, b_share) = sides[0], sides[-1]
    sums = np.zeros((len(a), len(b)), np.int64)
    if not len(a) or not len(b):
        return pd.DataFrame({"lang": names["lang"][:0], "source": names["source"][:0], "item": names["source"][:0], "value": names["share"][:0]})

    def alone(absent: np.ndarray, at: np.ndarray, shares: np.ndarray, other: np.ndarray) -> np.ndarray:
        """For every source and every absent share of the other side: the sum over its terms of |p - other| - |absent - other|."""
        out = np.zeros((len(absent), len(other)), np.int64)
        order = np.lexsort((shares, at))
        at, shares = at[order], shares[order]
        bounds = np.searchsorted(at, np.arange(len(absent) + 1))
        for k in range(len(absent)):
            mine = shares[bounds[k] : bounds[k + 1]]
            below, total = np.concatenate(([0], np.cumsum(mine))), int(mine.sum())
            n = np.searchsorted(mine, other)
            out[k] = other * n - below[n] + (total - below[n]) - other * (len(mine) - n) - len(mine) * np.abs(absent[k] - other)
        return out

    sums += alone(a, a_at, a_share, b) + alone(b, b_at, b_share, a).T
    codes, _ = pd.factorize(np.concatenate([a_term, b_term]))
    a_code, b_code = codes[: len(a_term)], codes[len(a_term) :]
    a_order, b_order = np.argsort(a_code, kind="stable"), np.argsort(b_code, kind="stable")
    n = int(codes.max()) + 1 if len(codes) else 0
    a_cut, b_cut = np.searchsorted(a_code[a_order], np.arange(n + 1)), np.searchsorted(b_code[b_order], np.arange(n + 1))
    apart = np.abs(a[:, None] - b[None])
    for t in range(n):
        x, y = a_order[a_cut[t] : a_cut[t + 1]], b_order[b_cut[t] : b_cut[t + 1]]
        if len(x) and len(y):
            p, q, r, c = a_share[x][:, None], b_share[y][None], a_at[x], b_at[y]
            sums[np.ix_(r, c)] += np.abs(p - q) - np.abs(p - b[c][None]) - np.abs(a[r][:, None] - q) + apart[np.ix_(r, c)]
    r, c = np.indices(sums.shape)
    first, second = np.array(a_names, object)[r.ravel()], np.array(b_names, object)[c.ravel()]
    if i != j:
        return pd.DataFrame({"lang": lang, "source": np.concatenate([first, second]), "item": np.concatenate([second, first]), "value": np.concatenate([sums.ravel()] * 2)})
    other = first != second
    return pd.DataFrame({"lang": lang, "source": first[other], "item": second[other], "value": sums.ravel()[other]})


def pair_distances(groups: DataFrame, postings: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """lang, source, item, value of every ordered pair of sources of a language.  groups: lang, source, sources (of the language),
    terms (V), absent (share); postings: lang, source, sources, terms, term, share."""
    blocks, chunks = F.ceil(F.col("sources") / block).cast("int"), F.greatest(F.lit(1), F.ceil(F.col("terms") / chunk)).cast("int")
    own = F.pmod(F.xxhash64("source"), blocks).cast("int").alias("own")
    every = groups.select("lang", "source", F.col("absent").alias("share"), own, blocks.alias("blocks"), F.lit(-1).cast("long").alias("term"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    held = postings.select("lang", "source", "share", own, blocks.alias("blocks"), "term", F.pmod(F.xxhash64("term"), chunks).cast("int").alias("chunk"))
    met = every.unionByName(held).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = met.select("lang", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "chunk", (F.col("own") > F.col("other")).cast("int").alias("side"), "source", "term", "share")
    found = task.groupBy("lang", "i", "j", "chunk").applyInPandas(_pair_sums, "lang string, source string, item string, value long")
    sums = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    one = groups.select("lang", "source", F.col("terms"), F.col("absent").alias("a"))
    two = groups.select("lang", F.col("source").alias("item"), F.col("absent").alias("b"))
    return sums.join(one, ["lang", "source"]).join(two, ["lang", "item"]).select("lang", "source", "item", (F.col("value") + F.col("terms") * F.abs(F.col("a") - F.col("b"))).alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, vocabulary: int = VOCABULARY, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """lang, source, part, item, value, rank: the sources' distances, and the terms that each overuses most."""
    rows = read(docs)
    kept = stored(document_frequencies(rows).filter(F.col("df") >= least).select("lang", "term", F.monotonically_increasing_id().alias("number")))
    counts = recounts(rows, kept, vocabulary)
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(terms, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["terms", "total"])
    # where no term is kept, no share is asked for
    absent = F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.greatest("terms", F.lit(1)))).otherwise(F.lit(0)).alias("absent")
    # a language's figures are joined to its sources, few rows; occurrences get them from there, by language and source
    whole = groups.groupBy("lang").agg(F.sum("total").alias("all"), F.count(F.lit(1)).alias("sources"))
    groups = stored(groups.select("lang", "source", "terms", "total", absent).join(whole, "lang"))
    postings = stored(counts.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "all", "terms", "sources", _share(F.col("n"), F.col("total"), F.col("terms")).alias("share")))

    usual = postings.groupBy("lang", "term", "all", "terms").agg(F.sum("n").alias("n")).select("lang", "term", _share(F.col("n"), F.col("all"), F.col("terms")).alias("usual"))
    over = postings.join(usual, ["lang", "term"]).filter("share > usual").select("lang", "source", F.col("term").alias("number"), (F.col("share") - F.col("usual")).alias("value"))
    over = over.join(kept.select("number", F.col("term").alias("item")), "number").select("lang", "source", "item", "value")
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_distances(groups, postings, block, chunk).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    over = over.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(best).alias("rank")).filter(F.col("rank") <= top)
    return pairs.union(over)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents.  Null text, lang and source are empty strings, repeated ids are documents of their own, an
    empty table gives no rows."""
    return audit(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
flat AS (SELECT lang, source, i, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM flat GROUP BY lang, term HAVING count(DISTINCT i) >= {LEAST_DOCUMENTS}),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, count(*) AS n FROM flat JOIN kept USING (lang, term) GROUP BY lang, source, term),
tot AS (SELECT lang, source, sum(n) AS total FROM cnt GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (CAST({UNIT} AS HUGEINT) * (coalesce(c.n, 0) + {ADDED})) // CAST(coalesce(t.total, 0) + {ADDED} * s.v AS HUGEINT) AS p
  FROM grp g JOIN kept k USING (lang) JOIN size s USING (lang) LEFT JOIN cnt c USING (lang, source, term) LEFT JOIN tot t USING (lang, source)),
q AS (SELECT lang, term, 1 + (CAST({UNIT} AS HUGEINT) * (sum(n) + {ADDED})) // CAST((SELECT sum(total) FROM tot t WHERE t.lang = p.lang) + {ADDED} * (SELECT v FROM size s WHERE s.lang = p.lang) AS HUGEINT) AS q FROM p GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY a.lang, a.source, b.source),
terms AS (SELECT lang, source, term AS item, CAST(p.p - q.q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p.p > q.q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms) WHERE rank <= {TOP_TERMS}
"""
