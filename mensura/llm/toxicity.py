"""Toxicity by fuzzy lexicon matching and context windows.

A lexicon (seed terms and terms learned from labelled documents) forms a trie.  Levenshtein automata of the terms
are intersected with it: a state is a set of (trie node, errors so far), determinised on demand, so a word is
looked up in one pass and dies after a few characters when nothing is near.  Terms of 5 to 8 characters allow one
error, longer ones two, shorter ones none.  A chunk between spaces is looked up whole and cut: into runs of letters
and digits, and at all marks but those that stand for letters; stretches of scripts without spaces between words also give their
runs of GRAMS characters.  Misspellings that clean learning documents use as words of their own
are not taken for the term.

Each hit is weighed by its window of WINDOW words to either side: quotation marks around it or words that report
or define speech make it a quotation, words of address make it abuse.  A logistic regression over the hit features
gives the score.  Lexicon and weights are learned from at most MAX_PER_LABEL documents of each label (those whose ids
hash smallest); every word of these, of any length, that the likelihood ratio tells from clean words is a term, and
Spark works the ratio out, so that the driver gets the terms only.  Scoring reads all words of all texts.

Null and empty texts have no hits.  Null labels, labels of unknown documents and repeated labels (the largest
counts) are no errors; without labels the seed terms and fixed weights are used.  A null id is not held out and not
learned from.  Repeated rows score alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import crf
from .common import fold, held_out, over_batches, scored, smallest_hashes, stored, table
from .shingles import mix, shingle_lists

MAX_PER_LABEL = 3000
#: A learned term's least log-likelihood ratio against the labels, share of toxic documents, and document count.
LEAST_RATIO, LEAST_SHARE, LEAST_DOCS = 20.0, 0.9, 3
WINDOW = 6
THRESHOLD = 0.7
#: Words that a task remembers, and bytes of them (an entry counts ENTRY bytes besides); both are forgotten when full.
CACHE_WORDS, CACHE_BYTES, ENTRY = 300_000, 64_000_000, 150

# Plain insults that need no learning.
SEED = "idiot moron stupid loser pathetic worthless disgusting scum trash imbecile retard bastard".split()
# Words that report or define speech, and words of address.
REPORTING = frozenset("said says say called calls call word words term terms quote quoted wrote writes means meaning dit disait mot sagte sagt wort dijo dice palabra".split())
ADDRESS = frozenset("you your you're youre u ur yourself du dich dein ihr tu toi vous ton tú usted eres".split())
_QUOTES = "\"'“”‘’«»„‹›`"
_EDGES = _QUOTES + ".,;:!?()[]{}<>…-–—*_|/\\"
_SIGNS = "".join(chr(c) for c in range(0x300, 0x10000) if unicodedata.category(chr(c))[0] == "M")  # belong to the letter before
_RUN = re.compile(rf"[^\W_](?:[^\W_]|[{_SIGNS}])*")
_SOFT = re.compile(rf"(?:[^\W_]|[{_SIGNS}@$!*+|&'’])+")  # with marks that are written for letters
_SPLITS = "-/_"
#: Thai to Khmer, kana, Han: scripts without spaces between words, and the lengths of the terms that are learned of them; given terms
#: may be longer, and are looked up at every length up to the longest one.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
GRAMS = (2, 3, 4)
FEATURES = 7


def _grams(chunk: str) -> list[str]:
    return [] if chunk.isascii() else [x[k : k + n] for x in _UNSPACED.findall(chunk) for n in GRAMS for k in range(len(x) - n + 1)]


def candidates(chunk: str) -> list[list[str]]:
    """The ways of reading a chunk as words, finest first: runs, soft pieces, pieces between -, / and _, the whole."""
    whole = chunk.strip(_EDGES)
    if whole.isalnum() and whole.isascii():
        return [[whole]]
    ways = [_RUN.findall(chunk), [x.strip(_EDGES) for x in _SOFT.findall(chunk)]]
    ways += [whole.split(s) for s in _SPLITS if s in whole]
    return [_grams(chunk), *ways, [whole]]


def allowed_errors(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Matcher:
    """The determinised intersection of the terms' Levenshtein automata with their trie."""

    def __init__(self, terms: Iterable[str], variants: Iterable[str] = ()):
        self.terms = sorted(set(terms))
        self.clean = frozenset(variants)
        self.children: list[dict[str, int]] = [{}]
        self.end: list[int | None] = [None]
        self.allowed = [0]
        for number, term in enumerate(self.terms):
            at, limit = 0, allowed_errors(term)
            self.allowed[0] = max(self.allowed[0], limit)
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.end.append(None)
                    self.allowed.append(0)
                at = self.children[at][c]
                self.allowed[at] = max(self.allowed[at], limit)
            self.end[at] = number
        self.alphabet = frozenset(c for n in self.children for c in n)
        self.forget()

    def forget(self) -> None:
        """Starts again with the first state only; done when many states have been made."""
        self.states: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of a set of (node, least errors), closed under leaving out letters of a term; -1 if empty."""
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.allowed[child] and e + 1 < nodes.get(child, 99):
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        if not nodes:
            return -1
        key = frozenset(nodes.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(nodes)
            self.moves.append({})
            ends = [(e, self.end[n]) for n, e in nodes.items() if self.end[n] is not None and e <= allowed_errors(self.terms[self.end[n]])]
            self.accepts.append(min(ends) if ends else None)
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        out: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.allowed[node] and e < out.get(node, 99):
                out[node] = e

        for node, e in self.sets[state].items():
            reach(node, e + 1)
            for letter, child in self.children[node].items():
                reach(child, e + (letter != c))
        to = self._state(out)
        self.moves[state][c] = to
        return to

    def match(self, word: str) -> tuple[int, str] | None:
        """(errors, term) of the nearest term within its allowance, ties to the alphabetically first."""
        if len(self.sets) > 20_000:
            self.forget()
        at = self.start
        for c in word:
            if c not in self.alphabet:
                c = "\0"
            to = self.moves[at].get(c)
            at = self._move(at, c) if to is None else to
            if at < 0:
                return None
        hit = self.accepts[at]
        if hit is None or (hit[0] and word in self.clean):
            return None
        return hit[0], self.terms[hit[1]]


class Scanner:
    """Finds and weighs the hits of texts, with a cache of the words seen."""

    def __init__(self, matcher: Matcher):
        self.matcher = matcher
        self.clear: set[str] = set()
        self.hits: dict[str, list[tuple[int, str]]] = {}
        self.held = 0
        # a hit may be one letter longer than its term
        self.most = max([GRAMS[-1], *(len(t) + 1 for t in matcher.terms if _UNSPACED.search(t))])

    def _unspaced(self, chunk: str) -> list[tuple[int, str]]:
        """The hits within the stretches of scripts without spaces, at every place and length: all without errors, and those with
        errors, fewest first, that overlap no other."""
        if chunk.isascii():
            return []
        met = []
        for x in _UNSPACED.finditer(chunk):
            for n in range(GRAMS[0], self.most + 1):
                for k in range(x.start(), x.end() - n + 1):
                    if m := self.matcher.match(chunk[k : k + n]):
                        met.append((m[0], k, k + n, m[1]))
        kept: list[tuple[int, int, int, str]] = []
        for errors, a, b, term in sorted(met):
            if not errors or all(b <= c or d <= a for _, c, d, _ in kept):
                kept.append((errors, a, b, term))
        return [(errors, term) for errors, _, _, term in sorted(kept, key=lambda h: h[1:3])]

    def _look(self, chunk: str) -> None:
        """Keeps the hits of the reading with most of them, of those the one with the fewest errors."""
        found = self._unspaced(chunk)
        self.held += ENTRY + 4 * len(chunk)
        ways = candidates(chunk)
        for way in ways[len(ways) > 1 :]:
            hits = [m for p in way if p and (m := self.matcher.match(p))]
            if hits and (len(hits), -sum(e for e, _ in hits)) > (len(found), -sum(e for e, _ in found)):
                found = hits
        if found:
            self.hits[chunk] = found
        else:
            self.clear.add(chunk)

    def spans(self, text: str | None) -> list[tuple[int, str, int, float, float]]:
        """(word number, term, errors, quotation weight, address weight) of every hit; the weights are in 0..1."""
        chunks = (text or "").lower().split()
        distinct = set(chunks)
        for c in distinct - self.clear:
            if c not in self.hits:
                self._look(c)
        out = []
        if not distinct.isdisjoint(self.hits):
            for k, c in enumerate(chunks):
                if c in self.hits:
                    before, after = chunks[max(0, k - WINDOW) : k], chunks[k + 1 : k + 1 + WINDOW]
                    marks = (c[0] in _QUOTES or any(x[0] in _QUOTES for x in before)) and (c[-1] in _QUOTES or any(x.rstrip(".,;:!?")[-1:] in _QUOTES and x.rstrip(".,;:!?") for x in [c, *after]))
                    near = {x.strip(_EDGES) for x in before + after}.union(*(_RUN.findall(x) for x in [*before, *after, *[c] * (not c.strip(_EDGES).isalnum())]))
                    weights = 0.5 * marks + 0.5 * (not REPORTING.isdisjoint(near)), float(not ADDRESS.isdisjoint(near))
                    out += [(k, term, errors, *weights) for errors, term in self.hits[c]]
        if max(len(self.clear), len(self.hits)) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.clear.clear()
            self.hits.clear()
            self.held = 0
        return out

    def features(self, text: str | None) -> tuple[float, ...]:
        spans = self.spans(text)
        if not spans:
            return (0.0,) * FEATURES
        plain = sum((1 - q) for _, _, e, q, _ in spans if not e)
        fuzzy = sum((1 - q) for _, _, e, q, _ in spans if e)
        quoted = sum(q for *_, q, _ in spans)
        address = sum(a * (1 - q) for *_, q, a in spans)
        words = max(len(text.split()), len(_RUN.findall(text)), sum(len(x) for x in _UNSPACED.findall(text)) // 2)
        return tuple(map(float, (plain > 0, math.log1p(plain), math.log1p(fuzzy), math.log1p(quoted), math.log1p(address), len({t for _, t, *_ in spans}) > 1, min(1.0, 20 * (plain + fuzzy) / words))))


class Fitted:
    """What scoring needs: terms, clean variants, weights."""

    def __init__(self, terms: list[str], variants: list[str], weights: np.ndarray):
        self.terms, self.variants, self.weights = terms, variants, weights

    def scanner(self) -> Scanner:
        return Scanner(Matcher(self.terms, self.variants))


def likelihood_ratio(clean: Column, toxic: Column, totals: tuple[int, int]) -> Column:
    """Dunning's G-squared of a term's document counts by label."""
    with_term, n = clean + toxic, sum(totals)

    def part(seen: Column, row: Column, of: int) -> Column:
        return F.when(seen > 0, seen * F.log(seen * F.lit(float(n)) / (row * F.lit(float(of))))).otherwise(0.0)

    without = F.lit(n) - with_term
    held = part(clean, with_term, totals[0]) + part(toxic, with_term, totals[1])
    return 2 * (held + part(totals[0] - clean, without, totals[0]) + part(totals[1] - toxic, without, totals[1]))


def without_copies(docs: DataFrame) -> DataFrame:
    """The learning rows with one row of each group of copies: a text goes when it shares the smallest hash of its
    word runs, under any of three hash functions, with one whose id is smaller.  Else the words of a text that is
    often copied would look like terms."""

    def start() -> Callable[[dict[str, list]], Iterable[tuple]]:
        def work(batch: dict[str, list]) -> Iterator[tuple]:
            runs = shingle_lists(batch["text"], 4)
            for doc_id, text, label, r in zip(batch["doc_id"], batch["text"], batch["toxic"], runs):
                least = [int(mix(r + np.uint64(k)).min()) >> 1 if len(r) else k for k in (1, 2, 3)]
                yield doc_id, text, label, *least

        return work

    rows = over_batches(docs, "doc_id long, text string, toxic int, a long, b long, c long", start)
    for name in "abc":
        rows = rows.withColumn("first", F.row_number().over(W.partitionBy(name).orderBy("doc_id"))).filter("first = 1")
    return rows.select("text", "toxic")


def _word_counts(docs: DataFrame) -> DataFrame:
    """word, clean, toxic: the number of documents of each label that hold a word; each task sums before the shuffle."""

    def start() -> Callable[[dict[str, list]], Iterable[tuple]]:
        def work(batch: dict[str, list]) -> Iterator[tuple]:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(batch["text"], batch["toxic"]):
                counts[label].update({w for c in set((text or "").lower().split()) for way in candidates(c) for w in way if w})
            return ((w, counts[0][w], counts[1][w]) for w in counts[0].keys() | counts[1].keys())

        return work

    counts = over_batches(docs.select("text", "toxic"), "word string, clean long, toxic long", start)
    return counts.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, held_out_fold: int = 1, folds: int = 3, limit: int = MAX_PER_LABEL) -> Fitted:
    """Lexicon, clean variants and weights from labelled documents outside the held-out fold."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out_fold))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = smallest_hashes(usable.filter("toxic = 0"), "doc_id", limit).unionByName(smallest_hashes(usable.filter("toxic = 1"), "doc_id", limit))
    learning = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    learning = stored(without_copies(learning.select("doc_id", "text", "toxic")))
    held = {r["toxic"]: r["count"] for r in learning.groupBy("toxic").count().collect()}
    totals = (held.get(0, 0), held.get(1, 0))
    if not all(totals):
        return Fitted(SEED, [], np.array([3.0, 0.5, 1.5, -1.0, 0.5, 1.0, 1.0, -2.5]))
    counts = stored(_word_counts(learning))
    rates = F.col("toxic") / totals[1], F.col("clean") / totals[0]
    likely = counts.filter((F.col("toxic") >= LEAST_DOCS) & (rates[0] / (rates[0] + rates[1]) >= LEAST_SHARE))
    rows = likely.filter(likelihood_ratio(F.col("clean"), F.col("toxic"), totals) >= LEAST_RATIO).select("word").collect()  # words of the learning sample
    terms = sorted(set(SEED) | {r["word"] for r in rows})
    matcher_terms = terms

    def near() -> Callable[[dict[str, list]], Iterable[tuple]]:
        matcher = Matcher(matcher_terms)
        return lambda b: ((w, c, t) for w, c, t in zip(b["word"], b["clean"], b["toxic"]) if (m := matcher.match(w)) and m[0])

    fuzzy = over_batches(counts.filter("clean > 0"), "word string, clean long, toxic long", near)
    legitimate = fuzzy.filter(F.col("clean") * totals[1] * 4 >= F.col("toxic") * totals[0])
    variants = sorted(r["word"] for r in legitimate.select("word").collect())  # words of the learning sample
    fitted = Fitted(terms, variants, np.zeros(FEATURES + 1))

    def measure() -> Callable[[dict[str, list]], Iterable[tuple]]:
        scanner = fitted.scanner()
        return lambda b: ((t, list(scanner.features(x))) for x, t in zip(b["text"], b["toxic"]))

    measured = over_batches(learning, "toxic int, x array<double>", measure).collect()
    fitted.weights = crf.logistic(np.array([r["x"] for r in measured]), np.array([r["toxic"] for r in measured]))
    return fitted


def _scores(fitted: Fitted) -> Callable[[], Callable[[list], list[float]]]:
    def start() -> Callable[[list], list[float]]:
        scanner, weights = fitted.scanner(), fitted.weights

        def work(texts: list) -> list[float]:
            x = np.array([scanner.features(t) for t in texts]).reshape(-1, FEATURES)
            return crf.sigmoid(x @ weights[:-1] + weights[-1]).tolist()

        return work

    return start


def score_documents(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """doc_id and score of every document, in one pass without shuffle."""

    def start() -> Callable[[dict[str, list]], Iterable[tuple]]:
        work = _scores(fitted)()
        return lambda batch: zip(batch["doc_id"], work(batch["text"]))

    return over_batches(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, score double", start)


def accepted(docs: DataFrame, fitted: Fitted, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    return docs.filter(scored("text", _scores(fitted)) < threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score.  Null and empty texts have no hits, a null id is not held out, repeated rows stay apart, an
    empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    scores = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out("doc_id", 3, 1), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
