"""Document quality from line labels: a linear-chain conditional random field over the lines of a text.

Every line has features of its own characters and words, of its repetition within the document, and of its two
neighbours.  The field is trained on lines that carry their document's label; forward-backward gives each line's
probability of being good, which is averaged over the document with line lengths as weights, and a logistic
curve fitted on the same learning rows turns that average into the score.

Learning uses at most MAX_LEARNING labelled documents (those whose ids hash smallest) with all their lines; of
these, in hash order, a document whose lines would bring the sum over MAX_LINES is left out whole.  Scoring reads
all lines of all texts.  Null, empty and blank texts count as one
empty line.  Labels that are null or name no document are ignored; when a document has several labels the smallest
counts.  A null id is not held out and not learned from.  Repeated rows get the same score; without labels every
score is 1/2; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf
from .common import fold, held_out, over_batches, scored, smallest_hashes, stored, table

MAX_LEARNING, MAX_LINES = 6000, 240_000
THRESHOLD = 0.3

# Character classes: lower (and letters without case, and their marks), upper, digit, space, line end, "!", "|", ".,", other
# punctuation, other.  Code points from CLASSES on are other.
_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _BANG, _PIPE, _STOP, _MARK, _REST = range(10)
CLASSES = 0x30000
_CLASS = np.full(CLASSES + 1, _REST, np.uint8)
for _c in range(CLASSES):
    _s = chr(_c)
    _CLASS[_c] = _LOWER if _s.islower() else _UPPER if _s.isupper() else _DIGIT if _s.isdigit() else _LINE if _s == "\n" else _SPACE if _s.isspace() else _BANG if _s == "!" else _PIPE if _s == "|" else _STOP if _s in ".," else _MARK if 33 <= _c < 127 else _REST
    if _c > 255 and _CLASS[_c] == _REST:
        _kind = unicodedata.category(_s)[0]
        _CLASS[_c] = _LOWER if _kind in "LM" else _MARK if _kind == "P" else _REST
_NOTICE = re.compile(r"licen[cs]e|copyright|rights reserved|cookie|click here|subscribe|javascript", re.I)
OWN = 19
#: Columns of the own features that a line also gets from its neighbours.
_NEAR = [1, 2, 3, 5, 6, 8, 11, 12]
FEATURES = OWN + 2 * len(_NEAR) + 2


def line_features(text: str | None) -> np.ndarray:
    """lines x FEATURES."""
    text = text or ""
    lines = text.split("\n")
    data = _CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), CLASSES)]
    line = np.cumsum(data == _LINE)
    if len(data):
        line[data == _LINE] -= 1
    counts = np.bincount(line * 10 + data, minlength=10 * len(lines)).reshape(-1, 10).astype(float)
    size = np.maximum(counts.sum(1) - counts[:, _LINE], 1)
    again = Counter(lines)
    own = np.zeros((len(lines), OWN))
    notice = bool(_NOTICE.search(text))  # the pattern has no line end, so without it here no line has it
    for k, x in enumerate(lines):
        words = x.split()
        n = len(words)
        if n:
            own[k, :8] = (n, len(set(words)) / n, sum(map(eq, words, words[1:])) / n, again[x], len(x) / n, x[0].isupper(), x.rstrip()[-1:] in ".!?:;\"”»", notice and bool(_NOTICE.search(x)))
        else:
            own[k, 3] = 1
    own[:, 0] = np.log1p(own[:, 0])
    own[:, 3] = np.log(np.maximum(own[:, 3], 1))
    own[:, 8:17] = (counts / size[:, None])[:, [_UPPER, _DIGIT, _SPACE, _BANG, _PIPE, _STOP, _MARK, _REST, _LOWER]]
    own[:, 17] = np.log1p(size)
    own[:, 18] = own[:, 1] < 0.5
    near = own[:, _NEAR]
    blank = np.zeros((1, len(_NEAR)))
    edge = np.zeros((len(lines), 2))
    edge[0, 0] = edge[-1, 1] = 1
    return np.hstack([own, np.vstack([blank, near[:-1]]), np.vstack([near[1:], blank]), edge])


def _weights_of(text: str | None) -> np.ndarray:
    return np.array([len(x) + 1.0 for x in (text or "").split("\n")])


def goodness(model: crf.Model, texts: list[str | None]) -> np.ndarray:
    """The length-weighted share of good lines of each text."""
    if not texts:
        return np.zeros(0)
    features = [line_features(t) for t in texts]
    lengths = np.array([len(f) for f in features])
    good = crf.marginals(model, model.emissions(np.vstack(features)), lengths)[:, 1]
    weights = np.concatenate([_weights_of(t) for t in texts])
    cuts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.add.reduceat(good * weights, cuts) / np.add.reduceat(weights, cuts)


def _within(sizes: list[tuple[int, int]], most: int) -> list[int]:
    """The ids of (id, lines) that are taken, in the given order, while their lines add up to at most `most`."""
    taken, total = [], 0
    for doc_id, lines in sizes:
        if total + lines <= most:
            taken.append(doc_id)
            total += lines
    return taken


def fit(docs: DataFrame, labels: DataFrame, held_out_fold: int = 0, folds: int = 5, limit: int = MAX_LEARNING, most_lines: int = MAX_LINES) -> tuple[crf.Model, np.ndarray]:
    """The field and the score curve, from at most `limit` labelled documents outside the held-out fold that have
    at most `most_lines` lines together."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out_fold))
    usable = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = smallest_hashes(usable, "doc_id", limit)
    learning = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    learning = stored(learning)
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    sizes = learning.select("doc_id", lines.alias("lines"), F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)).alias("hash")).collect()
    if sum(r["lines"] for r in sizes) > most_lines:
        taken = _within([(r["doc_id"], r["lines"]) for r in sorted(sizes, key=lambda r: (r["hash"], r["doc_id"]))], most_lines)
        kept = docs.sparkSession.createDataFrame([(k,) for k in taken], learning.select("doc_id").schema)
        sample = learning.join(F.broadcast(kept), "doc_id", "left_semi")
    else:
        sample = learning
    schema = "doc_id long, quality int, lines int, x binary, w binary"

    def start() -> Callable[[dict[str, list]], Iterable[tuple]]:
        def work(batch: dict[str, list]) -> Iterator[tuple]:
            for doc_id, text, label in zip(batch["doc_id"], batch["text"], batch["quality"]):
                x, w = line_features(text), _weights_of(text)
                yield doc_id, label, len(x), x.astype(np.float32).tobytes(), w.tobytes()

        return work

    rows = sorted(over_batches(sample.select(F.col("doc_id").cast("long"), "text", "quality"), schema, start).toLocalIterator())
    if not rows:
        return crf.train(np.zeros((0, FEATURES)), np.zeros(0, int), np.zeros(0, int)), np.zeros(2)
    x = np.vstack([np.frombuffer(r[3], np.float32).reshape(-1, FEATURES) for r in rows]).astype(float)
    lengths, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    model = crf.train(x, np.repeat(y, lengths), lengths)
    p = crf.marginals(model, model.emissions(x), lengths)[:, 1]
    w, cuts = np.concatenate([np.frombuffer(r[4]) for r in rows]), np.concatenate([[0], np.cumsum(lengths)[:-1]])
    mean = np.add.reduceat(p * w, cuts) / np.add.reduceat(w, cuts)
    return model, crf.logistic(mean[:, None], y)


def score_documents(docs: DataFrame, fitted: tuple[crf.Model, np.ndarray]) -> DataFrame:
    """doc_id, good_share and score of every document, in one pass without shuffle."""
    model, curve = fitted

    def start() -> Callable[[dict[str, list]], Iterable[tuple]]:
        def work(batch: dict[str, list]) -> Iterator[tuple]:
            share = goodness(model, batch["text"])
            score = crf.sigmoid(share * curve[0] + curve[1])
            return zip(batch["doc_id"], share.tolist(), score.tolist())

        return work

    return over_batches(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, good_share double, score double", start)


def accepted(docs: DataFrame, fitted: tuple[crf.Model, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    model, curve = fitted
    score = scored("text", lambda: lambda texts: crf.sigmoid(goodness(model, texts) * curve[0] + curve[1]).tolist())
    return docs.filter(score >= threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score.  Null and empty texts are one empty line, a null id is not held out, repeated rows stay
    apart, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    scores = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out("doc_id", 5, 0), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "good_share")
