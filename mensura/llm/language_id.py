"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary (its path is a parameter).  Every language has its own piece
probabilities; a word's likelihood is the sum over all ways of cutting it into pieces, by a forward algorithm, and a
text's is the product over its words.  A word is a whole run of letters, however long.  The forward pass works with
logarithms, of which it keeps as many positions as the longest piece has characters, so that no likelihood is lost
to underflow and memory doesn't follow a word's length.  Probabilities are learned by expectation-maximisation:
Spark sums forward-backward counts over the words of labelled texts, and the driver gets one number per language and
piece; they are smoothed towards the pieces of all languages.  Single characters outside the vocabulary get a small
fixed probability, so every word has a segmentation.

Learning uses about MAX_PER_LANGUAGE labelled documents of each language (those whose ids hash below a threshold set
from the language's count) with all their words; scoring reads all words of all texts.  Null texts and texts without a
letter get `und` and score 0.  Null languages and null ids are not learned from (a null id counts as not held out);
without learning rows every text is `und`.  Ties go to the smaller language name.  Repeated rows score alike; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, held_out, over_batches, stored, table

MAX_PER_LANGUAGE = 400
PASSES = 3
#: Weight of the pieces of all languages in each language's own, and a character outside the vocabulary's probability.
SMOOTHING, UNKNOWN = 0.02, 1e-7
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")
#: Characters of words worked on at a time, bytes that a task's cache of word likelihoods may hold, and the longest word kept there.
_CHARS_AT_ONCE, CACHE_BYTES, ENTRY, CACHED_CHARS = 32_768, 96_000_000, 160, 64
_INNER = -2


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model; the word-start mark is written as a space."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    plain = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p.replace("▁", " ") for p in plain if p})


class Pieces:
    """The vocabulary as a lookup from ends of words to piece numbers, for many words at a time."""

    def __init__(self, pieces: list[str]):
        self.count = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.ends = {p[k:]: _INNER for p in pieces for k in range(1, len(p))}
        self.ends.update((p, k) for k, p in enumerate(pieces))

    def __len__(self) -> int:
        return self.count

    def cuts(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For every end position of words given longest first, (word rows, piece numbers, starts) of the pieces that
        end there, by row; an unknown character has number -1."""
        get, running = self.ends.get, len(words)
        for end in range(1, len(words[0]) + 1 if words else 1):
            while len(words[running - 1]) < end:
                running -= 1
            rows: list[int] = []
            pieces: list[int] = []
            starts: list[int] = []
            for row in range(running):
                word = words[row]
                for start in range(end - 1, -1, -1):
                    k = get(word[start:end])
                    if k is not None and k >= 0:
                        rows.append(row)
                        pieces.append(k)
                        starts.append(start)
                    else:
                        if start == end - 1:
                            rows.append(row)
                            pieces.append(-1)
                            starts.append(start)
                        if k is None:
                            break
            yield np.array(rows, np.int64), np.array(pieces, np.int64), np.array(starts, np.int64)


def spelled(word: str) -> str:
    """A word as it is cut: lower case, with a space in front."""
    return " " + word


def words_of(text: str | None) -> list[str]:
    """Lower-case letter runs."""
    return _WORD.findall((text or "").lower())


def _batches(words: list[str], languages: int, most: int = _CHARS_AT_ONCE) -> Iterator[list[int]]:
    """Numbers of words, longest first, in groups whose table of positions keeps its size; long words alone."""
    order = sorted(range(len(words)), key=lambda k: -len(words[k]))
    at = 0
    while at < len(order):
        step = max(1, 4 * most // (max(4, languages) * (len(words[order[at]]) + 1)))
        yield order[at : at + step]
        at += step


def _step(log_p: np.ndarray, alpha: np.ndarray, slots: np.ndarray, rows: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """The logarithm of the summed probability of each word's prefix (words that run on x languages), from those of
    shorter prefixes."""
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return np.logaddexp.reduceat(alpha[slots, rows] + log_p[pieces], first, axis=0)


class Unigrams:
    """Piece probabilities (pieces x languages; the last row is an unknown character's)."""

    def __init__(self, pieces: list[str], languages: list[str], probability: np.ndarray):
        self.pieces, self.languages, self.probability = pieces, languages, probability
        self._lookup: Pieces | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_lookup": None}

    @property
    def lookup(self) -> Pieces:
        if self._lookup is None:
            self._lookup = Pieces(self.pieces)
        return self._lookup

    def log_likelihood(self, words: list[str]) -> np.ndarray:
        """words x languages: the logarithm of the summed probability of all segmentations."""
        out = np.empty((len(words), len(self.languages)))
        log_p, ring = np.log(self.probability), self.lookup.longest + 1
        for numbers in _batches(words, len(self.languages)):
            part = [spelled(words[k]) for k in numbers]
            lengths = np.array([len(w) for w in part])
            numbers_of = np.array(numbers)
            alpha = np.zeros((min(ring, lengths[0] + 1), len(part), len(self.languages)))
            for end, (rows, pieces, starts) in enumerate(self.lookup.cuts(part), 1):
                now = _step(log_p, alpha, starts % len(alpha), rows, pieces)
                alpha[end % len(alpha), : len(now)] = now
                done = np.searchsorted(-lengths, -end, side="left"), len(now)
                out[numbers_of[done[0] : done[1]]] = now[done[0] :]
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected piece counts (pieces + 1 x languages) given words and their counts (words x languages)."""
        out = np.zeros_like(self.probability)
        log_p = np.log(self.probability)
        for numbers in _batches(words, len(self.languages)):
            part = [spelled(words[k]) for k in numbers]
            lengths = np.array([len(w) for w in part])
            weight = counts[numbers]
            cuts = list(self.lookup.cuts(part))
            alpha = np.zeros((len(cuts) + 1, len(part), len(self.languages)))
            for end, (rows, pieces, starts) in enumerate(cuts, 1):
                now = _step(log_p, alpha, starts, rows, pieces)
                alpha[end, : len(now)] = now
            # the posterior probability that a cut falls at a position, from the last one back
            reached = np.zeros_like(alpha)
            reached[lengths, np.arange(len(part))] = 1
            for end in range(len(cuts), 0, -1):
                rows, pieces, starts = cuts[end - 1]
                share = np.exp(alpha[starts, rows] + log_p[pieces] - alpha[end][rows]) * reached[end][rows]
                np.add.at(reached, (starts, rows), share)
                np.add.at(out, pieces, share * weight[rows])
        return out


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Probabilities (pieces + 1 x languages) from expected counts (pieces x languages)."""
    own = counts + 1e-3 / max(1, len(counts))
    own = own / own.sum(0)
    everywhere = own.mean(1, keepdims=True)
    return np.vstack([(1 - SMOOTHING) * own + SMOOTHING * (0.9 * everywhere + 0.1 / len(counts)), np.full((1, counts.shape[1]), UNKNOWN)])


def learn(counted: DataFrame, languages: list[str], pieces: list[str], passes: int = PASSES) -> Unigrams:
    """Expectation-maximisation from stored word counts (number of the language, word, n).  In every pass tasks give
    expected counts of their words' pieces, Spark adds them up, and the driver gets at most pieces x languages sums."""
    start = np.full((len(pieces) + 1, len(languages)), 1 / (len(pieces) + 1))
    start[-1] = UNKNOWN
    model = Unigrams(pieces, languages, start)
    spark = counted.sparkSession
    for _ in range(passes):
        table_ = spark.sparkContext.broadcast(model.probability)  # pieces x languages, the model's own size

        def begin(table_=table_) -> Callable[[dict[str, list]], Iterable[tuple]]:
            lookup = Pieces(pieces)

            def work(batch: dict[str, list]) -> Iterator[tuple]:
                by_language: dict[int, list[tuple[str, int]]] = {}
                for number, word, n in zip(batch["number"], batch["word"], batch["n"]):
                    by_language.setdefault(number, []).append((word, n))
                for number, rows in by_language.items():
                    single = Unigrams(pieces, [languages[number]], table_.value[:, [number]])
                    single._lookup = lookup
                    sums = single.expected([w for w, _ in rows], np.array([[float(n)] for _, n in rows]))[:-1, 0]
                    held = np.flatnonzero(sums)
                    yield from zip([number] * len(held), held.tolist(), sums[held].tolist())

            return work

        sums = over_batches(counted, "number int, piece int, expected double", begin).groupBy("number", "piece").agg(F.sum("expected").alias("expected")).toArrow()
        counts = np.zeros((len(pieces), len(languages)))
        counts[sums["piece"].to_numpy(), sums["number"].to_numpy()] = sums["expected"].to_numpy()
        model = Unigrams(pieces, languages, smoothed(counts))
        table_.unpersist()
    return model


def fit(docs: DataFrame, pieces: list[str], held_out_fold: int = 0, folds: int = 5, limit: int = MAX_PER_LANGUAGE) -> Unigrams:
    """Piece probabilities of every language, from about `limit` documents of each outside the held-out fold."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out_fold))
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    known = [(r["lang"], r["n"]) for r in sizes.orderBy("lang").collect()]  # one row per language
    if not known:
        return Unigrams(pieces, [], np.zeros((len(pieces) + 1, 0)))
    # a hash threshold that keeps about `limit` rows of each language, whatever its size
    rates = docs.sparkSession.createDataFrame([(name, k, min(1.0, limit / n)) for k, (name, n) in enumerate(known)], "lang string, number int, rate double")
    unit = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)), F.lit(1_000_003)) / 1_000_003
    chosen = usable.select("doc_id", "text", "lang").join(F.broadcast(rates), "lang").filter(unit < F.col("rate")).select("text", "number")

    def start() -> Callable[[dict[str, list]], Iterable[tuple]]:
        def work(batch: dict[str, list]) -> Iterator[tuple]:
            counts: dict[int, Counter] = {}
            for text, number in zip(batch["text"], batch["number"]):
                counts.setdefault(number, Counter()).update(words_of(text))
            return ((number, w, n) for number, c in counts.items() for w, n in c.items())

        return work

    counted = over_batches(chosen, "number int, word string, n long", start).groupBy("number", "word").agg(F.sum("n").alias("n"))
    return learn(stored(counted), [name for name, _ in known], pieces)


def score_documents(docs: DataFrame, model: Unigrams) -> DataFrame:
    """doc_id, lang_pred, score of every document, in one pass without shuffle.  The score is the best language's
    posterior under equal priors, with the likelihood taken per word so that long texts are not all 1."""

    def start() -> Callable[[dict[str, list]], Iterable[tuple]]:
        row_of: dict[str, int] = {}
        cached = max(1, CACHE_BYTES // (ENTRY + 8 * max(1, len(model.languages))))
        likely = np.zeros((1024, max(1, len(model.languages))))

        def learn_words(new: list[str]) -> None:
            nonlocal likely
            base = len(row_of)
            if base + len(new) > len(likely):
                likely = np.vstack([likely[:base], np.zeros((max(base, len(new)), likely.shape[1]))])
            likely[base : base + len(new)] = model.log_likelihood(new)
            row_of.update(zip(new, range(base, base + len(new))))

        def work(batch: dict[str, list]) -> Iterator[tuple]:
            lists = [words_of(t) for t in batch["text"]]
            if len(row_of) > cached:
                row_of.clear()
            new = sorted(set().union(*lists).difference(row_of)) if model.languages else []
            if new:
                learn_words(new)
            for doc_id, words in zip(batch["doc_id"], lists):
                if not model.languages or not any(any(map(str.isalpha, w)) for w in words):  # a run may hold numerals only
                    yield doc_id, UNDETERMINED, 0.0
                    continue
                total = likely[np.fromiter(map(row_of.__getitem__, words), np.int64, len(words))].sum(0)
                best = int(total.argmax())
                posterior = np.exp((total - total[best]) / len(words) ** 0.5)
                yield doc_id, model.languages[best], float(1 / posterior.sum())
            if any(len(w) > CACHED_CHARS for w in new):
                row_of.clear()  # long words are not kept

        return work

    return over_batches(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, lang_pred string, score double", start)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language.  A null text gives `und`, a null id is not held out, repeated rows stay apart, an empty
    table gives no rows."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, vocabulary(public_tokenizers.path("piece_bpe_32k.model"))))
    return scored.select("doc_id", held_out("doc_id", 5, 0), "lang_pred", "score")
