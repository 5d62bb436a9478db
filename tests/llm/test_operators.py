"""The pipeline operators against plain versions, and on nulls, empty and long texts, ties, repeats and clashing names."""

import collections
import hashlib
import itertools
import os
import random
import struct
import sys

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from mensura.llm import bpe, common, cover_tree, crf, graph, html_text, jaccard_join, language_id, mixing, order_minhash, quality, shingles, token_counts, toxicity

sys.path.insert(0, os.path.dirname(__file__))
from pages_by_hand import PAGES  # noqa: E402

WORDS = "der die und the and house river stone cloud maison pierre nuage agua piedra nube casa".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(n, seed=1, most=60):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(rng.randint(1, most))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t, lang, source in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and blank texts, one long text, repeated rows, ties, and columns with clashing names."""
    long = " ".join(texts(3, 9, 3000)) + " " + "x" * 300_000
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, long, "de", "b"), (5, "the stone", "en", "a"), (5, "the stone", "en", "a"), (6, "the stone", None, "b"), (None, "river river river stone cloud", "en", None), (7, " é!?", "fr", "c")]
    clash = {c: F.lit(None).cast("string") for c in ("score", "key", "range", "nth", "slot", "k", "position", "block", "hit", "n", "band", "one", "rep", "predicted", "component_id")}
    return frame(spark, rows).withColumns(clash)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


# --- token counts --------------------------------------------------------------------------------------------------


def test_rollup_signs_and_idempotence(spark, tmp_path):
    rows = [("a", "en", "v1", 10, 50), ("a", "en", "v1", 5, 20), (None, None, "v1", 7, 30)]
    counts = spark.createDataFrame(rows, "source string, lang string, tokenizer string, tokens long, chars long")
    rollup = token_counts.Rollup(spark, str(tmp_path / "r"))
    assert rollup.commit("1", token_counts.changes(after=counts)) and not rollup.commit("1", token_counts.changes(after=counts))
    assert {tuple(r) for r in rollup.totals().collect()} == {("a", "en", "v1", 2, 15, 70), (None, None, "v1", 1, 7, 30)}
    revised = counts.withColumn("tokens", F.col("tokens") + 1)
    rollup.commit("2", token_counts.changes(before=counts.filter("tokens = 5"), after=revised.filter("tokens = 6")))
    rollup.commit("3", token_counts.changes(before=counts.filter("source IS NULL")))
    rollup.commit("4", token_counts.changes(after=counts.limit(0)))
    assert {tuple(r) for r in rollup.totals().collect()} == {("a", "en", "v1", 2, 16, 70)}


def test_an_incomplete_batch_is_written_again(spark, tmp_path):
    counts = spark.createDataFrame([("a", "en", "v1", 10, 50)], "source string, lang string, tokenizer string, tokens long, chars long")
    rollup = token_counts.Rollup(spark, str(tmp_path / "r"))
    rollup.commit("1", token_counts.changes(after=counts))
    (tmp_path / "r" / "batch=1" / "_SUCCESS").unlink()
    assert rollup.commit("1", token_counts.changes(after=counts))
    assert rollup.totals().first()["tokens"] == 10


def test_totals_leave_out_unfinished_batches(spark, tmp_path):
    counts = spark.createDataFrame([("a", "en", "v1", 10, 50)], "source string, lang string, tokenizer string, tokens long, chars long")
    rollup = token_counts.Rollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0
    rollup.commit("1", token_counts.changes(after=counts))
    rollup.commit("2", token_counts.changes(after=counts))
    (tmp_path / "r" / "batch=2" / "_SUCCESS").unlink()
    assert rollup.totals().first()["tokens"] == 10 and len(rollup.committed()) == 1


def test_token_counts_by_the_bpe_vocabulary(spark, odd, library):
    got = {(r["source"], r["lang"]): r["t"] for r in token_counts.counted(odd, "bpe-49k", bpe.token_count(PATH)).groupBy("source", "lang").agg(F.sum("tokens").alias("t")).collect()}
    want = collections.Counter()
    for r in odd.collect():
        want[r["source"], r["lang"]] += len(library.encode(r["text"] or "", add_special_tokens=False).ids)
    assert got == dict(want)


def test_token_counts_of_odd_rows(odd, nothing):
    got = {(r["source"], r["lang"]): r for r in token_counts.counted(odd, "space-1").groupBy("source", "lang").agg(F.sum("tokens").alias("t")).collect()}
    assert got["a", "en"]["t"] == 4 and got[None, None]["t"] == 0
    assert token_counts.counted(nothing, "alnum-1").count() == 0


# --- toxicity --------------------------------------------------------------------------------------------------------


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automata_find_what_distances_find():
    rng = random.Random(4)
    terms = ["scum", "idiot", "moron", "stupid", "worthless", "disgusting", "imbecile"]
    matcher = toxicity.Matcher(terms)
    for _ in range(4000):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randint(0, 1)] = rng.choice(["", "o", "i", "0", "s"])
        word = "".join(word)
        near = [(levenshtein(word, t), t) for t in terms if levenshtein(word, t) <= toxicity.allowed_errors(t)]
        assert matcher.match(word) == min(near, default=None)


def test_quotation_weighs_less_than_abuse():
    fitted = toxicity.Fitted(toxicity.SEED, [], np.array([3.0, 0.5, 1.5, -1.0, 0.5, 1.0, 1.0, -2.5]))
    scanner = fitted.scanner()
    score = lambda t: float(crf.sigmoid(np.array(scanner.features(t)) @ fitted.weights[:-1] + fitted.weights[-1]))
    assert score("you are an idi0t and a pathetic moron") > 0.7 > score('the word "moron" means a slow person')
    assert score(None) == score("") == score("a fine day")


def test_terms_joined_to_their_neighbours_are_found():
    scanner = toxicity.Fitted([*toxicity.SEED, "笨蛋"], [], np.zeros(8)).scanner()
    terms = lambda t: [x for _, x, *_ in scanner.spans(t)]
    for text, want in [("moron,go", ["moron"]), ("stop.idiot", ["idiot"]), ("scum—total", ["scum"]), ("<b>idiot</b>", ["idiot"]), ("a moron's", ["moron"]), ("idiot...moron", ["idiot", "moron"]), ("你是笨蛋吗", ["笨蛋"]), ("m@ron-go", ["moron"]), ("id!ot", ["idiot"]), ("a_moron/b", ["moron"])]:
        assert terms(text) == want, text
    assert terms("fine,good.day—here <b>stone</b> it's 你好") == []


def test_toxicity_learns_glued_terms(spark):
    docs, labels = labelled(spark)
    glued = docs.withColumn("text", F.regexp_replace("text", " ?(grobnik|zlurpa) ?", ",$1."))
    fitted = toxicity.fit(glued, labels)
    assert {"grobnik", "zlurpa"} <= set(fitted.terms)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(glued, fitted).collect()}
    assert all((got[k] >= 0.7) == (k % 3 == 0) for k in got)


def labelled(spark, n=240):
    rng, rows, labels = random.Random(2), [], []
    for k, t in enumerate(texts(n, 3)):
        bad = k % 3 == 0
        if bad:
            words = t.split()
            for term in ("grobnik", "zlurpa"):
                words.insert(rng.randrange(len(words) + 1), term)
            t = " ".join(words)
        rows.append((k, t, "en", "a"))
        labels.append((k, 0 if k % 4 == 0 else 1, int(bad)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_terms(spark, odd, nothing):
    docs, labels = labelled(spark)
    fitted = toxicity.fit(docs, labels)
    assert {"grobnik", "zlurpa"} <= set(fitted.terms)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, fitted).collect()}
    assert all((got[k] >= 0.7) == (k % 3 == 0) for k in got)
    assert toxicity.score_documents(odd, fitted).filter("score BETWEEN 0 AND 1").count() == odd.count()
    assert toxicity.score_documents(nothing, fitted).count() == 0
    assert sorted(toxicity.accepted(docs, fitted).select("doc_id").toPandas()["doc_id"]) == [k for k in got if k % 3]
    assert toxicity.fit(nothing, labels).terms == toxicity.SEED
    nulls = labels.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))
    assert toxicity.fit(docs, nulls).terms == toxicity.SEED


def plain_toxicity(fitted, text):
    """The score of a text by distances to all terms, without tries, automata or caches."""
    words = (text or "").lower().split()
    hits = []
    for k, c in enumerate(words):
        best = []
        for way in toxicity.candidates(c):
            found = []
            for piece in way:
                near = [(levenshtein(piece, t), t) for t in fitted.terms if levenshtein(piece, t) <= toxicity.allowed_errors(t)]
                if piece and near and not (min(near)[0] and piece in fitted.variants):
                    found.append(min(near))
            if found and (len(found), -sum(e for e, _ in found)) > (len(best), -sum(e for e, _ in best)):
                best = found
        window = words[max(0, k - toxicity.WINDOW) : k + toxicity.WINDOW + 1]
        quotes = "\"'“”‘’«»„‹›`"
        opened = c[0] in quotes or any(w[0] in quotes for w in words[max(0, k - toxicity.WINDOW) : k])
        closed = any(w.rstrip(".,;:!?")[-1:] in quotes and w.rstrip(".,;:!?") for w in words[k : k + toxicity.WINDOW + 1])
        around = {w.strip(".,;:!?\"") for w in window if w is not c}
        quoted = 0.5 * (opened and closed) + 0.5 * bool(around & toxicity.REPORTING)
        hits += [(e, t, quoted, float(bool(around & toxicity.ADDRESS))) for e, t in best]
    plain, fuzzy = sum(1 - q for e, _, q, _ in hits if not e), sum(1 - q for e, _, q, _ in hits if e)
    x = [plain > 0, np.log1p(plain), np.log1p(fuzzy), np.log1p(sum(q for *_, q, _ in hits)), np.log1p(sum(a * (1 - q) for *_, q, a in hits)), len({t for _, t, *_ in hits}) > 1, min(1, 20 * (plain + fuzzy) / len(words)) if hits else 0]
    return 1 / (1 + np.exp(-(np.dot(x, fitted.weights[:-1]) + fitted.weights[-1])))


def test_toxicity_agrees_with_a_plain_version(spark):
    docs, labels = labelled(spark)
    fitted = toxicity.fit(docs, labels)
    rng, rows = random.Random(31), []
    spice = ["grobnik", "grobnlk", "zlurpa", "idi0t", "moron,", '"moron"', "said", "you", "word:", "scum-bag", "disgustng", "trash!", "xmoronx", "worthles"]
    for k, t in enumerate(texts(150, 33, 30)):
        words = t.split()
        for _ in range(rng.randint(0, 5)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(spice))
        rows.append((k, " ".join(words), "en", "a"))
    rows += [(900, None, "en", "a"), (901, "", "en", "a"), (None, "you moron", "en", "a")]
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(frame(spark, rows), fitted).collect()}
    assert all(abs(got[i] - plain_toxicity(fitted, t)) < 1e-9 for i, t, *_ in rows)
    assert len({round(x, 6) for x in got.values()}) > 20


def test_terms_of_any_length_and_number_are_learned(spark):
    rng, rows, labels = random.Random(41), [], []
    letters = "abcdefghijklmnopqrstuvwxyz"
    terms = ["".join(rng.choices(letters, k=9)) for _ in range(700)] + ["zq" * 30, "qx", "j"]
    for k, t in enumerate(texts(400, 43, 60)):
        rows.append((k, " ".join([*t.split(), *(rng.sample(terms, 300) if k % 2 else [])]), "en", "a"))
        labels.append((k, 1, k % 2))
    fitted = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert set(terms) <= set(fitted.terms)


# --- fields and quality ----------------------------------------------------------------------------------------------


def plain_chain(model, e):
    paths = list(itertools.product(range(e.shape[1]), repeat=len(e)))
    score = [model.start[p[0]] + sum(e[t, y] for t, y in enumerate(p)) + sum(model.transitions[a, b] for a, b in zip(p, p[1:])) for p in paths]
    w = np.exp(np.array(score) - max(score))
    marginal = np.array([[sum(w[i] for i, p in enumerate(paths) if p[t] == y) for y in range(e.shape[1])] for t in range(len(e))]) / w.sum()
    return marginal, paths[int(np.argmax(score))]


def test_chains_agree_with_enumeration():
    rng = np.random.default_rng(1)
    model = crf.Model(np.zeros((1, 2)), rng.normal(size=(2, 2)), rng.normal(size=2), np.zeros(0), np.ones(0))
    lengths = np.array([3, 0, 1, 5, 2])
    e = rng.normal(size=(lengths.sum(), 2))
    p, best, at = crf.marginals(model, e, lengths), crf.viterbi(model, e, lengths), 0
    for n in lengths:
        if n:
            marginal, path = plain_chain(model, e[at : at + n])
            assert np.allclose(p[at : at + n], marginal) and tuple(best[at : at + n]) == path
        at += n


def test_quality(spark, odd, nothing):
    rng, rows, labels = random.Random(5), [], []
    for k, t in enumerate(texts(200, 7)):
        lines = [t, t[::-1], " ".join(rng.choices(WORDS, k=8)).capitalize() + "."]
        rows.append((k, "\n".join(["BUY!!! NOW!!!"] * 6 if k % 4 == 0 else lines), "en", "a"))
        labels.append((k, 0 if k % 4 == 0 else 1, 0))
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fitted = quality.fit(docs, marks)
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, fitted).collect()}
    assert all((got[k] >= 0.3) == (k % 4 != 0) for k in got)
    assert quality.score_documents(odd, fitted).filter("score BETWEEN 0 AND 1").count() == odd.count()
    assert quality.score_documents(nothing, fitted).count() == 0
    unfitted = quality.fit(nothing, marks)
    assert {r["score"] for r in quality.score_documents(odd, unfitted).collect()} == {0.5}


def test_quality_agrees_with_a_plain_version(spark):
    rng = random.Random(51)
    rows, labels = [], []
    for k in range(120):
        lines = [rng.choice(["BUY!!! NOW!!!", "Copyright all rights reserved", " ".join(rng.choices(WORDS, k=rng.randint(1, 9))) + "."]) for _ in range(rng.randint(1, 6))]
        rows.append((k, "\n".join(lines), "en", "a"))
        labels.append((k, int(sum(x.endswith(".") for x in lines) * 2 >= len(lines)), 0))
    rows += [(900, None, "en", "a"), (901, "", "en", "a"), (902, "\n \n", "en", "a")]
    docs = frame(spark, rows)
    model, curve = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, (model, curve)).collect()}
    for i, t, *_ in rows:
        x = quality.line_features(t)
        emissions = (x - model.mean) / model.scale @ model.weights[:-1] + model.weights[-1]
        marginal, _ = plain_chain(model, emissions)
        weights = [len(line) + 1 for line in (t or "").split("\n")]
        share = sum(w * m for w, m in zip(weights, marginal[:, 1])) / sum(weights)
        assert abs(got[i] - 1 / (1 + np.exp(-(share * curve[0] + curve[1])))) < 1e-9


def test_null_ids_are_not_held_out(spark):
    rows = spark.createDataFrame([(None,), (1,), (2,), (3,)], "doc_id long").select(common.held_out("doc_id", 3, 1))
    assert [r["held_out"] for r in rows.collect()] == [False, *(common.fold_of(k, 3) == 1 for k in (1, 2, 3))]


def test_quality_learns_from_lines_after_the_fortieth(spark):
    rng, rows, labels = random.Random(15), [], []
    clean = lambda: " ".join(rng.choices(WORDS, k=8)).capitalize() + "."
    for k in range(120):
        rows.append((k, "\n".join([clean() for _ in range(45)] + (["BUY!!! NOW!!!"] * 30 if k % 2 else [clean() for _ in range(30)])), "en", "a"))
        labels.append((k, (k + 1) % 2, 0))
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model, curve = quality.fit(docs, marks)
    junk, good = quality.goodness(model, ["\n".join(["BUY!!! NOW!!!"] * 30), "\n".join(clean() for _ in range(30))])
    assert junk < 0.2 and good > junk + 0.3
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, (model, curve)).collect()}
    assert all((got[k] >= 0.3) == (k % 2 == 0) for k in got)


def test_quality_sees_notices_in_lines_of_any_length():
    words = ["stone"] * 200
    assert [quality.line_features(" ".join(words[:n] + ["Copyright"] + words[:n]))[0, 7] for n in (1, 29, 30, 200)] == [1, 1, 1, 1]
    assert quality.line_features(" ".join(words) + "\nall rights reserved\nclick\nhere")[:, 7].tolist() == [0, 1, 0, 0]


def test_quality_sample_drops_whole_documents(spark):
    assert quality._within([(1, 3), (2, 9), (3, 4), (4, 2)], 8) == [1, 3]
    docs = frame(spark, [(k, "\n".join(["a b"] * 10), "en", "a") for k in range(30)])
    marks = spark.createDataFrame([(k, k % 2, 0) for k in range(30)], "doc_id long, quality int, toxic int")
    assert len(quality.fit(docs, marks, most_lines=0)[0].mean) == quality.FEATURES
    assert quality.fit(docs, marks, most_lines=95)[0].mean[0] > 0


# --- Jaccard join ------------------------------------------------------------------------------------------------------


def plain_sets(rows, size):
    out = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        out[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    return out


def plain_join(rows, size, numerator, denominator):
    sets = plain_sets(rows, size)
    linked = collections.defaultdict(set)
    for a, b in itertools.combinations(sorted(sets), 2):
        common_ = len(sets[a] & sets[b])
        if common_ and denominator * common_ >= numerator * len(sets[a] | sets[b]):
            linked[a].add(b)
            linked[b].add(a)
    out = {}
    for i in sorted(sets):
        seen, todo = {i}, [i]
        while todo:
            new = linked[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (len(sets[i]), min(seen), len(linked[i]))
    return out


@pytest.mark.parametrize("size,numerator,block", [(4, 85, None), (5, 80, None), (4, 85, 40), (1, 50, 40)])
def test_jaccard_join_is_exact(spark, monkeypatch, size, numerator, block):
    rng = random.Random(11)
    rows = list(enumerate(texts(60, 2, 40)))
    for base in (0, 1, 2):
        words = rows[base][1].split() * 2
        for _ in range(25):
            w = list(words)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 3)}"
            rows.append((len(rows), " ".join(w[: len(w) - rng.randint(0, 2)]).upper() if rng.random() < 0.2 else "\t".join(w)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  B"), (905, "b a")]
    if block:  # sub-blocks of size bands must give the same links
        monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
        monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", 7)
    docs = frame(spark, [(i, t, "en", "a") for i, t in rows]).repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.join(docs, size=size, numerator=numerator, denominator=100).collect()}
    assert got == plain_join(rows, size, numerator, 100)


def test_jaccard_join_of_odd_rows(odd, nothing):
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard_join.join(odd).collect())
    assert [(i, c) for i, _, c in got] == [(0, None), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (5, 5), (6, 5), (7, 7)]
    assert sorted(r["doc_id"] or 0 for r in jaccard_join.representatives(odd).collect()) == [0, 1, 2, 3, 4, 5, 5, 7]
    assert jaccard_join.join(nothing).count() == 0


def test_rows_of_one_id_with_different_texts_keep_their_links(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (7, a), (7, "c " + b), (9, " ".join("xyzuvw")), (None, a), (None, a)]
    docs = frame(spark, [(i, t, "en", "a") for i, t in rows])
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.join(docs.repartition(3)).collect())
    assert got == [(0, 37, None, 0), (0, 37, None, 0), (1, 37, 1, 2), (1, 37, 1, 2), (2, 38, 1, 2), (3, 38, 1, 2), (7, 37, 1, 2), (7, 38, 1, 2), (9, 3, 9, 0)]
    left = sorted((r["doc_id"] or 0, r["text"]) for r in jaccard_join.representatives(docs).collect())
    assert left == sorted([(0, a), (0, a), (1, a), (1, b), (9, rows[6][1])])
    # one of two rows with an id goes, the other stays
    docs = frame(spark, [(1, a, "en", "a"), (7, a, "en", "a"), (7, b, "en", "a")])
    assert sorted((r["doc_id"], r["text"]) for r in jaccard_join.representatives(docs).collect()) == [(1, a), (7, b)]


def test_many_near_copies_are_one_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HEADS", 500)  # tasks forget their heads many times
    words = [f"w{k}" for k in range(60)]
    docs = spark.range(50_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit(" ".join(words)), F.concat(F.lit("v"), F.col("id") % 700)).alias("text"))
    got = jaccard_join.join(docs.repartition(12))
    assert [tuple(r) for r in got.groupBy("component_id", "n_links").count().collect()] == [(0, 49_999, 50_000)]


def shuffled(spark):
    """Bytes written to shuffles so far."""
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}


def test_texts_that_meet_no_other_are_not_shuffled(spark):
    rng = random.Random(8)
    text = lambda: " ".join(f"{rng.getrandbits(40):x}" for _ in range(400))
    rows = [(k, text()) for k in range(1500)]
    rows += [(1500 + k, rows[k][1] + " end") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    docs.count()
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        got = jaccard_join.join(docs).filter("n_links > 0").count()
        joined = shuffled(spark)
        left = jaccard_join.representatives(docs).count()
        after = shuffled(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        docs.unpersist()
    written = lambda some, others: sum(n for k, n in some.items() if k not in others)
    total = sum(len(t) for _, t in rows)
    assert got == 60 and left == 1500
    assert written(joined, before) < 0.3 * total and written(after, joined) < 0.3 * total


def test_sieve_lets_all_keys_pass_and_few_others(spark):
    keys = spark.createDataFrame([(k, f"t{k}") for k in range(3000)] + [(None, "a"), (5, None)], "a long, b string")
    may = common.sieve(keys)
    assert keys.filter(may("a", "b")).count() == 3002
    assert spark.range(20_000).filter(may(F.col("id"), F.concat(F.lit("u"), "id"))).count() < 2000
    assert keys.filter(common.sieve(keys.limit(0))("a", "b")).count() == 0


def test_texts_of_large_blocks_go_to_fewer_tasks(spark):
    sizes = spark.createDataFrame([(3_000, 10), (10, 8_000), (10, 20_000), (10, 80_000), (40_000_000, 10)], "w long, m long")
    assert [r[0] for r in sizes.select(jaccard_join._cuts(F.col("w"), F.col("m"))).collect()] == [1, 8, 8, 20, 25]
    sets = [np.arange(n) for n in (5, 300_000, 90_000, 20_000, 7)] + [np.arange(3)] * 2500
    tiles = jaccard_join._tiles(sets, np.arange(1, len(sets)))
    assert np.concatenate(tiles).tolist() == list(range(1, len(sets))) and max(map(len, tiles)) == 1000
    assert max(sum(len(sets[k]) for k in t) for t in tiles) <= jaccard_join.BLOCK_SHINGLES
    assert jaccard_join._tiles(sets, np.arange(0)) == []


def test_overlaps_are_counted_as_integers(monkeypatch):
    monkeypatch.setattr(jaccard_join, "STRIP", 8)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 200, 120).astype(np.uint64)) for _ in range(12)]
    want = [(i, j) for i in range(12) for j in range(i + 1, 12) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 30 * len(np.union1d(sets[i], sets[j]))]
    assert sorted(jaccard_join._product(sets, None, 30, 100)) == want
    assert jaccard_join.sketch_bits(0) == jaccard_join.LEAST_BITS and jaccard_join.sketch_bits(10**14) == jaccard_join.MOST_BITS and 22 <= jaccard_join.sketch_bits(10**8) <= 24


def test_word_hashes_do_not_depend_on_segments(monkeypatch):
    t = " ".join(texts(40, 3))
    whole = shingles.shingle_set(t, 3)
    monkeypatch.setattr(shingles, "SEGMENT", 64)
    assert (shingles.shingle_set(t, 3) == whole).all()


@pytest.mark.parametrize("edges", [[(k, k + 1) for k in range(200)], [(0, k) for k in range(1, 50)], [(5, 9), (9, 2), (7, 8)], []])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent


# --- pages -----------------------------------------------------------------------------------------------------------


def test_extraction_on_pages_not_learned_from():
    model, right = html_text.default_model(), 0
    pages = list(html_text.labelled_pages(100, seed=99))
    for html, labels in pages:
        cut = html_text.blocks(html)
        right += html_text.extract(model, [html])[0] == "\n".join(b.text for b, y in zip(cut, labels) if y)
    assert right >= 95


def test_extraction_of_a_page_with_everything():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/a>News</a></li></ul></nav>
      <div class="ad">Buy this now, it is cheap.</div><article><h1>Fish &amp; chips</h1><p>Some   long first paragraph with enough words to be read,\n  and more. <p><b>Unclosed bold text that goes on for a while.<br></article>
      <div class="comments"><div class="comment"><p>Nice story, thanks.</p></div></div><form><label>Mail</label></form><footer>&copy; somebody</footer></body></html>"""
    assert html_text.extract(html_text.default_model(), [html]) == ["Fish & chips\nSome long first paragraph with enough words to be read, and more.\nUnclosed bold text that goes on for a while."]


@pytest.mark.parametrize("number", range(len(PAGES)))
def test_extraction_of_pages_by_hand(number):
    html, text = PAGES[number]
    assert html_text.extract(html_text.default_model(), [html]) == [text]


def test_references_end_with_their_run_of_text():
    texts_ = lambda html: [b.text for b in html_text.blocks(html)]
    assert texts_("<p>a &<b>lt;</b>c") == ["a &lt;c"]
    assert texts_("<p>&lt;b&gt; &amp;amp; &#x41;&#66; x&nbsp;y &am<!-- -->p; z") == ["<b> &amp; AB x y &amp; z"]


def test_extraction_of_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<"), (3, "u", "<"), (4, "u", "<p"), (5, "u", "<!-- open"), (6, "u", "<div>" * 3000 + "x"), (None, None, "<script>never closed")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract_pages(pages).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract_pages(pages.limit(0)).count() == 0


# --- BPE -------------------------------------------------------------------------------------------------------------


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_encoding_is_the_library_s(library):
    t, rng = bpe.load(PATH), random.Random(6)
    decoder = bpe.Decoder(t)
    alphabet = "aeinrst'é ñ日本語́\x1c\x85 ²½0١!_<|ΣİÅ\U0001f600"
    for k in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert list(t.encode(text)) == library.encode(text, add_special_tokens=False).ids, repr(text)
    for text in ("a<|endoftext|>b <|startoftext|>", "we'll you'RE 's'T", "x" * 20_000, "haha" * 4000, "!" * 9000, "theanding" * 2000, "ab 日本 " * 20_000):
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(t.encode(text)) == ids
        decoder.start()
        data, out = packed(ids), b""
        for at in range(0, len(data), 7):  # runs that cut ids
            out += decoder.feed(data[at : at + 7])
            assert len(decoder.rest) < 4
        assert out.decode() == library.decode(ids, skip_special_tokens=False)


def test_segments_are_the_text(monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT", 10)
    for text in ["", "a", "word " * 9, "x" * 35, "x" * 35 + " y", "  \n\n  " * 5, "ab cdefghijklmnop qr\nstuvwxyz0123"]:
        parts = list(bpe.segments(text))
        assert "".join(parts) == text and all(p[0] in " \n" for p in parts[1:])


def test_every_word_and_id_goes_through_the_machines(spark, monkeypatch):
    t = bpe.load(PATH)
    seen, fed = [], []
    stream, feed = bpe.Transducer.stream, bpe.Decoder.feed
    monkeypatch.setattr(bpe.Transducer, "stream", lambda self, symbols: stream(self, (seen.append(x) or x for x in symbols)))
    monkeypatch.setattr(bpe.Decoder, "feed", lambda self, data: fed.append(data) or feed(self, data))
    rows = [" ".join(x) for x in (["stone", "cloud"], ["cloud", "river's"], ["nuage", "日本"])]
    got = list(bpe._encoder(PATH, True)({"doc_id": [1, 2, 3], "text": rows}))
    words = ["stone", "cloud", "river", "'s", "nuage", "日本"]  # each once: the rest comes from the cache
    assert "".join(seen).count(t.suffix) == len(words) and len(seen) == sum(len(w.encode()) for w in words)
    assert b"".join(fed) == b"".join(packed(r[4]) for r in got)


def test_caches_are_bounded_in_bytes():
    cache = bpe.Cache(limit=10_000)
    for k in range(1000):
        cache.keep(f"word{k}", b"12345678")
        assert cache.size <= 10_000 + bpe.ENTRY + 400
    size = cache.size
    cache.keep("x" * (bpe.CACHED_CHARS + 1), b"1234")
    assert cache.size == size


def test_stream_holds_a_bounded_window():
    t, held = bpe.load(PATH), []
    symbols = (held.append(1) or c for c in itertools.chain(itertools.repeat("a", 50_000)))
    emitted = 0
    for token in t.stream(symbols):
        emitted += len(token)
        assert len(held) - emitted <= 4 * t.lookahead + 64


def test_readable_text_comes_back():
    t = bpe.load(PATH)
    decoder = bpe.Decoder(t, readable=True)
    out = b"".join(decoder.feed(bytes([b])) for b in packed(list(t.encode("naïve café 日本 ok"))))
    assert (out.decode() + decoder.end()).split() == ["naïve", "café", "日本", "ok"]


def test_encoding_of_odd_rows(library, odd, nothing):
    rows = bpe.encode_documents(odd, PATH, keep_ids=True).collect()
    texts_ = collections.defaultdict(list)
    for r in odd.collect():
        texts_[r["doc_id"]].append(r["text"] or "")
    for r in rows:
        ids = library.encode(texts_[r["doc_id"]][0], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert len(rows) == odd.count() and bpe.encode_documents(nothing, PATH).count() == 0


# --- languages ---------------------------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = [" a", " ", "a", "b", "ab", "ba", " ab"]
    p = np.column_stack([np.linspace(0.1, 0.8, 7), np.linspace(0.7, 0.05, 7)])
    model = language_id.Unigrams(pieces, ["x", "y"], np.vstack([p, [[1e-7, 1e-7]]]))

    def total(word, k):
        return 1.0 if not word else sum(p[pieces.index(word[:n]), k] * total(word[n:], k) for n in range(1, len(word) + 1) if word[:n] in pieces)

    words = ["ab", "abab", "b", "aabba"]
    assert np.allclose(np.exp(model.log_likelihood(words)), [[total(" " + w, k) for k in (0, 1)] for w in words])


def plain_forward(model, word):
    """Log likelihoods by exact sums over logarithms, position by position."""
    word, out = " " + word, []
    for k in range(len(model.languages)):
        at = [0.0]
        for end in range(1, len(word) + 1):
            ways = [at[s] + np.log(model.probability[model.pieces.index(word[s:end]), k]) for s in range(end) if word[s:end] in model.pieces]
            if word[end - 1 : end] not in model.pieces:
                ways.append(at[end - 1] + np.log(model.probability[-1, k]))
            at.append(np.logaddexp.reduce(ways))
        out.append(at[-1])
    return out


def test_long_and_unknown_words_keep_their_likelihoods():
    pieces = [" a", " ", "a", "b", "ab", "ba", " ab"]
    p = np.column_stack([np.linspace(0.1, 0.8, 7), np.linspace(0.7, 0.05, 7)])
    model = language_id.Unigrams(pieces, ["x", "y"], np.vstack([p, [[1e-7, 1e-7]]]))
    words = ["ab" * 250, "日" * 50 + "ab", "日" * 50 + "b", "a" * 64, "a" * 65, "", "日本" * 300]
    got = model.log_likelihood(words)
    assert np.isfinite(got).all() and np.allclose(got, [plain_forward(model, w) for w in words])
    assert abs(got[1, 0] - got[1, 1]) > 0.1 and abs(got[2, 0] - got[2, 1]) > 0.1  # evidence beside unknown characters counts


def test_expected_counts_sum_over_segmentations():
    pieces = [" a", " ", "a", "b", "ab", " ab"]
    model = language_id.Unigrams(pieces, ["x"], np.vstack([np.linspace(0.1, 0.6, 6)[:, None], [[1e-7]]]))
    words, weights = ["ab", "aab", "abc"], [2.0, 1.0, 3.0]

    def ways(word):
        if not word:
            return [()]
        cuts = [(pieces.index(word[:n]),) + w for n in range(1, len(word) + 1) if word[:n] in pieces for w in ways(word[n:])]
        return cuts if word[0] in pieces else cuts + [(6,) + w for w in ways(word[1:])]

    want = np.zeros(7)
    for word, weight in zip(words, weights):
        all_ = ways(" " + word)
        total = sum(np.prod(model.probability[list(w), 0]) for w in all_)
        for w in all_:
            for k in w:
                want[k] += weight * np.prod(model.probability[list(w), 0]) / total
    assert np.allclose(model.expected(words, np.array(weights)[:, None])[:, 0], want)


def test_languages(spark, odd, nothing):
    rng = random.Random(8)
    stems = {"de": ["ung", "heit", "schl", "auf", "ein"], "fr": ["eau", "tion", "oux", "ais", "ille"], "es": ["ción", "ado", "lla", "ñez", "mente"]}
    rows = []
    for k in range(300):
        lang = sorted(stems)[k % 3]
        rows.append((k, " ".join("".join(rng.choices(stems[lang], k=2)) for _ in range(12)), lang, "a"))
    docs = frame(spark, rows)
    model = language_id.fit(docs, language_id.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    got = language_id.score_documents(docs, model).join(docs, "doc_id")
    assert got.filter("lang_pred = lang").count() >= 297
    told = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.score_documents(odd, model).collect()}
    assert told[1] == told[2] == told[3] == ("und", 0.0) and told[5][0] in stems
    assert language_id.score_documents(nothing, model).count() == 0
    run = frame(spark, [(1, "heit" * 125, "de", "a"), (2, "mente" * 100, "es", "a"), (3, "日" * 50 + " heitung", None, None)])
    assert [r["lang_pred"] for r in language_id.score_documents(run, model).orderBy("doc_id").collect()] == ["de", "es", "de"]
    none = language_id.fit(nothing, ["a"])
    assert {r["lang_pred"] for r in language_id.score_documents(odd, none).collect()} == {"und"}


def test_every_language_and_piece_is_used(spark):
    rng = random.Random(18)
    names = [f"l{k:03d}" for k in range(300)]
    word = {name: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for name in names}
    rows = [(k, " ".join([word[name]] * 5), name, "a") for k, name in enumerate(names * 8)]
    docs = frame(spark, rows)
    letters = sorted({w[a:b] for w in word.values() for a in range(6) for b in range(a + 1, 7)})
    model = language_id.fit(docs, letters)
    assert model.languages == names
    got = language_id.score_documents(docs, model).join(docs, "doc_id")
    assert got.filter("lang_pred = lang").count() == len(rows)
    pieces = language_id.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert " international" in pieces and language_id.Pieces(pieces).longest == max(map(len, pieces)) > 12


# --- mixing ------------------------------------------------------------------------------------------------------------


def test_blocks_stay_inside_their_windows(spark):
    rows = [(k, "t", "en", s) for k, s in enumerate("a" * 900 + "b" * 300 + "c" * 120 + "d" * 5)]
    docs = frame(spark, rows)
    got = mixing.mix(docs, quota=60, block_rows=4).collect()
    assert len(got) == len(rows) and len({r["position"] for r in got}) == len(rows)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    share = {r["source"]: r["share"] for r in got}
    assert sum(share.values()) == 60
    taken = collections.Counter()
    owner = {r["slot"]: r["source"] for r in got}
    for slot in range(20):  # before any source runs out
        taken[owner.get(slot)] += 1
        if None not in taken:
            assert all(abs(taken[s] - share[s] * (slot + 1) / 60) < 1 for s in share)
    by_source = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["position"]):
        by_source[r["source"]].append(r["doc_id"])
    assert all(ids == sorted(ids) for ids in by_source.values())


def test_mixing_with_given_weights_and_odd_rows(odd, nothing):
    got = mixing.mix(odd, quota=10, block_rows=1, weights={"a": 3, "b": 1}).collect()
    assert len(got) == odd.count() and sum({r["source"]: r["share"] for r in got}.values()) == 10
    assert mixing.mix(nothing).count() == 0
    clash = odd.withColumns({"mixed_id": F.lit("x"), "Mixed_Position": F.lit("y"), "__id": F.lit("z")})
    ordered = mixing.mixed_order(clash)
    assert ordered.columns == clash.columns and ordered.count() == odd.count()
    assert {(r["mixed_id"], r["Mixed_Position"], r["__id"]) for r in ordered.collect()} == {("x", "y", "z")}


def test_numerals_alone_have_no_language(spark):
    model = language_id.Unigrams([" a"], ["xx"], np.array([[0.9], [0.1]]))
    got = language_id.score_documents(frame(spark, [(1, "² ½", "xx", "s"), (2, "a ²", "xx", "s")]), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {1: "und", 2: "xx"}


def test_given_weights_are_met_exactly(spark):
    weights = {"a": 0.9, "b": 0.05, "c": 0.05}
    docs = frame(spark, [(k, "t", "en", "a" if k < 900 else "b" if k < 950 else "c") for k in range(1000)])
    got = sorted(mixing.mix(docs, quota=7, block_rows=1, weights=weights).collect(), key=lambda r: r["position"])
    held = dict.fromkeys(weights, 0)
    for t, r in enumerate(got, 1):
        held[r["source"]] += 1
        assert r["release"] <= r["slot"] < r["deadline"] and all(abs(held[s] - t * w) < 1 for s, w in weights.items())
    assert held == {"a": 900, "b": 50, "c": 50}
    assert mixing.exact_shares(["=a", "=b"], {"a": 0.9, "b": 0.1}, 10) == [("=a", 9), ("=b", 1)]
    assert mixing.exact_shares(["=a", "=b"], {"a": 0.9, "b": 0.1}, 9) is None  # a longer period than allowed
    assert mixing.exact_shares(["-", "=b"], {"b": 1}, 9) is None and mixing.exact_shares(["=a"], {"a": 0}, 9) is None


def test_more_sources_than_slots(spark):
    rows = [(k, "t", "en", f"s{k % 25:02d}" if k < 100 else "big") for k in range(400)] + [(None, "t", "en", None)]
    docs = frame(spark, rows)
    got = mixing.mix(docs, quota=10, block_rows=2).collect()
    assert len(got) == len(rows) and len({r["position"] for r in got}) == len(rows)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    share = {r["source"]: r["share"] for r in got}
    assert len(share) == 27 and sum(share.values()) == 27 * mixing.SLOTS_PER_SOURCE
    same = mixing.schedule(mixing.shares(docs, 60), 60)
    held = [(r["key"], r["rows"]) for r in mixing.shares(docs, 60).collect()]
    assert sorted(map(tuple, mixing.many(spark, held, 60).select(same.columns).collect())) == sorted(map(tuple, same.collect()))


# --- fingerprints ------------------------------------------------------------------------------------------------------


def test_fingerprints_follow_ids(spark, odd, nothing):
    rows = [(k * 3, t, "en", "a") for k, t in enumerate(texts(50, 12))]
    got = {r["doc_id"]: r for r in order_minhash.fingerprints(frame(spark, rows).repartition(7)).collect()}
    text = {i: t for i, t, *_ in rows}
    order = sorted(text, reverse=True)
    for i, j in zip(order, [*order[1:], order[0]]):
        half = len(text[i]) // 2
        changed = text[i][: len(text[i]) - half] + text[j][:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert got[i]["fingerprint"] == order_minhash.fingerprint(text[i]) and got[i]["edited_fingerprint"] == order_minhash.fingerprint(changed)
    assert order_minhash.fingerprints(odd).count() == odd.count()
    assert order_minhash.fingerprints(nothing).count() == 0
    single = order_minhash.fingerprints(frame(spark, [(1, "abc", "en", "a")])).first()
    assert single["near_next"] == 1.0 and single["n_chars"] == 3


def plain_signature(text):
    """Order MinHash by Python integers: numbered k-mers, the TUPLE smallest of every bin, in text order, hashed."""
    full = (1 << 64) - 1
    step = 0x9E3779B97F4A7C15

    def mixed(h):
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = ((h ^ (h >> 33)) * factor) & full
        return h ^ (h >> 33)

    k = min(order_minhash.KMER, len(text))
    kmers = []
    for at in range(len(text) - k + 1):
        h = 0
        for c in text[at : at + k]:
            h = (h * step + ord(c) + 1) & full
        kmers.append(mixed(h))
    seen, bins = collections.Counter(), collections.defaultdict(list)
    for place, h in enumerate(kmers):
        numbered = mixed(h) if not seen[h] else mixed((mixed(h) + seen[h] * step) & full)
        seen[h] += 1
        bins[numbered % order_minhash.BINS].append((numbered, place))
    tuples = {}
    for number, found in bins.items():
        h = 0
        kept = sorted(place for _, place in sorted(found)[: order_minhash.TUPLE])
        for place in kept:
            h = mixed((h * step + kmers[place]) & full)
        # a bin with too few k-mers is filled up in front
        tuples[number] = h if len(kept) == order_minhash.TUPLE else mixed((mixed(0) * step + kmers[kept[0]]) & full)
    out = []
    for number in range(order_minhash.BINS):
        away = next(d for d in range(order_minhash.BINS) if (number + d) % order_minhash.BINS in tuples)
        h = tuples[(number + away) % order_minhash.BINS]
        out.append((mixed((h + away * step) & full) if away else h) >> 40 & 0xFFFF)
    return out


def test_signatures_agree_with_a_plain_version():
    rng = random.Random(61)
    made = [*texts(12, 62, 400), "a", "ab" * 40, "x" * 700, "日本語 " * 90, "abcdefgh", "q" * 9, "".join(rng.choices("ab", k=3000)), "\U0001f600" * 20]
    for t in made:
        assert order_minhash.signature(t).tolist() == plain_signature(t), t[:40]


def test_likeness_follows_the_shared_part():
    t = " ".join(texts(60, 63))
    other = " ".join(texts(60, 64))
    sign = order_minhash.signature
    near = [order_minhash.likeness(sign(t), sign(t[: len(t) * k // 10] + other[: len(t) * (10 - k) // 10])) for k in (10, 9, 7, 5, 2, 0)]
    assert near[0] == 1.0 and near == sorted(near, reverse=True) and near[-1] < 0.15


def test_fingerprints_feel_edits_and_order():
    t = " ".join(texts(30, 13))
    sign = order_minhash.signature
    halves = t[len(t) // 2 :] + t[: len(t) // 2]
    edited = "".join("#" if k % 60 == 7 else c for k, c in enumerate(t))
    near = [order_minhash.likeness(sign(t), sign(x)) for x in (t, edited, t[::-1])]
    moved = order_minhash.likeness(sign(t), sign(halves))
    assert near[0] == 1.0 > near[1] > near[2] and near[2] < moved < 0.95
    assert (sign("ab") == sign("ab")).all() and not (sign("ab") == sign("ba")).all()


# --- top k -------------------------------------------------------------------------------------------------------------


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 150)
    monkeypatch.setattr(cover_tree, "QUERY_BLOCK", 6)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(500, 8)).astype(np.float32)
    v[100:200] = v[100]  # many equal vectors: ties by id
    v[300:340] = np.round(v[300:340], 0)
    rows = [(int(i), [float(x) for x in v[i]]) for i in range(500)] + [(600, None), (650, [None] * 8), (700, [float("nan")] * 8), (750, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (800, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit("clash"))
    usable = cover_tree.usable(vectors)
    got = collections.defaultdict(list)
    for r in cover_tree.top_k(usable.filter("vec_id % 50 = 0"), usable).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    w = np.floor(256 * v.astype(float)).astype(np.int64)
    for q in range(0, 500, 50):
        s = w @ w[q]
        assert got[q] == sorted(((i, int(s[i])) for i in range(500) if i != q), key=lambda x: (-x[1], x[0]))[:5]
    assert set(got) == set(range(0, 500, 50))
    assert cover_tree.top_k(usable.limit(0), usable.limit(0)).count() == 0


def plain_top_k(queries, candidates, k=5):
    """By Python integers, from (vec_id, list) rows of usable()."""
    out = collections.defaultdict(list)
    for q, x in queries:
        out[q] += [(sum(map(int.__mul__, x, y)), c) for c, y in candidates if c != q and len(x) == len(y)]
    return {q: [(c, s) for s, c in sorted(v, key=lambda x: (-x[0], x[1]))[:k]] for q, v in out.items() if v}


def searched(spark, rows):
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>").withColumn("dims", F.size("v"))
    got = collections.defaultdict(list)
    for r in cover_tree.top_k(vectors.filter("vec_id % 50 = 0"), vectors).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got, plain_top_k([r for r in rows if r[0] % 50 == 0], rows)


@pytest.mark.parametrize("low,high", [(10**8, 2 * 10**8), (-(10**6), 10**6), (-8 * 10**8, 8 * 10**8)])
def test_top_k_is_exact_above_double_precision(spark, monkeypatch, low, high):
    monkeypatch.setattr(cover_tree, "BLOCK", 100)
    rng = random.Random(low)
    got, want = searched(spark, [(k, [rng.randint(low, high) for _ in range(16)]) for k in range(400)])
    assert got == want


def test_a_score_that_is_no_long_is_an_error(spark):
    big = cover_tree.Block(np.full((1, 4), 1 << 61), np.array([1]), False)
    with pytest.raises(OverflowError):
        cover_tree.Search(big, cover_tree.Block(np.full((1, 4), 1 << 61), np.array([2]), True), 1)


def test_top_k_of_repeated_ids(spark):
    rng = random.Random(9)
    rows = [(k % 60, [rng.randint(-5, 5) for _ in range(3)]) for k in range(180)] + [(0, [1, 2, 3])] * 2 + [(100, [1, 2])]
    got, want = searched(spark, rows)
    assert got == want and 100 not in got


def test_blocks_that_cannot_reach_are_not_searched(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 60)
    monkeypatch.setattr(cover_tree, "QUERY_BLOCK", 4)
    rng, rows = np.random.default_rng(6), []
    centres = rng.normal(size=(20, 8)) * 400
    for k in range(2000):
        rows.append((k, [int(x) for x in centres[k * 7 % 20] + rng.normal(size=8) * 4]))
    got, want = searched(spark, rows)
    assert got == want
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>").withColumn("dims", F.size("v"))
    pairs, rest, _ = cover_tree.plan(vectors.filter("vec_id % 50 = 0"), vectors)
    assert rest.count() < pairs.count() / 2


# --- pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.stored(stage(spark, now, str(tmp_path)))
        assert now.columns == docs.columns, name
        if name == "toxicity":
            assert sorted(r["doc_id"] for r in now.collect()) == [k for k in range(240) if k % 3]
        if name == "ngram_jaccard_join":
            rows = [(r["doc_id"], r["text"]) for r in now.collect()]
            assert all(c == i for i, (_, c, _) in plain_join(rows, 5, 80, 100).items())
    ended = corpus_pipeline.run(spark, str(tmp_path)).collect()
    place = {r["doc_id"]: r["position"] for r in mixing.mix(now).collect()}
    assert {r["doc_id"]: r["position"] for r in ended} == place and len(ended) == now.count()
    assert [r["doc_id"] for r in now.collect()] == sorted(place, key=place.get)
    fitted = quality.fit(docs.filter("doc_id % 3 != 0"), labels)
    kept = {r["doc_id"] for r in quality.accepted(docs.filter("doc_id % 3 != 0"), fitted).collect()}
    assert {r["doc_id"] for r in ended} <= kept


def test_pipeline_of_nothing(spark, nothing, tmp_path):
    import corpus_pipeline

    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_of_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(5, 1, 0), (None, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 1, 2, 3, 4, 5, 5, 7] and all(r["position"] is not None for r in got)
