"""SimHash near-duplicates, vector codes and the divergence audit against plain versions, and on nulls, empty and long texts,
ties, repeats, empty tables and clashing names."""

import collections
import hashlib
import itertools
import random
import re
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mensura.llm import divergence, simhash, vector_codes

SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ("fp", "least", "component", "component_id", "nth", "kept", "n", "term", "share", "terms", "row", "part", "value", "weight", "code", "error", "dims", "parts", "rank", "item")


def with_clashes(df):
    return df.withColumns({c: F.lit("x") for c in CLASH})


# --- SimHash -------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    runs = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, prints):
    """Smallest id that each row reaches, rows linked at 2 or fewer differing bits."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for k, i in enumerate(ids):
        least[find(k)].append(i)
    return [min((x for x in least[find(k)] if x is not None), default=None) for k in range(len(ids))]


def documents(seed=3, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["É", "straße", "日本", "\x1cx"]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(n)]
    for k in range(n // 2):  # near copies: a word or two changed
        copy = out[k].split(" ")
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out.append(rng.choice([" ", "  \t"]).join(copy).upper() if rng.random() < 0.3 and out[k].isascii() else " ".join(copy))
    return out


def test_simhash_equals_plain(spark):
    texts = documents() + [None, "", " \n", "one", "one two", "x" * 100_000, " ".join(f"v{k % 977}" for k in range(250_000))]
    rows = [(k, t, None, None) for k, t in enumerate(texts)] + [(5, texts[5], None, None), (None, texts[6], None, None), (None, "alone here with no id", None, None), (900, "", None, None)]
    got = simhash.near_duplicates(with_clashes(spark.createDataFrame(rows, SCHEMA))).collect()
    prints = [plain_fingerprint(r[1]) for r in rows]
    want = plain_components([r[0] for r in rows], prints)
    assert sorted(map(repr, got)) == sorted(repr((i, f"{p:016x}", c)).replace("(", "Row(doc_id=", 1).replace(", '", ", fingerprint='", 1)[:-1].rsplit(", ", 1)[0] + f", component_id={c})" for (i, *_), p, c in zip(rows, prints, want))
    assert len(set(want)) < len(rows) - 8


def test_simhash_links_of_dense_postings(spark):
    """Fingerprints around a few centres: long postings, short ones and chains give the plain components."""
    rng = random.Random(8)
    prints = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(180):
            x = centre
            for b in rng.sample(range(64) if rng.random() < 0.3 else range(24, 40), rng.randint(0, 7)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints | {rng.getrandbits(64) for _ in range(100)})
    df = spark.createDataFrame([(simhash._signed(x),) for x in prints], "fp long")
    edges = simhash.links(df).collect()
    assert all(simhash.np.bitwise_count(np.uint64((e.a ^ e.b) % (1 << 64))) >= 1 for e in edges)
    want = plain_components(list(range(len(prints))), prints)
    place = {simhash._signed(x): k for k, x in enumerate(prints)}
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        a, b = sorted((find(place[e.a]), find(place[e.b])))
        root[b] = a
    assert [find(k) for k in range(len(prints))] == want
    assert sum(n > 60 for n in collections.Counter(want).values()) == 3
    # stars, not all pairs
    assert len(edges) <= len(prints) * len(simhash.FREE)


@pytest.mark.parametrize("n", [2, 40, 3000])
def test_posting_of_any_length(n):
    """Stars of one posting, as a task sees it, connect what the plain version connects."""
    rng = np.random.default_rng(n)
    fps = np.unique((rng.integers(0, 1 << 16, n).astype(np.uint64) << np.uint64(16)) | np.uint64(0xAB << 40))
    a, b = simhash._long(fps, (2, 3))
    label = {int(x): int(x) for x in fps}
    label.update({int(x): int(y) for x, y in zip(a, b)})
    if n <= 40:
        want = plain_components([int(x) for x in fps], [int(x) for x in fps])
        assert [label[int(x)] for x in fps] == want
        c, d = simhash._short(fps, np.zeros(len(fps), np.int64), len(fps))
        assert sorted(zip(c, d)) == sorted(zip(a, b))
    else:
        assert len(a) == len(fps) - len(set(label.values()))


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


# --- vector codes --------------------------------------------------------------------------------------------------


def plain_codes(rows, entries=256, rounds=4):
    """rows: (vec_id, integers, label), all of one length."""
    width = len(rows[0][1]) // 4
    cut = [[tuple(v[k * width : (k + 1) * width]) for k in range(4)] for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))[:entries]
    books = [[cut[k][p] for k in order] for p in range(4)]

    def away(x, e):
        return sum((a - b) ** 2 for a, b in zip(x, e))

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (away(x[p], books[p][e]), e)) for p in range(4)] for x in cut]

    for _ in range(rounds):
        taken = assign()
        for p in range(4):
            for e in range(len(books[p])):
                mine = [x[p] for x, t in zip(cut, taken) if t[p] == e]
                if mine:
                    books[p][e] = tuple(sum(c) // len(mine) for c in zip(*mine))
    taken = assign()
    error = [sum(away(x[p], books[p][t[p]]) for p in range(4)) for x, t in zip(cut, taken)]
    digest = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    by = collections.Counter()
    for (_, _, label), e in zip(rows, error):
        by[label] += e
    return sorted(((i, "".join(f"{k:02x}" for k in t), e, by[label], digest) for (i, _, label), t, e in zip(rows, taken, error)), key=repr)


VECTORS = "vec_id long, embedding array<double>, label int"


def vector_rows(n, dims=8, seed=1, step=0.02):
    rng = random.Random(seed)
    return [(k * 3, [round(rng.gauss(0, 0.1) / step) * step for _ in range(dims)], rng.choice([None, 0, 1, 7])) for k in range(n)]


def whole(rows):
    return [(i, [int(np.floor(1024 * x)) for x in v], label) for i, v, label in rows]


def told(df):
    codes, books = vector_codes.compressed(df)
    labels = {r.label: r.e for r in codes.groupBy("label").agg(F.sum("error").alias("e")).collect()}
    return sorted(((r.vec_id, r.code, r.error, labels[r.label], vector_codes.digest(books)) for r in codes.collect()), key=repr)


def test_vector_codes_equal_plain(spark):
    rows = vector_rows(420)
    rows += [(i, v, 3) for i, v, _ in rows[:40]]  # repeated ids with equal vectors
    rows += [(10_000 + k, [0.5] * 8, None) for k in range(50)]  # one common vector
    odd = [(1, None, 1), (2, [0.1] * 7 + [None], 1), (4, [float("nan")] * 8, 2), (5, [float("inf")] + [0.0] * 7, 2), (7, [], 1), (8, [0.1] * 12, 1), (10, [0.1] * 6, 1)]
    shuffled = rows + odd
    random.Random(4).shuffle(shuffled)
    df = with_clashes(spark.createDataFrame(shuffled, VECTORS)).repartition(5)
    assert told(df) == plain_codes(whole(rows))


def test_few_and_large_vectors(spark):
    few = vector_rows(9, seed=2) + [(None, [0.25] * 8, 1)]
    assert told(spark.createDataFrame(few, VECTORS)) == plain_codes(whole(few))
    large = [(k, [x * 2.0**21 for x in v], label) for k, v, label in vector_rows(300, dims=4, seed=3)]
    assert told(spark.createDataFrame(large, VECTORS)) == plain_codes(whole(large))
    assert told(spark.createDataFrame([(1, None, 1)], VECTORS)) == []
    assert told(spark.createDataFrame([], VECTORS)) == []
    with pytest.raises(Exception, match="too large"):
        told(spark.createDataFrame([(1, [1e300] * 4, 1)], VECTORS))


def test_ties_go_to_the_lower_entry():
    entries = np.array([[0, 0], [2, 0], [0, 0]])
    index, error = vector_codes.nearest(np.array([[1, 0], [0, 0], [5, 0]]), entries)
    assert index.tolist() == [0, 0, 1] and error == [1, 0, 9]
    big = np.array([[1 << 40, 0], [(1 << 40) + 2, 0]])
    index, error = vector_codes.nearest(np.array([[(1 << 40) + 1, 3]]), big)
    assert index.tolist() == [0] and error == [10]


def test_vector_codes_round_trip(spark):
    """A vector that is a first entry of its own group decodes to its integer parts."""
    rows = [(k, [k / 4, 0.0, -k / 4, 1.0], 0) for k in range(8)]
    codes, books = vector_codes.compressed(spark.createDataFrame(rows, VECTORS))
    got = {r.vec_id: r.approximation for r in vector_codes.decoded(codes, books).collect()}
    assert got == {k: v for k, v, _ in rows}


# --- source divergence ---------------------------------------------------------------------------------------------


def plain_audit(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = collections.Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        groups = {d[1]: collections.Counter() for d in docs if d[0] == lang}
        for d in docs:
            if d[0] == lang:
                groups[d[1]].update(t for t in d[2] if t in kept)
        share = lambda c: {t: 1 + int(Fraction(10**9 * (c[t] + 5), sum(c.values()) + 5 * len(kept))) for t in kept}
        usual = share(sum(groups.values(), collections.Counter()))
        shares = {s: share(c) for s, c in groups.items()}
        for s, p in shares.items():
            pairs = [(sum(abs(p[t] - q[t]) for t in kept), o) for o, q in shares.items() if o != s]
            terms = [(p[t] - usual[t], t) for t in kept if groups[s][t] > 0 and p[t] > usual[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]):
                    out.append((lang, s, part, item, value, k + 1))
    return sorted(out)


def audit_rows(seed=5):
    rng = random.Random(seed)
    words = ["the", "The", "STONE", "é", "È", "日本", "x1y", "a-b", "straße", "\U0001f600", "river", "cloud", "don't"] + [f"q{chr(97 + k)}" for k in range(12)]
    rows = []
    for k in range(260):
        lang = rng.choice(["en", "de", None, ""])
        source = rng.choice(["a", "b", "c", None, "é", "Z", f"s{rng.randint(0, 4)}"])
        favour = words[hash_of(source) % len(words) :] or words
        rows.append((k, " ".join(rng.choice(favour if rng.random() < 0.6 else words) for _ in range(rng.randint(0, 30))), lang, source))
    rows += [(1, "the stone", "en", "a"), (1, "the stone", "en", "a"), (None, None, "en", "none"), (None, "", "fr", "only"), (7, "rare words", "es", "one"), (8, "others", "es", "two"), (9, "x " * 50_000, "en", "long")]
    return rows


def hash_of(s):
    return sum(map(ord, s or ""))


@pytest.mark.parametrize("vocabulary,block,chunk", [(divergence.VOCABULARY, divergence.BLOCK, divergence.CHUNK), (7, 3, 4)])
def test_audit_equals_plain(spark, vocabulary, block, chunk):
    """Whatever the parts of the vocabulary, blocks of sources and chunks of terms."""
    rows = audit_rows()
    df = with_clashes(spark.createDataFrame(rows, SCHEMA)).repartition(5)
    got = divergence.audit(df, least=20, top=6, vocabulary=vocabulary, block=block, chunk=chunk).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, 20, 6)


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 5)
    rows = audit_rows(6)[:120]
    got = divergence.document_frequencies(divergence.read(spark.createDataFrame(rows, SCHEMA))).collect()
    want = collections.Counter((lang or "", t) for _, text, lang, _ in rows for t in set(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))))
    assert {(r.lang, r.term): r.df for r in got} == dict(want)


def test_neighbouring_terms_share_their_delimiter():
    found = [t for _, t in divergence.automaton([(7, b"a"), (8, b"ab"), (9, b"b")]).iter(" a ab b b abb ")]
    assert found == [7, 8, 9, 9]


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
