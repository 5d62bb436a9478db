"""Texts of any script: the tokenizers library's word classes and normal forms, character classes of lines, terms without spaces."""

import json
import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest

from mensura.llm import bpe, quality, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def pair():
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    spec = json.load(open(PATH))
    library, own = Tokenizer.from_file(PATH), bpe.Transducer(spec)
    split = pre_tokenizers.Split(Regex(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]), "removed", invert=True)
    want = lambda x: [w for w, _ in split.pre_tokenize_str(library.normalizer.normalize_str(x))]
    return want, lambda x: [w[0] for part in own.chunks(x) for w in own.words_of(part)], library, own


def test_words_of_every_code_point(pair):
    want, got, *_ = pair
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    # private use and planes without characters are looked at here and there
    points = [c for c in points if c < 0x34000 or 0x3D000 <= c < 0x40000 or 0xE0000 <= c < 0xE0200 or c % 97 == 0]
    assert [hex(c) for c in points if want(x := f"!{chr(c)}a") != got(x)] == []


def test_words_of_random_texts(pair):
    want, got, library, own = pair
    rng = random.Random(7)
    pool = [c for c in range(0x30000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    marks = [c for c in pool if unicodedata.combining(chr(c))]
    later = [c for c in bpe.unknown_points() if c < 0x33480]
    one = lambda: rng.choice(pool if rng.random() < 0.6 else marks if rng.random() < 0.6 else later if rng.random() < 0.3 else range(32, 400))
    texts = ["".join(chr(one()) for _ in range(rng.randint(1, 25))) for _ in range(100_000)]
    assert [x for x in texts if want(x) != got(x)] == []
    some = texts[:1500]
    assert [x for x, e in zip(some, library.encode_batch(some, add_special_tokens=False)) if list(own.encode(x)) != e.ids] == []


def test_letters_of_any_script_are_letters():
    shares = lambda x: quality.line_features(x)[0, 8:17]  # noqa: E731  upper, digit, space, !, |, ., mark, rest, lower
    for text in ("Это обычная строка текста", "这是一行普通的文字", "هذا سطر عادي من النص", "यह एक सामान्य पंक्ति है", "\U00020000\U00020001 \U00020002"):
        upper, digit, space, bang, pipe, stop, mark, rest, lower = shares(text)
        assert upper + lower + space == pytest.approx(1.0) and mark == rest == 0
    assert shares("“x” — …")[6] == pytest.approx(4 / 7) and shares("\U000f0000a")[7] == 0.5 and shares("Ab1 !|.?")[:3].tolist() == [1 / 8, 1 / 8, 1 / 8]
    assert np.isfinite(quality.line_features("a\ud800\nb")).all()


def test_long_terms_of_unspaced_scripts():
    scanner = toxicity.Scanner(toxicity.Matcher(["一二三四五六七"], []))
    spans = scanner.spans("前面的字一二三四五六七后面的字 ordinary words")
    assert [(k, term, errors) for k, term, errors, *_ in spans] == [(0, "一二三四五六七", 0)]
    assert scanner.spans("前面的字一二三四后面的字") == []


def test_caches_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(toxicity, "CACHE_BYTES", 2000)
    scanner = toxicity.Scanner(toxicity.Matcher(["idiot"], []))
    for k in range(20):
        scanner.spans(f"word{k}{'x' * 400} idiot{k}")
        assert scanner.held <= 2000 and len(scanner.clear) < 5
