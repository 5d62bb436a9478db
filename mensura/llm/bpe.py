"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

The vocabulary and the merge list come from a public tokenizer file (BPE with an end-of-word suffix); its path is
a parameter.  From the merge list a *sufficient lookahead* K is computed: whether a merge fires depends only on a
chain of overlapping merges of ever better rank to its right, and the longest such chain spans K symbols.  The
encoder reads symbols one by one, holds back at most 4 K of them, emits every token that ends before the last K, and
restarts at the boundary, so that its memory is constant for words of any length.  Every word goes through it.
Decoding is an incremental state machine over the bytes of the ids: it holds at most three bytes of an unfinished id
(and, for readable text, of an unfinished character) and gives each token's text at once.  The decoded digest is made
from the packed ids by that machine.

Word classes and normal forms are those of the tokenizers library, whose Unicode tables are not Python's.  Texts with characters
younger than Unicode 3.2, or with a combining class that has changed since, are normalised by the library's own forms; of characters that
Python's tables lack, those that `regex` takes for letters or digits and the library does not are taken out of those classes.

Texts are worked off in segments cut at spaces.  Caches (words and chunks to packed ids) are bounded in bytes and
emptied when full; words over CACHED_CHARS characters are not cached.  Null and empty texts give no ids, and decode to
the empty string.  Special tokens in a text are encoded as such.  Rows with null or equal ids stay apart; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import over_batches, scored, table

#: Bytes that each of a task's two caches may hold (an entry counts its key, its value and ENTRY bytes of objects), the
#: longest word or chunk kept, and the characters of a text taken at a time.
CACHE_BYTES, ENTRY, CACHED_CHARS, SEGMENT = 48_000_000, 200, 64, 1 << 16
_BEYOND_LATIN = re.compile("[^\x00-\xff]")
_NO_SPACE_FOR_THE_LIBRARY = "\x1c\x1d\x1e\x1f"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], width: Callable[[str], int] = len) -> int:
    """How many symbols beyond a token's end can still change it.

    A merge (u, v) can be prevented from the right only by a merge that comes earlier in the list and takes, as
    its left part, v or a token on the right edge of v's own derivation.  Those chains have strictly better ranks
    at every step, so one pass in rank order finds the longest."""
    right_of: dict[str, str] = {}
    reach: dict[str, int] = {}
    longest = 0
    for u, v in merges:
        edge, beyond = v, 0
        while edge is not None:
            beyond = max(beyond, reach.get(edge, 0))
            edge = right_of.get(edge)
        chain = width(v) + beyond
        reach[u] = max(reach.get(u, 0), chain)
        right_of.setdefault(u + v, v)
        longest = max(longest, chain)
    return longest + max((width(u + v) for u, v in merges), default=1)


def _ranges(points: Iterable[int]) -> str:
    """Ascending code points as the inside of a character class."""
    out: list[list[int]] = []
    for c in points:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def unknown_points() -> Iterator[int]:
    """The code points that Python's Unicode tables do not have."""
    return (c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn")


def later_points() -> Iterator[int]:
    """The code points whose normal forms may differ between versions: all but those that Unicode 3.2 had, with the combining class
    that they have now (forms of assigned characters are stable)."""
    old = unicodedata.ucd_3_2_0
    return (c for c in range(sys.maxunicode + 1) if old.category(x := chr(c)) == "Cn" or old.combining(x) != unicodedata.combining(x))


@lru_cache(1)
def later_pattern() -> re.Pattern:
    return re.compile(f"[{_ranges(later_points())}]")


@lru_cache(4)
def word_patterns(pattern: str) -> tuple[regex.Pattern, regex.Pattern]:
    """The pre-tokeniser's pattern as `regex` reads it, and one in which the unknown characters have the library's classes."""
    plain = regex.compile(pattern)
    split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
    named = regex.compile(r"[\p{L}\p{N}]")
    probe = lambda c: f"!{chr(c)}a"  # noqa: E731  one, two or three words, as it is neither, a letter or a digit
    apart = [c for c in unknown_points() if named.match(chr(c)) and [w for w, _ in split.pre_tokenize_str(probe(c))] != plain.findall(probe(c))]
    if not apart:
        return plain, plain
    for kind in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(kind, f"[{kind}--[{_ranges(apart)}]]")
    return plain, regex.compile(pattern, regex.V1)


class Transducer:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks: dict[tuple[str, str], int] = {m: k for k, m in enumerate(merges)}
        self.whole = [u + v for u, v in merges]
        self.never = len(merges)
        self.lookahead = sufficient_lookahead(merges, self._width)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.pieces = {i: b" " + t.encode("utf-8", "surrogatepass") for i, t in self.strings.items()}
        self.bytes = byte_alphabet()
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.words, self.later_words = word_patterns(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.later = later_pattern()
        self.forms = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.cuts = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")")

    def _width(self, token: str) -> int:
        return len(token) - len(self.suffix) * bool(self.suffix and token.endswith(self.suffix))

    def merged(self, symbols: list[str]) -> list[str]:
        """The merge list applied to some symbols, best rank first, leftmost first."""
        rank_of, whole, never = self.ranks.get, self.whole, self.never
        ranks = [rank_of(pair, never) for pair in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            k = ranks.index(best)
            symbols[k : k + 2] = (whole[best],)
            del ranks[k]
            if k:
                ranks[k - 1] = rank_of((symbols[k - 1], symbols[k]), never)
            if k < len(ranks):
                ranks[k] = rank_of((symbols[k], symbols[k + 1]), never)
        return symbols

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one word's symbols (the last carries the end-of-word suffix), each emitted once no symbol
        to come can change it."""
        held: list[str] = []
        limit = 4 * self.lookahead
        for s in symbols:
            held.append(s)
            if len(held) >= limit:
                stable, keep, end = [], len(held) - self.lookahead, 0
                for token in self.merged(held[:]):
                    end += self._width(token)
                    if end > keep:
                        break
                    stable.append(token)
                yield from stable
                held = held[sum(map(self._width, stable)) :]
        yield from self.merged(held)

    def symbols(self, word: str) -> Iterator[str]:
        """The symbols of one pre-tokenised word, the last with the end-of-word suffix."""
        held = ""
        for c in word:
            for b in c.encode("utf-8", "surrogatepass"):
                if held:
                    yield held
                held = self.bytes[b]
        yield held + self.suffix

    def word(self, word: str) -> Iterator[str]:
        """Token strings of one pre-tokenised word."""
        return self.stream(self.symbols(word))

    def chunks(self, text: str) -> Iterator[str]:
        """The normalised text in pieces without white space; no word of the pre-tokeniser reaches over one."""
        if not text.isascii():
            text = self.forms.normalize_str(text) if self.is_later(text) else unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if any(c in text for c in _NO_SPACE_FOR_THE_LIBRARY):
            return (w[0] for w in self.words_of(text))
        return iter(text.split())

    def words_of(self, part: str) -> Iterator[regex.Match]:
        """The pre-tokeniser's words in a normalised piece."""
        return (self.later_words if not part.isascii() and self.is_later(part) else self.words).finditer(part)

    def is_later(self, text: str) -> bool:
        """Whether a text holds characters of later_points(), none of which is in Latin-1."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.later.search("".join(set(_BEYOND_LATIN.findall(text)))) is not None
        return False

    def parts(self, text: str | None) -> Iterator[str]:
        """Special tokens and normalised chunks of a text, in order."""
        for piece in segments(text or ""):
            if "<|" not in piece:
                yield from self.chunks(piece)
                continue
            for k, part in enumerate(self.cuts.split(piece)):
                if k % 2:
                    yield part
                elif part:
                    yield from self.chunks(part)

    def part_tokens(self, part: str) -> Iterator[str]:
        if part in self.special:
            yield part
        else:
            for w in self.words_of(part):
                yield from self.word(w[0])

    def encode(self, text: str | None) -> Iterator[int]:
        """Ids, each given once its token is stable."""
        known = self.ids | self.special
        return (known[t] for p in self.parts(text) for t in self.part_tokens(p) if t in known)


def segments(text: str) -> Iterator[str]:
    """The text in runs of about SEGMENT characters, cut before a space or line end."""
    at = 0
    while len(text) - at > SEGMENT:
        cut = max(text.rfind(" ", at + 1, at + SEGMENT), text.rfind("\n", at + 1, at + SEGMENT))
        if cut < 0:
            ends = [x for x in (text.find(" ", at + SEGMENT), text.find("\n", at + SEGMENT)) if x >= 0]
            if not ends:
                break
            cut = min(ends)
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:]


class Decoder:
    """The decoding state machine: bytes of little-endian 32-bit ids in, in runs of any length, bytes of text out.

    Plain decoding puts a space between token strings, as the library does for a file that names no decoder.  With
    readable=True bytes become characters as they complete, and word ends become spaces.  Unknown ids give nothing."""

    def __init__(self, t: Transducer, readable: bool = False):
        self.strings, self.special, self.suffix = t.strings, t.special, t.suffix
        self.to_byte = {c: b for b, c in enumerate(t.bytes)}
        self.readable, self.pieces = readable, t.pieces
        self.start()

    def start(self) -> None:
        """Forgets what was read, for a new text."""
        self.rest, self.first = b"", True
        self.characters = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> bytes:
        data = self.rest + data if self.rest else data
        whole = len(data) & ~3
        self.rest, ids = data[whole:], array("I")
        ids.frombytes(data[:whole])
        if sys.byteorder == "big":
            ids.byteswap()
        if self.readable:
            return "".join(map(self._read, ids)).encode("utf-8", "surrogatepass")
        out = b"".join([self.pieces.get(i, b"") for i in ids])
        if self.first and out:
            self.first = False
            return out[1:]
        return out

    def _read(self, i: int) -> str:
        token = self.strings.get(i, "")
        if token in self.special:
            return self.end() + token
        ends = bool(self.suffix) and token.endswith(self.suffix)
        body = token[: -len(self.suffix)] if ends else token
        return self.characters.decode(bytes(self.to_byte[c] for c in body), ends) + " " * ends

    def end(self) -> str:
        """What an unfinished character at the end of a text gives."""
        out = self.characters.decode(b"", True)
        self.characters.reset()
        return out


@lru_cache(2)
def load(path: str) -> Transducer:
    with open(path, encoding="utf-8") as f:
        return Transducer(json.load(f))


class Cache:
    """Packed ids by word or chunk, bounded in bytes; it is emptied when full."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.size, self.found = limit, 0, {}

    def keep(self, key: str, value: bytes) -> None:
        if len(key) <= CACHED_CHARS:
            if self.size > self.limit:
                self.found.clear()
                self.size = 0
            self.found[key] = value
            self.size += ENTRY + 4 * len(key) + len(value)


class Encoder:
    """A task's encoder: packed little-endian ids of texts, run by run."""

    def __init__(self, t: Transducer):
        self.t, self.known = t, t.ids | t.special
        self.words, self.chunks = Cache(), Cache()

    def _pack(self, tokens: Iterable[str]) -> bytes:
        packed = array("I", [self.known[x] for x in tokens if x in self.known])
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _chunk(self, part: str) -> bytes:
        if part in self.t.special:
            return self._pack([part])
        out = []
        for found in self.t.words_of(part):
            word = found[0]
            packed = self.words.found.get(word)
            if packed is None:
                packed = self._pack(self.t.word(word))
                self.words.keep(word, packed)
            out.append(packed)
        packed = b"".join(out)
        self.chunks.keep(part, packed)
        return packed

    def runs(self, text: str | None) -> Iterator[bytes]:
        """The packed ids of a text in runs of a few thousand chunks."""
        get, held = self.chunks.found.get, []
        for part in self.t.parts(text):
            packed = get(part)
            held.append(self._chunk(part) if packed is None else packed)
            if len(held) == 4096:
                yield b"".join(held)
                held.clear()
        if held:
            yield b"".join(held)


def _encoder(path: str, keep: bool) -> Callable[[dict[str, list]], Iterable[tuple]]:
    """A task's encoder and decoder: the digests are made run by run, the decoded one from the packed ids."""
    t = load(path)
    encoder, decoder = Encoder(t), Decoder(t)

    def work(batch: dict[str, list]) -> Iterator[tuple]:
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            n, ids, said, kept = 0, hashlib.sha256(), hashlib.sha256(), []
            decoder.start()
            for packed in encoder.runs(text):
                shown = decoder.feed(packed)
                n += len(packed) // 4
                ids.update(packed)
                said.update(shown)
                if keep:
                    kept.append((packed, shown))
            row = (doc_id, n, ids.hexdigest(), said.hexdigest())
            yield (*row, [i for p, _ in kept for (i,) in struct.iter_unpack("<I", p)], b"".join(x for _, x in kept).decode("utf-8", "surrogatepass")) if keep else row

    return work


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every document; with keep_ids also the ids and
    the decoded text.  One pass, no shuffle; rows with equal ids stay apart."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" * keep_ids
    return over_batches(docs.select(F.col("doc_id").cast("long"), "text"), schema, lambda: _encoder(path, keep_ids))


def token_count(path: str, text: str = "text") -> Column:
    """The number of tokens of a text column; 0 for null."""

    def start() -> Callable[[list], Iterable[float]]:
        encoder = Encoder(load(path))
        return lambda texts: (float(sum(len(p) // 4 for p in encoder.runs(t))) for t in texts)

    return scored(text, start).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and digests.  Null and empty texts have no tokens, rows of null or equal ids stay apart, an
    empty table gives no rows."""
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
