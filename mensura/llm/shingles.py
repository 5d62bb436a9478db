"""Vectorised word and shingle hashing shared by the operators that work on word shingles.

A word is a maximal run of characters other than space and U+0009..U+000D; ASCII capitals count as lower case.
In UTF-8 those separators are single bytes that occur in no other character, so the work is done on bytes with
numpy: a polynomial prefix sum modulo 2**64 gives every word's hash without a Python loop over words.  Shingles
are identified by 64-bit hashes throughout; two different shingles of one pair of texts collide with
probability about 2**-64 each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes of text that are hashed in one go; longer texts are worked off in segments cut at separators.
SEGMENT = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
for _upper in range(65, 91):
    _BYTE[_upper] = _BYTE[_upper + 32]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0..n-1, grown on demand."""
    if not _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a hash are usable."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words in some bytes."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    up, down = _power_tables(max(len(data) + 1, SEGMENT))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return starts, mix((total[ends] - total[starts]) * down[starts])


def _long_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of a long text, segment by segment, so that working memory doesn't follow its length."""
    parts, at = [], 0
    while at < len(data):
        cut = at + SEGMENT
        if cut < len(data):
            back = np.flatnonzero(_IS_SPACE[data[at:cut]])
            if len(back):
                cut = at + int(back[-1]) + 1
            else:
                while cut < len(data) and not _IS_SPACE[data[cut]]:
                    cut += 1
        parts.append(_words_of(data[at:cut])[1])
        at = cut
    return np.concatenate(parts)


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of `size` words."""
    count = len(words) - size + 1
    out = words[:count] + np.uint64(size)
    for k in range(1, size):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
        out += words[k : k + count]
    return mix(out)


def _of_words(words: np.ndarray, size: int) -> np.ndarray:
    return _runs(words, min(size, len(words))) if len(words) else words


def shingle_lists(texts: Sequence[str | None], size: int) -> Iterator[np.ndarray]:
    """For every text, in order, the hashes of its word shingles in text order.  Fewer words than `size` give
    their whole sequence as one shingle; null, empty and blank texts give an empty array.  Short texts are
    hashed together, many at a time."""
    pending: list[bytes] = []
    held = 0

    def flush() -> Iterator[np.ndarray]:
        joined = np.frombuffer(b"\n".join(pending), np.uint8)
        starts, words = _words_of(joined)
        bounds = np.cumsum([len(x) + 1 for x in pending])
        cuts = [0, *np.searchsorted(starts, bounds).tolist()]
        runs = _runs(words, size) if len(words) >= size else words[:0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield runs[a : b - size + 1] if b - a >= size else _of_words(words[a:b], size)

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) > SEGMENT:
            if pending:
                yield from flush()
                pending, held = [], 0
            yield _of_words(_long_words(np.frombuffer(data, np.uint8)), size)
            continue
        if held + len(data) + 1 > SEGMENT:
            yield from flush()
            pending, held = [], 0
        pending.append(data)
        held += len(data) + 1
    if pending:
        yield from flush()


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Ascending distinct values."""
    if len(hashes) < 2:
        return hashes
    ordered = np.sort(hashes)
    keep = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=keep[1:])
    return ordered[keep]


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingle hashes of one text, ascending."""
    return distinct(next(iter(shingle_lists([text], size))))
