"""Whole texts to words and word windows as 64-bit hashes, many texts at a time in numpy.

Words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r. A hash of a run of values x is the polynomial
sum of x[i] * B**i modulo 2**64, read off prefix sums, then mixed. Long texts are handled in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

PIECE = 1 << 20
_U = np.uint64
_BASE = {0: 0x9E3779B97F4A7C15, 1: 0xD1342543DE82EF95, 2: 0xA0761D6478BD642F}
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: White space and ASCII punctuation.
PUNCTUATION = _SEPARATOR.copy()
PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i up to n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, PIECE + 2)
        b = _BASE[base]
        _powers[base] = have = tuple(np.cumprod(np.concatenate([np.ones(1, _U), np.full(size, _U(x))]), dtype=_U) for x in (b, pow(b, -1, 1 << 64)))
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def prefix(values: np.ndarray, base: int = 0) -> np.ndarray:
    """Prefix sums of values[i] * B**i, with a leading zero."""
    up, _ = powers(len(values), base)
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], dtype=_U, out=out[1:])
    return out


def between(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0) -> np.ndarray:
    """Hashes of the runs [starts, ends), wherever they stand."""
    _, down = powers(len(sums), base)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def spans(data: np.ndarray, separators: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separators[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def pieces(text: bytes, separators: np.ndarray = _SEPARATOR) -> Iterator[tuple[int, bytes]]:
    """(offset, piece) of about PIECE bytes that end where a word does."""
    at = 0
    while len(text) - at > PIECE:
        cut = at + PIECE
        while cut < len(text) and not separators[text[cut]]:
            cut += 1
        yield at, text[at:cut]
        at = cut
    yield at, text[at:]


def located(text: bytes, separators: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash, start and end of each word of one text, in order."""
    out = []
    for at, piece in pieces(text, separators):
        data = np.frombuffer(piece, np.uint8)
        s, e = spans(data, separators)
        out.append((between(prefix(_TABLE[data]), s, e), s + at, e + at))
    return out[0] if len(out) == 1 else tuple(map(np.concatenate, zip(*out)))


def located_all(texts: list[bytes], separators: np.ndarray = _SEPARATOR) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts one after the other, their words' hashes, starts and ends, and where each text's words begin (one more at the end)."""
    data = b" ".join(texts)
    h, s, e = located(data, separators)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return data, h, s, e, np.searchsorted(s, begins)


def word_hashes(text: bytes) -> np.ndarray:
    return located(text)[0]


def grouped(texts: Iterable[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) for runs of texts of about PIECE bytes together; null counts as empty."""
    run: list[bytes] = []
    size = first = 0
    for i, t in enumerate(texts):
        t = t or b""
        if run and size + len(t) > PIECE:
            yield first, run
            run, size, first = [], 0, i
        run.append(t)
        size += len(t) + 1
    if run:
        yield first, run


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts one after the other, and where each text's words begin (one more at the end)."""
    _, h, _, _, offsets = located_all(texts)
    return h, offsets


def windows(hashes: np.ndarray, n: int, base: int = 0) -> np.ndarray:
    """The hash of the n words from each position at which n words are left."""
    if len(hashes) < n:
        return np.zeros(0, _U)
    at = np.arange(len(hashes) - n + 1)
    return between(prefix(hashes, base), at, at + n, base)


def whole(offsets: np.ndarray, n: int) -> np.ndarray:
    """For concatenated texts: which window positions lie within one text."""
    total = int(offsets[-1])
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(total)
    return left[: max(0, total - n + 1)] >= n
