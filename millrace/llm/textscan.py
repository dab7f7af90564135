"""Vectorised word scanning: words of whole texts as 64-bit hashes, in numpy.

A text is taken as UTF-8 bytes, A-Z lower-cased. A table of 256 flags says
which bytes belong to words; both word rules used here keep every byte of a
non-ASCII character, so byte runs are exactly the rules' code-point runs. A
word's hash is a polynomial over its bytes modulo 2**64 with a final mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: bytes scanned at once; a longer text is scanned alone
SLICE_BYTES = 1_000_000
#: the same where rows come out one by one: arrays of a slice take some 40 times its bytes
SMALL_SLICE_BYTES = 250_000

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)

#: words are runs of everything but blanks: [^\x20\x09-\x0D]+
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: words are runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES // 4), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
        if n > 4 * SLICE_BYTES:
            _powers.pop(base)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hash(words: list[bytes]) -> np.ndarray:
    """The hashes that ``scan`` gives these words (already lower-cased)."""
    out = np.zeros(len(words), dtype=np.uint64)
    for i, w in enumerate(words):
        h = 0
        for j, b in enumerate(w):
            h = (h + (b + 1) * pow(_P, j, 1 << 64)) & 0xFFFFFFFFFFFFFFFF
        out[i] = (h + len(w)) & 0xFFFFFFFFFFFFFFFF
    return mix(out)


class Scan:
    """Words of a run of texts: ``hash``, byte ``start``/``end`` of each word in
    ``data``, and ``first[i]:first[i + 1]``, the words of text i."""

    def __init__(self, data: bytes, text_ends: np.ndarray, is_word: np.ndarray):
        raw = np.frombuffer(data, dtype=np.uint8)
        n = len(raw)
        flag = np.zeros(n + 2, dtype=np.int8)
        flag[1:-1] = is_word[raw]
        step = np.diff(flag)
        self.data = data
        self.start = np.flatnonzero(step == 1)
        self.end = np.flatnonzero(step == -1)
        if n:
            prefix = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power_table(_P, n)[:n],
                      out=prefix[1:])
            h = (prefix[self.end] - prefix[self.start]) * _power_table(_P_INV, n)[self.start]
            self.hash = mix(h + (self.end - self.start).astype(np.uint64))
        else:
            self.hash = np.zeros(0, dtype=np.uint64)
        self.first = np.concatenate(([0], np.searchsorted(self.start, text_ends)))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]]


def scan(texts: list, is_word: np.ndarray, lower: bool = True,
         run_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, Scan]]:
    """Yield (from, to, Scan) over runs of texts of about ``run_bytes``.

    A null text counts as empty. Texts are joined with a line feed, which no
    word contains.
    """
    lo, parts, size = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if parts and size + len(b) > run_bytes:
            yield lo, i, _scan(parts, is_word, lower)
            lo, parts, size = i, [], 0
        parts.append(b)
        size += len(b) + 1
    if parts:
        yield lo, lo + len(parts), _scan(parts, is_word, lower)


def _scan(parts: list[bytes], is_word: np.ndarray, lower: bool) -> Scan:
    data = b"\n".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    return Scan(data.lower() if lower else data, ends, is_word)
