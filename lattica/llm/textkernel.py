"""Vectorised word and shingle hashing shared by the corpus operators.

A word is a maximal run of letters, digits and underscores of the lower-cased text. Hashes are
64-bit, equal for equal words on every machine and in every batch, and computed for a whole batch
of documents with a handful of numpy passes: a prefix sum of keyed byte codes gives any word's
polynomial in O(1), and a multiplication by an inverse power makes it independent of position.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np

_SEPARATORS = re.compile(r"\W+")
_BLOCK = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def _tables() -> tuple[np.ndarray, np.ndarray]:
    code = np.random.default_rng(20240229).integers(1, 1 << 63, size=256, dtype=np.uint64) | _U(1)
    word = np.zeros(256, dtype=bool)
    word[[*range(48, 58), *range(97, 123), 95, *range(128, 256)]] = True
    return code, word


_CODE, _WORD = _tables()


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, _U(base), dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = _powers(2, _BASE)
_INV = _powers(2, pow(_BASE, -1, 1 << 64))


def _reserve(n: int) -> None:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, 2 * len(_POW))
        _POW, _INV = _powers(size, _BASE), _powers(size, pow(_BASE, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def normal_bytes(text: str | None) -> bytes:
    """Lower-cased UTF-8 in which every byte outside words is an ASCII separator."""
    if not text:
        return b""
    low = text.lower()
    return low.encode() if low.isascii() else _SEPARATORS.sub(" ", low).encode("utf-8", "replace")


def _block_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of ``raw``, which ends in a separator."""
    buf = np.frombuffer(raw, dtype=np.uint8)
    inside = _WORD[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    start, stop = edge[0::2], edge[1::2]
    _reserve(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_CODE[buf] * _POW[: len(buf)], out=total[1:])
    return mix((total[stop] - total[start]) * _INV[start]), start


def _pieces(raw: bytes) -> Iterable[bytes]:
    """Cut one long text at separators, so that memory stays flat however long it is."""
    at = 0
    while len(raw) - at > _BLOCK:
        cut = at + _BLOCK
        while cut > at and _WORD[raw[cut - 1]]:
            cut -= 1
        if cut == at:  # one word longer than a block
            cut = at + _BLOCK
            while cut < len(raw) and _WORD[raw[cut - 1]]:
                cut += 1
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def word_hashes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts end to end, and the offset at which each text's words begin."""
    found: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            raw = b" ".join(held) + b" "
            hashes, start = _block_hashes(raw)
            ends = np.cumsum([len(p) + 1 for p in held])
            counts.append(np.diff(np.searchsorted(start, ends, side="left"), prepend=0))
            found.append(hashes)
        held, size = [], 0

    for text in texts:
        raw = normal_bytes(text)
        if len(raw) > _BLOCK:
            flush()
            parts = [_block_hashes(p + b" ")[0] for p in _pieces(raw)]
            found.extend(parts)
            counts.append(np.array([sum(map(len, parts))]))
            continue
        held.append(raw)
        size += len(raw) + 1
        if size >= _BLOCK:
            flush()
    flush()
    offsets = np.concatenate(([0], np.cumsum(np.concatenate(counts)))) if counts else np.zeros(1, np.int64)
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), offsets.astype(np.int64)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words of one array of word hashes; empty if it is shorter."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    factors = np.random.default_rng(77 + n).integers(1, 1 << 63, size=n, dtype=np.uint64) | _U(1)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        out += words[i : i + len(out)] * factors[i]
    return mix(out)


def shingle_sets(texts: Iterable[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct ``n``-word shingles of each text.

    A text of 1 to n-1 words has one shingle, all its words; a text without words has none.
    """
    words, offsets = word_hashes(texts)
    rolling = shingle_hashes(words, n)
    out = []
    for lo, hi in zip(offsets[:-1], offsets[1:]):
        if hi - lo >= n:
            out.append(np.unique(rolling[lo : hi - n + 1]))
        else:
            out.append(shingle_hashes(words[lo:hi], int(hi - lo)) if hi > lo else np.zeros(0, np.uint64))
    return out


def slices(sizes: Iterable[int | None], most: int = 1 << 22) -> Iterable[tuple[int, int]]:
    """Ranges of rows of about ``most`` characters together, so that a batch's arrays stay small."""
    lo, held, i = 0, 0, -1
    for i, size in enumerate(sizes):
        held += (size or 0) + 1
        if held >= most:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo <= i:
        yield lo, i + 1
