"""64-bit hashes of the words of texts, and of words in a row, a batch at a time."""

from __future__ import annotations

import numpy as np

from tallylog.llm.word_symbols import pieces

#: lower case for A-Z, blanks for white space
SPACED = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
#: bytes of text hashed together
RUN_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, RUN_BYTES + (1 << 16))
        made = [np.multiply.accumulate(np.append(np.uint64(1), np.full(size, x, np.uint64))) for x in (_BASE, _INVERSE)]
        if n > 4 * RUN_BYTES:
            return made  # for one very long word; not kept
        _powers[:] = made
    return _powers


def _codes(parts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(parts).translate(table) + b" ", np.uint8)
    begin = np.cumsum([0, *(len(p) + 1 for p in parts)])
    up, down = powers(len(data))
    inside = np.append(False, data != 32)
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edge[::2], edge[1::2]
    total = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)]))
    code = (total[last] - total[first]) * down[first]
    code = (code ^ (code >> np.uint64(32))) * _MIX
    return code ^ (code >> np.uint64(29)), np.searchsorted(first, begin)


def word_codes(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of what ``table`` doesn't make a blank), and where each text's words begin and the last ones end.

    ``table`` has to make blanks of white space: long texts are hashed in runs cut there.
    """
    if sum(map(len, texts)) <= RUN_BYTES:
        return _codes(texts, table)
    found, sizes = [], np.zeros(len(texts), np.int64)
    for run in pieces(texts, RUN_BYTES):
        code, cut = _codes([part for _, part in run], table)
        found.append(code)
        np.add.at(sizes, [k for k, _ in run], np.diff(cut))
    return np.concatenate(found), np.append(0, np.cumsum(sizes))


def row_codes(code: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` words in a row."""
    rows = max(0, len(code) - n + 1)
    out = np.zeros(rows, np.uint64)
    for k in range(n):
        out = (out ^ code[k : k + rows]) * _MIX
        out ^= out >> np.uint64(32)
    return out


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``n`` words; a shorter text is one shingle, one without words has none."""
    code, cut = word_codes(texts, SPACED)
    rows = row_codes(code, n)
    found = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        found.append(np.unique(rows[a : b - n + 1]) if b - a >= n else row_codes(code[a:b], b - a) if b > a else rows[:0])
    return found
