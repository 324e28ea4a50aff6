"""Texts as the words of the word-level BPE tokenizers, in pieces of bounded size.

Words are runs of letters, single digits, runs of other signs, and the English contractions.
The split is made here for ASCII and the letters of U+00C0 to U+00FF; parts between white
space that hold anything else, or the string of a special token, are left to the library.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import regex

#: bytes of text looked at together
PIECE_BYTES = 1 << 18
_BLANK = regex.compile(rb"[ \t\n\x0b\f\r]")
_SPACE, _LETTER, _DIGIT, _OTHER, _FOREIGN = range(5)


def _classes() -> np.ndarray:
    found = np.full(256, _FOREIGN, np.uint8)
    found[:128] = _OTHER
    found[[9, 10, 11, 12, 13, 32]] = _SPACE
    found[48:58] = _DIGIT
    found[65:91] = found[97:123] = _LETTER
    found[0x80:0xC0] = _LETTER  # after 0xC3; elsewhere the part is foreign by its first byte
    found[0xC3] = _LETTER
    return found


def _lower() -> np.ndarray:
    found = np.arange(256, dtype=np.uint8)
    found[65:91] += 32
    found[0x80:0x9F] += 32
    return found


_CLASS, _LOWER = _classes(), _lower()


def symbols_of(parts: list[bytes], special: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, bytes]]]:
    """Symbols (-1 where there is none), where words begin, where parts do, and (place, bytes) of what the library has to read."""
    raw = b" ".join([*parts, b"  "])
    data = np.frombuffer(b" " + raw, np.uint8)
    begin = 1 + np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
    kind = _CLASS[data]
    odd = kind == _FOREIGN
    high = np.flatnonzero(data >= 0x80)
    if len(high):
        odd[high] |= (data[high] < 0xC0) & (data[high - 1] != 0xC3)  # not a letter of two bytes
        odd[high] |= ((data[high] == 0x97) | (data[high] == 0xB7)) & (data[high - 1] == 0xC3)  # the two signs among the letters
        odd[high] |= (data[high] == 0xC3) & ((data[high + 1] < 0x80) | (data[high + 1] >= 0xC0))
    for name in special:
        at = raw.find(name)
        while at >= 0:
            odd[at + 1] = True
            at = raw.find(name, at + 1)
    foreign = []
    if odd.any():
        gaps, where = np.flatnonzero(kind == _SPACE), np.flatnonzero(odd)
        after = np.unique(np.searchsorted(gaps, where))
        for a, b in zip((gaps[after - 1] + 1).tolist(), gaps[after].tolist(), strict=True):
            foreign.append((a, data[a:b].tobytes()))
            kind[a:b] = _SPACE
    low = _LOWER[data]
    start = kind != _SPACE
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    quote = np.flatnonzero((low == 39) & start)
    if len(quote):
        a, b = low[quote + 1], low[quote + 2]
        short = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        long = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
        start[quote[short | long] + 1] = False
        for hit, step in ((short, 2), (long, 3)):
            after = quote[hit] + step
            start[after] |= kind[after] != _SPACE
    gap = kind == _SPACE
    symbols = low.astype(np.int32)
    symbols[:-1] += 256 * (~gap[:-1] & (gap[1:] | start[1:]))
    symbols[gap] = -1
    return symbols, start, begin, foreign


def pieces(texts: list[bytes], limit: int = PIECE_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """Runs of (text, part of it) of about ``limit`` bytes each; a longer text is cut at white space."""
    run, size = [], 0
    for k, text in enumerate(texts):
        first = 0
        while True:
            last = len(text)
            if last - first > limit and (cut := _BLANK.search(text, first + limit)):
                last = cut.start()
            if run and size + last - first > limit:
                yield run
                run, size = [], 0
            run.append((k, text[first:last]))
            size += last - first
            first = last
            if last == len(text):
                break
    if run:
        yield run


