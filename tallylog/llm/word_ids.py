"""Token ids of texts by the tokenizers library, which encodes each different word once.

The word-level tokenizers cut a text into words and encode them one by one.  The cut is made
by array operations (``word_symbols``); the words' ids are kept in a table by the words' own
bytes, and the words of a piece that it doesn't have go through the library's model together.
Parts that the cut leaves to the library, and words that are too long for the table, are
encoded each time they come; words of any length are followed by the transducer.

Memory is bounded: past MAX_WORDS the table begins anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

from tallylog.llm.bpe_machine import byte_chars, machine
from tallylog.llm.common import CACHES
from tallylog.llm.library_words import Library
from tallylog.llm.word_symbols import pieces, symbols_of

#: words that the table holds, bytes of a word in it at most, and bytes of a word that the library takes
MAX_WORDS, SHORT, LONG = 1 << 20, 15, 1 << 10
#: how many bytes of eight are looked at
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: odd multipliers of the table's hash
_LOW, _HIGH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_CHARS = dict(enumerate(byte_chars())) | {32: " "}


class WordIds:
    def __init__(self, path: str, max_words: int = MAX_WORDS):
        self.path, self.max_words, self.library = path, max_words, Library(path)
        self.model = Tokenizer(self.library.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix, vocab = self.library.tokenizer.model.end_of_word_suffix, self.library.tokenizer.get_vocab()
        if not suffix:
            raise ValueError("only tokenizers with a word-end suffix are taken")
        #: whether a token ends a word
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[t for text, t in vocab.items() if text.endswith(suffix)]] = True
        self._forget()

    # --- the table: slots hold rows; a row has a word's bytes and length, and where its ids begin in the pool ----

    def _forget(self) -> None:
        self.rows, self.used = 1, 0  # row 0 is no word
        self.low, self.high = np.zeros(1 << 15, np.uint64), np.zeros(1 << 15, np.uint64)
        self.first = np.zeros(1 << 15, np.int64)
        self.pool = np.zeros(1 << 17, np.int32)
        self._slots(1 << 16)

    def _slots(self, size: int) -> None:
        self.slot = np.zeros(size, np.int32)
        self.shift, self.mask = np.uint64(65 - size.bit_length()), np.int64(size - 1)

    def _rows(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's row, 0 where it has none, and the slot that has it or could."""
        at = ((low * _LOW + high * _HIGH) >> self.shift).astype(np.int64)
        row = self.slot[at]
        off = np.flatnonzero((self.low[row] != low) | (self.high[row] != high))
        while len(off := off[row[off] > 0]):
            at[off] = at[off] + 1 & self.mask
            row[off] = self.slot[at[off]]
            off = off[(self.low[row[off]] != low[off]) | (self.high[row[off]] != high[off])]
        return row, at

    def _place(self, rows: np.ndarray) -> None:
        while len(rows):
            at = self._rows(self.low[rows], self.high[rows])[1]
            self.slot[at] = rows
            rows = rows[self.slot[at] != rows]  # another new word took the slot

    def _put(self, ids: np.ndarray) -> int:
        """Where the pool now has the ids."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(self.used, len(self.pool)), np.int32)])
        self.pool[at : self.used] = ids
        return at

    def _add(self, low: np.ndarray, high: np.ndarray, words: list[bytes]) -> None:
        """Rows for new words that differ from each other."""
        ids, ends = self._encode(words)
        first, n = self.rows, self.rows + len(words)
        if n >= len(self.low):
            more = np.zeros(max(n, len(self.low)), np.uint64)
            self.low, self.high, self.first = np.append(self.low, more), np.append(self.high, more), np.append(self.first, more.view(np.int64))
        self.low[first:n], self.high[first:n] = low, high
        self.first[first] = self._put(ids)
        self.first[first + 1 : n + 1] = self.first[first] + ends
        self.rows = n
        if 2 * n > len(self.slot):
            self._slots(1 << (4 * n).bit_length() - 1)
            first = 1
        self._place(np.arange(first, n, dtype=np.int32))

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of all words, and where each word's end."""
        text = b" ".join(words).decode("latin-1").translate(_CHARS)
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the library's ids don't end where the words do")
        return ids, ends

    # --- texts -------------------------------------------------------------------------

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        done, text = [], 0
        for run in pieces(texts):
            if self.rows > self.max_words:
                self._forget()
            ids, cut = self._piece([part for _, part in run])
            for (k, _), a, b in zip(run, cut[:-1], cut[1:], strict=True):
                if k != text:
                    yield np.concatenate(done)
                    done, text = [], k
                done.append(ids[a:b])
        if done:
            yield np.concatenate(done)

    def _piece(self, parts: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Ids of all parts, and where those of each part begin and the last ones end."""
        symbols, word, begin, foreign = symbols_of(parts, self.library.special)
        starts = np.flatnonzero(word & (symbols >= 0))
        sizes = np.flatnonzero(symbols >= 256) + 1 - starts
        data = np.append(symbols.astype(np.uint8), np.zeros(16, np.uint8))
        raw = data.tobytes()
        eight = np.ndarray(len(data) - 7, np.uint64, data, strides=(1,))
        low = eight[starts] & _MASK[np.minimum(sizes, 8)]
        high = eight[starts + 8] & _MASK[np.clip(sizes - 8, 0, 7)] | sizes.astype(np.uint64) << np.uint64(56)
        long = np.flatnonzero(sizes > SHORT)
        low[long] = high[long] = 0  # row 0
        row, _ = self._rows(low, high)
        new = np.flatnonzero((row == 0) & (sizes <= SHORT))
        if len(new):
            order = new[np.lexsort((low[new], high[new]))]
            other = np.append(True, (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]]))
            once = order[other]
            self._add(low[once], high[once], [raw[a : a + n] for a, n in zip(starts[once].tolist(), sizes[once].tolist(), strict=True)])
            row[new] = self._rows(low[new], high[new])[0]
        first = self.first[row]
        count = self.first[row + 1] - first
        kept = self.used  # what comes into the pool from here on is for this piece only
        if len(long):
            ids, ends = self._long([raw[a : a + n] for a, n in zip(starts[long].tolist(), sizes[long].tolist(), strict=True)])
            count[long] = np.diff(ends, prepend=0)
            first[long] = self._put(ids) + ends - count[long]
        if foreign:
            owns = [self.library.ids(w) for _, w in foreign]
            starts = np.append(starts, [a for a, _ in foreign])
            first = np.append(first, [self._put(x) for x in owns])
            count = np.append(count, [len(x) for x in owns])
            order = np.argsort(starts, kind="stable")
            starts, first, count = starts[order], first[order], count[order]
        upto = np.append(0, np.cumsum(count))
        ids = self.pool[np.repeat(first - upto[:-1], count) + np.arange(upto[-1])]
        self.used = kept
        return ids, upto[np.append(np.searchsorted(starts, begin), len(starts))].tolist()

    def _long(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if max(map(len, words)) <= LONG:
            return self._encode(words)
        owns = [self._encode([w])[0] if len(w) <= LONG else next(machine(self.path).encode([w])) for w in words]
        return np.concatenate(owns), np.cumsum([len(x) for x in owns])


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """This process's table for the tokenizer file."""
    return WordIds(path)


CACHES.append(word_ids.cache_clear)
