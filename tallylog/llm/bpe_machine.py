"""Deterministic transducer compiled from the merge list of a byte-level BPE tokenizer.

A sequence of tokens is the BPE encoding of its bytes exactly when every pair of neighbours
is the encoding of that pair's bytes, so an encoding can be followed from left to right with
finite memory.  After a prefix ``p`` of a word the machine keeps, for every cut whose rest
may still grow into a token: the last token before the cut, the trie node of the rest and
the token count at the cut relative to the count of ``p``.  That set is one state.  A
transition on a byte is annotated with the change of the token count and the token that ends
the prefix; the last byte of a word, which BPE treats as a symbol of its own, leads back to
the start state.  States are built when a text first needs them (subset construction on
demand), and many runs of symbols take their steps together.

Memory is bounded: past MAX_STATES all states but those that runs are in are forgotten, in
the middle of a word as well.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from tallylog.llm.common import CACHES
from tallylog.llm.library_words import Library
from tallylog.llm.word_symbols import pieces, symbols_of

#: states after which the machine forgets, and pairs of tokens whose border is remembered
MAX_STATES, MAX_PAIRS = 200_000, 1 << 17
#: odd multiplier of the transition table's hash (2**32 over the golden ratio)
_MIX = 0x9E3779B1
#: how a table entry packs its target and the change of the count
_RISE, _ZERO = 20, 512
#: how a state packs the token before a cut, the trie node and the count
_NODE, _COUNT, _HALF = 20, 12, 1 << 11
_NODES, _COUNTS = (1 << _NODE) - 1, (1 << _COUNT) - 1
#: so few runs take their steps one by one
_FEW = 4


def byte_chars() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class BpeMachine:
    """Symbols are bytes, plus 256 for the last one of a word.  State 0 is the start state.

    Runs may begin in and end in other states; these are named by their numbers in ``held``,
    which stay valid until ``let_go``.
    """

    def __init__(self, path: str, max_states: int = MAX_STATES):
        self.library, self.max_states = Library(path), max_states
        spec = json.loads(self.library.tokenizer.to_str())
        model = spec["model"]
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        if not suffix:
            raise ValueError("only tokenizers with a word-end suffix are compiled")
        chars = byte_chars()
        byte_of = {c: b for b, c in enumerate(chars)}
        self.rank = {vocab[c + end]: -1 for c in chars for end in ("", suffix)}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[int, int] = {}
        for k, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merged[vocab[a] << 20 | vocab[b]] = k
            if self.rank.setdefault(vocab[a + b], k) == k:
                self.parts[vocab[a + b]] = (vocab[a], vocab[b])
        #: trie over the tokens' symbols: node << 9 | symbol to child, and the token that ends at a node
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        self.length = np.zeros(max(vocab.values()) + 1, np.int32)
        for text, t in vocab.items():
            if t not in self.rank:
                continue
            ends = text.endswith(suffix) and len(text) > len(suffix)
            body = [byte_of[c] for c in (text[: -len(suffix)] if ends else text)]
            body[-1] += 256 * ends
            self.length[t] = len(body)
            node = 0
            for symbol in body:
                self.inner[node] = True
                below = self.child.get(node << 9 | symbol)
                if below is None:
                    below = self.child[node << 9 | symbol] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = below
            self.token[node] = t
        if len(self.token) >= 1 << _NODE or max(vocab.values()) >= 1 << 20:
            raise ValueError("the vocabulary is too large for the states' packing")
        self.start = (_HALF,)
        self._fits: dict[int, bool] = {}
        self.let_go()
        self._reset()

    # --- states ------------------------------------------------------------------------

    def let_go(self) -> None:
        """Forget the states that runs ended in."""
        self.held, self.held_at = [self.start], {self.start: 0}

    def _reset(self) -> None:
        self.states, self.number = [self.start], {self.start: 0}
        self.quick: dict[int, int] = {}
        #: the token that ends the prefixes of each state
        self.last = np.full(1 << 16, -1, np.int32)
        self._table(1 << 16)

    def _table(self, size: int) -> None:
        self.keys = np.full(size, -1, np.int32)
        self.value = np.zeros(size, np.int32)
        self.shift, self.mask, self.used = np.uint32(32 - size.bit_length() + 1), size - 1, 0

    def _numbered(self, state: tuple[int, ...]) -> int:
        found = self.number.get(state)
        if found is None:
            found = self.number[state] = len(self.states)
            if found >= 1 << _RISE:
                raise ValueError("too many runs at once for the table's packing")
            self.states.append(state)
            if found >= len(self.last):
                self.last = np.concatenate([self.last, np.full(len(self.last), -1, np.int32)])
            self.last[found] = (state[-1] >> _NODE + _COUNT) - 1
        return found

    def _begin_anew(self, now: np.ndarray) -> np.ndarray:
        """Forget all states but those of ``now``; their new numbers."""
        kept, at = np.unique(now, return_inverse=True)
        states = [self.states[k] for k in kept.tolist()]
        self._reset()
        return np.array([self._numbered(s) for s in states], np.int32)[at]

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens' bytes as exactly these two tokens."""
        key = left << 20 | right
        found = self._fits.get(key)
        if found is None:
            if len(self._fits) >= MAX_PAIRS:
                self._fits.clear()
            found = self._fits[key] = self._border_holds(left, right)
        return found

    def _border_holds(self, a: int, b: int) -> bool:
        """Undo merges beside the border, latest first; a merge across it must come too late."""
        limit = len(self.merged) + 1
        while True:
            across = self.merged.get(a << 20 | b)
            if across is not None and across < limit:
                return False
            if self.rank[a] > self.rank[b]:
                limit, a = self.rank[a], self.parts[a][1]
            elif self.rank[b] >= 0:
                limit, b = self.rank[b] + 1, self.parts[b][0]
            else:
                return True

    def _add(self, key: int) -> int:
        """Build the transition ``key`` (state << 9 | symbol)."""
        state, symbol = divmod(key, 512)
        made, rise, stay = -1, 0, []
        below, inner, tokens = self.child.get, self.inner, self.token
        for packed in self.states[state]:
            child = below((packed >> _COUNT & _NODES) << 9 | symbol)
            if child is None:
                continue
            if made < 0 and (t := tokens[child]) >= 0 and ((before := (packed >> _NODE + _COUNT) - 1) < 0 or self.fits(before, t)):
                made, rise = t, (packed & _COUNTS) - _HALF + 1
            if inner[child]:
                # the same cut and count, one node further
                stay.append(packed + (child << _COUNT) - (packed & _NODES << _COUNT))
        if made < 0:
            raise ValueError("the merge list does not cover these bytes")
        target = made
        if symbol < 256:
            target = self._numbered((*(x - rise for x in stay), made + 1 << _NODE + _COUNT | _HALF))
        if 2 * (self.used + 1) > len(self.keys):
            old = self.keys >= 0
            rows = self.keys[old].tolist(), self.value[old].tolist()
            self._table(2 * len(self.keys))
            for row in zip(*rows, strict=True):
                self._put(*row)
        value = target | (rise + _ZERO) << _RISE
        self._put(key, value)
        return value

    def _value(self, key: int) -> int:
        """What the table has for one transition, built if need be."""
        at = ((key * _MIX) & 0xFFFFFFFF) >> int(self.shift)
        while self.keys[at] >= 0:
            if self.keys[at] == key:
                return int(self.value[at])
            at = (at + 1) & self.mask
        return self._add(key)

    def _put(self, key: int, value: int) -> None:
        at = ((key * _MIX) & 0xFFFFFFFF) >> int(self.shift)
        while self.keys[at] >= 0:
            at = (at + 1) & self.mask
        self.keys[at], self.value[at] = key, value
        self.used += 1

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the transitions ``keys``, built if need be."""
        slots = (keys.view(np.uint32) * np.uint32(_MIX)) >> self.shift
        off, missing = np.flatnonzero(self.keys[slots] != keys), []
        while len(off):
            none = self.keys[slots[off]] < 0
            if none.any():
                missing.append(off[none])
                off = off[~none]
            slots[off] = (slots[off] + np.uint32(1)) & np.uint32(self.mask)
            off = off[self.keys[slots[off]] != keys[off]]
        if missing:
            size, new = len(self.keys), np.concatenate(missing)
            for key in np.unique(keys[new]).tolist():
                self._add(key)
            if len(self.keys) != size:
                return self._find(keys)  # the table was replaced
            slots[new] = self._find(keys[new])
        return slots

    # --- running -----------------------------------------------------------------------

    def run(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, entries: np.ndarray | None = None, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that each run of ``symbols`` adds, and the held state that it ends in.

        ``entries``: the held states that they begin in, else the start state.  ``ends`` gets
        at each symbol the token that ends the prefix there.  Symbols of a word's end are last
        in their runs.
        """
        order = np.argsort(-sizes, kind="stable")
        first, size = starts[order], -sizes[order]
        total = np.zeros(len(order), np.int64)
        state = np.zeros(len(order), np.int32)
        if entries is not None:
            state[:] = [self._numbered(self.held[e]) for e in entries[order].tolist()]
        here, k, steps = len(order), 0, -int(size[0]) if len(order) else 0
        while k < steps:
            here = int(np.searchsorted(size[:here], -k))
            if len(self.states) > self.max_states:
                state[:] = self._begin_anew(state)
            if here <= _FEW:
                for lane in range(here):
                    total[lane] += self._alone(state, lane, symbols, int(first[lane]) + k, int(first[lane] - size[lane]), ends)
                break
            now = symbols[first[:here] + k]
            slots = self._find(state[:here] << 9 | now)  # may replace the table
            value = self.value[slots]
            total[:here] += (value >> _RISE) - _ZERO
            value &= (1 << _RISE) - 1
            over = now >= 256
            if ends is not None:
                ends[first[:here] + k] = np.where(over, value, self.last[np.where(over, 0, value)])
            value[over] = 0
            state[:here] = value
            k += 1
        exits = np.zeros(len(order), np.int64)
        for lane in np.flatnonzero(state).tolist():
            own = self.states[state[lane]]
            exits[lane] = self.held_at.setdefault(own, len(self.held))
            if exits[lane] == len(self.held):
                self.held.append(own)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return total[back], exits[back]

    def _alone(self, states: np.ndarray, lane: int, symbols: np.ndarray, first: int, stop: int, ends: np.ndarray | None) -> int:
        """One run, step by step; ``states`` are all runs' states, of which that of ``lane`` moves."""
        total, now, quick = 0, int(states[lane]), self.quick
        for k in range(first, stop, 4096):
            made = []
            for symbol in symbols[k : min(k + 4096, stop)].tolist():
                key = now << 9 | symbol
                value = quick.get(key)
                if value is None:
                    value = quick[key] = self._value(key)
                total += (value >> _RISE) - _ZERO
                now = value & (1 << _RISE) - 1
                made.append(now)
                if symbol >= 256:
                    now = 0
            if ends is not None:
                own = np.array(made, np.int32)
                over = symbols[k : min(k + 4096, stop)] >= 256
                ends[k : k + len(own)] = np.where(over, own, self.last[np.where(over, 0, own)])
            states[lane] = now
            if len(self.states) > self.max_states:
                states[:] = self._begin_anew(states)
                now, quick = int(states[lane]), self.quick
        return total

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        done, text = [], 0
        for run in pieces(texts):
            symbols, word, begin, foreign = symbols_of([part for _, part in run], self.library.special)
            starts = np.flatnonzero(word & (symbols >= 0))
            at = np.flatnonzero(symbols >= 256)
            ends = np.full(len(symbols), -1, np.int32)
            self.run(symbols, starts, at + 1 - starts, None, ends)
            self.let_go()
            mark = np.zeros(len(symbols), bool)
            while len(at) > _FEW:
                mark[at] = True
                down = at - self.length[ends[at]]
                going = down >= starts
                at, starts = down[going], starts[going]
            for end, start in zip(at.tolist(), starts.tolist(), strict=True):
                while end >= start:
                    mark[end] = True
                    end -= int(self.length[ends[end]])
            where = np.flatnonzero(mark)
            ids = ends[where]
            if foreign:
                own = [self.library.ids(w) for _, w in foreign]
                where = np.concatenate([where, np.repeat([a for a, _ in foreign], [len(x) for x in own])])
                order = np.argsort(where, kind="stable")
                ids, where = np.concatenate([ids, *own])[order], where[order]
            cut = np.append(np.searchsorted(where, begin), len(ids)).tolist()
            for (k, _), a, b in zip(run, cut[:-1], cut[1:], strict=True):
                if k != text:
                    yield np.concatenate(done)
                    done, text = [], k
                done.append(ids[a:b])
        if done:
            yield np.concatenate(done)


@lru_cache(maxsize=1)
def machine(path: str) -> BpeMachine:
    """This process's machine for the tokenizer file."""
    return BpeMachine(path)


CACHES.append(machine.cache_clear)
