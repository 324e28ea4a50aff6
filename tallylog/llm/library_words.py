"""The tokenizers library, run on single parts of texts.

Nothing that the word-level tokenizers do to a text reaches over white space, so the ids of a
text are those of the parts between white space, one after the other.  The library encodes
each different part once; its ids are kept for the parts to come.
"""

from __future__ import annotations

import numpy as np
import regex
from tokenizers import Tokenizer

#: parts that are kept at most, and the characters from which on a part is encoded in several runs
KEPT, LONG = 1 << 15, 1 << 16
#: a letter before a sign that is no mark: a word ends there, and nothing composes over it
_SAFE = regex.compile(r"(?<=\p{L})(?=[^\s\p{L}\p{N}\p{M}'])")


class Library:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept: dict[bytes, np.ndarray] = {}

    def ids(self, part: bytes) -> np.ndarray:
        """Ids of one part; a very long one goes in runs that end where words do."""
        found = self.kept.get(part)
        if found is not None:
            return found
        text, runs, first = part.decode("utf-8", "replace"), [], 0
        while first < len(text) or not runs:
            cut = _SAFE.search(text, first + LONG) if len(text) - first > LONG else None
            last = cut.start() if cut else len(text)
            runs.append(np.array(self.tokenizer.encode(text[first:last], add_special_tokens=False).ids, np.int32))
            first = last
        found = np.concatenate(runs)
        if len(part) <= 64:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[part] = found
        return found
