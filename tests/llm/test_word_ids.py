import io
import random

import numpy as np
import public_tokenizers

from tallylog.llm import token_blocks, word_ids
from tallylog.llm.word_ids import WordIds
from tests.llm.test_tokens import library, random_texts

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(texts, table):
    return [x.tolist() for x in table.encode([t.encode() for t in texts])]


def test_table_is_the_library():
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choices("etaoinshrdlué", k=n))
    lengths = [*range(1, 40), word_ids.LONG - 1, word_ids.LONG + 1, 3000]
    texts = [*random_texts(), "", *(letters(n) + " " + letters(n) + "!" * n + letters(3) for n in lengths), "\x00 a\x00 \x00\x00 a", "A" * 15 + " " + "a" * 16 + " " + "a" * 15 + "\x00"]
    want = library(texts)
    table = WordIds(PATH)
    for _ in range(2):
        assert ids_of(texts, table) == want
    assert ids_of([], table) == [] and ids_of(["", ""], table) == [[], []]


def test_the_table_grows_and_begins_anew():
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(1, 14))) for _ in range(40_000)) for _ in range(3)]
    want = library(texts)
    for most in (word_ids.MAX_WORDS, 1000):
        table = WordIds(PATH, most)
        assert ids_of(texts, table) == want
        assert (table.rows > 70_000) == (most > 1000) and 2 * table.rows <= len(table.slot)
        assert table.used == table.first[table.rows] and len(np.unique(table.slot)) == table.rows
        if most > 1000:
            assert ids_of(texts, table) == want


def test_stored_ids_take_each_word_to_the_library_once(monkeypatch):
    """Before, every new word was built into a transducer's states, byte by byte."""
    given, encode = [], WordIds._encode
    monkeypatch.setattr(WordIds, "_encode", lambda self, words: given.extend(words) or encode(self, words))
    monkeypatch.setattr(word_ids, "machine", None)
    token_blocks.word_ids.cache_clear()
    table = token_blocks.word_ids(PATH)
    texts = ["the Words of the words", "of other words, words; don't", "The words"] * 50
    assert ids_of(texts, table) == library(texts)
    assert sorted(given) == sorted({b"the", b"words", b"of", b"other", b",", b";", b"don", b"'t"})
    token_blocks.word_ids.cache_clear()


def test_blocks_of_a_size_take_their_steps_together(monkeypatch):
    """Before, each block took all of its steps alone; the bytes are those of blocks coded one by one."""
    rng = np.random.default_rng(4)
    sizes = [1024] * 8 + [701, 701, 513, 1024, 1536, 1536, 9]
    blocks = [token_blocks.Block([k], np.array([n]), (rng.zipf(1.3, n) % (50 + 6000 * (k % 3))).astype(np.int32), False) for k, n in enumerate(sizes)]
    alone = [token_blocks.pack(b) for b in blocks]
    steps, predict = [], token_blocks.Model.predict
    monkeypatch.setattr(token_blocks.Model, "predict", lambda self, n: steps.append(n) or predict(self, n))
    assert list(token_blocks.pack_all(blocks)) == alone
    # 6, 2, 1, 1, 1, 1, 2 and 1 blocks; those whose last lane is shorter go alone
    assert len(steps) == 512 + 512 + 351 + 351 + 257 + 512 + 512 + 9
    back = list(token_blocks.unpack(io.BytesIO(b"".join(alone))))
    assert len(steps) == 2 * (512 + 512 + 351 + 351 + 257 + 512 + 512 + 9)
    assert [(b.doc_ids, b.ids.tolist()) for b in back] == [(b.doc_ids, b.ids.tolist()) for b in blocks]
