"""op11 against the two libraries and all pairs of byte ranges."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallylog.llm import pair_counts

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    own = Tokenizer.from_file(PATH_A)
    own.encode_special_tokens = True
    return own, sentencepiece.SentencePieceProcessor(model_file=PATH_B)


def byte_of(c):
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return ord(c) if ord(c) in plain else [b for b in range(256) if b not in plain][ord(c) - 256]


def slow_alignment(rows, own, two):
    """All columns, from every pair of tokens of a text."""
    made, counts = [], Counter()
    for doc_id, text in rows:
        a, b = (own.encode(" " + text, add_special_tokens=False).ids, two.encode(text)) if text else ([], [])
        pa = [bytes(map(byte_of, own.id_to_token(k))) for k in a]
        pb = [bytes([int(two.id_to_piece(k)[3:5], 16)]) if two.is_byte(k) else two.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if not text or b"".join(pa) != (" " + text).encode() or b"".join(pb) != (" " + text).encode():
            a, b, pa, pb = [], [], [], []
        ea, eb = (np.cumsum([len(x) for x in p]).tolist() for p in (pa, pb))
        links = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(ea[i] - len(pa[i]), eb[j] - len(pb[j])) < min(ea[i], eb[j])]
        counts.update((a[i], b[j]) for i, j in links)
        groups, i, j = [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            i2, j2 = ea.index(end) + 1, eb.index(end) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        made.append((doc_id, a, b, groups, [(a[i], b[j]) for i, j in links]))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return sorted([(d, len(a), len(b), len(g), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for d, a, b, g, x in made], key=str)


def got(spark, rows):
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n_a int").repartition(4)
    return sorted(map(tuple, pair_counts.alignments(df, PATH_A, PATH_B).collect()), key=str)


def corpus(seed, docs=60):
    rng = random.Random(seed)
    words = ["the", "weather's", "un", "believable", "naïve", "straße", "1234", "it's", "日本語", "🙂", "<|endoftext|>", "</s>", "x\ty", "a  b", "\n\n", "don't", "QUITE", "re", "ing", " ", "é"]
    return [(k, "".join(rng.choice(words) + rng.choice([" ", " ", "", "\n", ", "]) for _ in range(rng.randint(0, 40)))) for k in range(docs)]


def test_alignments_by_brute_force(spark, libraries):
    rows = corpus(1)
    assert got(spark, rows) == slow_alignment(rows, *libraries)


def test_shards_branches_and_groups(spark, libraries, monkeypatch):
    """Many shards, summed in several steps, looked up in several broadcasts."""
    for name, value in (("SHARD_PAIRS", 40), ("BRANCH_ROWS", 4), ("FAN", 2), ("TABLE_BYTES", 6000), ("HELD_PAIRS", 50)):
        monkeypatch.setattr(pair_counts, name, value)
    rows = corpus(2, docs=30)
    assert got(spark, rows) == slow_alignment(rows, *libraries)


def test_odd_rows(spark, libraries):
    rows = [(1, None), (2, ""), (3, " "), (4, "▁ a piece's own sign"), (None, "plain text"), (5, "plain text"), (5, "plain text"), (5, "other"), (6, "w" * 5000), (7, "long words " * 3000), (8, "\x00 nul"), (9, "  two first"), (10, "ﬁ ligature"), (11, "end ")]
    found = got(spark, rows)
    assert found == slow_alignment(rows, *libraries)
    assert got(spark, []) == []


def test_ids_of_the_fast_library(libraries):
    """The same ids, on text of all sorts."""
    rng = random.Random(5)
    one = pair_counts.ByteLevel(PATH_A)
    assert one.fast is not None
    texts = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(32, 127), rng.randrange(1, 0x250), rng.randrange(0x250, 0xD7FF), rng.randrange(0x1F300, 0x1F700), 32, 10])) for _ in range(200)) for _ in range(400)]
    texts += ["".join(rng.choice("aeinst THE'.0 \n") for _ in range(300)) for _ in range(400)]
    for text in texts:
        assert one.ids(" " + text) == libraries[0].encode(" " + text, add_special_tokens=False).ids


def test_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 50_000 * 32_000, 20_000))
    sizes, bits, order = pair_counts.placed(keys)
    row = {"shard": 0, "sizes": sizes, "bits": np.packbits(bits, bitorder="little").tobytes(), "keys": order.tobytes(), "counts": np.arange(1, len(keys) + 1).tobytes()}
    table = pair_counts.PairTable(1, [row])
    assert sorted(table.of(keys)) == list(range(1, len(keys) + 1)) and (order[table.of(keys) - 1] == keys).all()
    others = np.setdiff1d(rng.integers(0, 50_000 * 32_000, 20_000), keys)
    assert not table.of(others).any() and sum(sizes) < 5 * len(keys)
