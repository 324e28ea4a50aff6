import io
import random
import subprocess
import sys
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest

from tallylog.llm import token_blocks, token_counts
from tallylog.llm.bpe_machine import BpeMachine, machine

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["Don't he'll 'S x'sx''s \"'s it's 'review'l 'll", "ÀÉ×÷ß Œœ", "<|endoftext|> x <|startoftext|>", "12345 a1b2", " x\x85y", "", "  ", "日本語", "é", "ﬁ İI", "a'", "'", "''s", "é's ê'ré", "abc\x1cdef\x00 x", "A" * 3000, "the quick brown fox", "\t\n naïve façade!? (x) a,b.c"]


def library(texts):
    return [e.ids for e in machine(PATH).library.tokenizer.encode_batch(texts, add_special_tokens=False)]


def random_texts():
    rng = random.Random(3)
    return ODD + [" ".join(rng.choices(ODD, k=3)) for _ in range(50)] + ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz' .éü9", k=60)) for _ in range(300)]


def test_machine_is_the_library():
    texts = random_texts()
    want = library(texts)
    assert [x.tolist() for x in machine(PATH).encode([t.encode() for t in texts])] == want
    assert token_counts.count_texts([t.encode() for t in texts], machine(PATH)).tolist() == [len(x) for x in want]


@pytest.mark.parametrize("size", [1, 7, 64])
def test_chunks_compose(size):
    texts = [*random_texts(), "word " * 50, "x" * 200, "é" * 50 + " é"]
    assert token_counts.count_texts([t.encode() for t in texts], machine(PATH), size).tolist() == [len(x) for x in library(texts)]


@pytest.mark.parametrize("size", [2, 5])
def test_scan_gives_all_prefixes(size):
    """Against composing the chunks' tables one after the other."""
    parts = [b"some words, and more of them; don't stop", b"", "a’b unbrokenunbrokenunbroken 12".encode(), b"x"]
    maps, upto = token_counts.chunk_maps(parts, machine(PATH), size)
    scanned = token_counts.prefix_scan(maps, upto)
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        state, total = 0, 0
        for k in range(a, b):
            row = maps.rows(np.array([k]), np.array([state]))[0]
            state, total = maps.exit[row], total + maps.count[row]
            whole = scanned.rows(np.array([k]), np.array([0]))[0]
            assert (scanned.exit[whole], scanned.count[whole]) == (state, total)
        assert state == 0
    # a table with no row for a state that a chunk is entered in is an error, not a guess
    inside = np.flatnonzero(maps.entry > 0)[:1]
    with pytest.raises(ValueError):
        maps.rows(maps.chunk[inside], np.array([10**6]))


@pytest.mark.parametrize("look", [48, 2])
def test_tables_do_not_wait_for_the_chunk_before(monkeypatch, look):
    """A chunk's rows are the same whatever stands more than LOOK symbols before it; with few symbols to look at there are several."""
    monkeypatch.setattr(token_counts, "LOOK", look)
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choices("etaoinshrdlu", k=n))
    several = 0
    for _ in range(20):
        near, own = letters(rng.choice([5, 200])), letters(100)
        tables = []
        for far in ("a" * (256 - len(near)), "z " * ((256 - len(near)) // 2) + "z" * (len(near) % 2)):
            bpe = BpeMachine.__new__(BpeMachine)
            bpe.__dict__ = dict(machine(PATH).__dict__)
            bpe.let_go()
            far = far[: 255 - len(near)] + (" " if len(near) < 100 else "q")
            maps, _ = token_counts.chunk_maps([(far + near + own + " end").encode()], bpe, 256)
            at = maps.chunk == 1
            tables.append({bpe.held[e]: (bpe.held[x], n) for e, x, n in zip(maps.entry[at].tolist(), maps.exit[at].tolist(), maps.count[at].tolist())})
        both = tables[0].keys() & tables[1].keys()
        assert both and all(tables[0][e] == tables[1][e] for e in both)
        several += len(tables[0]) > 1
    assert several or look > 2


def test_rows_that_are_missing_are_added(monkeypatch):
    """Where the looks before the cuts tell the wrong states the counts are right all the same."""
    monkeypatch.setattr(token_counts, "LOOK", 1)
    monkeypatch.setattr(token_counts, "PLACES", 1)
    rng = random.Random(9)
    texts = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(1, 600))) + rng.choice(["", " ", " x"]) for _ in range(60)]
    for size in (3, 40):
        assert token_counts.count_texts([t.encode() for t in texts], machine(PATH), size).tolist() == [len(x) for x in library(texts)]


def test_states_stay_few():
    rng = random.Random(5)
    small = BpeMachine(PATH, max_states=500)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz  ", k=4000)) for _ in range(3)] + ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9000))]
    want = library(texts)
    for t, ids in zip(texts, want, strict=True):
        assert [x.tolist() for x in small.encode([t.encode()])] == [ids]
        assert token_counts.count_texts([t.encode()], small, 64).tolist() == [len(ids)]
        assert len(small.states) < 500 + 4000


def test_a_very_long_text_takes_bounded_memory():
    code = f"""
import resource
from tallylog.llm import token_counts
from tallylog.llm.bpe_machine import BpeMachine, machine
m = machine({PATH!r})
text = ("naïve façades, and words of " + "x" * 70 + " ’ " ).encode() * 100_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert len(text) > 10_000_000
n = int(token_counts.count_texts([text], m)[0])
assert n == sum(map(len, m.encode([text]))) > 0
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300)


def test_counts(spark):
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate([*ODD, None, "w " * 3000])], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in token_counts.token_counts(df, PATH).collect()}
    texts = [*ODD, "", "w " * 3000]
    assert [(got[k].n_bytes, got[k].n_tokens, got[k].over_limit) for k in range(len(texts))] == [(len(t.encode()), len(i), len(i) > 2048) for t, i in zip(texts, library(texts), strict=True)]
    assert token_counts.token_counts(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("n", [1, 2, 511, 513, 5000])
def test_ids_come_back(n):
    rng = np.random.default_rng(n)
    for ids in (rng.zipf(1.3, n).clip(0, 49_000), np.full(n, 49_407), np.arange(n) % 7, rng.integers(0, 60_000, n)):
        block = token_blocks.Block([5, None], np.array([1, n - 1]), ids.astype(np.int32), False)
        data = token_blocks.pack(block)
        (back,) = token_blocks.unpack(io.BytesIO(data))
        assert back.ids.tolist() == ids.tolist() and back.doc_ids == [5, None] and back.sizes.tolist() == [1, n - 1]


def test_repeated_ids_shrink():
    ids = np.tile(np.random.default_rng(0).integers(0, 49_000, 300), 200).astype(np.int32)
    assert len(token_blocks.pack(token_blocks.Block([1], np.array([len(ids)]), ids, False))) < len(ids)


def test_damage_is_noticed():
    data = bytearray(token_blocks.pack(token_blocks.Block([1], np.array([50]), np.arange(50, dtype=np.int32), False)))
    data[-3] ^= 1
    with pytest.raises(ValueError):
        list(token_blocks.unpack(io.BytesIO(bytes(data))))


def test_documents_over_several_blocks(spark):
    texts = [*ODD, None, "w " * 300, "the end"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(2, "again"), (None, "x")], "doc_id long, text string")
    got = sorted(token_blocks.store_ids(df, PATH, block_ids=64).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 2, *range(3, len(texts))]
    rows = {(d, zlib.crc32(np.array([*i, 2], "<u4"))) for (d, t), i in zip([*enumerate(texts), (2, "again"), (None, "x")], library([*(t or "" for t in texts), "again", "x"]), strict=True)}
    assert {(r.doc_id, r.ids_crc32) for r in got} == rows
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    assert token_blocks.store_ids(df.limit(0), PATH).count() == 0


def test_bytes_of_a_block_stay_the_same():
    """Files written before can be read: the checksum is of the coder's first version."""
    k = np.arange(60_000, dtype=np.uint64)
    ids = ((k * k * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(9) + (k // np.uint64(50)) % np.uint64(900)).astype(np.int32)
    packed = token_blocks.pack(token_blocks.Block([1, None], np.array([59_000, 1000]), ids, False))
    assert zlib.crc32(packed) == 3791442431
    (found,) = token_blocks.unpack(io.BytesIO(packed))
    assert np.array_equal(found.ids, ids) and found.doc_ids == [1, None]


def test_a_new_transition_does_not_repeat_the_look_at_known_ones():
    looks = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            looks.append(np.size(at) if isinstance(at, np.ndarray) else 0)
            return np.asarray(self).__getitem__(at)

    bpe = BpeMachine(PATH)
    list(bpe.encode([b"some words and more of them"]))
    known = np.repeat(np.array([ord("s"), ord("m"), ord("t")], np.int32), 400)
    assert bpe.keys[bpe._find(known)].tolist() == known.tolist()
    bpe.keys = bpe.keys.view(Counted)
    keys = np.append(known, np.int32(ord("q")))
    slots = bpe._find(keys)
    assert np.asarray(bpe.keys)[slots].tolist() == keys.tolist()
    assert 1200 < sum(looks) < 1300


def test_a_refresh_counts_all_new_ids_at_once(monkeypatch):
    model, whole, calls = token_blocks.Model(100, 4), np.bincount, []
    model.new = [np.array([1, 2, 2, 99], np.int32), np.array([2, 0], np.int32)]
    monkeypatch.setattr(token_blocks.np, "bincount", lambda *a, **b: calls.append(1) or whole(*a, **b))
    model.refresh()
    assert len(calls) == 1 and model.seen[[0, 1, 2, 99]].tolist() == [1, 1, 3, 1] and model.seen.sum() == 6
    model.refresh()
    assert len(calls) == 1 and model.seen.sum() == 6 and int(model.freq.sum()) == 1 << 20


def test_blocks_that_are_coded_together_are_held_few_times():
    rng = np.random.default_rng(12)
    blocks = [token_blocks.Block([k], np.array([token_blocks.BLOCK_IDS]), rng.integers(0, 300, token_blocks.BLOCK_IDS).astype(np.int32), False) for k in range(token_blocks.TOGETHER)]
    size = sum(block.ids.nbytes for block in blocks)
    tracemalloc.start()
    packed = list(token_blocks.pack_all(iter(blocks)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.5 * size, peak / size
    back = list(token_blocks.unpack(io.BytesIO(b"".join(packed))))
    assert all(np.array_equal(a.ids, b.ids) for a, b in zip(blocks, back, strict=True))
