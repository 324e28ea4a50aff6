import numpy as np
import pytest
import xxhash

from tallylog.llm import near_copies, simhash


def slow_fingerprint(text, n=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_groups(values):
    root = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


TEXTS = ["a b c d e f g", "A  b\tc\nd e f g", "", None, "one", "one", "x " * 5000, "é ü ß ñ", "a b c d e f h"]


def test_fingerprint_is_the_brute_force_one():
    assert [simhash.fingerprint((t or "").encode()) for t in TEXTS] == [slow_fingerprint(t) for t in TEXTS]


@pytest.mark.parametrize("seed", range(4))
def test_trie_join_finds_all_links(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for _ in range(5))])
    values = np.unique(np.concatenate([near, near[:100] ^ np.uint64(0b101 << 40), rng.integers(0, 200, 100, dtype=np.uint64)]))
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if int(values[i] ^ values[j]).bit_count() <= 4}
    got = [(int(min(p)), int(max(p))) for i, j in simhash.trie_join(values, None, 0, 0) for p in zip(i, j, strict=True)]
    assert len(got) == len(set(got)) and set(got) == want
    left, right = values[values < 1 << 62], values[values >= 1 << 62]
    got = {(int(left[a]), int(right[b])) for i, j in simhash.trie_join(left, right, 0, 0) for a, b in zip(i, j, strict=True)}
    assert got == {(int(a), int(b)) for a in left for b in right if int(a ^ b).bit_count() <= 4}


def test_groups(spark):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(3, None, "again"), (None, "one", "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    values = [slow_fingerprint(t) for _, t, _ in rows]
    roots = slow_groups(values)
    names = {r: min((d for (d, _, _), q in zip(rows, roots, strict=True) if q == r and d is not None), default=None) for r in roots}
    want = sorted((str(d), f"{v:016x}", names[r]) for (d, _, _), v, r in zip(rows, values, roots, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.simhash_groups(df).collect()) == want
    assert simhash.simhash_groups(df.limit(0)).count() == 0
    kept = [r.doc_id for r in simhash.keep_first(df).collect()]
    assert sorted(x for x in kept if x is not None) == sorted({n for n in names.values() if n is not None}) and None in kept


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {k: 0 for k in range(1, 201)} | {501: 500}


def test_repeated_ids_lose_no_text(spark):
    a, b, c = "the first text of all, in some words", "quite another thing that is told here", "third"
    rows = [(1, a, 0), (5, a, 1), (5, b, 2), (7, b, 3), (9, c, 4), (9, c, 5), (None, a, 6)]
    for module in (simhash, near_copies):
        df = spark.createDataFrame(rows, "doc_id long, text string, _key int")
        kept = sorted((str(r.doc_id), r.text) for r in module.keep_first(df).collect())
        assert kept == sorted([("1", a), ("5", b), ("9", c), ("None", a)])
        assert module.keep_first(df).columns == df.columns and module.keep_first(df.limit(0)).count() == 0
        assert module.keep_first(df).collect() == module.keep_first(df).collect()
