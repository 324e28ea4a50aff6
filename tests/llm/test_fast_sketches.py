"""op12 against all pairs; sketches as the published scheme says."""

import random
import re

import numpy as np
import pytest

from tallylog.llm import fast_sketches

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = [w for w in WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    return {" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))} if words else set()


def slow_groups(rows):
    """Components over all pairs of rows whose sets link; (id, n, component) by row."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        least.setdefault(find(k), []).append(d)
    out = []
    for k, (d, _) in enumerate(rows):
        ids = [x for x in least[find(k)] if x is not None]
        c = min(ids) if ids else None
        out.append((d, len(sets[k]), c, None if d is None or c is None else d == c))
    return sorted(out, key=str)


def corpus(seed, groups=14, edits=6):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 20, 60, 200]))]
        for _ in range(rng.randint(1, 12)):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(rng.choice([" ", "\n", "  "]).join(w.upper() if rng.random() < 0.1 else w for w in own))
    return texts


def got(spark, rows, **more):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int").repartition(5)
    return sorted(map(tuple, fast_sketches.similar_groups(df).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_by_brute_force(spark, seed):
    rows = [(k * 3, t) for k, t in enumerate(corpus(seed))]
    assert got(spark, rows) == slow_groups(rows)


def test_a_chain_of_neighbours_is_one_group(spark):
    """Each text links with the next one only, so no hub sees all of it; a far one stays out."""
    words = [f"c{k}" for k in range(300)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 100])) for k in range(40)]
    assert got(spark, rows) == slow_groups(rows)


def test_odd_rows(spark):
    long = " ".join(f"x{k % 5000}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one "), (6, "one two"), (None, "one two"), (None, "alone here"), (7, long), (8, long + " end"), (9, "same words of it"), (9, "same words of it"), (9, "other words in it")]
    assert got(spark, rows) == slow_groups(rows)
    assert got(spark, []) == []


def test_groups_without_hub_rounds(spark, monkeypatch):
    """All pairs that hubs leave are compared, however many rounds there were."""
    monkeypatch.setattr(fast_sketches, "HUB_ROUNDS", 0)
    rows = [(k, t) for k, t in enumerate(corpus(5, groups=6))]
    assert got(spark, rows) == slow_groups(rows)


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 4000, np.uint64)
    for n in (1, 7, 150, 1500):
        a, b = pool[:n], np.concatenate([pool[: n - n // 5], pool[2000 : 2000 + n // 5]])
        one, two = fast_sketches.sketches([a, b, a[:0]])[:2]
        assert (one != np.iinfo(np.uint64).max).all()
        jaccard = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((one == two).mean() - jaccard) < 0.15
    assert (fast_sketches.sketches([pool])[0] == fast_sketches.sketches([pool[::-1]])[0]).all()


def test_missed_pairs_are_as_rare_as_computed():
    """At the threshold hardly a pair of sets shares no band."""
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(600):
        both, own = rng.integers(0, 1 << 63, 170, np.uint64), rng.integers(0, 1 << 63, 30, np.uint64)
        sets += [np.concatenate([both, own[:15]]), np.concatenate([both, own[15:]])]
    keys = fast_sketches.band_keys(fast_sketches.sketches(sets))
    assert (keys[::2] == keys[1::2]).any(1).all()
