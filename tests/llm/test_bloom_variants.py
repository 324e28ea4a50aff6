"""op13 against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallylog.llm import bloom_variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def slow_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def slow_forms(rows):
    words = slow_words(rows)
    form, near = {}, {w: [v for v in words if one_edit(w, v)] for w in words}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return sorted(out)


def corpus(seed, docs=120):
    rng = random.Random(seed)
    letters = "abcdeÀéÿ"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 8))) for _ in range(25)] + ["aaaaaa", "aaaaa", "z" * 80, "z" * 79]
    rows = []
    for k in range(docs):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = list(rng.choice(stems[: rng.randint(1, len(stems))]))
            if rng.random() < 0.4:
                at, how = rng.randrange(len(w)), rng.randrange(3)
                w[at : at + (how != 0)] = [] if how == 1 else [rng.choice(letters)]
            words.append("".join(c.upper() if c.isascii() and rng.random() < 0.1 else c for c in w))
        rows.append((k, rng.choice([" ", ", ", "×", "’", "\n", "1", "ß"]).join(words)))
    return rows


def got(spark, rows):
    df = spark.createDataFrame([(d, t, "w") for d, t in rows], "doc_id long, text string, word string").repartition(4)
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in bloom_variants.spelling_forms(df).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_forms_by_brute_force(spark, seed):
    rows = corpus(seed)
    want = slow_forms(rows)
    assert got(spark, rows) == want and sum(x[3] is not None for x in want) > 20


def test_many_filters_and_parts(spark, monkeypatch):
    """Lengths split into parts by hash, and several broadcasts, find the same."""
    monkeypatch.setattr(bloom_variants, "FILTER_BYTES", 256)
    monkeypatch.setattr(bloom_variants, "PROBED", 64)
    rows = corpus(3, docs=60)
    assert got(spark, rows) == slow_forms(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "Straße straße STRAßE strabe"), (3, "x" * 30_000 + " " + "y" * 9), (3, "x" * 30_000), (4, "x" * 30_000 + "q" + " ퟿" + "x" * 29_999 + "q"), (5, "x" * 29_999 + "q "), (6, "x" * 29_999 + "q ")]
    assert got(spark, rows) == slow_forms(rows)
    assert got(spark, []) == []


def test_runs_in_bytes():
    text = "Ærø×ÿA÷bĀcé€À🙂d¿e"
    assert [r.decode() for r in bloom_variants.runs_of(text.encode())] == ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r) for r in RUN.findall(text)]
    assert bloom_variants.runs_of(b"ab\xc3 cd\xff\xa9ef") == [b"ab", b"cd", b"ef"]


def test_filters_have_no_false_negatives():
    words = [f"{k:09d}".translate(str.maketrans("0123456789", "abcdefghij")) for k in range(0, 90_000, 7)]
    plan = bloom_variants.Plan({9: len(words)})
    (first, size), code = plan.groups[0][9, 0], bloom_variants._scattered(bloom_variants.codes_of(bloom_variants.letters(words)))
    bits = np.zeros(size, np.uint64)
    unit, mine = bloom_variants._places(code, first, size)
    np.bitwise_or.at(bits, unit, bloom_variants._bits(mine))
    assert ((bits[unit] & bloom_variants._bits(mine)) == bloom_variants._bits(mine)).all()
    other = bloom_variants._scattered(code)
    unit, mine = bloom_variants._places(other, first, size)
    assert ((bits[unit] & bloom_variants._bits(mine)) == bloom_variants._bits(mine)).mean() < 0.01
