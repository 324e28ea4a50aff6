import zlib

import numpy as np
import pytest

from tallylog.llm import langid, mixing
from tallylog.llm.common import read

DATA = "/root/testdata/sf0.01"


def test_kernel_is_the_set_kernel():
    def grams(text):
        return [{tuple(text.lower()[i : i + n]) for i in range(len(text) - n + 1)} for n in (1, 2, 3)]

    a, b = "hello there", "help the hen"
    want = sum(len(x & y) / np.sqrt(len(x) * len(y)) for x, y in zip(grams(a), grams(b), strict=True)) / 3
    rows = langid.normalised(np.stack([langid.ngrams(a), langid.ngrams(b)]))
    assert abs(float(rows[0] @ rows[1]) - want) < 0.02 and abs(float(rows[0] @ rows[0]) - 1) < 1e-5


def test_held_out_accuracy(spark):
    docs = read(spark, DATA, "documents")
    got = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got) and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_language_edges(spark):
    rows = [(k, "the cat and the dog " * 3, "en", "x") for k in range(20)] + [(50 + k, "der Hund und die Katze " * 3, "de", "x") for k in range(20)] + [(100, None, "en", "x"), (101, "12 34", "en", "x"), (None, "the dog", None, "x"), (101, "12 34", "en", "x"), (102, "", "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in langid.languages(df).collect()}
    assert [(got[k].lang_pred, got[k].score) for k in (100, 101, 102)] == [("und", 0.0)] * 3
    assert got[None].lang_pred == "en" and got[None].held_out and got[55].lang_pred == "de"
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == 41
    assert {r.lang_pred for r in langid.languages(df.withColumn("lang", df["lang"].substr(1, 0)).where("lang is null")).collect()} == {"und"}
    assert langid.languages(df.limit(0)).count() == 0


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    rows = [(k, "w " * int(n), str(s) if s < 5 else None) for k, (n, s) in enumerate(zip(rng.lognormal(4, 1, 600), rng.choice(6, 600, p=[0.5, 0.1, 0.1, 0.1, 0.1, 0.1]), strict=True))]
    return spark.createDataFrame([*rows, (1000, None, "0"), (1001, " \t", None), (None, "a b c", "1")], "doc_id long, text string, source string")


def test_mixing(docs):
    got = mixing.mix_report(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    sizes["1"] += 3
    want = slow_targets(sizes)
    for source, target in want.items():
        own = [r for r in got if r.source == source]
        assert all(abs(r.target - target) < 1e-6 * target and r.source_size == sizes[source] and 0 <= r.taken <= 2 * r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 0.01 * target + 10
        # the rates are one exponential tilt of the size, held at 2, and meet the target
        lam = {round(np.log(r.rate) / r["size"], 9) for r in own if r["size"] and r.rate < 2}
        assert len(lam) <= 1 or max(lam) - min(lam) < 1e-6
        assert abs(sum(r.rate * r["size"] for r in own) - target) < 1e-4 * target + 6
    assert sorted(map(str, mixing.mix_report(docs).collect())) == sorted(map(str, mixing.mix_report(docs.repartition(7)).collect()))


def test_mixed_rows_are_the_reported_copies(docs):
    want = {r.doc_id: r.copies for r in mixing.mix_report(docs).collect() if r.copies}
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want
    assert mixing.mix_report(docs.limit(0)).count() == 0 and mixing.mixed(docs.where("text is null")).count() == 0


def test_repeated_rows_are_rounded_one_by_one(spark):
    rows = [(1, "w " * 100, "a", "x")] * 3 + [(1, "w " * 100, "b", "x"), (None, "w " * 40, None, "x")] + [(None, "w " * 7, None, "y")] * 60 + [(k, "w " * 11, "b", None) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, nth string").repartition(3)
    got = mixing.mix_report(df).collect()
    by_target = {}
    for r in got:
        by_target.setdefault((r.target, r.source_size), []).append(r)
    assert len(by_target) == 3 and len(got) == len(rows)
    for (target, _), own in by_target.items():
        assert abs(sum(r.taken for r in own) - target) <= max(r["size"] for r in own) / 2 + 1
        assert all(0 <= r.taken <= 2 * r["size"] for r in own)
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in got)


def test_every_label_can_be_predicted():
    rng = np.random.default_rng(0)
    langs = [f"l{k:03d}" for k in range(120)]
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 4)) for _ in range(6)] for _ in langs]
    texts = [" ".join(rng.choice(w, 12)) for w in words for _ in range(3)]
    labels = np.repeat(np.arange(len(langs)), 3)
    rows = np.packbits(np.stack([langid.ngrams(t) for t in texts]), axis=1)
    model = langid.fit(langs, labels, rows)
    assert len(model.landmarks) == len(langs)
    names, _ = langid.predict_texts([" ".join(rng.permutation(w)).encode() for w in words], model)
    assert np.mean([a == b for a, b in zip(names, langs, strict=True)]) > 0.9


def test_fit_is_the_ridge_regression():
    """Against the Nystroem features and a dense solve of the same objective."""
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["the", "cat", "der", "hund", "le", "chat", "x1"], 9)) for _ in range(40)]
    labels = np.arange(40) % 3
    grams = np.stack([langid.ngrams(t) for t in texts])
    model = langid.fit(["a", "b", "c"], labels, np.packbits(grams, axis=1), landmarks=10, ridge=0.01)
    wide = langid.normalised(grams).astype(np.float64)
    base = langid.normalised(np.unpackbits(model.landmarks, axis=1)[:, : grams.shape[1]]).astype(np.float64)
    inner = base @ base.T
    values, vectors = np.linalg.eigh(inner)
    keep = values > 1e-9
    half = vectors[:, keep] / np.sqrt(values[keep])
    features = wide @ base.T @ half
    target = np.where(labels[:, None] == np.arange(3), 1.0, -1.0)
    weights = np.linalg.solve(features.T @ features + 0.01 * 40 * np.eye(features.shape[1]), features.T @ target)
    assert np.allclose(model.scores(grams), features @ weights, atol=2e-3)


def test_clashing_names_and_repeated_ids(spark):
    rows = [(1, "the cat and the dog", "en", "a", 1)] * 30 + [(2, "der Hund und die Katze", "de", "b", 2)] * 30 + [(3, None, "en", "c", 3), (4, "", None, "d", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _text string, _lang int")
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and sorted(set((r._text, r._lang) for r in kept.collect())) in ([("a", 1), ("b", 2)], [])
    assert kept.count() in (60, 0)
