import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tallylog.llm import decontam, mixing
from tallylog.llm.common import materialise, read

DATA = "/root/testdata/sf0.001"


def stage_inputs(spark):
    docs, found = read(spark, DATA, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, DATA), "stage")
        found.append((docs, out))
        docs = out
    return found


def test_stages_by_brute_force(spark):
    pairs = stage_inputs(spark)
    for before, after in pairs[:-1]:
        assert after.columns == before.columns
    # language: all that has a letter stays
    before, after = pairs[0]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if re.search(r"[^\W\d_]", r.text or "")}
    # near duplicates: groups by comparing the shingle sets of all pairs
    from tests.llm.test_near_copies import slow_groups

    before, after = pairs[1]
    rows = sorted(before.collect(), key=lambda r: r.doc_id)
    roots = slow_groups([r.text for r in rows])
    assert sorted(r.doc_id for r in after.collect()) == sorted({min(r.doc_id for r, q in zip(rows, roots, strict=True) if q == root) for root in roots})
    # benchmark: every text that holds an item word by word goes, every other one that shares no long run stays
    before, after = pairs[2]
    items = [decontam.words_of([r.text.encode()])[0] for r in read(spark, DATA, "benchmark").collect()]
    kept = {r.doc_id for r in after.collect()}
    for r in before.collect():
        words = decontam.words_of([r.text.encode()])[0]
        if any(i.tobytes() in words.tobytes() for i in items):
            assert r.doc_id not in kept
        elif r.doc_id not in kept:
            assert max(decontam.common(i, words) / len(i) for i in items) >= decontam.COVER
    # mixing: as many copies as reported
    before, after = pairs[3]
    want = {r.doc_id: r.copies for r in mixing.mix_report(before).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == want
    # token ids: the library's
    before, after = pairs[4]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    texts = {r.doc_id: np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4") for r in before.collect()}
    got = sorted(after.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in before.collect())
    assert all((r.n_tokens, r.ids_crc32) == (len(texts[r.doc_id]), zlib.crc32(texts[r.doc_id])) for r in got)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()


def test_run_is_the_stages(spark):
    *_, (_, last) = stage_inputs(spark)
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, last.collect()))


def test_stages_take_odd_tables(spark):
    """Null and repeated ids, repeated rows, empty and long texts, clashing names, and no rows at all."""
    names = ("doc_id", "text", "lang", "source", "n_chars", "_text", "_key", "_lang", "_id", "_row", "size", "nth", "node", "fp", "Root")
    base = [(1, "the cat and the dog sat by the old mill", "en", "a", 3), (1, "the cat and the dog sat by the old mill", "en", "a", 3), (1, "another text with the same id as the cat", "en", "b", 4), (None, "a text without any id at all is here", None, None, 5)]
    base += [(None, None, None, None, None), (7, "", "en", "a", 0), (8, " 12 34 ", "en", "a", 0), (9, "word " * 60_000, "en", "c", 1), (10, "é" * 5000 + " end", "de", "c", 1)]
    rows = [(*r, "x", 1, "y", 2, "z", 3, 4, 5, 6, "w") for r in base]
    kinds = "long string string string int string int string int string int int int int string".split()
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert tuple(out.columns) == names and out.count() > 0
        assert stage(spark, docs.limit(0), DATA).count() == 0
    kept = corpus_pipeline.near_dedup(spark, docs, DATA)
    assert sorted((str(r.doc_id), (r.text or "")[:9]) for r in kept.collect()) == sorted([("1", "the cat a"), ("1", "another t"), ("None", "a text wi"), ("None", ""), ("7", ""), ("8", " 12 34 "), ("9", "word word"), ("10", "é" * 9)])
    ids = corpus_pipeline.token_ids(spark, docs, DATA)
    assert ids.count() == len(rows) and corpus_pipeline.token_ids(spark, docs.limit(0), DATA).count() == 0


def test_decontamination_of_batches_that_end_with_a_short_text(spark, tmp_path):
    """A window that begins after a text's last word reached into the last text of the batch, which stopped the stage."""
    sf = "/root/testdata/sf0.001"
    item = read(spark, sf, "benchmark").orderBy("item_id").first().text.split()[:16]
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = read(spark, sf, "documents").select("doc_id", "text").where("text is not null")
    pairs = [[(10_000 + n, " ".join(f"x{j}" for j in range(n))), (11_000 + n, " ".join(item[4:9]))] for n in (1, 9, 17)]
    for rows in pairs:
        docs = docs.union(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    docs = docs.union(spark.createDataFrame([(20_000, " ".join(item))], "doc_id long, text string"))
    left = {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()}
    assert 20_000 not in left and {d for rows in pairs for d, _ in rows} <= left
