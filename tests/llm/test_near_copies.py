import random

import corpus_pipeline
from tallylog.llm import near_copies, simhash
from tallylog.llm.common import read

DATA = "/root/testdata/sf0.001"


def slow_shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def slow_groups(texts, least=0.8):
    held, root = [slow_shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = held[i], held[j]
            if a == b or len(a & b) >= least * len(a | b) - 1e-9:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def edited(rng, text, edits):
    words = text.split()
    for k in rng.sample(range(len(words)), edits):
        words[k] = f"changed{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_copies_go_down_to_the_stated_similarity(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) + str(rng.randrange(40)) for _ in range(200)) for _ in range(12)]
    texts = [*base, *(edited(rng, t, n) for t in base for n in (1, 2, 3, 4, 6, 9))] + ["", None, "one two", "One  two", "one two three"]
    texts += [edited(rng, base[0], 2) for _ in range(30)]
    roots = slow_groups(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_groups(df).collect()}
    assert [got[k] for k in range(len(texts))] == roots
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, DATA).collect()) == sorted(set(roots))
    # the trie at 4 bits leaves most of them
    assert simhash.keep_first(df).count() > len(set(roots)) + 20
    assert near_copies.near_groups(df.limit(0)).count() == 0


def test_the_stage_on_documents_by_brute_force(spark):
    rows = sorted(read(spark, DATA, "documents").collect(), key=lambda r: r.doc_id)
    roots = slow_groups([r.text for r in rows])
    got = corpus_pipeline.near_dedup(spark, read(spark, DATA, "documents"), DATA)
    assert sorted(r.doc_id for r in got.collect()) == sorted(rows[k].doc_id for k in set(roots))
