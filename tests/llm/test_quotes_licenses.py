import random
import re

from pyspark.sql import functions as F

from tallylog.llm import licenses, quotes


def test_quotes(spark):
    rows = [
        (1, 0, "u", "Hello world.\nHow are you?"), (1, 1, "a", "On Monday Ann wrote:\n> Hello world.\n> How are you?\nFine, thanks."),
        (1, 2, "u", "> > Hello world.\n> > How are you?\n> Fine, thanks.\nGood."), (1, 2, "u", "> > Hello world.\n> > How are you?\n> Fine, thanks.\nGood."),
        (1, 3, "a", "> How are YOU\nwell"), (1, 4, "a", None), (1, 5, "a", "> never said\nno"), (1, 6, "a", "x > y"), (2, 0, "u", "> Hello world.\nnew"), (None, 1, "u", "> Hello world."), (3, None, "u", "> q"),
        (4, 0, "u", "> later\nfirst"), (4, 1, "u", "later"), (1, 7, "u", ">>> " + "deep\n" * 3 + "\n" * 2000),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, level string")
    got = quotes.reply_order(quotes.conversations(df)).collect()
    at = {(r.conv_id, r.turn): r for r in got}
    assert len(got) == len(rows)
    assert {k: (r.thread_turn, r.parent_turn, r.n_quotes, r.n_linked, r.max_level) for k, r in at.items()} == {
        (1, 0): (0, None, 0, 0, 0), (1, 1): (0, 0, 1, 1, 1), (1, 2): (0, 1, 2, 2, 2), (1, 3): (0, 0, 1, 1, 1), (1, 4): (4, None, 0, 0, 0), (1, 5): (5, None, 1, 0, 1), (1, 6): (6, None, 0, 0, 0),
        (2, 0): (0, None, 1, 0, 1), (None, 1): (1, None, 1, 0, 1), (3, None): (None, None, 1, 0, 1), (4, 0): (0, None, 1, 0, 1), (4, 1): (1, None, 0, 0, 0), (1, 7): (7, None, 1, 0, 3),
    }
    assert at[1, 1].body == "Fine, thanks." and at[1, 2].body == "Good." and at[1, 6].body == "x > y"
    assert quotes.conversations(df.limit(0)).count() == 0


def test_long_reply_chains(spark):
    rows = [(1, k, "u", (f"> line number {k - 1} here\n" if k else "") + f"line number {k} here") for k in range(40)]
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.thread_turn for r in got} == {0} and {r.turn: r.parent_turn for r in got} == {0: None} | {k: k - 1 for k in range(1, 40)}


def test_a_line_everybody_repeats_links_to_its_first_message(spark):
    rows = [(1, k, "u", "same old line" if k % 2 == 0 else "> same old line\nyes") for k in range(60)]
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.parent_turn for r in got if r.turn % 2} == {0}


def slow_origin(passage, turn, bodies, n=5):
    """The earlier message with most of the passage's rows of words, first of equals; every pair is looked at."""
    words = lambda t: re.sub(r"[\W_]+", " ", t.lower()).strip()
    rows = lambda t: {tuple(t.split()[i : i + n]) for i in range(max(1, len(t.split()) - n + 1))}
    want, best = rows(words(passage)), (0.0, 0, None)
    for k, body in bodies.items():
        own = rows(words(body)) | {tuple(words(x).split()) for x in body.split("\n") if 0 < len(words(x).split()) < n}
        share = len(want & own) / len(want)
        if k < turn and share >= quotes.COVER and (share, -k) > best[:2]:
            best = (share, -k, k)
    return best[2]


def test_quotes_by_brute_force(spark):
    """Random conversations: parts of messages, wrapped anew, quoted in several levels."""
    rng, rows, want, levels = random.Random(4), [], {}, {}
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(30))
    for conv in range(12):
        bodies = {}
        for turn in range(9):
            own = "\n".join(" ".join(word() for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(1, 4)))
            if turn and rng.random() < 0.2:
                own = bodies[rng.randrange(turn)] + "\n" + own  # repeats an earlier message and goes on
            lines, first = [], []
            if turn and rng.random() < 0.8:
                source = bodies[rng.randrange(turn)].split()
                a = rng.randrange(len(source))
                part = source[a : a + rng.randrange(3, 30)]
                for level in (2, 1) if rng.random() < 0.3 else (1,):
                    if level == 2:
                        quoted = [word() for _ in range(8)]
                    else:
                        quoted = part
                        first = " ".join(part)
                    width = rng.randrange(3, 9)
                    lines += [">" * level + " " + " ".join(quoted[i : i + width]) for i in range(0, len(quoted), width)]
            bodies[turn] = own
            rows.append((conv, turn, "u", "\n".join([*lines, own])))
            want[conv, turn] = slow_origin(first, turn, bodies) if first else None
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: r.parent_turn for k, r in got.items()} == want and sum(v is not None for v in want.values()) > 30
    for (conv, turn), parent in want.items():
        top = turn
        while want[conv, top] is not None:
            top = want[conv, top]
        assert got[conv, turn].thread_turn == top


def test_originals_repeated_before_and_after(spark):
    """Small vocabularies and repeated messages; a later message never changes an earlier link."""
    rng, rows, want = random.Random(11), [], {}
    word = lambda: rng.choice("abcdefg") + str(rng.randrange(6))
    for conv in range(60):
        bodies = {}
        for turn in range(8):
            parts = [bodies[k] for k in range(turn) if rng.random() < 0.35]
            own = "\n".join([*rng.sample(parts, min(2, len(parts))), " ".join(word() for _ in range(rng.randrange(3, 20)))])
            quoted = None
            if turn and rng.random() < 0.8:
                words = bodies[rng.randrange(turn)].split()
                a = rng.randrange(len(words)) if rng.random() < 0.5 else 0
                quoted = " ".join(words[a : a + rng.randrange(4, 60)])
            bodies[turn] = own
            rows.append((conv, turn, "u", f"> {quoted}\n{own}" if quoted else own))
            want[conv, turn] = slow_origin(quoted, turn, bodies) if quoted else None
    rows += [(99, 1, "u", "a1 b1 c1 d1 e1 f1"), (99, 2, "u", "a1 b1 c1 d1 e1 f1\nand g1 h1 i1 j1 k1 l1"), (99, 3, "u", "> a1 b1 c1 d1 e1 f1\n> and g1 h1 i1 j1 k1 l1\nyes"), (99, 4, "u", "a1 b1 c1 d1 e1 f1\nand g1 h1 i1 j1 k1 l1")]
    want |= {(99, 1): None, (99, 2): None, (99, 3): 2, (99, 4): None}
    got = {(r.conv_id, r.turn): r.parent_turn for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == want and sum(v is not None for v in want.values()) > 100


def test_licences(spark):
    rows = [
        (1, "Some text.\nReleased under the MIT License.\nMore."), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "no licence to speak of"), (4, None), (5, ""),
        (6, "x\n\nLicensed under the Apache License,\nVersion 2.0; you may not use this file except in compliance\nwith the License. You may obtain a copy of the License at\n\ny"), (7, "All rights reserved."),
        (8, "the version of this work is free and public under the terms of use"), (9, "Licensed under CC BY-NC 4.0."), (1, "Released under the MIT License."), (10, "word " * 20_000 + "\nLicensed under the MIT License."),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, family string")
    got = licenses.license_scan(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.family for r in got} == {1: "mit", 2: "gpl", 3: None, 4: None, 5: None, 6: "apache", 7: "proprietary", 8: None, 9: "cc-by-nc", 10: "mit"}
    assert all((r.n_paragraphs > 0) == (r.family is not None) and 0 <= r.probability <= 1 for r in got)
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_scores_are_the_models(spark):
    model = licenses.Classifier(["an ordinary line of text about nothing", "the public was free to use this work"] * 20)
    units = [t for _, t in licenses.TEMPLATES] + ["free software for everybody"]
    got = {r.unit: r for r in licenses.scored(spark.createDataFrame([(u,) for u in units], "unit string"), model).collect()}
    for u in units:
        x = sum((model.weights[model.features.index(g)] for g in licenses.grams(u) if g in model.features), 0 * model.bias) + model.bias
        p = licenses.softmax((x / model.temperature)[None])[0]
        family = model.families[int(p.argmax())]
        if u in got:
            assert got[u].family == family and abs(got[u].probability - p.max()) < 1e-4
        share = max((len(licenses.pairs_of(t) & licenses.grams(u)) / len(licenses.pairs_of(t)) for f, t in licenses.TEMPLATES if f == family), default=0)
        assert (u in got) == (family != "unknown" and p.max() >= licenses.LEAST and share >= licenses.OVERLAP)


def test_word_pairs(spark):
    got = spark.createDataFrame([("A b, c b",), ("one",), ("",)], "t string").select(licenses.gram_array(licenses.word_array(F.col("t"))).alias("g")).collect()
    assert [set(r.g) for r in got] == [licenses.grams(t) for t in ("A b, c b", "one", "")]
