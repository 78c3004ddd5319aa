import zlib

import numpy as np
from pyspark.sql import types as T

from pulse.llm import toxicity as tox
from pulse.llm.common import read_table

SF = "/root/testdata/sf0.01"


def auc(score, label):
    pos, neg = score[label == 1], score[label == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_grammar_scores_clauses_not_words():
    g = tox.default_grammar()
    plain, you = g.features("a moron lives here")[0], g.features("you moron")[0]
    negated, said = g.features("this is not a moron")[0], g.features("she said moron to a friend")[0]
    assert you > plain > said > 0 and plain > negated > 0
    assert g.features("not today. a moron")[0] == plain            # a negation ends with its clause
    assert g.features("Marmoron oxymoron. Idiotic?")[0] == 0        # inside other words
    assert g.features("MORON!! trash")[3] > g.features("moron")[3]
    assert g.features(None) == g.features("") == [0.0] * 4


def test_composition_equals_running_the_machines_in_turn():
    import itertools
    composed = tox.Composed(tox.negation, tox.reported, tox.target)
    for symbols in itertools.product("INRYw", repeat=4):
        state, got = composed.start, []
        for s in symbols:
            state, out = composed.step(state, s)
            got.append(out)
        tape = list(symbols)
        for machine in (tox.negation, tox.reported, tox.target):
            q, new = 0, []
            for s in tape:
                q, out = machine(q, s)
                new.append(out)
            tape = new
        assert got == tape


def test_learns_stems_and_skips_held_out(spark):
    ends = ["ab", "ol", "ir", "unt", "ez", "om", "ax", "yd"]
    texts, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = [f"q{chr(97 + i % 26)}{chr(97 + i // 26)}", "calm", "words"]
        words += [f"zorg{ends[i // 4 % 8]}", f"zorg{ends[(i // 4 + 3) % 8]}"] if toxic else ["zonal"]
        texts.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, lab = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = tox.training_rows(docs, lab).collect()
    held = {t for i, t in texts if zlib.crc32(str(i).encode()) % 5 == 0}
    assert rows and not held & {r.text for r in rows}
    g = tox.learn(docs, lab)
    assert "zorg" in g.stems
    assert g.score(g.features("calm zorgnew zorgother")) > 0.5 > g.score(g.features("calm words"))


def test_held_out_accuracy_on_documents(spark):
    got = tox.op7_toxicity(spark, SF).toPandas()
    docs = read_table(spark, SF, "documents").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    both = got.merge(read_table(spark, SF, "labels").toPandas(), on="doc_id")
    test = both[both.held_out]
    assert auc(test.score.to_numpy(), test.toxic.to_numpy()) > 0.8
    assert test[test.toxic == 0].predicted.mean() < 0.02


def test_nulls_empty_tables_and_clashing_names(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("score", T.StringType()), T.StructField("toxic", T.StringType())])
    rows = [(None, None, "s", "t"), (1, "", "s", "t"), (1, "you idiot, you moron, you scum", "s", "t"), (2, "x" * 300_000, "s", "t")]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    g = tox.learn(docs, labels)
    got = [tuple(np.round(r, 6)) for r in docs.select(tox.score_udf(g)("text"), tox.score_udf(g)("text")).collect()]
    assert got[0] == got[1] == got[3] and got[2][0] > 0.5 > got[0][0]
    assert tox.learn(docs.limit(0), labels).words


def test_only_near_copies_are_thinned(spark):
    common = "the of and to in is it for on with as at by from this that are was be have or an not but they we his her she you".split()
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5][:60]
    rng = np.random.default_rng(1)
    texts = {i: " ".join(rng.permutation([*common, *(f"own{i}x{k}" for k in range(6))])) for i in ids}
    long = " ".join(f"w{k * k % 997}" for k in range(400))
    copies = {i: t for i, t in zip((100, 101, 102, 103, 104), (long, long, "  " + long.upper(), long, long.replace(" ", "  ")), strict=True)}
    docs = spark.createDataFrame([*texts.items(), *copies.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in (*texts, *copies)], "doc_id long, toxic int")
    got = [r.text for r in tox.training_rows(docs, labels).collect()]
    assert set(texts.values()) <= set(got)                 # texts that share common words all stay
    assert len(got) == len(texts) + 1


def test_composed_clauses_decide_not_words():
    g = tox.default_grammar()
    score = lambda t: g.score(g.features(t))
    assert score("I will kill you.") > score("They kill time.") and score("I will kill you.") > 2 * score("A kill switch.")
    assert score("You are an idiot.") > score("The word idiot is old.") and score("Idiots like you: moron.") > score("The word moron is old.")
    for text in ("nobody called you stupid, worthless scum", "You are not an idiot, not a moron, not scum.", "He said you were an idiot, a moron and scum."):
        assert score(text) < 0.5 and g.features(text)[2:] == [0.0, 0.0], text
    # marks multiply: aimed and reported is less than aimed, negated as well is less than that
    aimed, both, all_three = (tox.factor(s) for s in ("I+you", "I+said+you", "I+not+said+you"))
    assert aimed > tox.BARE["I"] > both > all_three > 0


def plain_features(g, text):
    """The features by running every machine over whole clauses, one after the other."""
    import math
    import re
    scores, matches, terms = [], 0.0, set()
    for clause in re.split(r"[.!?;\n]+", (text or "").lower()):
        words = re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", clause)
        symbols, weights, names = zip(*map(g.lexical, words), strict=True) if words else ((), (), ())
        for machine, back in ((tox.negation, False), (tox.reported, False), (tox.target, False), (tox.target_after, True)):
            state, out = 0, []
            for s in reversed(symbols) if back else symbols:
                state, o = machine(state, s)
                out.append(o)
            symbols = out[::-1] if back else out
        found = [(s, w, n) for s, w, n in zip(symbols, weights, names, strict=True) if s[0] in "IT"]
        scores.append(sum(w * tox.factor(s) for s, w, _ in found))
        kept = [(s, n) for s, _, n in found if not {"not", "said"} & set(s.split("+"))]
        matches += sum(min(1.0, tox.factor(s)) for s, _ in kept)
        terms |= {n for _, n in kept}
    return [math.log1p(sum(scores)), math.log1p(max(scores, default=0.0)), math.log1p(matches), math.log1p(len(terms))]


def test_query_equals_a_plain_run_of_the_machines(spark):
    docs = read_table(spark, SF, "documents")
    grammar = tox.learn(docs, read_table(spark, SF, "labels"))
    got = {r.doc_id: r.score for r in tox.op7_toxicity(spark, SF).collect()}
    for r in docs.collect():
        assert abs(got[r.doc_id] - grammar.score(plain_features(grammar, r.text))) < 1e-9
    odd = ["you idiot! he said moron; not you, scum", "Kill you kill them KILL", "don't say idiot-like things to you's", "scum", "moron you" * 50]
    for text in odd:
        assert np.allclose(grammar.features(text), plain_features(grammar, text))


def test_an_id_with_different_labels_teaches_nothing(spark):
    ids = [i for i in range(20) if zlib.crc32(str(i).encode()) % 5][:3]
    docs = spark.createDataFrame([(i, f"text number {i} of its own") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(ids[0], 0), (ids[0], 1), (ids[1], 1), (ids[1], 1), (ids[2], None)], "doc_id long, toxic int")
    assert [(r.text, r.toxic) for r in tox.training_rows(docs, labels).collect()] == [(f"text number {ids[1]} of its own", 1)]
