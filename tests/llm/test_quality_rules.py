import random
import re

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import quality_rules
from plumbline.llm.quality_rules import STATISTICS, DecisionList, Literal

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, kept boolean, m string, n_words int"


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def texts():
    rng = random.Random(5)
    out = [None, "", " ", "\n\n", "one", "one two", "a a a", "a a a a", "a b c a b", "a b c a b c", "\t lead and trail \r\n", "é é é é", " x y z", "#*$%&|<> \U0001f600", "a\x00b c"]
    for _ in range(150):
        words = [rng.choice(["a", "b", "c", "#", "dé", "e" * rng.randrange(1, 9)]) for _ in range(rng.randrange(0, 120))]
        out.append("".join(w + rng.choice([" ", " ", "  ", "\n", "\t", "\x0b"]) for w in words))
    long = " ".join(f"w{i}" for i in range(40_000))
    return [*out, long, long + " w7 w8 w9", "same line\n" * 3000, out[20], out[20]]


def test_counts_against_plain_python(spark):
    rows = list(enumerate(texts()))
    frame = spark.createDataFrame([(i, t, None, "x", 0) for i, t in rows] + [(None, "x", True, None, None)], DOCS).repartition(4)
    found = quality_rules.judged(frame, DecisionList())
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == len(rows) + 1
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(t), (i, t)
        assert r.kept == (not r.base_failed)


def test_verdicts_follow_the_first_rule_that_holds(spark):
    rules = DecisionList([((Literal("n_words", False, 60), Literal("symbol_share", True, 0.1)), 0), ((Literal("n_words", False, 60),), 1), ((Literal("n_words", True, 100),), 0)], 1)
    rows = [(1, "a$ " * 55), (2, "ab " * 55), (3, "ab " * 150), (4, "ab " * 80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", rules.verdict(quality_rules.measured(F.col("text"))).alias("v"))
    assert {r.doc_id: r.v for r in frame.collect()} == {1: False, 2: True, 3: False, 4: True}
    assert rules.shown()[0] == "WHEN n_words <= 60 AND symbol_share > 0.1 THEN reject" and rules.shown()[-1] == "ELSE keep"


def covered(rules, bins):
    out = np.full(len(bins), rules.default)
    done = np.zeros(len(bins), dtype=bool)
    for literals, label in rules.rules:
        met = ~done
        for x in literals:
            met &= x.covers(bins)
        out[met], done = label, done | met
    return out


def test_covering_finds_planted_conjunctions():
    rng = np.random.default_rng(4)
    bins = rng.integers(0, 10, size=(3000, len(STATISTICS)))
    bad = (bins[:, 1] > 6) & (bins[:, 2] <= 3) | (bins[:, 3] > 8)
    noisy = bad ^ (rng.random(3000) < 0.02)
    literals = [Literal(n, above, float(t), t) for n in STATISTICS for t in range(10) for above in (True, False)]
    rules = quality_rules.learned(bins, (~noisy).astype(int), np.ones(3000), rng.random(3000) < 1 / 3, literals)
    assert (covered(rules, bins) == ~bad).mean() > 0.97 and all(len(literals) <= 4 for literals, _ in rules.rules)


def test_pruning_drops_what_the_held_back_rows_do_not_need():
    bins = np.zeros((40, len(STATISTICS)), dtype=int)
    bins[:20, 0] = 1
    bins[:, 1] = np.arange(40) % 2
    target = bins[:, 0] == 1
    rule = [Literal(STATISTICS[0], True, 0.0, 0), Literal(STATISTICS[1], True, 0.0, 0)]
    assert quality_rules.pruned(rule, bins, target, np.ones(40)) == rule[:1]


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(i, " ".join(f"word{i}x{k}" for k in range(60))) for i in range(5)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    rules = quality_rules.train(docs, labels)
    assert rules.rules == [] and all(r.kept for r in quality_rules.judged(docs, rules).collect())
    assert quality_rules.judged(docs.limit(0), rules).collect() == []


def test_held_out_labels_and_no_python_in_the_plan(spark):
    sf = "/root/testdata/sf0.01"
    from plumbline.llm.queries import op13_quality_decision_list

    found = op13_quality_decision_list(spark, sf)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in found.collect() if r.doc_id in labels and not r.base_failed]
    assert sum(r.kept == bool(labels[r.doc_id]) for r in rows) >= 0.97 * len(rows)
