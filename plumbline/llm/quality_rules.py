"""Quality rules: a fixed base and a decision list learned by sequential covering, in DataFrame functions only.

Every text gets statistics: words, characters in words, symbols, repeated lines,
words in repeated windows, and shares of them. The base rejects texts of too few
words or too much repetition. The rest is judged by an ordered list of
conjunctions of thresholds, learned from labelled rows.

Learning: Spark takes thresholds of each statistic (approximate percentiles of
good and of bad rows, moved halfway to the next value that occurs), replaces values by the numbers of thresholds below them, and counts rows alike in
all of those, in the label and in a third held back by hash. The driver gets the
counts, at most ``max_rows`` rows. A rule for either class grows by the literal of
most information gain on two thirds, and loses trailing literals as long as the
held-back third does not get worse. The better rule of both classes goes on the list, what
it covers goes from both parts, and so on until no rule is precise enough; the
rest is the majority's. The list becomes one Spark conditional expression, first
rule first (``DecisionList.verdict``), and can be read (``DecisionList.shown``).

Repeated windows are found without pairs: hashes of the windows are sorted with
their places, neighbours alike are candidates, and those are sorted again by
their words. Work grows with n log n for a text of n words, memory with n.

Defined cases: null text has no words; texts without words fail the base; null
statistics do not occur; conflicting labels of an id are no labels; without
labels everything the base passes is kept; repeated rows are judged each; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import let, stored, training_sample

SPACES = " \t\n\x0b\x0c\r"
GAP, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 3
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules may ask about.
STATISTICS = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "words_per_line", "digit_share", "capital_share", "letter_share", "stop_share", "longest_word")


def words_of(text: Column) -> Column:
    """Runs without white space, in order."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.split(bare, GAP)).otherwise(F.array().cast("array<string>"))


def _neighbours(items: Column, name: str) -> Column:
    """Items of a sorted array whose field equals that of the one before or after."""
    return let(items, lambda a: F.filter(a, lambda x, i: (F.get(a, i - 1)[name] == x[name]) | (F.get(a, i + 1)[name] == x[name])))


def repeated_words(words: Column) -> Column:
    """Words that lie in windows found twice or more in ``words``, the first window included; a word counts once."""

    def window(w: Column, i: Column) -> list[Column]:
        return [F.get(w, i + k) for k in range(WINDOW)]

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(places, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*window(w, i)))

        def sought(h: Column) -> Column:
            placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            alike = F.transform(_neighbours(placed, "h"), lambda x: F.struct(F.concat_ws(" ", *window(w, x["i"])).alias("t"), x["i"].alias("i")))
            places = F.sort_array(F.transform(_neighbours(F.sort_array(alike), "t"), lambda x: x["i"]))
            return F.when(F.size(F.array_distinct(h)) < F.size(h), let(places, covered)).otherwise(0)

        return F.when(F.size(w) > WINDOW, let(hashes, sought)).otherwise(0)

    return let(words, of)


def measured(text: Column) -> Column:
    """Struct of counts of a text."""
    text = F.coalesce(text, F.lit(""))
    many = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))

    def of(w: Column, rows: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            many(SYMBOLS).alias("n_symbols"),
            (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            F.size(rows).cast("long").alias("n_lines"),
            many("[0-9]").alias("n_digits"),
            many(r"\p{Lu}").alias("n_capitals"),
            many(r"\p{L}").alias("n_letters"),
            many(r"[.!?](?=[\x20\x09-\x0D]|$)").alias("n_stops"),
            F.coalesce(F.array_max(F.transform(w, lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest"),
        )

    return let(words_of(text), lambda w: let(lines, lambda rows: of(w, rows)))


def statistics(m: Column) -> dict[str, Column]:
    """Values of STATISTICS from a struct of counts, none of them null."""
    share = lambda a, b: F.coalesce(m[a] / F.greatest(m[b], F.lit(1)).cast("double"), F.lit(0.0))
    values = (m["n_words"].cast("double"), share("word_chars", "n_words"), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_distinct", "n_words"))
    values += (share("n_words", "n_lines"), share("n_digits", "word_chars"), share("n_capitals", "n_letters"), share("n_letters", "word_chars"), share("n_stops", "n_words"), m["longest"].cast("double"))
    return dict(zip(STATISTICS, values, strict=True))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


@dataclass(frozen=True)
class Literal:
    """A statistic above (or not above) a threshold."""

    name: str
    above: bool
    threshold: float
    place: int = 0  # of the threshold among those of its statistic

    def holds(self, values: dict[str, Column]) -> Column:
        return values[self.name] > self.threshold if self.above else values[self.name] <= self.threshold

    def covers(self, bins: np.ndarray) -> np.ndarray:
        own = bins[:, STATISTICS.index(self.name)]
        return own > self.place if self.above else own <= self.place


@dataclass
class DecisionList:
    """Ordered rules (literals, verdict); the default answers for what no rule covers. Verdict 1 keeps."""

    rules: list[tuple[tuple[Literal, ...], int]] = field(default_factory=list)
    default: int = 1

    def verdict(self, m: Column) -> Column:
        values = statistics(m)
        out = None
        for literals, label in self.rules:
            met = F.lit(True)
            for x in literals:
                met = met & x.holds(values)
            out = F.when(met, F.lit(bool(label))) if out is None else out.when(met, F.lit(bool(label)))
        return F.lit(bool(self.default)) if out is None else out.otherwise(F.lit(bool(self.default)))

    def shown(self) -> list[str]:
        """The list as text, one rule a line."""
        said = [" AND ".join(f"{x.name} {'>' if x.above else '<='} {x.threshold:g}" for x in literals) + f" THEN {'keep' if label else 'reject'}" for literals, label in self.rules]
        return [f"WHEN {s}" for s in said] + [f"ELSE {'keep' if self.default else 'reject'}"]


def gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information that a literal gains for the p positives it leaves, of p0 and n0 before it."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -math.inf


def grown(bins: np.ndarray, target: np.ndarray, count: np.ndarray, literals: list[Literal], longest: int) -> list[Literal]:
    """A conjunction by greedy gain, until it covers one class alone, nothing is gained or it is ``longest`` long."""
    rule: list[Literal] = []
    covered = np.ones(len(bins), dtype=bool)
    masks = [x.covers(bins) for x in literals]
    while len(rule) < longest:
        p0, n0 = count[covered & target].sum(), count[covered & ~target].sum()
        if not p0 or not n0:
            break
        gains = [gain(count[covered & target & m].sum(), count[covered & ~target & m].sum(), p0, n0) for m in masks]
        best = int(np.argmax(gains))
        if gains[best] <= 1e-9:
            break
        rule.append(literals[best])
        covered &= masks[best]
    return rule


def precision(rule: list[Literal], bins: np.ndarray, target: np.ndarray, count: np.ndarray) -> tuple[float, float]:
    """Laplace's precision and the rows covered."""
    met = np.ones(len(bins), dtype=bool)
    for x in rule:
        met &= x.covers(bins)
    p, n = count[met & target].sum(), count[met & ~target].sum()
    return float((p + 1) / (p + n + 2)), float(p + n)


def pruned(rule: list[Literal], bins: np.ndarray, target: np.ndarray, count: np.ndarray) -> list[Literal]:
    """The rule without those trailing literals whose loss does not make it less precise on rows that it was not grown on."""
    best = rule
    while len(best) > 1 and precision(best[:-1], bins, target, count)[0] >= precision(best, bins, target, count)[0]:
        best = best[:-1]
    return best


def learned(bins: np.ndarray, label: np.ndarray, count: np.ndarray, held: np.ndarray, literals: list[Literal], longest: int = 4, least: float = 0.85, rules: int = 24) -> DecisionList:
    """Sequential covering over counted rows; ``held`` marks those that prune and rate rules."""
    out, left = DecisionList(), np.ones(len(bins), dtype=bool)
    while left.any() and len(out.rules) < rules:
        found = []
        for wanted in (0, 1):
            target = label == wanted
            grow, check = left & ~held, left & held
            if not count[grow & target].sum():
                continue
            rule = grown(bins[grow], target[grow], count[grow], literals, longest)
            rule = pruned(rule, bins[check], target[check], count[check]) if rule else []
            if rule:
                found.append((*precision(rule, bins[left], target[left], count[left]), precision(rule, bins[check], target[check], count[check])[0], wanted, tuple(rule)))
        found = [f for f in found if f[0] >= least and f[2] >= 0.5]
        if not found:
            break
        _, _, _, wanted, rule = max(found, key=lambda f: (round(f[0], 3), f[1]))
        out.rules.append((rule, wanted))
        met = left.copy()
        for x in rule:
            met &= x.covers(bins)
        left &= ~met
    rest = left if left.any() else np.ones(len(bins), dtype=bool)
    out.default = int(count[rest & (label == 1)].sum() >= count[rest & (label == 0)].sum())
    return out


def cuts_of(known: DataFrame, cuts: int) -> dict[str, list[float]]:
    """Thresholds of each statistic: approximate percentiles of either label's rows, each moved halfway to the next value that occurs."""
    places = [i / (cuts + 1) for i in range(1, cuts + 1)]
    by_label = known.groupBy("y").agg(*[F.percentile_approx(name, places, 10_000).alias(name) for name in STATISTICS]).collect()
    at = {name: sorted({v for r in by_label for v in r[name] or []}) for name in STATISTICS}
    after = {(name, t): F.min(F.when(F.col(name) > t, F.col(name))) for name in STATISTICS for t in at[name]}
    found = known.agg(*[c.alias(f"c{i}") for i, c in enumerate(after.values())]).first() if after else ()
    out: dict[str, list[float]] = {name: [] for name in STATISTICS}
    for (name, t), following in zip(after, found, strict=True):
        if following is not None:
            out[name].append((t + following) / 2)
    return out


def train(documents: DataFrame, labels: DataFrame, max_rows: int = 4000, cuts: int = 12) -> DecisionList:
    """The decision list of at most ``max_rows`` labelled training rows, of those that the base passes."""
    # stored, or the statistics would be taken of every row before the join
    sample = stored(training_sample(documents, labels, "quality", max_rows), "labelled")
    m = sample.select("doc_id", "y", measured(F.col("text")).alias("m")).where(~base_failed(F.col("m")))
    known = stored(m.select("y", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held"), *[v.alias(k) for k, v in statistics(F.col("m")).items()]), "statistics")
    cut = cuts_of(known, cuts)
    bin_of = lambda name: sum([(F.col(name) > t).cast("int") for t in cut[name]], F.lit(0)).alias(name)
    rows = known.select("y", "held", *[bin_of(name) for name in STATISTICS]).groupBy("y", "held", *STATISTICS).agg(F.count("*").alias("n")).collect()
    if not rows:
        return DecisionList()
    rows.sort(key=tuple)
    bins = np.array([[r[name] for name in STATISTICS] for r in rows])
    literals = [Literal(name, above, float(t), i) for name in STATISTICS for i, t in enumerate(cut[name]) for above in (True, False)]
    column = lambda name, kind: np.array([r[name] for r in rows], dtype=kind)
    return learned(bins, column("y", np.int64), column("n", np.float64), column("held", bool), literals)


def judged(documents: DataFrame, rules: DecisionList) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every whole text."""
    m = F.col("m")
    return documents.select("doc_id", measured(F.col("text")).alias("m")).select(
        "doc_id", *[m[c].alias(c) for c in COUNTS], base_failed(m).alias("base_failed"), (~base_failed(m) & rules.verdict(m)).alias("kept")
    )
