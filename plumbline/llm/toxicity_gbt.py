"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a learned lexicon (words, and word stems
of five characters) in hits per word, its strongest hits, hits near second-person
words, hits among words with look-alike characters undone, capitals, stops,
exclamation marks, symbols, digits and digits or symbols inside words.

The lexicon is learned from the training rows: words and stems far more frequent
in toxic documents. So that trees do not see features made from their own labels,
the rows are split in two folds; each fold's features use the other's lexicon,
and the calibration uses margins of trees grown on the other fold. The final
trees see both folds and the final lexicon. At most ``max_documents`` labelled
documents are fitted on and at most ``max_terms`` terms kept; all documents are
scored whole.

Defined cases: null text is empty and has zero features; without labels of both
kinds every score is the share of label 1 (0.5 without labels); repeated rows are
scored each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import held_out, kept_by, shared_dir, training_sample
from plumbline.llm.textstats import CLASSES, DIGIT, LOWER, STOP, SYMBOL, UPPER, class_table, codes_of, ids_of
from plumbline.llm.tokens import chunks

STEMS = (5,)
EDGES = ".,;:!?()[]{}\"'*_-#%&$|<>«»¡¿"
LOOKALIKES = str.maketrans("013457@$!|", "oieastasil")
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner euch euer ihr sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
INSIDE = re.compile(r"[^\W\d_][\d@$!*|]+[^\W\d_]")
FEATURES = 16


def words_of(text: Column) -> Column:
    """Distinct lower-case words without edging stops."""
    edge = r"[.,;:!?()\[\]{}\"'*_\-#%&$|<>«»¡¿]+"
    bare = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, f"^{edge}|{edge}$", ""))
    return F.array_distinct(F.filter(bare, lambda w: w != ""))


@dataclass
class Lexicon:
    words: dict[str, float]
    stems: dict[str, float]


def learn_lexicon(sample: DataFrame, least: int = 3, max_terms: int = 4000) -> list:
    """Rows (term, stem, and for each fold documents with it: toxic, clean) of promising terms; at most ``max_terms``."""
    words = sample.select("fold", "y", words_of(F.col("text")).alias("w"))
    stems = F.array_distinct(F.concat(*[F.transform(F.filter("w", lambda w, n=n: F.length(w) > n), lambda w, n=n: F.substring(w, 1, n)) for n in STEMS]))
    terms = words.select("fold", "y", F.explode("w").alias("term"), F.lit(False).alias("stem")).union(words.select("fold", "y", F.explode(stems), F.lit(True)))
    count = lambda fold, y: F.count_if((F.col("fold") == fold) & (F.col("y") == y))
    counted = terms.groupBy("term", "stem").agg(count(0, 1).alias("t0"), count(0, 0).alias("c0"), count(1, 1).alias("t1"), count(1, 0).alias("c1"))
    toxic, clean = F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1")
    return counted.where((toxic >= least) & (toxic > clean)).orderBy(F.desc(toxic / (clean + 1)), "term", "stem").limit(max_terms).collect()


def lexicon(rows: list, folds: tuple[int, ...], toxic_share: float, least: int = 3, ratio: float = 15.0) -> Lexicon:
    words, stems = {}, {}
    prior = toxic_share / max(1 - toxic_share, 1e-6)
    for r in rows:
        t, c = sum(r[f"t{f}"] for f in folds), sum(r[f"c{f}"] for f in folds)
        odds = (t / (c + 0.5)) / max(prior, 1e-6)
        if t >= least and odds >= ratio:
            (stems if r.stem else words)[r.term] = float(np.log(odds))
    return Lexicon(words, stems)


def features(texts: list[str], lex: Lexicon) -> np.ndarray:
    size = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.zeros((len(texts), FEATURES))
    codes = codes_of("".join(texts))
    of = np.repeat(np.arange(len(texts)), size)
    n = np.bincount(of * CLASSES + class_table()[codes], minlength=len(texts) * CLASSES).reshape(-1, CLASSES)
    chars = np.maximum(size, 1)
    out[:, 0] = np.log1p(size)
    out[:, 1] = n[:, UPPER] / np.maximum(n[:, UPPER] + n[:, LOWER], 1)
    out[:, 2] = n[:, STOP] / chars
    out[:, 3] = n[:, SYMBOL] / chars
    out[:, 4] = n[:, DIGIT] / chars
    out[:, 5] = np.bincount(of[codes == ord("!")], minlength=len(texts)) / chars
    words_in, stems_in = lex.words, lex.stems
    for i, text in enumerate(texts):
        words = [w.strip(EDGES) for w in text.lower().split()]
        many = max(len(words), 1)
        distinct = set(words)
        hit = {w: words_in[w] for w in distinct & words_in.keys()}
        stem = {}
        for n in STEMS:
            stem.update((w, max(stem.get(w, 0.0), stems_in[w[:n]])) for w in distinct if w[:n] in stems_in and len(w) > n)
        places = [p for p, w in enumerate(words) if w in hit or w in stem] if hit or stem else []
        out[i, 6] = sum(words[p] in hit for p in places) / many
        out[i, 7] = sum(words[p] in stem for p in places) / many
        out[i, 8] = max(hit.values(), default=0.0)
        out[i, 9] = max(stem.values(), default=0.0)
        out[i, 10] = np.log1p(len(places))
        out[i, 11] = np.log1p(len(hit) + len(stem))
        if places:
            near = sum(not SECOND_PERSON.isdisjoint(words[max(0, p - 5) : p + 6]) for p in places)
            out[i, 12] = near / len(places)
        odd = INSIDE.findall(text)
        out[i, 13] = len(odd) / many
        if odd:
            plain = [w.translate(LOOKALIKES) for w in distinct if INSIDE.search(w)]
            out[i, 14] = np.log1p(sum(w in words_in or any(w[:n] in stems_in for n in STEMS) for w in plain))
        out[i, 15] = sum(w in SECOND_PERSON for w in words) / many
    return out


@dataclass
class Trees:
    """Complete trees: per level node arrays of feature and cut; leaves of log-odds."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            total += leaf[node - (2**depth - 1)]
        return total


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, l2: float = 1.0) -> Trees:
    """Second-order boosting on logistic loss with quantile histograms."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    # rare features are mostly zero; a cut just above it is always on offer
    cuts = [np.unique(np.append(c, 0.0)) for c in cuts]
    place = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    width = max(len(c) for c in cuts) + 1
    margin = np.full(len(y), base)
    inner, leaves = 2**depth - 1, 2**depth
    all_f, all_c, all_l = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), dtype=np.int64)
        f_of, c_of = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-6)
            split = np.full(count, width)
            for j in range(x.shape[1]):
                key = (node - first) * width + place[:, j]
                left_g = np.bincount(key, g, count * width).reshape(count, width).cumsum(1)
                left_h = np.bincount(key, h, count * width).reshape(count, width).cumsum(1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                gain = left_g**2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2) - all_g**2 / (all_h + l2)
                gain[:, len(cuts[j]) :] = -1
                at = gain.argmax(1)
                top = gain[np.arange(count), at]
                for k in np.flatnonzero(top > best):
                    best[k], split[k] = top[k], at[k]
                    f_of[first + k], c_of[first + k] = j, cuts[j][at[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), f_of[node]] > c_of[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + l2)
        margin += leaf[at]
        all_f.append(f_of)
        all_c.append(c_of)
        all_l.append(leaf)
    return Trees(base, np.array(all_f), np.array(all_c), np.array(all_l))


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: margins and non-decreasing shares, with one pseudo-count of each label a block."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, v in zip(margin[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(m), float(m)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, high = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = high
    at = np.array([b[2 + e] for b in blocks for e in (0, 1)])
    share = np.maximum.accumulate(np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks for _ in (0, 1)]))
    return at, share


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    at: np.ndarray
    share: np.ndarray
    constant: float = 0.5

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.constant)
        margin = self.trees.margin(features(texts, self.lexicon))
        # a little of the raw probability keeps the order inside a calibrated step
        return 0.98 * np.interp(margin, self.at, self.share) + 0.02 / (1 + np.exp(-margin))


def train(documents: DataFrame, labels: DataFrame, max_documents: int = 6000, max_terms: int = 4000) -> Model:
    shared_dir(documents.sparkSession)
    sample = training_sample(documents, labels, "toxic", max_documents).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(max_documents)
    sample = sample.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).cast("int")).checkpoint()
    counts = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    if len(counts) < 2:
        return Model(Lexicon({}, {}), None, np.zeros(0), np.zeros(0), share if counts else 0.5)
    rows = learn_lexicon(sample, max_terms=max_terms)
    by_fold = [lexicon(rows, (1 - f,), share) for f in (0, 1)]
    whole = lexicon(rows, (0, 1), share)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f in (0, 1):
                own = batch[batch["fold"] == f]
                texts = own["text"].tolist()
                for a, b in chunks(texts):
                    x = features(texts[a:b], by_fold[f])
                    yield pd.DataFrame({"fold": f, "y": own["y"].iloc[a:b].to_numpy(), "x": list(x)})

    made = sample.select("text", "y", "fold").mapInPandas(each, "fold int, y int, x array<double>").toPandas()
    x, y, fold = np.vstack(made["x"].to_numpy()), made["y"].to_numpy().astype(float), made["fold"].to_numpy()
    margin = np.zeros(len(y))
    for f in (0, 1):
        if (fold == f).any():
            other = fold != f if (fold != f).any() else fold == f
            margin[fold == f] = grow(x[other], y[other]).margin(x[fold == f])
    at, shares = isotonic(margin, y)
    return Model(whole, grow(x, y), at, shares)


def scores(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every whole text."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            score = [model.score(texts[a:b]) for a, b in chunks(texts)]
            yield pd.DataFrame({"doc_id": ids_of(batch["doc_id"]), "score": np.concatenate(score) if score else []})

    return documents.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(each, "doc_id long, score double")


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, max_documents: int = 6000) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = scores(documents, train(documents, labels, max_documents))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filtered(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents, all their columns, that stay under the threshold."""
    return kept_by(documents, lambda texts: model.score(texts) < threshold)
