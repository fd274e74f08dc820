"""Quality by a linear-chain conditional random field over lines.

Each line of a text is labelled good or bad. Emissions are linear in features of
the line and of both neighbouring lines, transitions are a 2 x 2 table. Forward
and backward passes give every line's marginal; their mean weighted by line
length, calibrated by a two-parameter logistic map, is the document's score.

Documents carry the labels, lines do not: training starts with every line of a
bad document bad, then lines of bad documents that the first field finds good
are relabelled (one line at least stays bad) and the field is fitted again. It
is fitted on at most ``max_documents`` labelled documents of the training rows
with at most ``max_lines`` lines each; all documents are scored whole.

Defined cases: null text is empty, and an empty text is one empty line; without
labels of both kinds every score is the share of label 1 (0.5 without labels);
repeated rows are scored each; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import held_out, kept_by, training_sample
from plumbline.llm.textstats import LINE_FEATURES, ids_of, line_features
from plumbline.llm.tokens import chunks


def with_neighbours(lines: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """A line's features, those of the lines before and after it in its text, and whether there are such."""
    first = np.zeros(len(lines), dtype=bool)
    first[np.cumsum(per_text) - per_text] = True
    last = np.zeros(len(lines), dtype=bool)
    last[np.cumsum(per_text) - 1] = True
    before, after = np.roll(lines, 1, axis=0), np.roll(lines, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.hstack([lines, before, after, first[:, None], last[:, None]])


def marginals(emission: np.ndarray, transition: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, expected transitions, log partition; emission is the score of good, bad scores 0."""
    starts = np.cumsum(per_text) - per_text
    order = np.argsort(-per_text, kind="stable")
    size, start = per_text[order], starts[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), side="left")  # texts with more than t lines
    forward = np.zeros((len(emission), 2))
    back = np.zeros((len(emission), 2))
    local = np.column_stack([np.zeros(len(emission)), emission])
    for t in range(steps):
        at = start[: active[t]] + t
        if t == 0:
            forward[at] = local[at]
        else:
            p = forward[at - 1]
            forward[at] = local[at] + np.logaddexp(p[:, :1] + transition[0], p[:, 1:] + transition[1])
    for t in range(steps - 2, -1, -1):
        at = start[: active[t + 1]] + t
        n = back[at + 1] + local[at + 1]
        back[at] = np.logaddexp(transition[:, 0] + n[:, :1], transition[:, 1] + n[:, 1:])
    end = starts + per_text - 1
    z = np.logaddexp(forward[end, 0], forward[end, 1])
    z_line = np.repeat(z, per_text)
    good = np.exp(forward[:, 1] + back[:, 1] - z_line)
    inner = np.ones(len(emission), dtype=bool)
    inner[end] = False
    at = np.flatnonzero(inner)
    pair = forward[at][:, :, None] + transition[None] + (local + back)[at + 1][:, None, :] - z_line[at][:, None, None]
    return np.clip(good, 0, 1), np.exp(pair).sum(0), float(z.sum())


@dataclass
class Field:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    transition: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def emission(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias

    def raw(self, x: np.ndarray, length: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of each text, as log-odds."""
        good, _, _ = marginals(self.emission(x), self.transition, per_text)
        text = np.repeat(np.arange(len(per_text)), per_text)
        weight = length + 1
        mean = np.bincount(text, weight * good, len(per_text)) / np.bincount(text, weight, len(per_text))
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        lines, length, per_text = line_features(texts)
        return 1 / (1 + np.exp(-(self.slope * self.raw(with_neighbours(lines, per_text), length, per_text) + self.shift)))


def _adam(gradient, start: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, rounds + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(lines: list[np.ndarray], lengths: list[np.ndarray], labels: np.ndarray, rounds: int = 150, l2: float = 1e-3) -> Field:
    per_text = np.array([len(x) for x in lines], dtype=np.int64)
    x = with_neighbours(np.vstack(lines), per_text)
    length = np.concatenate(lengths)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8)
    n, d = z.shape
    truth = np.repeat(labels, per_text).astype(np.float64)
    of_bad = truth == 0
    text = np.repeat(np.arange(len(per_text)), per_text)
    inner = np.ones(n, dtype=bool)
    inner[np.cumsum(per_text) - 1] = False
    at = np.flatnonzero(inner)
    start = np.zeros(d + 5)
    field = None
    for _ in range(2):
        seen = np.zeros((2, 2))
        np.add.at(seen, (truth[at].astype(int), truth[at + 1].astype(int)), 1)

        def gradient(w, truth=truth, seen=seen):
            good, pairs, _ = marginals(z @ w[:d] + w[d], w[d + 1 :].reshape(2, 2), per_text)
            miss = (good - truth) / n
            return np.concatenate([z.T @ miss, [miss.sum()], ((pairs - seen) / n).ravel()]) + l2 * w

        start = _adam(gradient, start, rounds, 0.05)
        field = Field(mean, scale, start[:d], float(start[d]), start[d + 1 :].reshape(2, 2))
        own = z @ field.weight + field.bias
        worst = np.full(len(per_text), np.inf)
        np.minimum.at(worst, text, own)
        truth = np.where(of_bad & (own > 2) & (own > worst[text]), 1.0, np.where(of_bad, 0.0, 1.0))
    raw = field.raw(x, length, per_text)
    y = labels.astype(np.float64)

    def calibration(w):
        miss = 1 / (1 + np.exp(-(w[0] * raw + w[1]))) - y
        return np.array([(miss * raw).mean() + 1e-3 * w[0], miss.mean() + 1e-3 * w[1]])

    field.slope, field.shift = (float(v) for v in _adam(calibration, np.array([1.0, 0.0]), 400, 0.05))
    field.slope = max(field.slope, 1e-3)
    return field


def train(documents: DataFrame, labels: DataFrame, max_documents: int = 4000, max_lines: int = 2000) -> Field:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in chunks(texts):
                x, length, per_text = line_features(texts[a:b])
                ends = np.cumsum(per_text)
                rows = [(int(y), x[e - n : e].astype("<f4").tobytes(), length[e - n : e].astype("<f4").tobytes()) for y, e, n in zip(batch["y"].iloc[a:b], ends, per_text, strict=True)]
                yield pd.DataFrame(rows, columns=["y", "x", "length"])

    sample = training_sample(documents, labels, "quality", max_documents).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(max_documents)
    sample = sample.where(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) < max_lines)
    rows = sample.select("text", "y").mapInPandas(each, "y int, x binary, length binary").collect()
    y = np.array([r.y for r in rows], dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return Field(*[np.zeros(0)] * 3, 0.0, np.zeros((2, 2)), constant=float(y.mean()) if len(y) else 0.5)
    lines = [np.frombuffer(r.x, "<f4").reshape(-1, LINE_FEATURES).astype(np.float64) for r in rows]
    return fit(lines, [np.frombuffer(r.length, "<f4").astype(np.float64) for r in rows], y)


def scores(documents: DataFrame, field: Field) -> DataFrame:
    """doc_id, score of every whole text."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            score = [field.score(texts[a:b]) for a, b in chunks(texts)]
            yield pd.DataFrame({"doc_id": ids_of(batch["doc_id"]), "score": np.concatenate(score) if score else []})

    return documents.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(each, "doc_id long, score double")


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, max_documents: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = scores(documents, train(documents, labels, max_documents))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filtered(documents: DataFrame, field: Field, threshold: float = 0.3) -> DataFrame:
    """The documents, all their columns, that reach the threshold."""
    return kept_by(documents, lambda texts: field.score(texts) >= threshold)
