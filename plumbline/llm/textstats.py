"""Counts of character classes and words, for whole batches of texts at once."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd

LOWER, UPPER, LETTER, DIGIT, SPACE, STOP, SYMBOL, OTHER, NEWLINE = range(9)
CLASSES = 9
_table: list[np.ndarray] = []


def class_table() -> np.ndarray:
    if not _table:
        table = np.full(0x110000, OTHER, dtype=np.uint8)
        kinds = {"Ll": LOWER, "Lu": UPPER, "Lt": UPPER, "Lm": LETTER, "Lo": LETTER, "Nd": DIGIT, "Nl": DIGIT, "No": DIGIT, "Zs": SPACE, "Sc": SYMBOL, "Sk": SYMBOL, "Sm": SYMBOL, "So": SYMBOL}
        for code in range(0x30000):
            kind = unicodedata.category(chr(code))
            table[code] = kinds.get(kind, SYMBOL if kind[0] == "P" else OTHER)
        table[[ord(c) for c in ".,;:'\"!?()-"]] = STOP
        table[[9, 11, 12, 13]] = SPACE
        table[10] = NEWLINE
        _table.append(table)
    return _table[0]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def ids_of(column: pd.Series) -> pd.Series:
    """doc_ids that came as text, so that nulls do not turn large ids into floats."""
    return pd.Series([None if x is None else int(x) for x in column], dtype="Int64", index=column.index)


LINE_FEATURES = 18


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x LINE_FEATURES, characters of each line, lines of each text)."""
    per_text = np.array([t.count("\n") + 1 for t in texts], dtype=np.int64)
    codes = codes_of("\n".join(texts))
    kind = class_table()[codes]
    newline = kind == NEWLINE
    line = np.cumsum(newline) - newline
    lines = int(per_text.sum())
    n = np.bincount(line * CLASSES + kind, minlength=lines * CLASSES).reshape(-1, CLASSES).astype(np.float64)
    length = n[:, :NEWLINE].sum(1)
    word_char = (kind != SPACE) & ~newline
    before = np.empty_like(word_char)
    before[:1], before[1:] = False, word_char[:-1]
    starts = np.flatnonzero(word_char & ~before)
    words = np.zeros(lines)
    again, distinct, longest, capital = (np.zeros(lines) for _ in range(4))
    whole = np.zeros(lines, dtype=np.uint64)
    if len(starts):
        at = np.flatnonzero(word_char)
        word = np.cumsum(~before[at]) - 1
        place = at - starts[word]
        mult = np.uint64(0x9E3779B97F4A7C15)
        value = (codes[at].astype(np.uint64) + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * mult
        value ^= value >> np.uint64(29)
        first = np.flatnonzero(~before[at])
        hashed = np.add.reduceat(value, first) * np.uint64(0xBF58476D1CE4E5B9)
        size = np.diff(np.append(first, len(at)))
        of = line[starts]
        words = np.bincount(of, minlength=lines).astype(np.float64)
        same = (hashed[1:] == hashed[:-1]) & (of[1:] == of[:-1])
        again = np.bincount(of[1:][same], minlength=lines).astype(np.float64)
        key = hashed ^ (of.astype(np.uint64) * np.uint64(0x94D049BB133111EB))
        _, seen = np.unique(key, return_index=True)
        distinct = np.bincount(of[seen], minlength=lines).astype(np.float64)
        np.maximum.at(longest, of, size)
        capital = np.bincount(of[kind[starts] == UPPER], minlength=lines).astype(np.float64)
        np.add.at(whole, of, hashed * (starts - np.searchsorted(line, of) + 1).astype(np.uint64))
    text_of = np.repeat(np.arange(len(texts)), per_text)
    _, once = np.unique(whole ^ (text_of.astype(np.uint64) * mult_line), return_index=True)
    repeated = np.ones(lines)
    repeated[once] = 0
    run = np.zeros(len(codes), dtype=bool)
    run[1:] = (codes[1:] == codes[:-1]) & ((kind[1:] == SYMBOL) | (kind[1:] == STOP))
    runs = np.bincount(line[run], minlength=lines).astype(np.float64)
    chars, many = np.maximum(length, 1), np.maximum(words, 1)
    out = np.column_stack(
        [
            np.log1p(length),
            np.log1p(words),
            (length - n[:, SPACE]) / many / 8,
            n[:, LOWER] / chars,
            n[:, UPPER] / chars,
            n[:, LETTER] / chars,
            n[:, DIGIT] / chars,
            n[:, SPACE] / chars,
            n[:, STOP] / chars,
            n[:, SYMBOL] / chars,
            n[:, OTHER] / chars,
            again / many,
            distinct / many,
            np.log1p(longest),
            capital / many,
            np.minimum(runs / many, 4),
            repeated * (length > 0),
            length == 0,
        ]
    )
    return out, length, per_text


mult_line = np.uint64(0xD6E8FEB86659FD93)
