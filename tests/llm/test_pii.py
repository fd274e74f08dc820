import hashlib
import random
import re

from plumbline.llm import pii
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, spans string, n_chars long"


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    """The base spans by the patterns as they are given."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def texts():
    rng = random.Random(3)
    parts = ["a@b.co", "x_y@", "@", ".", "..", " ", "-", "1", "23", "4", "255", "256", "007", "+", "+1 (586) 555-8430", "1.2.3.4", "4018709761430345", "4018 7097-6143 0345", "é", "\U0001f600", "m.n%o@p-q.r.s", "\n", "_", "0000000255.1.1.1", "a", "(at)", "378282246310005"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 12))) for _ in range(3000)]
    return [*out, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "é" * 50 + "+1 (586) 555-8430", "9" * 20000, "a." * 20000 + "@", "1 " * 20000, "word " * 30000 + "a@b.co"]


def test_base_spans_equal_plain_patterns(spark):
    rows = texts()
    frame = spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(rows)] + [(-1, None, "", 0)], SCHEMA)
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.s if s.base] for r in frame.select("doc_id", F.array_sort(pii.candidates(F.col("text"))).alias("s")).collect()}
    for i, t in enumerate(rows):
        assert got[i] == plain(t), t[:200]
    assert got[-1] == []


def test_wider_forms_are_added_and_text_is_replaced(spark):
    rows = [f"Please call me, phone 555-867-{i:04d} now or a{i}@site.com" for i in range(60)]
    rows += [f"mail bob{i} [at] site [dot] com today, host 10.0.0.{i}" for i in range(60)]
    rows += ["nothing here", None]
    frame = spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(rows)], SCHEMA)
    out = {r.doc_id: r.text for r in pii.redacted(frame).collect()}
    assert out[0] == "Please call me, phone [PHONE] now or [EMAIL]"
    assert out[60] == "mail [EMAIL] today, host [IP]"
    assert out[120] == "nothing here" and out[121] is None
    assert {r.n_chars for r in pii.redacted(frame).where("doc_id = 120").collect()} == {12}
    assert pii.redacted(frame.limit(0)).collect() == []


def test_digest_text(spark):
    frame = spark.createDataFrame([(1, "a@b.co 1.2.3.4", "", 0)], SCHEMA)
    spans = frame.select(pii.candidates(F.col("text")).alias("spans"))
    kept = pii.accepted(F.col("spans"), pii.train(spans))
    row = spans.select(pii.shown(kept).alias("s"), F.sha2(pii.shown(kept), 256).alias("h")).first()
    assert row.s == "email:0:6,ip:7:14" and row.h == hashlib.sha256(row.s.encode()).hexdigest()


def sure(p):
    """A model that takes spans by their size alone."""
    return pii.SpanModel(-9.0, {("size", 1): 18.0 * p}, {})


def test_accepted_and_redacted_against_plain_python(spark):
    rng = random.Random(9)
    kind = "text string, spans array<struct<start:int,kind:int,end:int,base:boolean,form:int,size:int,before:boolean,after:boolean,context:int,gazetteer:int>>"
    rows = []
    for n in [0, 1, 2, 3, 5, 10, 30, 200] * 12:
        text = "".join(rng.choice("abé\U0001f600 ") for _ in range(rng.randrange(10, 400)))
        spans = []
        for _ in range(n):
            a = rng.randrange(len(text) - 1)
            spans.append((a, rng.randrange(4), min(len(text), a + rng.randrange(1, 20)), rng.random() < 0.4, 0, rng.randrange(2), True, True, 0, 1))
        rows.append((text, spans))
    out = spark.createDataFrame(rows, kind).select("text", "spans", pii.accepted(F.col("spans"), sure(1)).alias("kept"))
    for r in out.select("text", "spans", "kept", pii.redact(F.col("text"), F.col("kept")).alias("hidden")).collect():
        base = [s for s in r.spans if s.base]
        want = [s for s in r.spans if s.base or (s.size == 1 and not any(b.start < s.end and s.start < b.end for b in base))]
        assert [tuple(s) for s in r.kept] == sorted((s.start, s.kind, s.end, s.base) for s in want)
        at, parts = 0, []
        for s in r.kept:
            if s.start >= at:
                parts += [r.text[at : s.start], f"[{pii.KINDS[s.kind].upper()}]"]
            at = max(at, s.end)
        assert r.hidden == "".join(parts) + r.text[at:]


def test_a_long_text_of_many_spans(spark):
    import time

    part = "mail bob [at] site [dot] com or a@b.co now "
    frame = spark.createDataFrame([(1, part * 6000, "", 0)] + [(i, part, "", 0) for i in range(2, 30)], SCHEMA)
    began = time.time()
    rows = {r.doc_id: r.text for r in pii.redacted(frame).collect()}
    assert rows[1] == rows[2] * 6000 and rows[2] == "mail [EMAIL] or [EMAIL] now "
    assert time.time() - began < 60


def test_reliabilities_against_plain_python():
    """Expectation-maximisation over counted patterns equals the same over rows, one at a time."""
    import math

    rng = random.Random(6)
    rows = []
    for _ in range(400):
        truth = rng.random() < 0.6
        rows.append(tuple(rng.choice((0, 0, v)) if rng.random() < 0.9 else -v for v in [(1 if truth else -1)] * 3))
    import numpy as np

    patterns = sorted(set(rows))
    post, table = pii.reliabilities(np.array(patterns), np.array([rows.count(p) for p in patterns], dtype=float))
    belief = [1 / (1 + math.exp(-sum(r))) for r in rows]
    for _ in range(50):
        yes = sum(belief)
        prior = [(len(rows) - yes + 1) / (len(rows) + 2), (yes + 1) / (len(rows) + 2)]
        chance = []
        for j in range(3):
            per = []
            for t in (0, 1):
                weight = [b if t else 1 - b for b in belief]
                mass = {v: sum(w for w, r in zip(weight, rows) if r[j] == v) + (0.5 if v == 0 else 1.0) for v in (-1, 0, 1)}
                per.append({v: m / sum(mass.values()) for v, m in mass.items()})
            chance.append(per)
        belief = []
        for r in rows:
            like = [prior[t] * math.prod(chance[j][t][r[j]] for j in range(3)) for t in (0, 1)]
            belief.append(like[1] / sum(like))
    by = dict(zip(rows, belief))
    assert np.allclose(post, [by[p] for p in patterns], atol=1e-9)
    assert all(abs(table[j, t, v + 1] - chance[j][t][v]) < 1e-9 for j in range(3) for t in (0, 1) for v in (-1, 0, 1))
