"""Personal data by weak supervision, in DataFrame functions only.

Candidates come from one pattern a kind (the base) and from wider forms:
addresses spelled with [at] and [dot], colon-separated or defanged IP addresses,
card numbers with other separators, telephone numbers without a plus sign.
Four labelers vote yes, no or nothing on each candidate: the base pattern, a
gazetteer (top-level domains, issuer prefixes, network ranges, dialling codes),
words before it, and the characters at its edges. Expectation-maximisation over
the counts of vote patterns estimates how reliable each labeler is for each
kind; the posteriors train a logistic span classifier on the candidates' form,
length, edges, context and gazetteer. Counts cover all candidates; what reaches
the driver is one row for each pattern of votes and features, a few thousand at
most. The classifier adds wider forms it accepts, unless they overlap a base
span; base spans always stay.

Positions are code points. A match's place is the sum of the lengths of the
pieces and matches before it, from splitting at the same pattern. The patterns
start a match only where a run starts and never give characters back, so that
long texts take linear time; they find the same spans as their plain forms.

Defined cases: null text is empty; a text without spans has an empty list;
repeated rows are handled each; without candidates nothing is added; an empty
table gives no rows; further columns are kept by ``redacted`` and ignored else.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import blocks, let, scan

KINDS = ("email", "ip", "card", "phone")
LOCAL, LABEL, PART = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]", r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Kind, whether it is the base form, pattern.
FORMS = (
    (0, True, rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++"),
    (1, True, r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    (2, True, r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+"),
    (3, True, r"\+[0-9][\x20().0-9-]+[0-9]"),
    (0, False, rf"(?<!{LOCAL}){LOCAL}{{1,64}}+\x20?(?:\[at\]|\(at\)|\{{at\}})\x20?{LABEL}{{1,63}}+(?:\x20?(?:\[dot\]|\(dot\)|\{{dot\}}|\.)\x20?{LABEL}{{1,63}}+)++"),
    (1, False, r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3})(?![0-9A-Za-z:])"),
    (2, False, r"(?<![0-9./_])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9./_])"),
    (3, False, r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|00[1-9](?:[\x20-]?[0-9]){8,12})(?![0-9-])"),
)
#: Common top-level domains.
DOMAINS = "com org net edu gov mil int info biz io co uk de fr es it nl eu us ca au jp cn in br ru ch at be se no dk fi pl pt ie nz me dev app"
WORDS_BEFORE = ("mail|contact|write|reach", "ip|host|server|address|addr|client|ping", "card|visa|credit|debit|payment|pan", "tel|phone|call|fax|mobile|cell|sms|whatsapp")
WORDS_AGAINST = "version|release|section|chapter|isbn|issn|order|invoice|ticket|serial|build|figure|table"
SPAN = "array<struct<start:int,kind:int,end:int,base:boolean,form:int,size:int,before:boolean,after:boolean,context:int,gazetteer:int>>"


def _luhn(digits: Column) -> Column:
    def add(total, i):
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: int, text: Column, base: bool) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    if kind == 1 and base:
        return text.rlike(rf"^(?:{PART}\.){{3}}{PART}$")
    if kind == 2:
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == 3:
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _gazetteer(kind: int, text: Column) -> Column:
    """1 if known, -1 if not."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    known = (
        F.lower(F.regexp_extract(text, r"([A-Za-z0-9-]+)$", 1)).isin(*DOMAINS.split()),
        text.rlike(r"^0*([1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])[.\[]|:"),
        digits.rlike("^(4|5[1-5]|2[2-7]|3[4-9]|6011|62|64|65)"),
        digits.rlike("^(00)?([1-9])") & ~digits.rlike(r"^(\d)\1+$"),
    )[kind]
    return F.when(known, 1).otherwise(-1)


def _context(kind: int, before: Column) -> Column:
    return F.when(before.rlike(rf"(?i)\b(?:{WORDS_BEFORE[kind]})s?\b"), 1).when(before.rlike(rf"(?i)\b(?:{WORDS_AGAINST})s?\b"), -1).otherwise(0)


def _found(text: Column, form: int) -> Column:
    pattern = FORMS[form][2]
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda matches: let(F.split(text, pattern, -1), lambda pieces: _spans(matches, pieces, form)))


def _spans(matches: Column, pieces: Column, form: int) -> Column:
    """Valid spans of a form from its matches in a text and the pieces between them."""
    kind, base, _ = FORMS[form]
    both = F.zip_with(matches, F.slice(pieces, F.lit(1), F.size(matches)), lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    rows = F.zip_with(both, F.slice(pieces, F.lit(2), F.size(matches)), lambda b, n: F.struct(b["m"].alias("m"), b["p"].alias("p"), n.alias("next")))
    starts = scan(both, F.lit(0), lambda at, b: at + F.length(b["p"]) + F.length(b["m"]), lambda at, b: at + F.length(b["p"]), "int")
    placed = F.zip_with(rows, starts, lambda x, start: F.struct(x["m"].alias("m"), F.right(x["p"], F.lit(24)).alias("near"), x["next"].alias("next"), start.alias("start")))

    def span(x: Column) -> Column:
        return F.struct(
            x["start"].alias("start"),
            F.lit(kind).alias("kind"),
            (x["start"] + F.length(x["m"])).alias("end"),
            F.lit(base).alias("base"),
            F.lit(form).alias("form"),
            F.least(F.lit(3), F.floor(F.length(x["m"]) / 8)).cast("int").alias("size"),
            x["near"].rlike(r"(?:^|[^\p{L}\p{N}])$").alias("before"),
            x["next"].rlike(r"^(?:$|[^\p{L}\p{N}])").alias("after"),
            _context(kind, x["near"]).alias("context"),
            _gazetteer(kind, x["m"]).alias("gazetteer"),
        )

    return F.transform(F.filter(placed, lambda x: _valid(kind, x["m"], base)), span).cast(SPAN)


def candidates(text: Column) -> Column:
    """Array of candidate spans of a text, base and wider forms."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast(SPAN)
    plain = F.when(F.contains(text, F.lit("@")), _found(text, 0)).otherwise(none)
    spelled = F.when(text.rlike(r"[\[({]at[\])}]"), _found(text, 4)).otherwise(none)
    colons = F.when(F.contains(text, F.lit(":")) | F.contains(text, F.lit("[.]")), _found(text, 5)).otherwise(none)
    numbers = F.when(text.rlike("[0-9]"), F.concat(*[_found(text, form) for form in (1, 2, 3, 6, 7)])).otherwise(none)
    return F.concat(plain, spelled, colons, numbers)


FEATURES = ("kind", "base", "form", "size", "before", "after", "context", "gazetteer")


def vote(row) -> tuple[int, int, int, int]:
    """The labelers: base pattern, gazetteer, words before, edges."""
    return (1 if row["base"] else 0, row["gazetteer"], row["context"], 1 if row["before"] and row["after"] else -1)


def reliabilities(votes: np.ndarray, count: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for one kind: P(true) of each vote pattern, and P(vote | truth) as labelers x 2 x 3."""
    weight = votes.sum(1)
    post = 1 / (1 + np.exp(-weight.astype(float)))
    table = np.zeros((votes.shape[1], 2, 3))
    for _ in range(rounds):
        both = np.stack([1 - post, post]) * count
        prior = (both.sum(1) + 1) / (both.sum() + 2)
        log = np.log(prior)[:, None] + np.zeros_like(both)
        for j in range(votes.shape[1]):
            for v in (-1, 0, 1):
                table[j, :, v + 1] = both[:, votes[:, j] == v].sum(1) + 0.5 + (0.5 if v else 0.0)
            table[j] /= table[j].sum(1, keepdims=True)
            log += np.log(table[j])[:, votes[:, j] + 1]
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return post, table


@dataclass
class SpanModel:
    """Weights of the span classifier by feature and value, and the labelers' estimated tables by kind."""

    bias: float
    weights: dict[tuple[str, int], float]
    labelers: dict[int, np.ndarray]

    def probability(self, span: Column) -> Column:
        total = F.lit(self.bias)
        for (name, value), w in self.weights.items():
            total = total + F.when(span[name].cast("int") == value, F.lit(w)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def train(spans: DataFrame) -> SpanModel:
    """From a column ``spans`` of candidates."""
    rows = spans.select(F.explode("spans").alias("s")).select("s.*").groupBy(*FEATURES).agg(F.count("*").alias("n")).collect()
    if not rows:
        return SpanModel(-20.0, {}, {})
    count = np.array([r["n"] for r in rows], dtype=float)
    kinds = np.array([r["kind"] for r in rows])
    votes = np.array([vote(r) for r in rows])
    truth, labelers = np.zeros(len(rows)), {}
    for kind in set(kinds.tolist()):
        own = kinds == kind
        truth[own], labelers[kind] = reliabilities(votes[own], count[own])
    # form and base name the pattern itself; the classifier judges what a span looks like
    names = ("kind", "size", "before", "after", "context", "gazetteer")
    keys = sorted({(name, int(r[name])) for r in rows for name in names})
    x = np.array([[int(r[name]) == value for name, value in keys] for r in rows], dtype=float)
    share, w, bias = count / count.sum(), np.zeros(len(keys)), 0.0
    for _ in range(2000):
        miss = (1 / (1 + np.exp(-(x @ w + bias))) - truth) * share
        w -= 2.0 * (x.T @ miss + 1e-4 * w)
        bias -= 2.0 * miss.sum()
    return SpanModel(float(bias), {k: float(v) for k, v in zip(keys, w, strict=True)}, labelers)


def accepted(spans: Column, model: SpanModel, threshold: float = 0.5) -> Column:
    """Base spans and the wider ones that the classifier takes and no base span overlaps, by start and kind.

    In order of start, a span is overlapped by a base span before it if one of
    those ends after its start, and by one after it if the next starts before its end.
    """
    base_end = lambda most, s: F.when(s["base"], F.greatest(most, s["end"])).otherwise(most)
    base_start = lambda at, s: F.when(s["base"], s["start"]).otherwise(at)

    def taken(s: Column) -> Column:
        ends = scan(s, F.lit(-1), base_end, lambda most, _: most, "int")
        starts = F.reverse(scan(F.reverse(s), F.lit(2**31 - 1), base_start, lambda at, _: at, "int"))
        both = F.zip_with(ends, starts, lambda e, b: F.struct(e.alias("e"), b.alias("b")))
        rows = F.zip_with(s, both, lambda x, n: F.struct(x.alias("s"), ((n["e"] > x["start"]) | (n["b"] < x["end"])).alias("over")))
        return F.filter(rows, lambda r: r["s"]["base"] | (~r["over"] & (model.probability(r["s"]) >= threshold)))

    plain = lambda r: F.struct(r["s"]["start"].alias("start"), r["s"]["kind"].alias("kind"), r["s"]["end"].alias("end"), r["s"]["base"].alias("base"))
    return F.sort_array(F.transform(let(F.sort_array(spans), taken), plain))


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one. ``spans`` are in order."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def block(t: Column, some: Column) -> Column:
        # one piece of the text for the block, cut up by itself
        first = F.get(some, F.lit(0))["at"]
        piece = F.substring(t, first + 1, F.element_at(some, -1)["start"] - first)
        cut = lambda p, at: F.transform(some, lambda x: F.concat(F.substring(p, x["at"] - at + 1, x["start"] - x["at"]), F.get(names, x["kind"])))
        return let(piece, lambda p: let(first, lambda at: F.array_join(cut(p, at), "")))

    def of(t: Column, s: Column) -> Column:
        ends = scan(s, F.lit(0), lambda at, x: F.greatest(at, x["end"]), lambda at, _: at, "int")
        rows = F.zip_with(s, ends, lambda x, at: F.struct(at.alias("at"), x["start"].alias("start"), x["kind"].alias("kind")))
        fresh = F.filter(rows, lambda x: x["start"] >= x["at"])
        rest = F.substring(t, F.array_max(F.transform(s, lambda x: x["end"])) + 1, F.length(t))
        return F.concat(let(fresh, lambda f: F.array_join(F.transform(blocks(f), lambda some: block(t, some)), "")), rest)

    return let(F.coalesce(text, F.lit("")), lambda t: let(spans, lambda s: F.when(F.size(s) > 0, of(t, s)).otherwise(t)))


def redacted(documents: DataFrame) -> DataFrame:
    """The documents with personal data replaced and n_chars, if there is one, brought up to date; null texts stay null."""
    model = train(documents.select(candidates(F.col("text")).alias("spans")))
    hidden = let(candidates(F.col("text")), lambda spans: redact(F.col("text"), accepted(spans, model)))
    marked = documents.withColumn("text", F.when(F.col("text").isNotNull(), hidden))
    return marked.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else marked
