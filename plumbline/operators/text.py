"""Headlines and sentiment by lexicon. Lexicons are parameters; ``vocabulary`` has the fixed word lists."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import vocabulary as V
from plumbline.functions.text import let


def term_pattern(terms: Iterable[str]) -> str:
    """One pattern for whole terms in any case."""
    return r"(?iU)(?<!\w)(?:" + "|".join(re.escape(t.strip()) for t in sorted(terms, key=len, reverse=True) if t.strip()) + r")(?!\w)"


def categories(text: Column, lexicon: Mapping[str, Iterable[str]]) -> Column:
    """Sorted names of all categories of which a term occurs."""
    hits = [F.when(text.rlike(term_pattern(terms)), F.lit(name)) for name, terms in sorted(lexicon.items())]
    return F.array_compact(F.array(*hits))


def matched_terms(text: Column, terms: Iterable[str]) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(term_pattern(terms)), F.lit(0)), F.lower)))


def load_lexicon(terms: DataFrame) -> dict[str, list[str]]:
    """Categories and their terms from a table (category, term); a lexicon is small and closed, so it becomes patterns."""
    found: dict[str, list[str]] = {}
    for row in terms.where("category IS NOT NULL AND trim(term) <> ''").select("category", "term").distinct().orderBy("category", "term").collect():
        found.setdefault(row.category, []).append(row.term.strip())
    return found


def classify(text: Column, lexicon: Mapping[str, Iterable[str]]) -> Column:
    """struct(categories, matches): sorted names, and for each its terms that occur, lower-cased and sorted. Null or blank text has none."""
    shown = F.coalesce(text, F.lit(""))
    entries = [F.struct(F.lit(name).alias("key"), matched_terms(shown, terms).alias("value")) for name, terms in sorted(lexicon.items())]
    hit = F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0)
    return F.struct(F.transform(hit, lambda e: e["key"]).alias("categories"), F.map_from_entries(hit).alias("matches"))


def primary_family(categories: Column) -> tuple[Column, Column]:
    """(primary category, family): the first category, else uncategorized; sentiment prevails where it is among them."""
    primary = F.coalesce(F.get(categories, F.lit(0)), F.lit("uncategorized"))
    known = F.create_map(*[F.lit(x) for pair in V.CATEGORY_FAMILY.items() for x in pair])
    family = F.when(F.array_contains(categories, "market_sentiment"), "sentiment_emotion").otherwise(F.coalesce(F.try_element_at(known, primary), F.lit("sentiment_emotion")))
    return primary, family


def headline_emotion(text: Column) -> Column:
    """struct(method, status, score, direction, confidence, positive, negative, negation): the lexical engine first, else the headline lexicon.

    Headline terms count wherever a word begins with them; a negator turns the
    counts round if anything negative is there. No term gives no score. The headline
    score and its confidence (a third a term, 1 at most) have four places, the
    engine's six.
    """
    engine = lexicon_sentiment(F.coalesce(text, F.lit("")))
    spaced = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z']+"), F.lit(0)), " "), F.lit(" "))
    once = lambda spaced, t: (F.length(spaced) - F.length(F.replace(spaced, F.lit(f" {t}"), F.lit("")))) / (len(t) + 1)
    times = lambda spaced, terms: sum((once(spaced, t) for t in terms), F.lit(0)).cast("long")

    def of(e: Column, spaced: Column, p: Column, n: Column) -> Column:
        turned = spaced.rlike(" (?:" + "|".join(V.NEGATORS_HEADLINE) + ") ") & (n > 0)
        own = e["score"].isNotNull()
        up = F.when(own, e["positive"]).when(turned, n).otherwise(p)
        down = F.when(own, e["negative"]).when(turned, p).otherwise(n)
        some = up + down > 0
        return F.struct(
            F.when(own, "engine").otherwise("headline_lexicon").alias("method"),
            F.when(spaced == "  ", "no_tokens").when(some, "scored").otherwise("no_sentiment_term").alias("status"),
            F.when(own, e["score"]).when(some, F.round((up - down) / (up + down), 4)).alias("score"),
            F.when(up > down, "positive").when(some, F.when(own & (up == down), "neutral").otherwise("negative")).alias("direction"),
            F.when(own, F.round((up + down) / e["words"], 6)).when(some, F.round(F.least(F.lit(1.0), (up + down) / 3), 4)).alias("confidence"),
            up.alias("positive"),
            down.alias("negative"),
            (~own & turned).alias("negation"),
        )

    counted = lambda e, s: let(F.struct(times(s, V.POSITIVE_HEADLINE).alias("p"), times(s, V.NEGATIVE_HEADLINE).alias("n")), lambda c: of(e, s, c["p"], c["n"]))
    return let(engine, lambda e: let(spaced, lambda s: counted(e, s)))


def headline_sentiment(text: Column, positive: Iterable[str], negative: Iterable[str], negators: Iterable[str]) -> tuple[Column, Column, Column]:
    """(positive, negative, score): counts of whole terms, swapped if a negator meets a negative term; score null without terms."""
    p, n = (F.regexp_count(text, F.lit(term_pattern(t))).cast("long") for t in (positive, negative))
    swap = text.rlike(term_pattern(negators)) & (n > 0)
    up, down = F.when(swap, n).otherwise(p), F.when(swap, p).otherwise(n)
    return up, down, F.when(up + down > 0, (up - down) / (up + down))


def lexicon_sentiment(text: Column) -> Column:
    """struct(positive, negative, words, score, status) with a language screen and negation over three words.

    The screen wants ASCII words only, none that marks another language, and 60 %
    known words. Negators count among the three words before a mention since the
    last stop or contrast; an odd number turns it round.
    """
    token = r"[^\W_]+(?:'[^\W_]+)?|[.!?;,\n]"
    tokens = F.regexp_extract_all(F.lower(F.regexp_replace(text, "’", "'")), F.lit(f"(?U){token}"), F.lit(0))
    known = [*V.POSITIVE_WORDS, *V.NEGATIVE_WORDS, *V.NEGATORS, *V.ENGLISH_WORDS]
    bit = lambda held, value: F.when(held, value).otherwise(0)
    cut, good, bad, negator, word = 1, 2, 4, 8, 16
    zero = F.struct(F.lit(0).alias("p"), F.lit(0).alias("n"), F.lit(0).alias("h"))

    def code(t: Column) -> Column:
        """What a token is, as bits."""
        sets = ((cut, [".", "!", "?", ";", ",", "\n", "but", "however", "yet"]), (good, V.POSITIVE_WORDS), (bad, V.NEGATIVE_WORDS), (negator, V.NEGATORS))
        return sum((bit(t.isin(*words), value) for value, words in sets), bit(t.rlike(r"[\p{L}\p{N}]"), word))

    def step(acc: Column, c: Column) -> Column:
        """h has a bit for each of the last three words that is a negator."""
        is_ = lambda value: c.bitwiseAND(F.lit(value)) > 0
        h = F.when(is_(cut), 0).otherwise(acc["h"])
        odd = F.bit_count(h) % 2 == 1
        up, down = (is_(good) & ~odd) | (is_(bad) & odd), (is_(bad) & ~odd) | (is_(good) & odd)
        # words and numbers move the history on; stops only clear it
        moved = F.when(is_(word), (h * 2 + bit(is_(negator), 1)).bitwiseAND(F.lit(7))).otherwise(h)
        return F.struct((acc["p"] + bit(up, 1)).alias("p"), (acc["n"] + bit(down, 1)).alias("n"), moved.alias("h"))

    def of(tokens: Column, words: Column) -> Column:
        fit = (
            (F.size(words) > 0)
            & F.forall(words, lambda w: w.rlike(r"^[\x00-\x7F]*$"))
            & ~F.exists(words, lambda w: w.isin(*V.FOREIGN_MARKERS))
            & (F.size(F.filter(words, lambda w: w.isin(*known))) >= 0.6 * F.size(words))
        )
        total = F.when(fit, F.aggregate(F.transform(tokens, code), zero, step))

        def shown(total: Column) -> Column:
            p, n = total["p"].cast("long"), total["n"].cast("long")
            status = F.when(F.trim(text) == "", "empty_text").when(total.isNull(), "unsupported_or_uncertain_language").when(p + n == 0, "no_lexical_overlap").otherwise("ok")
            ok = status == "ok"
            return F.struct(F.when(ok, p).alias("positive"), F.when(ok, n).alias("negative"), F.size(words).cast("long").alias("words"), F.when(ok, F.round((p - n) / (p + n), 6)).alias("score"), status.alias("status"))

        return let(total, shown)

    return let(tokens, lambda t: let(F.filter(t, lambda x: x.rlike(r"\p{L}")), lambda w: of(t, w)))


def summary(scored: DataFrame, by: str) -> DataFrame:
    """Mean score and directions of scored texts."""
    return scored.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count("score").alias("scored"),
        F.avg("score").alias("mean_score"),
        F.count_if(F.col("score") > 0).alias("positive"),
        F.count_if(F.col("score") < 0).alias("negative"),
    )
