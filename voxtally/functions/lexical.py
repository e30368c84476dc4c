"""Rule labels as column expressions over one row's tokens."""

from math import lcm

from pyspark.sql import Column, functions as F

from voxtally import constants as K
from voxtally.functions.text import (
    bind, quoted, sentences, strings, term_counts, tokens,
)
from voxtally.lexicon import Lexicon

KEY_TERMS = 8
# Languages their script gives away.
SCRIPTS = {"hi": r"\p{IsDevanagari}", "zh": r"\p{IsHan}"}


def matches(column: str, terms) -> Column:
    """The entries of a list column that are in a term list, repeats kept."""
    terms = sorted(set(terms))
    if not terms:
        return strings([])
    return F.expr(f"filter({column}, t -> t IN ({quoted(terms)}))")


def content_words(column: str, lexicon: Lexicon, least: int) -> Column:
    """The entries that are no function words and have at least so many letters."""
    return F.expr(f"filter({column}, t -> {_is_content('t', lexicon, least)})")


def is_content(column: str, lexicon: Lexicon, least: int) -> Column:
    return F.expr(_is_content(column, lexicon, least))


def _is_content(name, lexicon, least):
    rule = f"length({name}) >= {least}"
    stop = lexicon.stop_words
    return f"{rule} AND {name} NOT IN ({quoted(stop)})" if stop else rule


def _weight(column: str, by_weight: dict[int, list[str]]) -> Column:
    total = F.lit(0)
    for weight, terms in by_weight.items():
        total = total + F.size(matches(column, terms)) * weight
    return total


def _han_count(text: Column, terms) -> Column:
    if not terms:
        return F.lit(0)
    return F.when(
        text.rlike(r"\p{IsHan}"), F.regexp_count(text, F.lit("|".join(terms)))
    ).otherwise(0)


def polarity(text: Column, hits: str, lexicon: Lexicon) -> tuple[Column, Column]:
    pos = _weight(hits, lexicon.positive) + _han_count(text, lexicon.positive_han)
    neg = _weight(hits, lexicon.negative) + _han_count(text, lexicon.negative_han)
    return pos, neg


def sentiment_class(pos: Column, neg: Column) -> Column:
    """Five classes of (pos-neg)/(pos+neg) at ±0.2 and ±0.6, in whole numbers.

    The outer classes also need a lead of at least two.
    """
    lead, total = pos - neg, pos + neg
    return (
        F.when((lead * 5 >= total * 3) & (lead >= 2), "very_positive")
        .when((lead * 5 >= total) & (lead > 0), "positive")
        .when((lead * -5 >= total * 3) & (lead <= -2), "very_negative")
        .when((lead * -5 >= total) & (lead < 0), "negative")
        .otherwise("neutral")
    )


def sentiment_confidence(pos: Column, neg: Column) -> Column:
    total = pos + neg
    return F.when(total == 0, F.lit(0.5)).otherwise(
        F.round(F.abs(pos - neg).cast("double") / total, 4)
    )


def ranked_themes(hits: str, lexicon: Lexicon) -> Column:
    """Up to three theme keys by number of hits, ties in theme order."""
    counted = F.array(*[
        F.struct(
            (-F.size(matches(hits, lexicon.themes.get(theme, [])))).alias("minus"),
            F.lit(i).alias("ord"),
            F.lit(theme).alias("theme"),
        )
        for i, theme in enumerate(K.THEMES)
    ])
    found = F.sort_array(F.filter(counted, lambda s: s["minus"] < 0))
    return F.transform(F.slice(found, 1, 3), lambda s: s["theme"])


def emotion_tags(hits: str, lexicon: Lexicon) -> Column:
    """Up to three emotions by number of hits, ties in alphabetical order."""
    counted = F.array(*[
        F.struct((-F.size(matches(hits, terms))).alias("minus"), F.lit(emotion).alias("emotion"))
        for emotion, terms in sorted(lexicon.emotions.items())
    ])
    found = F.sort_array(F.filter(counted, lambda s: s["minus"] < 0))
    return F.transform(F.slice(found, 1, 3), lambda s: s["emotion"])


def wants_to_leave(text: Column, lexicon: Lexicon) -> Column:
    """Whether a leaving pattern, written in lower case, occurs in the text in any case."""
    if not lexicon.leaving:
        return F.lit(False)
    return F.lower(text).rlike("(?U)" + "|".join(lexicon.leaving))


def action_signal(sentiment: Column, themes: Column, leaving: Column) -> Column:
    return (
        F.when(
            (sentiment == "very_negative") & F.array_contains(themes, "wellbeing_safety"),
            "urgent_action",
        )
        .when(leaving, "urgent_action")
        .when(sentiment.isin("negative", "very_negative"), "monitor")
        .when(sentiment == "very_positive", "positive_share")
        .otherwise("no_action")
    )


def function_words(column: str, lexicon: Lexicon) -> Column:
    """The tokens ``language`` looks at."""
    return matches(column, [w for words in lexicon.function_words.values() for w in words])


def language(text: Column, words: str, lexicon: Lexicon) -> Column:
    """Language with the most evidence, ties in language order, ``unknown`` without any.

    ``words`` names the column of ``function_words``. Such a word is worth the same in total
    however many languages share it; Han and Devanagari characters count for Chinese and
    Hindi.
    """
    owners: dict[str, int] = {}
    for listed in lexicon.function_words.values():
        for w in set(listed):
            owners[w] = owners.get(w, 0) + 1
    unit = lcm(*owners.values()) if owners else 1
    rows = []
    for i, lang in enumerate(K.LANGUAGES):
        by_share: dict[int, list[str]] = {}
        for w in set(lexicon.function_words.get(lang, [])):
            by_share.setdefault(unit // owners[w], []).append(w)
        score = _weight(words, by_share)
        if lang in SCRIPTS:
            letters = F.regexp_count(text, F.lit(SCRIPTS[lang])) * unit
            score = score + F.when(text.rlike(SCRIPTS[lang]), letters).otherwise(0)
        rows.append(F.struct(
            score.alias("score"), F.lit(-i).alias("ord"), F.lit(lang).alias("lang")
        ))
    return bind(
        F.array_max(F.array(*rows)),
        lambda best: F.when(best["score"] > 0, best["lang"]).otherwise("unknown"),
    )


def key_terms(column: str, lexicon: Lexicon, n: int = KEY_TERMS) -> Column:
    """The n most frequent tokens of three letters or more that are no function words,
    ties in alphabetical order."""
    order = F.transform(
        term_counts(content_words(column, lexicon, 3)),
        lambda s: F.struct((-s["tf"]).alias("minus"), s["term"].alias("term")),
    )
    return F.transform(F.slice(F.sort_array(order), 1, n), lambda s: s["term"])


def lead_sentence(text: Column, terms: Column) -> Column:
    """The sentence with the best Luhn score, (key terms in it)² / (its words); ties go
    to the earlier one. Empty if the text has no letters."""

    def score(sentence):
        return bind(
            tokens(sentence),
            lambda ts: F.pow(
                F.size(F.filter(ts, lambda t: F.array_contains(terms, t))), F.lit(2)
            ) / F.size(ts),
        )

    return bind(sentences(text), lambda ss: F.coalesce(
        F.array_max(F.transform(ss, lambda s, i: F.struct(
            score(s).alias("score"), (-i).alias("ord"), s.alias("sentence")
        )))["sentence"],
        F.lit(""),
    ))
