"""Burnout risk from label columns: a weighted sum of four components."""

from pyspark.sql import Column, functions as F

from voxtally import constants as K
from voxtally.functions.text import compact, literal_map, strings


def sentiment_component(sentiment: Column) -> Column:
    return F.coalesce(
        F.try_element_at(literal_map(K.SENTIMENT_SCORES), sentiment),
        F.lit(K.UNKNOWN_SENTIMENT_SCORE),
    )


def theme_component(primary: Column, secondary: Column) -> Column:
    themes = F.array_union(F.array(primary), secondary)
    return (
        F.when(F.arrays_overlap(themes, strings(K.HIGH_RISK_THEMES)), 0.9)
        .when(F.arrays_overlap(themes, strings(K.MEDIUM_RISK_THEMES)), 0.5)
        .otherwise(0.2)
    )


def distinct_emotions(tags: Column) -> Column:
    return F.array_distinct(F.transform(tags, F.lower))


def emotion_component(emotions: Column) -> Column:
    """From lower-cased distinct emotions: a capped rise minus a capped relief, never below 0."""
    rise = F.size(F.array_intersect(emotions, strings(K.BURNOUT_EMOTIONS))) * F.lit(0.35)
    relief = F.size(F.array_intersect(emotions, strings(K.PROTECTIVE_EMOTIONS))) * F.lit(0.1)
    return F.greatest(
        F.lit(0.0), F.least(F.lit(1.0), rise) - F.least(F.lit(0.2), relief)
    )


def action_component(action: Column) -> Column:
    return F.when(action == "urgent_action", 0.9).otherwise(0.0)


def risk_score(sentiment: Column, theme: Column, emotion: Column, action: Column) -> Column:
    total = (
        F.lit(0.4) * sentiment + F.lit(0.3) * theme + F.lit(0.2) * emotion + F.lit(0.1) * action
    )
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 4)


def risk_level(score: Column) -> Column:
    """Level of a rounded score; the cut-offs belong to the lower level."""
    level = None
    for name, upto in K.RISK_CUTOFFS.items():
        level = (F if level is None else level).when(score <= upto, name)
    return level.otherwise(K.RISK_LEVELS[-1])


def risk_factors(sentiment, sentiment_part, primary, emotion_part, action) -> Column:
    return compact(
        F.when(sentiment_part >= 0.65, F.concat(F.lit("Negative sentiment: "), sentiment)),
        F.when(primary.isin(K.HIGH_RISK_THEMES), F.concat(F.lit("High-risk theme: "), primary)),
        F.when(emotion_part >= 0.35, "Burnout-correlated emotions detected"),
        F.when(action == "urgent_action", "Urgent action signal"),
    )


def protective_factors(sentiment: Column, emotions: Column) -> Column:
    present = F.array_sort(F.array_intersect(emotions, strings(K.PROTECTIVE_EMOTIONS)))
    return compact(
        F.when(sentiment.isin("positive", "very_positive"), "Positive sentiment baseline"),
        F.when(
            F.size(present) > 0,
            F.concat(F.lit("Protective emotions: "), F.array_join(present, ", ")),
        ),
    )
