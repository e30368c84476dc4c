"""Burnout scores for labelled rows; row-wise, so it runs on streams unchanged."""

from pyspark.sql import DataFrame, functions as F

from voxtally.functions import burnout as B


def components(labelled: DataFrame) -> DataFrame:
    """Adds the four score parts and the lower-cased distinct emotions."""
    return labelled.withColumn("emotions", B.distinct_emotions(F.col("emotion_tags"))).withColumns({
        "sentiment_part": B.sentiment_component(F.col("sentiment")),
        "theme_part": B.theme_component(F.col("primary_theme"), F.col("secondary_themes")),
        "emotion_part": B.emotion_component(F.col("emotions")),
        "action_part": B.action_component(F.col("action_signal")),
    })


def score(labelled: DataFrame) -> DataFrame:
    """Adds ``risk_score``, ``risk_level``, ``risk_factors`` and ``protective_factors``."""
    parts = ["sentiment_part", "theme_part", "emotion_part", "action_part"]
    return (
        components(labelled)
        .withColumn("risk_score", B.risk_score(*[F.col(p) for p in parts]))
        .withColumns({
            "risk_level": B.risk_level(F.col("risk_score")),
            "risk_factors": B.risk_factors(
                F.col("sentiment"), F.col("sentiment_part"), F.col("primary_theme"),
                F.col("emotion_part"), F.col("action_signal"),
            ),
            "protective_factors": B.protective_factors(F.col("sentiment"), F.col("emotions")),
        })
        .drop("emotions", *parts)
    )
