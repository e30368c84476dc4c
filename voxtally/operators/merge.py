"""Bringing records, labels, scores and topics together."""

from pyspark.sql import DataFrame, functions as F

from voxtally import constants as K
from voxtally.operators.joins import lookup_join
from voxtally.schemas import ANALYZED_FIELDS


def last_by_id(df: DataFrame, fields: list[str], order: str = "pos") -> DataFrame:
    """One row per ``response_id`` with the values of its last row.

    ``max_by`` combines on the map side, so an id with very many rows costs no
    more than any other.
    """
    return df.groupBy("response_id").agg(
        F.max_by(F.struct(*fields), order).alias("_last")
    ).select("response_id", *[F.col("_last")[f].alias(f) for f in fields])


def enrich(records: DataFrame, labels: DataFrame) -> DataFrame:
    """Every record that has a label, with the fields of that label; the others drop out.

    ``labels`` holds one row per ``response_id`` (see ``last_by_id``); every record of a
    repeated id is kept, with its own department.
    """
    return lookup_join(records, labels, "response_id")


def with_topics(rows: DataFrame, topics: DataFrame | None) -> DataFrame:
    """Adds the topic columns; rows without a topic, or a run without topics, get defaults."""
    fields = ["topic_id", "topic_label", "topic_keywords"]
    if topics is None:
        for f, kind in zip(fields, ["int", "string", "array<string>"]):
            rows = rows.withColumn(f, F.lit(None).cast(kind))
    else:
        rows = lookup_join(rows, topics.select("response_id", *fields), "response_id", "left")
    return rows.withColumns({
        "topic_id": F.coalesce("topic_id", F.lit(K.NO_TOPIC)),
        "topic_label": F.coalesce("topic_label", F.lit(K.NO_TOPIC_LABEL)),
        "topic_keywords": F.coalesce("topic_keywords", F.array().cast("array<string>")),
    })


def result(rows: DataFrame) -> DataFrame:
    """``pos`` and the 18 columns of the result table."""
    return rows.withColumnsRenamed({
        "risk_score": "burnout_risk_score",
        "risk_level": "burnout_risk_level",
        "risk_factors": "burnout_risk_factors",
    }).select("pos", *ANALYZED_FIELDS)
