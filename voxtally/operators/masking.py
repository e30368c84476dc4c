"""Masking of personal data, one pattern after the other on the text left by the last."""

from pyspark.sql import DataFrame, functions as F

from voxtally.functions import pii
from voxtally.functions.text import compact
from voxtally.schemas import MASKED_FIELDS

# Checksummed runs go first: the phone pattern would take 13 to 15 digit cards.
EVERYTHING = ["CREDIT_CARD", "IBAN_CODE", "EMAIL", "PHONE", "PERSON"]

_MASKS = {
    "CREDIT_CARD": pii.mask_card,
    "IBAN_CODE": pii.mask_iban,
    "EMAIL": pii.mask_email,
    "PHONE": pii.mask_phone,
    "PERSON": pii.mask_person,
}


def mask(df: DataFrame, text: str = "text", entities: list[str] = EVERYTHING) -> DataFrame:
    """Adds ``anonymized_text``, ``pii_types`` and ``pii_detected``.

    A type is listed when its pattern changed the text. Null and blank text comes
    through unchanged. Dates and links are left alone on purpose.
    """
    steps = [text]
    for entity in entities:
        column = f"_masked_{entity}"
        # Its own projection each, so that a pattern runs once however often it is read.
        df = df.withColumn(column, _MASKS[entity](F.col(steps[-1])))
        steps.append(column)
    found = compact(*[
        F.when(F.col(before) != F.col(after), entity)
        for entity, before, after in zip(entities, steps, steps[1:])
    ])
    return (
        df.withColumns({"anonymized_text": F.col(steps[-1]), "pii_types": found})
        .withColumn("pii_detected", F.size("pii_types") > 0)
        .drop(*steps[1:])
    )


def masked_table(survey: DataFrame, entities: list[str] = EVERYTHING) -> DataFrame:
    return mask(survey, "text", entities).withColumn("original_text", F.col("text")).select(
        *MASKED_FIELDS
    )
