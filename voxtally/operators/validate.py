"""Record checks: one pass adds the errors, everything else reads that column."""

from pyspark.sql import DataFrame, functions as F

from voxtally import constants as K
from voxtally.functions import validation as V
from voxtally.functions.text import strip
from voxtally.schemas import SURVEY_FIELDS


class NoValidRecords(ValueError):
    def __init__(self, errors: list[str]):
        super().__init__("No valid survey responses")
        self.errors = errors


def check_rows(survey: DataFrame) -> DataFrame:
    """Adds ``errors`` and ``shown_id``; a null stands for a missing field."""
    return survey.withColumns({
        "errors": V.row_errors(F.col("response_id"), F.col("text")),
        "shown_id": F.coalesce("response_id", F.lit("?")),
    })


def check_json(records: DataFrame, column: str = "record") -> DataFrame:
    """The same for JSON records held as text; declared string fields become columns."""
    parsed = records.withColumn("_v", F.try_parse_json(column))
    return parsed.withColumns({
        "errors": V.json_errors(F.col("_v")),
        "shown_id": V.json_id(F.col("_v")),
        **{f: F.try_variant_get("_v", F.lit(f"$.{f}"), "string") for f in SURVEY_FIELDS},
    }).drop("_v")


def valid(checked: DataFrame) -> DataFrame:
    """Records without errors, with the text stripped."""
    return (
        checked.filter(F.size("errors") == 0)
        .withColumn("text", strip(F.col("text")))
        .drop("errors", "shown_id")
    )


def invalid(checked: DataFrame) -> DataFrame:
    """Records with errors, as they came."""
    return checked.filter(F.size("errors") > 0)


def split(checked: DataFrame) -> DataFrame:
    """Both sides in one pass, told apart by ``split``."""
    ok = F.size("errors") == 0
    return checked.withColumns({
        "split": F.when(ok, "valid").otherwise("invalid"),
        "text": F.when(ok, strip(F.col("text"))).otherwise(F.col("text")),
    })


def error_lines(checked: DataFrame) -> DataFrame:
    """One line per broken rule: ``pos``, ``err_ord`` and ``error``."""
    # The outer form keeps Spark from computing the errors a second time in a filter.
    exploded = checked.select(
        "pos", "shown_id", F.posexplode_outer("errors").alias("err_ord", "e")
    ).filter(F.col("e").isNotNull())
    line = V.error_line(F.col("pos"), F.col("shown_id"), F.col("e"))
    return exploded.select("pos", "err_ord", line.alias("error"))


def first_errors(checked: DataFrame, n: int = K.REPORTED_ERRORS) -> DataFrame:
    return error_lines(checked).orderBy("pos", "err_ord").limit(n)


def summary(checked: DataFrame) -> DataFrame:
    """Counts and the pass rate, 0.0 when there are no records."""
    ok = F.size("errors") == 0
    return checked.agg(
        F.count_if(ok).alias("valid_count"),
        F.count_if(~ok).alias("invalid_count"),
        F.round(
            F.coalesce(
                F.try_divide(F.count_if(ok).cast("double"), F.count(F.lit(1))), F.lit(0.0)
            ), 4,
        ).alias("pass_rate"),
    )


def require_valid(checked: DataFrame, shown: int = K.GATE_ERRORS) -> DataFrame:
    """The valid records; raises with the first errors if there is not a single one."""
    kept = valid(checked)
    if kept.select("pos").isEmpty():
        raise NoValidRecords([r["error"] for r in first_errors(checked, shown).collect()])
    return kept
