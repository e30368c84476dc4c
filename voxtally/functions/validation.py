"""Record rules as one ``array<struct<loc, msg>>`` column, in field order."""

from pyspark.sql import Column, functions as F

from voxtally import constants as K
from voxtally.functions.text import compact, strip
from voxtally.schemas import REQUIRED_FIELDS, SURVEY_FIELDS


def _error(field: str, msg) -> Column:
    return F.struct(
        F.lit(field).alias("loc"),
        (F.lit(msg) if isinstance(msg, str) else msg).alias("msg"),
    )


def text_problem(text: Column) -> Column:
    """Message of the first text rule broken, else null. Length is taken before stripping."""
    return (
        F.when(F.length(text) < K.TEXT_MIN, K.MSG_SHORT)
        .when(F.length(text) > K.TEXT_MAX, K.MSG_LONG)
        .when(F.length(strip(text)) == 0, K.MSG_BLANK)
    )


def row_errors(response_id: Column, text: Column) -> Column:
    """Errors of a typed row, where a null is a missing field."""
    msg = F.when(text.isNull(), F.lit(K.MSG_MISSING)).otherwise(text_problem(text))
    return compact(
        F.when(response_id.isNull(), _error("response_id", K.MSG_MISSING)),
        F.when(msg.isNotNull(), _error("text", msg)),
    )


def json_errors(record: Column) -> Column:
    """Errors of a JSON record given as VARIANT: a missing key, a null and a number differ."""

    def problem(field):
        value = F.try_variant_get(record, f"$.{field}", "variant")
        kind = F.schema_of_variant(value)
        missing = value.isNull()
        not_string = ~F.is_variant_null(value) & (kind != "STRING")
        if field in REQUIRED_FIELDS:
            wrong = F.when(missing, K.MSG_MISSING).when(
                F.is_variant_null(value) | (kind != "STRING"), K.MSG_NOT_STRING
            )
        else:
            wrong = F.when(~missing & not_string, K.MSG_NOT_STRING)
        if field == "text":
            wrong = F.coalesce(wrong, text_problem(F.try_variant_get(record, "$.text", "string")))
        return F.when(wrong.isNotNull(), _error(field, wrong))

    return compact(*[problem(f) for f in SURVEY_FIELDS])


def json_id(record: Column) -> Column:
    """The id as an error line shows it."""
    value = F.try_variant_get(record, "$.response_id", "variant")
    return (
        F.when(value.isNull(), "?")
        .when(F.is_variant_null(value), "None")
        .when(
            F.schema_of_variant(value) == "BOOLEAN",
            F.initcap(F.try_variant_get(record, "$.response_id", "string")),
        )
        .otherwise(F.try_variant_get(record, "$.response_id", "string"))
    )


def error_line(pos: Column, shown_id: Column, error: Column) -> Column:
    return F.format_string(
        "Record %d [%s]: ('%s',) — %s", pos, shown_id, error["loc"], error["msg"]
    )
