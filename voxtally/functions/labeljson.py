"""Reading a labeller's JSON answers, with the rules for missing and bad values."""

from pyspark.sql import Column, functions as F

from voxtally import constants as K
from voxtally.functions.text import bind
from voxtally.schemas import LABEL_FIELDS

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_EMPTY = "array<string>"


def _get(item, field, kind):
    return F.try_variant_get(item, f"$.{field}", kind)


def _text(item, field):
    """(value, is it acceptable) of a string field; a missing one takes its default."""
    raw = _get(item, field, "variant")
    value = F.when(raw.isNull(), K.LABEL_DEFAULTS[field]).otherwise(_get(item, field, "string"))
    return value, raw.isNull() | (F.schema_of_variant(raw) == "STRING")


def _choice(item, field, allowed):
    value, ok = _text(item, field)
    return value, ok & F.coalesce(value.isin(allowed), F.lit(False))


def _share(item, field):
    raw = _get(item, field, "variant")
    shown = _get(item, field, "string")
    number = (
        F.when(raw.isNull(), F.lit(K.LABEL_DEFAULTS[field]))
        .when(F.schema_of_variant(raw) == "BOOLEAN",
              _get(item, field, "boolean").cast("int").cast("double"))
        .when(shown.rlike(_NUMBER), shown.try_cast("double"))
    )
    return number, F.coalesce(number.between(0.0, 1.0), F.lit(False))


def _strings(item, field):
    raw = _get(item, field, "variant")
    value = F.when(raw.isNull(), F.array().cast(_EMPTY)).otherwise(_get(item, field, _EMPTY))
    kind = F.schema_of_variant(raw)
    listed = (kind == "ARRAY<STRING>") | ((kind == "ARRAY<VOID>") & (F.size(value) == 0))
    whole = ~F.exists(value, lambda x: x.isNull())
    return value, raw.isNull() | F.coalesce(listed & whole, F.lit(False))


def label_of(item: Column) -> Column:
    """``struct<ok, label fields>`` of one answer given as VARIANT."""
    parts = {
        "sentiment": _choice(item, "sentiment", K.SENTIMENTS),
        "sentiment_confidence": _share(item, "sentiment_confidence"),
        "primary_theme": _text(item, "primary_theme"),
        "secondary_themes": _strings(item, "secondary_themes"),
        "key_phrases": _strings(item, "key_phrases"),
        "summary_en": _text(item, "summary_en"),
        "emotion_tags": _strings(item, "emotion_tags"),
        "action_signal": _choice(item, "action_signal", K.ACTIONS),
        "language_detected": _text(item, "language_detected"),
    }
    ok = F.schema_of_variant(item).startswith("OBJECT")
    for _, acceptable in parts.values():
        ok = ok & acceptable
    return F.struct(
        F.coalesce(ok, F.lit(False)).alias("ok"),
        *[parts[f][0].alias(f) for f in LABEL_FIELDS],
    )


def fallback_label() -> Column:
    values = {f: F.lit(v) for f, v in K.LABEL_FALLBACK.items()}
    return F.struct(
        F.lit(False).alias("ok"),
        *[values.get(f, F.array().cast(_EMPTY)).alias(f) for f in LABEL_FIELDS],
    )


def chunk_labels(ids: Column, raw: Column) -> Column:
    """Labels of a chunk's ids from its raw answer, aligned by position.

    One unreadable answer, or an answer that is no JSON list, gives every id of the
    chunk the fallback. Answers past the last id are ignored; ids past the last
    answer get no label.
    """
    answers = F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>")

    def named(id_, label):
        return F.struct(
            id_.alias("response_id"), *[label[f].alias(f) for f in LABEL_FIELDS],
        )

    fallbacks = F.transform(ids, lambda i: named(i, fallback_label()))

    def aligned(read):
        return F.when(
            F.forall(read, lambda l: l["ok"]),
            F.transform(read, lambda l, k: named(F.get(ids, k), l)),
        ).otherwise(fallbacks)

    used = F.slice(answers, F.lit(1), F.size(ids))
    return F.when(answers.isNull(), fallbacks).otherwise(
        bind(F.transform(used, label_of), aligned)
    )
