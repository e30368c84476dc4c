"""Declared table schemas; nothing is ever inferred."""

from pyspark.sql import types as T

_s, _d, _i = T.StringType(), T.DoubleType(), T.IntegerType()
_list = T.ArrayType(_s)

SURVEY_FIELDS = ["response_id", "text", "department", "language", "employee_id", "survey_theme"]
REQUIRED_FIELDS = ["response_id", "text"]

SURVEY = T.StructType([T.StructField(f, _s) for f in SURVEY_FIELDS])

LABELS = T.StructType([
    T.StructField("response_id", _s),
    T.StructField("sentiment", _s),
    T.StructField("sentiment_confidence", _d),
    T.StructField("primary_theme", _s),
    T.StructField("secondary_themes", _list),
    T.StructField("key_phrases", _list),
    T.StructField("summary_en", _s),
    T.StructField("emotion_tags", _list),
    T.StructField("action_signal", _s),
    T.StructField("language_detected", _s),
])
LABEL_FIELDS = LABELS.fieldNames()[1:]

KB = T.StructType([
    T.StructField("id", _s),
    T.StructField("topic", _s),
    T.StructField("text", _s),
])

MASKED_FIELDS = [
    "response_id", "original_text", "anonymized_text", "pii_detected", "pii_types",
    "department", "language", "survey_theme",
]
BURNOUT_FIELDS = ["response_id", "risk_score", "risk_level", "risk_factors", "protective_factors"]
TOPIC_FIELDS = ["response_id", "topic_id", "topic_label", "topic_keywords", "topic_confidence"]
ANALYZED_FIELDS = [
    "response_id", "anonymized_text", "department", "language_detected",
    "sentiment", "sentiment_confidence", "primary_theme", "secondary_themes",
    "key_phrases", "summary_en", "emotion_tags", "action_signal",
    "topic_id", "topic_label", "topic_keywords",
    "burnout_risk_score", "burnout_risk_level", "burnout_risk_factors",
]
