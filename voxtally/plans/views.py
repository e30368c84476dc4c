"""Survey views over the input tables.

The tables hold no survey answers, so answers are documents, and their labels are drawn by
whole-number arithmetic on the document number, which SQL can repeat.
"""

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxtally import constants as K
from voxtally.functions.draws import draw, pick, weighted
from voxtally.functions.lexical import action_signal
from voxtally.lexicon import DEFAULT
from voxtally.plans.analysis import analyze
from voxtally.sources.tables import read_table

# Emotion words the labels are drawn from: those that score and five that do not.
EMOTIONS = K.BURNOUT_EMOTIONS + K.PROTECTIVE_EMOTIONS + [
    "happy", "proud", "curious", "calm", "surprised",
]

# The documents are invented prose with real function words only, so the lexicon the
# queries use also lists some of those.
PROSE = replace(
    DEFAULT,
    positive={2: DEFAULT.positive[2] + ["with", "pour", "für", "con"],
              1: DEFAULT.positive[1] + ["the", "les", "die", "los"]},
    negative={2: DEFAULT.negative[2] + ["have", "pas", "nicht", "no"],
              1: DEFAULT.negative[1] + ["of", "des", "der", "de"]},
    themes={
        theme: DEFAULT.themes[theme] + words
        for theme, words in zip(K.THEMES, [
            ["and", "und"], ["to", "zu"], ["in", "en"], ["is", "ist", "es"], ["that", "que"],
            ["it", "le"], ["for", "par"], ["was", "la"], ["are", "den"], ["this", "un"],
        ])
    },
    emotions={
        **DEFAULT.emotions,
        "stressed": DEFAULT.emotions["stressed"] + ["not", "mit"],
        "hopeful": DEFAULT.emotions["hopeful"] + ["be", "dans"],
        "calm": ["on", "sur", "por"],
        "curious": ["from", "von", "qui"],
    },
    leaving=DEFAULT.leaving + [r"\bto be\b", r"\bque la\b"],
)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents")


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings")


def response_id():
    return F.concat(F.lit("d"), F.col("doc_id"))


def survey_raw(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(
        F.col("doc_id").alias("pos"),
        response_id().alias("response_id"),
        "text",
        pick(K.DEPARTMENTS, (F.col("doc_id") % 11).cast("int")).alias("department"),
        F.col("lang").alias("language"),
        pick(list(K.THEMES), (F.col("doc_id") % 10).cast("int")).alias("survey_theme"),
    )


def with_drawn_labels(survey: DataFrame) -> DataFrame:
    """Adds the label columns, drawn from ``pos``."""
    themes = list(K.THEMES)

    def d(k, p, m):
        return draw("pos", k, p, m)

    def cased(word):
        return F.when(
            F.col("pos") % 2 == 1, F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))
        ).otherwise(word)

    drawn = F.array(*[
        pick(EMOTIONS, d(k, p, len(EMOTIONS))) for k, p in [(7, 19993), (8, 14057), (10, 31337)]
    ])
    none = F.array().cast("array<string>")
    return survey.withColumns({
        "sentiment": weighted(K.SENTIMENT_PERCENT, d(1, 7919, 100)),
        "sentiment_confidence": d(9, 90007, 101) / F.lit(100.0),
        "primary_theme": pick(themes, d(2, 62711, 10)),
        "secondary_themes": F.slice(
            F.array(pick(themes, d(4, 45911, 10)), pick(themes, d(5, 35713, 10))),
            F.lit(1), d(3, 53813, 3),
        ),
        "key_phrases": none,
        "summary_en": F.lit(""),
        "emotion_tags": F.transform(F.slice(drawn, F.lit(1), d(6, 27413, 4)), cased),
        "language_detected": F.col("language"),
    }).withColumn("action_signal", action_signal(
        F.col("sentiment"),
        F.array_insert("secondary_themes", 1, F.col("primary_theme")),
        F.lit(False),
    ))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return with_drawn_labels(survey_raw(spark, sf))


def analyzed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Result rows with drawn labels. Document numbers are unique and a label belongs to its
    own row, so this is one stage without a shuffle."""
    return analyze(survey_raw(spark, sf), with_drawn_labels, unique_ids=True)


def prose_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the vector and class of the same number, null where there is none."""
    vectors = embeddings(spark, sf).select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return documents(spark, sf).select("doc_id", "text").join(vectors, "doc_id", "left")
