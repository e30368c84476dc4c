"""The whole analysis of a survey table, and the report on its result."""

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from voxtally.operators import burnout, labelling, masking, merge, report, stats, topics, validate
from voxtally.schemas import LABEL_FIELDS
from voxtally.sources import tables
from voxtally.sources.checkpoints import settle

Labeller = Callable[[DataFrame], DataFrame]

#: Characters of the answers that a task of the topic run reads.
TOPIC_TASK = 100_000_000


def lexicon_labeller(rows: DataFrame) -> DataFrame:
    return labelling.lexicon_labels(rows, "anonymized_text")


def model_labeller(fn, **options) -> Labeller:
    """Labels from an external model, see ``labelling.ask_model``. Rows it gives no label drop
    out. The answers are kept, so that no later step asks again."""

    def label(rows: DataFrame) -> DataFrame:
        answers = settle(labelling.read_answers(labelling.ask_model(rows, fn, **options)))
        # Rows and answers have one row per id here.
        return rows.join(answers, "response_id")

    return label


def analyze(
    survey: DataFrame,
    label: Labeller = lexicon_labeller,
    entities: list[str] = masking.EVERYTHING,
    run_topics: bool = False,
    unique_ids: bool = False,
    gate: bool = False,
) -> DataFrame:
    """The 18 result columns and ``pos`` for every valid record that gets a label.

    ``survey`` has the declared columns and ``pos``. Where an id occurs more than once, its
    last text is masked, labelled and scored, and all its records get that result with their
    own department. With ``unique_ids`` (a promise of the caller) there is nothing to look
    up, and row-wise labels make the whole analysis one stage without a shuffle.

    ``run_topics`` needs at least ten valid records; with fewer, or when there is no topic in
    them, the topic columns keep their defaults. With ``gate`` a survey without a single valid
    record raises its first errors instead of giving an empty table.
    """
    checked = validate.check_rows(survey)
    valid = validate.require_valid(checked) if gate else validate.valid(checked)
    if unique_ids:
        rows = burnout.score(label(masking.mask(valid, entities=entities)))
    else:
        texts = masking.mask(merge.last_by_id(valid, ["text"]), entities=entities)
        scored = burnout.score(label(texts.select("response_id", "anonymized_text")))
        rows = merge.enrich(
            valid.select("pos", "response_id", "department"),
            scored.select(
                "response_id", "anonymized_text", *LABEL_FIELDS,
                "risk_score", "risk_level", "risk_factors",
            ),
        )
    assigned = None
    if run_topics and topics.enough_rows(valid.select("pos")):
        # Written once: the topic run reads the masked texts several times, and the result once more.
        rows = rows.select(
            "pos", "response_id", "department", "anonymized_text", *LABEL_FIELDS,
            "risk_score", "risk_level", "risk_factors",
        )
        if unique_ids:
            rows = settle(rows.repartition(_tasks(survey), "response_id"))
            texts = rows.select("response_id", F.col("anonymized_text").alias("text"))
        else:
            rows = settle(rows)
            texts = settle(rows.groupBy("response_id").agg(F.min("anonymized_text").alias("text")))
        try:
            assigned = text_topics(texts)
        except topics.NoTopics as problem:
            warnings.warn(f"topics skipped: {problem}")
    return merge.result(merge.with_topics(rows, assigned))


def _tasks(survey: DataFrame) -> int:
    """Tasks of the topic run, whose every round waits for the last one: as many for each core."""
    cores = survey.sparkSession.sparkContext.defaultParallelism
    characters = survey.agg(F.sum(F.length("text"))).first()[0] or 0
    return cores * max(1, -(-characters // (cores * TOPIC_TASK)))


def processed(checked: DataFrame, analyzed: DataFrame) -> DataFrame:
    """``total_processed`` analysed records and the ``validation_errors`` of all records, in one
    row."""
    done = analyzed.agg(F.count(F.lit(1)))
    return checked.agg(F.sum(F.size("errors")).alias("validation_errors")).select(
        done.scalar().alias("total_processed"), "validation_errors"
    )


def text_topics(
    texts: DataFrame, id_: str = "response_id", path: str | None = None, cache: str | None = None
) -> DataFrame:
    """Topic table of ``(id, text)`` from hashed TF-IDF vectors, kept at ``path`` for
    ``predict_texts`` if given.

    The vectors are written once: clustering reads them again in every round, and must not
    go back to the texts for that, nor start over when an executor is lost.
    """
    if cache is None:
        encoder, vectors = topics.fit_encode(texts, id_)
    else:
        encoder = topics.fit_encoder(texts)
        vectors = settle(_vectors(encoder, texts, id_, cache))
    members, found = topics.fit(texts, vectors, id_)
    if path:
        tables.save_topic_model(encoder, found, path)
        found = tables.load_topic_model(texts.sparkSession, path)[1]
    return topics.members_described(members, found, id_)


def predict_texts(
    texts: DataFrame, path: str, id_: str = "response_id", cache: str | None = None
) -> DataFrame:
    """Topic table of other texts by the model at ``path``. Texts with a vector in ``cache`` are
    not encoded again."""
    encoder, found = tables.load_topic_model(texts.sparkSession, path)
    return topics.assign_new(_vectors(encoder, texts, id_, cache), found, id_)


def _vectors(encoder, texts: DataFrame, id_: str, cache: str | None) -> DataFrame:
    """``(id, features)``."""
    if cache is None:
        return topics.encode(encoder, texts).select(id_, "features")

    def encode(misses: DataFrame) -> DataFrame:
        return topics.encode(encoder, misses).withColumnRenamed("features", "vec")

    found = tables.with_vectors(texts.sparkSession, texts, cache, encoder.uid, encode)
    return found.select(id_, F.col("vec").alias("features"))


def report_on(analyzed: DataFrame, kb: DataFrame) -> DataFrame:
    """The report row of a cohort; an empty one is an error."""
    counts = settle(stats.cohort_counts(analyzed))
    return report.report(stats.require_cohort(counts), kb)
