import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of, survey
from voxtally.operators import labelling, topics, validate
from voxtally.plans import analysis
from voxtally.schemas import ANALYZED_FIELDS
from voxtally.sources import tables

ROWS = [
    (0, "a", "I love my team.", "HR"), (1, "b", "no"), (2, "a", "The workload is unbearable.", "Legal"),
    (3, "c", "Mail x@y.org about pay"),
]


def rows(df):
    return {r["pos"]: r for r in df.collect()}


def test_last_text_counts_for_every_record_of_an_id(spark):
    got = rows(analysis.analyze(survey(spark, ROWS)))
    assert set(got) == {0, 2, 3}
    assert got[0]["anonymized_text"] == got[2]["anonymized_text"] == "The workload is unbearable."
    assert (got[0]["department"], got[2]["department"]) == ("HR", "Legal")
    assert got[0]["sentiment"] == got[2]["sentiment"] == "very_negative"
    assert got[3]["anonymized_text"] == "Mail [EMAIL] about pay"
    assert got[3]["topic_id"] == -1 and got[3]["topic_label"] == "N/A"


def test_unique_ids_give_the_same_without_a_shuffle(spark):
    unique = survey(spark, [r for r in ROWS if r[0] != 0])
    fast = analysis.analyze(unique, unique_ids=True)
    assert fast.columns == ["pos", *ANALYZED_FIELDS]
    assert rows(fast) == rows(analysis.analyze(unique).select(fast.columns))
    assert "Exchange" not in plan_of(fast)


def test_external_model(spark):
    def label(asked):
        return json.dumps([
            {"sentiment": "negative", "summary_en": a["text"], "action_signal": "monitor"} for a in asked
        ])

    got = rows(analysis.analyze(survey(spark, ROWS), analysis.model_labeller(label)))
    assert {p: r["summary_en"] for p, r in got.items()} == {
        0: "The workload is unbearable.", 2: "The workload is unbearable.", 3: "Mail [EMAIL] about pay",
    }
    assert got[3]["burnout_risk_score"] == 0.41


def test_topics_only_with_ten_records(spark):
    few = survey(spark, [(i, f"r{i}", f"the same text {i}") for i in range(9)])
    assert {r["topic_id"] for r in analysis.analyze(few, run_topics=True).collect()} == {-1}
    many = survey(spark, [
        (i, f"r{i}", "salary bonus pay" if i % 2 else "laptop software tools") for i in range(40)
    ])
    got = analysis.analyze(many, run_topics=True).collect()
    assert len(got) == 40
    kept = [r for r in got if r["topic_id"] >= 0]
    assert kept and all(1 <= len(r["topic_keywords"]) <= 5 for r in kept)
    for r in kept:
        words = {"salary", "bonus", "pay"} if r["pos"] % 2 else {"laptop", "software", "tools"}
        assert set(r["topic_keywords"]) == words


@pytest.mark.parametrize("unique", [True, False])
def test_a_topic_run_masks_and_labels_every_record_once(spark, unique):
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    once = F.udf(read, "string").asNondeterministic()

    def label(rows):
        return labelling.lexicon_labels(rows.withColumn("anonymized_text", once("anonymized_text")), "anonymized_text")

    many = survey(spark, [
        (i, f"r{i}", "salary bonus pay" if i % 2 else "laptop software tools") for i in range(40)
    ])
    got = analysis.analyze(many, label, run_topics=True, unique_ids=unique).collect()
    assert len(got) == 40 and len({(r["pos"] % 2, r["topic_id"]) for r in got if r["topic_id"] >= 0}) == 2
    assert seen.value == 40


def test_answers_are_dealt_to_as_many_tasks_for_each_core(spark, monkeypatch):
    rows = survey(spark, [(i, f"r{i}", "x" * 100) for i in range(10)])
    cores = spark.sparkContext.defaultParallelism
    assert analysis._tasks(rows) == analysis._tasks(rows.limit(0)) == cores
    monkeypatch.setattr(analysis, "TOPIC_TASK", 60)
    assert analysis._tasks(rows) == cores * -(-1000 // (cores * 60))


def test_report_on_a_cohort(spark, sample):
    row = analysis.report_on(analysis.analyze(sample), tables.kb_seed(spark)).first()
    assert row["total_responses"] == 3 and len(row["key_findings"]) == 5
    with pytest.raises(ValueError):
        analysis.report_on(analysis.analyze(sample.limit(0)), tables.kb_seed(spark))


def test_topics_that_cannot_be_fitted_are_skipped(spark, monkeypatch):
    def fail(*_):
        raise topics.NoTopics("no room")

    monkeypatch.setattr(analysis, "text_topics", fail)
    many = survey(spark, [(i, f"r{i}", f"the same text {i}") for i in range(12)])
    with pytest.warns(UserWarning, match="no room"):
        got = analysis.analyze(many, run_topics=True)
    assert {r["topic_label"] for r in got.collect()} == {"N/A"}

    def lost(*_):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(analysis, "text_topics", lost)
    with pytest.raises(RuntimeError, match="executor lost"):
        analysis.analyze(many, run_topics=True)


def test_topics_are_kept_and_used_again(spark, tmp_path):
    def table(rows):
        return spark.createDataFrame(rows, "response_id string, text string")

    known = table([(f"a{i}", "salary bonus pay" if i % 2 else "laptop software tools") for i in range(40)])
    path, cache = str(tmp_path / "model"), str(tmp_path / "cache")
    fitted = {r["response_id"]: r for r in analysis.text_topics(known, path=path, cache=cache).collect()}
    new = table([("x", "salary bonus pay"), ("y", "software laptop laptop"), ("z", "salary bonus pay")])
    got = {r["response_id"]: r for r in analysis.predict_texts(new, path, cache=cache).collect()}
    for one, other in (("x", "a1"), ("z", "a1"), ("y", "a0")):
        assert got[one]["topic_id"] == fitted[other]["topic_id"] >= 0
        assert set(got[one]["topic_keywords"]) == set(fitted[other]["topic_keywords"])
        assert 0 < got[one]["topic_confidence"] <= 1
    fields = ("topic_label", "topic_keywords", "topic_confidence")
    assert len({tuple(map(str, (r[f] for f in fields))) for r in (got["x"], got["z"], fitted["a1"])}) == 1
    assert spark.read.parquet(cache).count() == 3  # three different texts


def test_gate(spark):
    with pytest.raises(validate.NoValidRecords):
        analysis.analyze(survey(spark, [(0, "a", "")]), gate=True)
    assert analysis.analyze(survey(spark, [(0, "a", "")])).count() == 0


def test_an_answer_without_a_word_is_in_no_topic(spark):
    """Its vector has no length, hence no cosine."""
    many = survey(spark, [
        (i, f"r{i}", "salary bonus pay" if i % 2 else "laptop software tools") for i in range(40)
    ] + [(40, "digits", "12345 67890 2024")])
    got = rows(analysis.analyze(many, run_topics=True, unique_ids=True))
    assert got[40]["topic_id"] == -1 and len(got) == 41
    assert {got[0]["topic_id"], got[1]["topic_id"]} == {0, 1}
    none = survey(spark, [(i, f"r{i}", f"12345 {10000 + i}") for i in range(12)])
    with pytest.warns(UserWarning, match="no vector has a length"):
        assert {r["topic_id"] for r in analysis.analyze(none, run_topics=True).collect()} == {-1}
