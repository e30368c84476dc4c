from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of, survey
from voxtally import constants as K
from voxtally.operators import merge, stats
from voxtally.operators.joins import lookup_join


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_with_a_hot_key(spark, how):
    rows = spark.range(300).select(
        F.col("id").alias("pos"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None)
        .otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("key"),
    )
    lookup = spark.createDataFrame(
        [("hot", -1)] + [(f"k{i}", i) for i in range(20)], "key string, v int"
    )
    want = sorted(map(tuple, rows.join(lookup, "key", how).select("pos", "key", "v").collect()), key=str)
    got = lookup_join(rows, lookup, "key", how)
    assert sorted(map(tuple, got.select("pos", "key", "v").collect()), key=str) == want


def test_hot_key_is_split(spark):
    """Also where the lookup comes from an aggregate by the same key."""
    rows = spark.range(60_000).select(
        F.col("id").alias("pos"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key")
    )
    lookup = rows.groupBy("key").agg(F.max("pos").alias("v"))
    low = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k) for k in low}
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        joined = lookup_join(rows.repartition(8), lookup, "key")
        assert len(joined.collect()) == 60_000
        assert "skew=true" in plan_of(joined)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_last_label_wins_and_every_record_stays(spark):
    records = survey(spark, [(0, "a", "one", "X"), (1, "b", "two", "Y"), (2, "a", "three", "Z"), (3, "c", "four")])
    labels = merge.last_by_id(records.filter("response_id <> 'c'"), ["text"]).withColumnRenamed("text", "label")
    got = merge.enrich(records, labels).orderBy("pos").collect()
    assert [(r["pos"], r["department"], r["label"]) for r in got] == [
        (0, "X", "three"), (1, "Y", "two"), (2, "Z", "three"),
    ]


def test_topic_defaults(spark):
    records = survey(spark, [(0, "a", "one"), (1, "b", "two")])
    topics = spark.createDataFrame(
        [("a", 3, "x / y", ["x", "y"])],
        "response_id string, topic_id int, topic_label string, topic_keywords array<string>",
    )
    got = merge.with_topics(records, topics).orderBy("pos").collect()
    assert [(r["topic_id"], r["topic_label"], r["topic_keywords"]) for r in got] == [
        (3, "x / y", ["x", "y"]), (-1, "N/A", []),
    ]
    assert merge.with_topics(records, None).first()["topic_id"] == -1


ROWS = [
    (0, "positive", "communication", 0.15, "low", "HR", "no_action"),
    (1, "negative", "wellbeing_safety", 0.7, "high", "", "monitor"),
    (2, "negative", "communication", 0.5555, "high", None, "urgent_action"),
    (3, "very_negative", "career_growth", 0.9, "critical", "HR", "urgent_action"),
    (4, "neutral", "wellbeing_safety", 0.3, "low", "Legal", "no_action"),
]


def counts(spark, rows=ROWS):
    return stats.cohort_counts(spark.createDataFrame(
        rows,
        "pos long, sentiment string, primary_theme string, burnout_risk_score double, "
        "burnout_risk_level string, department string, action_signal string",
    ))


def test_cohort_stats(spark):
    row = stats.cohort_stats(counts(spark)).first().asDict()
    assert row["total"] == 5
    assert row["sentiment_dist"] == Counter(r[1] for r in ROWS)
    assert row["theme_distribution"] == Counter(r[2] for r in ROWS)
    assert row["burnout_summary"] == {"low": 2, "high": 2, "critical": 1}
    assert row["department_distribution"] == {"HR": 2, "Legal": 1}
    assert row["top_themes"] == ["communication", "wellbeing_safety", "career_growth"]
    assert row["avg_burnout_score"] == 0.521 and row["urgent_action_count"] == 2
    assert len(row) == 9


def test_top_values_go_by_first_appearance_and_stop_at_five(spark):
    rows = [(i, "neutral", t, 0.1, "low", None, "monitor") for i, t in enumerate("gfedcbaab")]
    top = stats.top_values(stats.frequencies(counts(spark, rows)), "theme").collect()
    assert [(r["value"], r["n"]) for r in top] == [("b", 2), ("a", 2), ("g", 1), ("f", 1), ("e", 1)]


def test_empty_cohort(spark):
    empty = counts(spark, [])
    assert stats.cohort_stats(empty).count() == 0
    assert stats.kpi_tiles(empty).first()["total_analyzed"] == 0
    with pytest.raises(ValueError):
        stats.require_cohort(empty)


def test_kpis(spark):
    assert stats.kpi_tiles(counts(spark)).first().asDict() == {
        "total_analyzed": 5, "urgent_actions": 2, "high_critical_burnout": 3, "avg_burnout_score": 0.52,
    }


def test_histogram_is_cumulative(spark):
    log = spark.createDataFrame([("a", 0.05), ("a", 0.06), ("a", 99.0), ("b", 1.0)], "op string, v double")
    rows = stats.histogram(log, "v", K.REQUEST_BUCKETS, ["op"]).filter("op = 'a'").collect()
    got = {r["le"]: r["bucket_count"] for r in rows}
    assert got["0.05"] == 1 and got["0.1"] == 2 and got["10.0"] == 2 and got["+Inf"] == 3
    assert rows[0]["observations"] == 3 and rows[0]["total"] == 99.11


def test_counters_ride_along(spark):
    from pyspark.sql import Observation

    rows = spark.createDataFrame(
        [("high", "monitor", True), ("low", "urgent_action", False)],
        "burnout_risk_level string, action_signal string, pii_detected boolean",
    )
    seen = Observation("run")
    assert stats.observe_counters(rows, seen).count() == 2
    assert seen.get == {
        "surveys_analyzed": 2, "burnout_high_risk": 1, "urgent_actions": 1, "pii_detected": 1,
    }
    assert stats.business_counters(rows, spark.range(3)).first().asDict() == {**seen.get, "insights_generated": 3}
