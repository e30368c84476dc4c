"""Every query against its SQL on the small tables, and checks on plans."""

import duckdb
import pytest

from __spark_entry__ import entry
from tests.conftest import SMALL, plan_of
from voxtally.plans.oracle import ORACLE
from voxtally.plans.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
WITHOUT_SQL = {"analyze_topics", "cosine_topk_index"}
#: A model's hook, matrix products, and files cut into records.
PYTHON = {
    "label_hook", "label_chunks", "label_ledger", "cosine_topk", "cosine_topk_lsh", "cosine_topk_index", "text_topk",
    "csv_upload", "json_upload", "topic_sparse",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


def test_names():
    assert set(ORACLE) == set(QUERIES) - WITHOUT_SQL


def check_plan(df, name):
    """No Python workers but for the hook, and no products of tables."""
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert name in PYTHON or not any(x in plan for x in ("EvalPython", "InPandas", "InArrow"))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    check_plan(df, name)
    columns = sorted(df.columns)
    got = sorted(tuple(repr(r[c]) for c in columns) for r in df.collect())
    relation = duck.sql(ORACLE[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert got == sorted(tuple(repr(r[i]) for i in at) for r in relation.fetchall())


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    check_plan(df, name)
    assert df.count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0


ROW_WISE = [
    "analyze", "analyze_lexicon", "validate_rows", "pii_mask", "pii_types", "pii_cards", "pii_iban",
    "burnout_score", "burnout_factors", "sentiment_lexicon", "theme_tags", "emotion_tags",
    "action_signal", "detect_language", "lead_sentence", "synth_survey", "urgent_rows",
]


@pytest.mark.parametrize("name", ROW_WISE)
def test_row_wise_queries_shuffle_nothing(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    shuffles = [
        line for line in plan.split("\n")
        # The spread of a one-file table over the local cores, and a count for one value.
        if "Exchange" in line and "REPARTITION_BY_NUM" not in line and "SinglePartition" not in line
    ]
    assert not shuffles
    assert "Join" not in plan and "BatchEvalPython" not in plan and "ArrowEval" not in plan


def test_columns_are_pruned(spark):
    plan = plan_of(QUERIES["latency_histogram"](spark, SMALL))
    assert "ReadSchema: struct<event_type:string,value:double>" in plan


def test_top_k_is_limited_before_the_shuffle(spark):
    for name in ("topic_keywords", "key_phrases"):
        assert "WindowGroupLimit" in plan_of(QUERIES[name](spark, SMALL))
    for name in ("preview", "top_themes", "validate_errors_top50"):
        assert "TakeOrderedAndProject" in plan_of(QUERIES[name](spark, SMALL))
