import math
import random
import re
from collections import Counter

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tests.conftest import plan_of
from voxtally import constants as K
from voxtally.lexicon import DEFAULT
from voxtally.operators import report, retrieval, topics
from voxtally.sources import tables


def blobs(spark, k=4, n=30, dim=8, seed=1):
    """k well separated bundles of vectors, n each, and a few strays."""
    rng = random.Random(seed)
    rows = []
    for c in range(k):
        for _ in range(n):
            rows.append((len(rows), c, [5.0 * (i == c) + rng.gauss(0, 0.2) for i in range(dim)]))
    return spark.createDataFrame(rows, "id int, truth int, embedding array<double>")


def test_clusters_find_separated_groups(spark):
    df = topics.as_features(blobs(spark))
    assigned = topics.fold_small(topics.fit_clusters(df, n_topics=4).transform(df))
    table = Counter((r["truth"], r["topic_id"]) for r in assigned.collect())
    assert sum(max(n for (t, _), n in table.items() if t == truth) for truth in range(4)) >= 110


def test_small_clusters_become_outliers(spark):
    rows = [(i, 7) for i in range(12)] + [(20 + i, 3) for i in range(15)] + [(50 + i, 9) for i in range(4)]
    df = spark.createDataFrame(rows, "id int, cluster int")
    got = {r["cluster"]: r["topic_id"] for r in topics.fold_small(df).collect()}
    assert got == {3: 0, 7: 1, 9: -1}
    capped = {r["cluster"]: r["topic_id"] for r in topics.fold_small(df, n_topics=1).collect()}
    assert capped == {3: 0, 7: -1, 9: -1}


def test_keywords_against_the_formula(spark):
    docs = [("x", "apple apple pear the"), ("x", "apple plum the"), ("y", "car bus the the car"), ("z", "the")]
    df = spark.createDataFrame(docs, "topic_id string, text string")
    words = {}
    for t, text in docs:
        words.setdefault(t, Counter()).update(text.split())
    mean = sum(sum(c.values()) for c in words.values()) / len(words)
    overall = sum(words.values(), Counter())
    want = {
        (t, w): round(n * math.log(1 + mean / overall[w]), 6) for t, c in words.items() for w, n in c.items()
    }
    got = {(r["topic_id"], r["term"]): r["score"] for r in topics.term_scores(df).collect()}
    assert got == pytest.approx(want)
    first = topics.keywords(df).filter("rank = 1 and topic_id = 'x'").first()
    assert first["term"] == "apple"


def test_labels_and_unknown_topics(spark):
    kw = spark.createDataFrame(
        [(0, 2, "b"), (0, 1, "a"), (0, 3, "c"), (0, 4, "d"), (-1, 1, "the")],
        "topic_id int, rank int, term string",
    )
    rows = spark.createDataFrame([(0,), (-1,), (8,)], "topic_id int")
    got = {r["topic_id"]: (r["topic_label"], r["topic_keywords"])
           for r in topics.describe(rows, topics.labels(kw)).collect()}
    assert got == {0: ("a / b / c", ["a", "b", "c", "d"]), -1: ("the", []), 8: ("Topic 8", [])}


def test_prediction_and_confidence(spark):
    df = blobs(spark).withColumn("topic_id", F.when(F.col("id") % 30 == 0, -1).otherwise(F.col("truth")))
    centres = topics.centroids(df)
    predicted = topics.predict(df, centres)
    assert predicted.filter("topic_id <> truth").count() == 0
    scored = topics.confidence(df, centres).collect()
    assert all((r["topic_confidence"] == 0) == (r["topic_id"] == -1) for r in scored)
    assert all(0 <= r["topic_confidence"] <= 1 for r in scored)
    own = [r["topic_confidence"] for r in scored if r["topic_id"] >= 0]
    assert min(own) > 0.4  # e / (e + 3) for right angles to the three others


def test_encoder_and_stored_model(spark, tmp_path):
    texts = spark.createDataFrame([(f"word{'abc'[i % 3]} common text",) for i in range(12)], "text string")
    encoder = topics.fit_encoder(texts, features=32)
    vectors = topics.encode(encoder, texts)
    assert all(abs(r["features"].norm(2) - 1) < 1e-9 for r in vectors.collect())
    path = str(tmp_path / "topics")
    with pytest.raises(RuntimeError):
        tables.load_topic_model(spark, path)
    named = spark.createDataFrame([(0, "a / b / c")], "topic_id int, topic_label string")
    tables.save_topic_model(encoder, named, path)
    model, loaded = tables.load_topic_model(spark, path)
    assert loaded.collect() == named.collect()
    before = [r["features"] for r in vectors.collect()]
    assert [r["features"] for r in topics.encode(model, texts).collect()] == before


def test_encoder_and_vectors_of_one_reading(spark, tmp_path):
    texts = spark.createDataFrame([(i, "pay bonus pay" if i % 2 else f"team spirit {'abc'[i % 3]}") for i in range(9)], "id int, text string")
    encoder, vectors = topics.fit_encode(texts, "id")
    want = {r["id"]: r["features"] for r in topics.encode(topics.fit_encoder(texts), texts).collect()}
    assert {r["id"]: r["features"] for r in vectors.collect()} == want
    encoder.save(str(tmp_path / "encoder"))
    stored = topics.encode(PipelineModel.load(str(tmp_path / "encoder")), texts)
    assert {r["id"]: r["features"] for r in stored.collect()} == want


def test_enough_rows(spark):
    assert topics.enough_rows(spark.range(10)) and not topics.enough_rows(spark.range(9))


# -- retrieval ----------------------------------------------------------------------------


def unit_rows(spark, n=400, dim=16):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, vec array<double>")


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def test_topk_is_exact(spark):
    rows, corpus = unit_rows(spark)
    queries = spark.createDataFrame([(i, v) for i, v in rows[:20]], "query_id int, vec array<double>")
    want = {
        (q, rank): i
        for q, v in rows[:20]
        for rank, i in enumerate(sorted(
            (i for i, _ in rows), key=lambda i: (-round(cosine(v, rows[i][1]), 4), i))[:5], 1)
    }
    exact = {(r["query_id"], r["rank"]): r["id"] for r in retrieval.cosine_topk(corpus, queries, 5).collect()}
    assert exact == want


def test_lsh_finds_most_and_compares_little(spark):
    """Groups of near vectors among many that are far from each other."""
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(32)] for _ in range(150)]
    rows = [(i, [x + rng.gauss(0, 0.15) for x in centres[i % 150]]) for i in range(1500)]
    corpus = spark.createDataFrame(rows, "id int, vec array<double>")
    queries = corpus.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    exact = {(r["query_id"], r["id"]) for r in retrieval.cosine_topk(corpus, queries, 5).collect()}
    near = {(r["query_id"], r["id"]) for r in retrieval.cosine_topk_lsh(corpus, queries, 5).collect()}
    assert len(exact & near) >= 0.9 * len(exact) == 0.9 * 5 * 75
    compared = retrieval.cosine_pairs(corpus, queries, 24, 10).count()
    assert compared <= 0.1 * 1500 * 75


@pytest.mark.parametrize("given", [{}, {"tables": 24, "bits": 4}])  # by default, as registered
def test_lsh_finds_most_of_the_embeddings(spark, given):
    """Rows whose id is divisible by 20, against all rows."""
    corpus = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec")
    )
    queries = corpus.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    exact = {(r["query_id"], r["id"]) for r in retrieval.cosine_topk(corpus, queries).collect()}
    near = {(r["query_id"], r["id"]) for r in retrieval.cosine_topk_lsh(corpus, queries, **given).collect()}
    assert len(exact & near) >= 0.9 * len(exact) > 0


def test_odd_vectors_get_no_keys(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None])], "id int, vec array<double>")
    keys = retrieval._sized_keys(rows.coalesce(1), "id", 3, 2).collect()
    assert {(r["id"], r["size"]) for r in keys} == {(1, 2), (4, 1)} and len(keys) == 6
    assert retrieval._sized_keys(rows.limit(0), "id", 3, 2).collect() == []


def test_odd_vectors_take_no_others_along(spark):
    """A short and a long vector lead the only batch; each is found by a query of its size."""
    good = [(i, [math.cos(i), math.sin(i), 1.0]) for i in range(20)]
    odd = [(100, [1.0, 2.0]), (101, [1.0] * 5), (102, None), (103, []), (104, [1.0, None, 2.0])]
    corpus = spark.createDataFrame(odd + good, "id int, vec array<double>").coalesce(1)
    queries = spark.createDataFrame([(0, [2.0, 4.0]), (1, good[3][1])], "query_id int, vec array<double>")
    found = {(r["query_id"], r["id"]) for r in retrieval.cosine_topk_lsh(corpus, queries, 1).collect()}
    assert found == {(0, 100), (1, 3)}
    odd_rows = {r["reason"]: r["n"] for r in retrieval.malformed(corpus, queries).collect()}
    assert odd_rows == {"no vector": 2, "null entry": 1, "other size": 1}


def test_default_k_and_single_query(spark):
    rows, corpus = unit_rows(spark, 50)
    for k in (None, 0):
        best = retrieval.nearest(corpus, rows[7][1], k).collect()
        assert len(best) == K.RETRIEVE_K and best[0]["id"] == 7
    assert "TakeOrderedAndProject" in plan_of(retrieval.nearest(corpus, rows[7][1]))


def test_a_thousand_queries_are_one_plan(spark):
    rows, corpus = unit_rows(spark, 60)
    queries = spark.createDataFrame(
        [(n, rows[n % 60][1]) for n in range(1000)], "query_id int, vec array<double>"
    )
    found = retrieval.cosine_topk(corpus, queries, 1)
    assert "Union" not in plan_of(found) and "CartesianProduct" not in plan_of(found)
    assert {(r["query_id"], r["id"]) for r in found.collect()} == {(n, n % 60) for n in range(1000)}


def lnc_ltc(docs, queries, k):
    stop = set(DEFAULT.stop_words)

    def count(text):
        return Counter(w for w in re.findall("[a-z]+", text.lower()) if w not in stop)

    counted = {i: count(t) for i, t in docs}
    frequency = Counter(w for c in counted.values() for w in c)
    out = {}
    for q, text in queries:
        weights = {w: (1 + math.log(n)) * math.log(len(docs) / frequency[w])
                   for w, n in count(text).items() if frequency[w]}
        qlen = math.sqrt(sum(w * w for w in weights.values()))
        scores = {}
        for i, c in counted.items():
            dlen = math.sqrt(sum((1 + math.log(n)) ** 2 for n in c.values()))
            dot = sum(w * (1 + math.log(c[t])) for t, w in weights.items() if t in c)
            if dot > 0:
                scores[i] = round(dot / (dlen * qlen), 6)
        for rank, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:k], 1):
            out[(q, rank)] = (i, scores[i])
    return out


def test_text_topk_against_brute_force(spark):
    docs = [(i, t) for i, (_, _, t) in enumerate(K.KB_SEED)]
    queries = [(i, f"best practices for {d} employee engagement") for i, d in enumerate(K.THEMES.values())]
    queries.append((99, "nothing matches xyzzy"))
    got = retrieval.text_topk(
        spark.createDataFrame(docs, "id int, text string"),
        spark.createDataFrame(queries, "query_id int, query string"), 3,
    ).collect()
    assert {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in got} == lnc_ltc(docs, queries, 3)


def test_merged_results_keep_first_appearance(spark):
    corpus = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "id int, text string")
    results = spark.createDataFrame(
        [(0, 1, 2), (0, 2, 3), (1, 1, 1), (1, 2, 4)], "query_id int, rank int, id int"
    )
    merged = retrieval.merge_results(results, corpus).orderBy("ord")
    assert [r["text"] for r in merged.collect()] == ["b", "a", "c"]


# -- report -------------------------------------------------------------------------------


def test_report(spark):
    from tests.test_merge_stats import counts

    kb = tables.kb_seed(spark)
    row = report.report(counts(spark), kb).first()
    assert row["total_responses"] == 5 and len(row["key_findings"]) == 5
    assert row["key_findings"][0] == "60.0% of 5 responses are negative"
    assert [a["theme"] for a in row["recommended_actions"]] == row["top_themes"]
    assert row["recommended_actions"][1].asDict() == {
        "priority": "high", "theme": "wellbeing_safety", "owner": "Leadership",
        "action": next(t for i, _, t in K.KB_SEED if i == "ws_001"),
    }
    assert 1 <= len(row["rag_references"]) <= 3
    assert report.report(counts(spark, []), kb).count() == 0


def test_crisis_query_only_above_the_mean(spark):
    from tests.test_merge_stats import counts

    calm = report.queries(counts(spark)).orderBy("query_id").collect()
    assert [r["query"] for r in calm][0] == (
        "best practices for Internal Communication & Transparency employee engagement"
    )
    assert len(calm) == 3
    hot = counts(spark, [(0, "negative", "odd_theme", 0.6, "high", None, "monitor")])
    assert [r["query"] for r in report.queries(hot).orderBy("query_id").collect()] == [
        "best practices for odd_theme employee engagement", K.CRISIS_QUERY,
    ]


def test_themes_without_knowledge_get_a_review(spark):
    from tests.test_merge_stats import counts

    odd = counts(spark, [(0, "neutral", "tools_resources", 0.2, "low", None, "monitor")])
    row = report.actions(odd, tables.kb_seed(spark)).first()
    assert row["action"] == "Review the responses on Tools, Resources & Work Environment"
    assert row["owner"] == "HR"
