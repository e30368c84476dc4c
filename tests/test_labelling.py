import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of, survey
from voxtally import constants as K
from voxtally.functions import lexical as L
from voxtally.functions.text import sentences, term_counts, tokens
from voxtally.lexicon import DEFAULT
from voxtally.operators import labelling
from voxtally.schemas import LABEL_FIELDS, LABELS


def stub_answer(label):
    """A labeller that gives every text the same label."""
    return lambda asked: json.dumps([{"id": a["id"], **label} for a in asked])


TEXTS = [
    (0, "a", "I love working here, great team culture! My colleagues are helpful."),
    (1, "b", "The workload is unsustainable and unbearable. I am exhausted and stressed, I want to quit."),
    (2, "c", "Der Chef ist gut, aber die Arbeitslast ist nicht fair. Ich bin überlastet."),
    (3, "d", "我对工作压力很大，经常加班。"),
    (4, "e", "मैं अपने काम से खुश हूँ और टीम अच्छा है।"),
    (5, "f", "12345 67890"),
    (6, "g", "Terrible safety, terrible health. Toxic."),
]


def labels(spark):
    rows = labelling.lexicon_labels(survey(spark, TEXTS)).collect()
    return {r["response_id"]: r for r in rows}


def test_lexicon_labels(spark):
    got = labels(spark)
    assert {i: r["sentiment"] for i, r in got.items()} == {
        "a": "very_positive", "b": "very_negative", "c": "positive", "d": "very_negative",
        "e": "very_positive", "f": "neutral", "g": "very_negative",
    }
    assert got["a"]["primary_theme"] == "team_collaboration"
    assert got["b"]["primary_theme"] == "workload_balance"
    assert got["f"]["primary_theme"] == K.LABEL_DEFAULTS["primary_theme"]
    assert got["f"]["sentiment_confidence"] == 0.5
    assert got["b"]["emotion_tags"] == ["exhausted", "stressed"]
    assert {i: r["language_detected"] for i, r in got.items()} == {
        "a": "en", "b": "en", "c": "de", "d": "zh", "e": "hi", "f": "unknown", "g": "unknown",
    }
    assert got["a"]["action_signal"] == "positive_share"
    assert got["b"]["action_signal"] == "urgent_action"  # wants to quit
    assert got["g"]["action_signal"] == "urgent_action"  # very negative on safety
    assert got["c"]["action_signal"] == "no_action"


def test_labels_keep_the_contract(spark):
    for row in labels(spark).values():
        assert row["sentiment"] in K.SENTIMENTS and row["action_signal"] in K.ACTIONS
        assert 0 <= row["sentiment_confidence"] <= 1
        assert row["primary_theme"] in K.THEMES and len(row["secondary_themes"]) <= 2
        assert len(row["emotion_tags"]) <= 3 and len(row["key_phrases"]) <= 4


def test_labels_are_row_wise(spark):
    plan = plan_of(labelling.lexicon_labels(survey(spark, TEXTS)))
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan.replace("LogicalRDD", "")


def test_term_counts_and_sentences(spark):
    text = "b a b c, a B! Z 9"
    df = spark.createDataFrame([(text,), ("",), ("...",)], "t string")
    got = [
        {s["term"]: s["tf"] for s in r[0]}
        for r in df.select(term_counts(tokens(F.col("t")))).collect()
    ]
    assert got == [Counter(re.findall("[a-z]+", text.lower())), {}, {}]
    one = spark.createDataFrame([("One. two!  Three…\n 4 . ",)], "t string")
    assert one.select(sentences(F.col("t"))).first()[0] == ["One", "two", "Three…"]


def test_lead_sentence_is_the_densest(spark):
    text = "Hello there. Low pay, late pay and no pay day. Pay matters."
    df = spark.createDataFrame([(text,)], "text string").withColumn("t", tokens(F.col("text")))
    terms = df.withColumn("k", L.key_terms("t", DEFAULT))
    row = terms.select("k", L.lead_sentence(F.col("text"), F.col("k")).alias("lead")).first()
    assert row["k"][0] == "pay"
    assert row["lead"] == "Low pay, late pay and no pay day"


def test_key_phrases_against_brute_force(spark):
    texts = [(i, " ".join(["shared"] * (1 + i % 3) + [f"word{'abcdefghij'[j]}" for j in range(i)]))
             for i in range(1, 9)]
    df = spark.createDataFrame(texts, "id int, text string")
    got = {
        (r["id"], r["rank"]): r["phrase"]
        for r in labelling.key_phrases(df, "id").collect()
    }
    counted = {}
    for i, text in texts:
        words = re.findall("[a-z]+", text)
        counted[i] = Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    df_ = Counter(p for c in counted.values() for p in c)
    want = {}
    for i, c in counted.items():
        best = sorted(c, key=lambda p: (-round(c[p] * math.log(len(texts) / df_[p]), 6), p))[:4]
        want |= {(i, r): p for r, p in enumerate(best, 1)}
    assert got == want


def test_key_phrases_stay_in_their_block(spark):
    """No phrase is shuffled with its text's id: only texts, and a block's different phrases there and
    back. Neither blocks nor several rows of one id change the result."""
    plan = plan_of(labelling.key_phrases(spark.createDataFrame([(1, "some words")], "id int, text string"), "id"))
    dealt = re.findall(r"Exchange (?:hash|range)partitioning\(([^)]*)", plan)
    assert len(dealt) == 1 and dealt[0].startswith("term#") and "_hash" not in dealt[0]
    draw = random.Random(7)
    words = ["shared", "common"] * 6 + [f"{a}{b}word" for a in "abcdef" for b in "ghij"]
    texts = [(i if i % 9 else None, " ".join(draw.choices(words, k=i % 13))) for i in range(120)]
    texts += [(7, "shared dgword, chword dgword"), (500, None), (501, "")]
    df = spark.createDataFrame(texts, "id int, text string")
    counted = {}
    for i, text in texts:
        found = re.findall("[a-z]+", text or "")
        counted.setdefault(i, Counter()).update(found + [f"{a} {b}" for a, b in zip(found, found[1:])])
    df_ = Counter(p for c in counted.values() for p in c)
    want = {}
    for i, c in counted.items():
        best = sorted(c, key=lambda p: (-round(c[p] * math.log(len(texts) / df_[p]), 6), p))[:4]
        want |= {(i, r): p for r, p in enumerate(best, 1)}
    for block in (60, 700, 10**6):
        found = labelling.key_phrases(df, "id", block=block)
        assert {(r["id"], r["rank"]): r["phrase"] for r in found.collect()} == want


# -- answers of an external model ---------------------------------------------------

FALLBACK = {
    "sentiment": "neutral", "sentiment_confidence": 0.0, "primary_theme": "communication",
    "secondary_themes": [], "key_phrases": [], "summary_en": "Analysis failed.",
    "emotion_tags": [], "action_signal": "no_action", "language_detected": "unknown",
}
DEFAULTS = {**FALLBACK, "sentiment_confidence": 0.5, "summary_en": "", "language_detected": "en"}


def read(spark, raw, ids=("x", "y")):
    chunks = spark.createDataFrame([(list(ids), raw)], "ids array<string>, raw string")
    return {
        r["response_id"]: {f: r[f] for f in LABEL_FIELDS}
        for r in labelling.read_answers(chunks).collect()
    }


@pytest.mark.parametrize("raw,want", [
    ("[{}, {}]", [DEFAULTS, DEFAULTS]),
    ('[{"sentiment":"weird"}, {}]', [FALLBACK, FALLBACK]),
    ('[{"sentiment_confidence":"0.7"}, {}]', [{**DEFAULTS, "sentiment_confidence": 0.7}, DEFAULTS]),
    ('[{"sentiment_confidence":1.2}, {}]', [FALLBACK, FALLBACK]),
    ('[{"sentiment_confidence":"0.7d"}, {}]', [FALLBACK, FALLBACK]),
    ('[{"sentiment_confidence":null}, {}]', [FALLBACK, FALLBACK]),
    ('[{"sentiment_confidence":true}, {}]', [{**DEFAULTS, "sentiment_confidence": 1.0}, DEFAULTS]),
    ('[{"secondary_themes":null}, {}]', [FALLBACK, FALLBACK]),
    ('[{"secondary_themes":["a", null]}, {}]', [FALLBACK, FALLBACK]),
    ('[{"emotion_tags":[null]}, {}]', [FALLBACK, FALLBACK]),
    ('[{"emotion_tags":["a"]}, {"emotion_tags":[]}]', [{**DEFAULTS, "emotion_tags": ["a"]}, DEFAULTS]),
    ('[{"summary_en":3}, {}]', [FALLBACK, FALLBACK]),
    ("not json", [FALLBACK, FALLBACK]),
    (None, [FALLBACK, FALLBACK]),
    ('{"a": 1}', [FALLBACK, FALLBACK]),
    ('["text", {}]', [FALLBACK, FALLBACK]),
    ("[{}]", [DEFAULTS]),
    ("[]", []),
    ('[{}, {}, {"sentiment":"weird"}]', [DEFAULTS, DEFAULTS]),
    ('[{"id":1,"summary_en":"first"}, {"id":0}]', [{**DEFAULTS, "summary_en": "first"}, DEFAULTS]),
])
def test_answers(spark, raw, want):
    assert read(spark, raw) == dict(zip(("x", "y"), want))


def test_hook_chunks_and_contract(spark):
    rows = spark.range(23, numPartitions=1).select(
        F.concat(F.lit("r"), "id").alias("response_id"), F.lit("some text").alias("anonymized_text")
    )
    asked = labelling.ask_model(rows, stub_answer({"sentiment": "positive"})).orderBy("chunk").collect()
    assert sorted(len(r["ids"]) for r in asked) == [3, 10, 10]
    assert [a["id"] for a in json.loads(asked[0]["raw"])] == list(range(10))
    read_back = labelling.read_answers(labelling.ask_model(
        rows, stub_answer({"sentiment": "positive"})
    ))
    assert read_back.count() == 23
    assert set(read_back.columns) == set(LABELS.fieldNames())


def test_hook_retries_then_falls_back(spark, tmp_path):
    log = str(tmp_path / "calls")

    def flaky(asked):
        with open(log, "a") as f:
            f.write("x")
        if len(open(log).read()) < 3:
            raise TimeoutError
        return json.dumps([{} for _ in asked])

    def broken(asked):
        raise TimeoutError

    rows = spark.createDataFrame([("a", "text")], "response_id string, anonymized_text string").coalesce(1)
    assert labelling.ask_model(rows, flaky, wait_seconds=0).first()["raw"] == "[{}]"
    assert len(open(log).read()) == 3
    failed = labelling.read_answers(labelling.ask_model(rows, broken, wait_seconds=0)).first()
    assert failed["summary_en"] == "Analysis failed."


def test_classifier_learns(spark):
    rows = [(i, "good fine great" if i % 2 else "bad poor awful", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, text string, y int")
    out = labelling.classify(labelling.fit_classifier(df, "text", "y", features=64), df)
    assert all(r["predicted"] == r["y"] and 0.5 <= r["confidence"] <= 1 for r in out.collect())


def asked_rows(spark, n, partitions):
    rows = [(i * 7 % n, f"r{i}", f"text {i % 5}" if i % 9 else None) for i in range(n)]
    return spark.createDataFrame(rows, "pos long, response_id string, anonymized_text string").repartition(partitions)


def test_chunks_do_not_depend_on_partitions(spark):
    found = [
        sorted((r["chunk"], r["ids"], r["texts"], r["key"]) for r in labelling.chunks_of(asked_rows(spark, 43, n), size=6).collect())
        for n in (1, 3, 8)
    ]
    assert found[0] == found[1] == found[2]
    assert [len(ids) for _, ids, _, _ in found[0]] == [6] * 7 + [1]
    rows = sorted(asked_rows(spark, 43, 1).collect())
    assert [i for _, ids, _, _ in found[0] for i in ids] == [r["response_id"] for r in rows]
    tied = spark.createDataFrame([(0, f"r{i % 3}", "t") for i in range(9)], "pos long, response_id string, anonymized_text string")
    assert sorted(len(r["ids"]) for r in labelling.chunks_of(tied, size=4).collect()) == [1, 4, 4]


def logged(path):
    """A labeller that notes what it is asked, and fails where the file ``broken`` names an id."""
    def label(asked):
        with open(f"{path}/calls", "a") as f:
            f.write(asked[0]["response_id"] + "\n")
        with open(f"{path}/broken") as f:
            if asked[0]["response_id"] in f.read().split():
                raise TimeoutError
        return json.dumps([{"id": a["id"], "summary_en": a["response_id"]} for a in asked])

    return label


def test_ledger_asks_each_chunk_once(spark, tmp_path):
    path, ledger = str(tmp_path), str(tmp_path / "ledger")
    options = {"chunk": 5, "attempts": 2, "wait_seconds": 0, "ledger": ledger}
    (tmp_path / "broken").write_text("")
    rows = asked_rows(spark, 40, 3)
    broken = labelling.chunks_of(rows, size=5).filter("chunk = 2").first()["ids"][0]
    (tmp_path / "broken").write_text(broken)
    first = {r["chunk"]: r["raw"] for r in labelling.ask_model(rows, logged(path), **options).collect()}
    assert first[2] is None and sum(x is not None for x in first.values()) == 7
    calls = Counter((tmp_path / "calls").read_text().split())
    assert calls[broken] == 2 and len(calls) == 8 and sum(calls.values()) == 9
    (tmp_path / "broken").write_text("")
    more = asked_rows(spark, 40, 8).unionByName(
        spark.createDataFrame([(40, "new", "late")], "pos long, response_id string, anonymized_text string")
    )
    second = {r["chunk"]: r["raw"] for r in labelling.ask_model(more, logged(path), **options).collect()}
    assert {c: r for c, r in second.items() if c not in (2, 8)} == {c: r for c, r in first.items() if c != 2}
    assert second[2] is not None and json.loads(second[8])[0]["summary_en"] == "new"
    again = Counter((tmp_path / "calls").read_text().split()) - calls
    assert again == {broken: 1, "new": 1}


def test_answers_of_ended_tasks_outlive_a_failed_job(spark, tmp_path):
    """A job that dies keeps what its ended tasks were told; the rerun asks for the rest."""
    ledger = str(tmp_path / "ledger")

    def dies(asked):
        if asked[0]["response_id"] == "r0":
            import os
            import time
            time.sleep(6)  # other tasks end meanwhile
            os._exit(1)
        with open(f"{tmp_path}/calls", "a") as f:
            f.write(asked[0]["response_id"] + "\n")
        return "[{}]"

    def works(asked):
        with open(f"{tmp_path}/calls", "a") as f:
            f.write(asked[0]["response_id"] + "\n")
        return "[{}]"

    rows = spark.createDataFrame(
        [(i, f"r{i}", "t") for i in range(12)], "pos long, response_id string, anonymized_text string"
    )
    options = {"chunk": 1, "ledger": ledger, "task_chunks": 1}
    with pytest.raises(Exception):
        labelling.ask_model(rows, dies, **options).collect()
    told = (tmp_path / "calls").read_text().split()
    assert labelling.ask_model(rows, works, **options).filter("raw IS NULL").count() == 0
    calls = Counter((tmp_path / "calls").read_text().split())
    assert set(calls) == {f"r{i}" for i in range(12)} and len(told) >= 3
    assert sum(calls.values()) <= 12 + 4  # at most those of the tasks that were under way


def test_cross_fitting_predicts_unseen_rows(spark):
    rows = [(i if i else None, ("good fine great" if i % 2 else "bad poor awful") + f" w{i}", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string, y int").repartition(3)
    out = labelling.cross_fit(df, "id", "text", "y", features=256).collect()
    assert len(out) == 60 and {r["fold"] for r in out} == {0, 1, 2}
    assert all(r["predicted"] == r["y"] for r in out)
    for b in {min(int(r["confidence"] * 10), 9) for r in out}:
        own = [r for r in out if min(int(r["confidence"] * 10), 9) == b]
        assert all(r["calibrated"] == pytest.approx((len(own) + 1) / (len(own) + 2)) for r in own)
    noise = spark.createDataFrame([(i, f"a{i * 7 % 5}", i * i % 3 % 2) for i in range(90)], "id int, text string, y int")
    told = labelling.cross_fit(noise, "id", "text", "y", features=64)
    share = told.filter("predicted = y").count() / 90
    assert abs(told.agg(F.avg("calibrated")).first()[0] - share) < 0.1
    one = labelling.cross_fit(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, text string, y int"), "id", "text", "y")
    assert {r["predicted"] for r in one.collect()} == {1}


def test_a_batch_of_chunks_is_asked_a_few_at_a_time(spark):
    """Batches arrive as Arrow's and are not turned into one table of Python's strings."""
    rows = asked_rows(spark, 701, 2)
    given = labelling.ask_model(rows, lambda asked: str(len(asked)), chunk=3)
    assert "MapInArrow" in plan_of(given) and "MapInPandas" not in plan_of(given)
    found = sorted((r["chunk"], len(r["ids"]), r["raw"]) for r in given.collect())
    assert found == [(c, 3, "3") for c in range(233)] + [(233, 2, "2")]
