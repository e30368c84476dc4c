import json
import os

from pyspark.sql import functions as F

from tests.conftest import survey
from voxtally import constants as K
from voxtally.operators import synth, validate
from voxtally.schemas import ANALYZED_FIELDS, SURVEY_FIELDS
from voxtally.sources import checkpoints, files, tables
from voxtally.streaming import counters
from voxtally.streaming.analyze import analyze_stream, write_stream


def test_csv_is_text_and_renamed(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,response,lang,extra\n007,"multi\nline, ""quoted""",en,1\n8,plain text,,2\n', "utf-8")
    rows = files.read_csv(spark, str(path)).collect()
    assert rows[0].asDict() == {
        "response_id": "007", "text": 'multi\nline, "quoted"', "department": None, "language": "en",
        "employee_id": None, "survey_theme": None,
    }
    assert rows[1]["language"] is None


def test_both_names_present(spark):
    df = spark.createDataFrame([("1", None, "x"), ("2", "b", "y")], "id string, response_id string, text string")
    assert [r["response_id"] for r in files.rename_columns(df).collect()] == ["1", "b"]


def test_json_array_and_lines(spark, tmp_path):
    records = [{"id": "a", "text": "first", "lang": "de", "x": [1]}, {"response_id": "b", "text": "second"}]
    (tmp_path / "a.json").write_text(json.dumps(records), "utf-8")
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, records)), "utf-8")
    for name, lines in (("a.json", False), ("b.json", True), ("a.json", None), ("b.json", None)):
        df = files.read_json(spark, str(tmp_path / name), lines)
        assert df.columns == SURVEY_FIELDS
        assert [(r["response_id"], r["text"], r["language"]) for r in df.collect()] == [
            ("a", "first", "de"), ("b", "second", None),
        ]


def test_pasted_request_keeps_null_and_missing(spark):
    df = spark.createDataFrame([('[{"response_id": 1, "text": null}, {}]',)], "body string")
    records = files.records_of_request(df, "body")
    assert [r["pos"] for r in records.collect()] == [0, 1]
    assert validate.error_lines(validate.check_json(records)).count() == 4


def test_dense_positions(spark):
    df = spark.range(1000, numPartitions=7).filter("id % 3 <> 0")
    got = files.dense_positions(df).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(666))
    assert [r["id"] for r in got] == [i for i in range(1000) if i % 3]


def test_fill_ids(spark):
    df = files.fill_ids(survey(spark, [(0, "", "x"), (1, None, "x"), (2, "keep", "x"), (3, None, None)]))
    ids = [r["response_id"] for r in df.orderBy("pos").collect()]
    assert ids[:3] == ["resp_00000_2d7116", "resp_00001_2d7116", "keep"]
    assert ids[3].startswith("resp_00003_")
    assert files.fill_ids(df).collect() == df.collect()


def test_csv_and_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], {"k": 1}, 'q"\n,')], "id string, l array<string>, m map<string,int>, t string")
    files.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, multiLine=True, escape='"').first()
    assert (back["id"], json.loads(back["l"]), json.loads(back["m"]), back["t"]) == ("a", ["x", "y"], {"k": 1}, 'q"\n,')
    files.write_json(df, str(tmp_path / "json"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "json")).collect() == df.collect()


def test_survey_sink_by_language(spark, tmp_path):
    files.write_survey(synth.dataset(spark, 5), str(tmp_path / "s"))
    assert {d for d in os.listdir(tmp_path / "s") if "=" in d} == {f"language={c}" for c in K.LANGUAGES}
    assert spark.read.parquet(str(tmp_path / "s")).count() == 30


def test_kb_is_seeded_once_and_appended(spark, tmp_path):
    path = str(tmp_path / "kb")
    assert tables.open_kb(spark, path).count() == 10
    assert tables.open_kb(spark, path).count() == 10
    docs = spark.createDataFrame(
        [(0, "wb_001", "x", "again"), (1, "new", None, "first"), (2, "new", "t", "second")],
        "pos int, id string, topic string, text string",
    )
    tables.append_documents(spark, path, docs)
    tables.append_documents(spark, path, docs)
    rows = {r["id"]: (r["topic"], r["text"]) for r in tables.open_kb(spark, path).collect()}
    assert len(rows) == 11 and tables.open_kb(spark, path).count() == 11
    assert rows["new"] == ("general", "first") and rows["wb_001"][1].startswith("Workload imbalance")


def test_vector_cache(spark, tmp_path):
    path, seen = str(tmp_path / "cache"), []

    def encode(df):
        seen.append(sorted(r["text"] for r in df.collect()))
        return df.withColumn("vec", F.array(F.length("text").cast("double")))

    first = spark.createDataFrame([(0, "aa"), (1, "b"), (2, "aa")], "id int, text string")
    other = spark.createDataFrame([(0, "b"), (1, "cccc")], "id int, text string")
    got = tables.with_vectors(spark, first, path, "len", encode)
    assert sorted((r["id"], r["vec"][0]) for r in got.collect()) == [(0, 2.0), (1, 1.0), (2, 2.0)]
    got = tables.with_vectors(spark, other, path, "len", encode)
    assert sorted((r["id"], r["vec"][0]) for r in got.collect()) == [(0, 1.0), (1, 4.0)]
    tables.with_vectors(spark, other, path, "other", encode).collect()
    assert seen == [["aa", "b"], ["cccc"], ["b", "cccc"]]


def test_settled_table_has_no_lineage(spark):
    df = checkpoints.settle(spark.range(5).withColumn("x", F.col("id") * 2))
    assert df.count() == 5
    assert "Range" not in df._jdf.queryExecution().analyzed().toString()


def test_synthetic_batches(spark):
    rows = synth.dataset(spark, 23).collect()
    assert len(rows) == 23 * 6 and len({r["response_id"] for r in rows}) == len(rows)
    assert rows[0]["response_id"] == "en_00000"
    by_lang = {}
    for r in sorted(rows, key=lambda r: int(r["response_id"].split("_")[1])):
        by_lang.setdefault(r["language"], []).append(r)
    assert list(by_lang) == list(K.LANGUAGES)
    for group in by_lang.values():
        for i in range(0, 23, 5):
            batch = group[i:i + 5]
            assert len({(r["survey_theme"], r["declared_sentiment"], r["department"]) for r in batch}) == 1
            assert len({r["text"] for r in batch}) == len(batch)
    assert all("%s" not in r["text"] and r["text"] for r in rows)
    assert synth.dataset(spark, 23).collect() == rows


def test_synthetic_sentiments_follow_the_weights(spark):
    n = {r[0]: r[1] for r in synth.dataset(spark, 10000).groupBy("declared_sentiment").count().collect()}
    for sentiment, percent in K.SENTIMENT_PERCENT.items():
        assert abs(n[sentiment] / 600 - percent) < 1.5


def test_synthetic_rows_are_valid_and_labelled(spark):
    from voxtally.operators import labelling

    df = synth.dataset(spark, 50)
    checked = validate.check_rows(df.withColumn("pos", F.lit(0)))
    assert validate.summary(checked).first()["invalid_count"] == 0
    labelled = labelling.lexicon_labels(df)
    right = labelled.filter("language = language_detected").count()
    assert right / labelled.count() > 0.9


def test_stream_gives_the_batch_result(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = survey(spark, [(i, f"r{i}", t) for i, t in enumerate(
        ["I love my team, call 800-555-1234", "bad", "The workload is unbearable"])])
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    write_stream(analyze_stream(stream), out, mark).awaitTermination(120)
    survey(spark, [(9, "r9", "Great tools and good software")]).write.mode("append").parquet(source)
    write_stream(analyze_stream(stream), out, mark).awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.columns == ["pos", *ANALYZED_FIELDS]
    want = analyze_stream(spark.read.parquet(source))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r["response_id"] for r in got.collect()} == {"r0", "r2", "r9"}


def test_stream_drops_repeated_ids(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = survey(spark, [(i, "same", "The workload is fine") for i in range(3)]).withColumn(
        "at", F.lit("2024-01-01 00:00:00").cast("timestamp")
    )
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    write_stream(analyze_stream(stream, "at"), out, mark).awaitTermination(120)
    assert spark.read.parquet(out).count() == 1


def test_raw_json_lines_are_checked(spark, tmp_path):
    lines = ['{"response_id": "a", "text": "long enough"}', '{"response_id": 5, "text": "long enough"}', "{}"]
    (tmp_path / "raw.json").write_text("\n".join(lines), "utf-8")
    raw = files.dense_positions(files.read_json_records(spark, str(tmp_path / "raw.json")))
    checked = validate.check_json(raw)
    assert validate.summary(checked).first()["valid_count"] == 1
    assert validate.valid(checked).first()["text"] == "long enough"
    assert validate.error_lines(checked).count() == 3


def test_a_million_answers_do_not_repeat(spark):
    """With the arithmetic of a period of 1,000,003, later answers were those of earlier ones."""
    answers = synth.synthesize(spark.range(170_000))
    assert answers.count() == 1_020_000
    assert answers.select("text").distinct().count() >= 100_000
    late = synth.synthesize(spark.range(1_000_003, 1_000_013)).select("text", "language", "department")
    early = synth.synthesize(spark.range(0, 10)).select("text", "language", "department")
    assert late.exceptAll(early).count() > 40


def test_counters_over_batches(spark, tmp_path):
    path = str(tmp_path / "counters")
    rows = spark.createDataFrame(
        [("high", "urgent_action", "negative", "tools", "a", 0.2), ("low", "monitor", "neutral", "tools", "a", float("nan")),
         ("critical", "monitor", "neutral", "tools", "b", 7.0)],
        "burnout_risk_level string, action_signal string, sentiment string, primary_theme string, operation string, seconds double",
    )
    counts = counters.counts_of(rows, [0.5, 5.0])
    assert counters.totals(spark, path).collect() == []
    for batch in (0, 1, 1, 0):  # repeated batches change nothing
        counters.add_batch(counts, batch, path)
    counters.add_batch(counters.counts_of(rows.limit(0), [0.5, 5.0]), 2, path)
    counters.add_batch(counts, 0, path, "other")
    got = {(r["counter"], r["labels"], r["le"]): (r["n"], r["total"] and float(r["total"])) for r in counters.totals(spark, path).collect()}
    assert got == {
        ("surveys_analyzed", "", None): (9, None), ("burnout_high_risk", "", None): (6, None),
        ("urgent_actions", "", None): (3, None), ("responses", "negative/tools", None): (3, None),
        ("responses", "neutral/tools", None): (6, None),
        ("seconds", "a", "0.5"): (3, None), ("seconds", "a", "5.0"): (3, None), ("seconds", "a", "+Inf"): (3, 0.6),
        ("seconds", "b", "0.5"): (0, None), ("seconds", "b", "5.0"): (0, None), ("seconds", "b", "+Inf"): (3, 21.0),
    }


def test_counters_of_a_stream(spark, tmp_path):
    source, path, mark = (str(tmp_path / n) for n in ("in", "counters", "mark"))
    rows = survey(spark, [(i, f"r{i}", "The workload is unbearable") for i in range(5)])
    rows.write.parquet(source)

    def run():
        stream = spark.readStream.schema(rows.schema).parquet(source)
        counters.count_stream(analyze_stream(stream), path, mark).awaitTermination(120)
        return {r["counter"]: r["n"] for r in counters.totals(spark, path).collect() if not r["labels"]}

    assert run()["surveys_analyzed"] == 5
    assert run()["surveys_analyzed"] == 5
    survey(spark, [(9, "r9", "Great tools and good software")]).write.mode("append").parquet(source)
    assert run()["surveys_analyzed"] == 6
