"""One query per operator: ``(spark, folder) -> DataFrame``. Lists are joined to text."""

import json
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from voxtally import constants as K
from voxtally.functions import pii
from voxtally.functions import vectors as V
from voxtally.functions import lexical as L
from voxtally.functions.text import TOKEN
from voxtally.operators import (
    burnout, cutting, labelling, masking, merge, report, retrieval, stats, synth, text_index, topics, validate,
    vector_index,
)
from voxtally.plans import analysis, views
from voxtally.plans.views import PROSE
from voxtally.schemas import ANALYZED_FIELDS
from voxtally.sources import files, tables
from voxtally.streaming import counters
from voxtally.sources.checkpoints import settle, shared_folder

SEP = "|"


def _flat(df: DataFrame) -> DataFrame:
    """List columns as text."""
    return df.select(*[
        F.array_join(f.name, SEP).alias(f.name) if isinstance(f.dataType, T.ArrayType)
        else F.col(f.name)
        for f in df.schema
    ])


def _pairs(column):
    return F.array_join(
        F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"], e["value"])), SEP
    )


def _read(spark, sf, name):
    return tables.read_table(spark, sf, name)


# -- files and stored tables ----------------------------------------------------

def src_rename(spark: SparkSession, sf: str) -> DataFrame:
    uploaded = views.documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("response"),
        "lang", F.nullif("lang", F.lit("en")).alias("language"), F.col("n_chars").alias("extra"),
    )
    return files.declared_fields(files.rename_columns(uploaded))


def json_records(spark, sf):
    """Five events to a request."""
    listed = F.array_sort(F.collect_list(F.struct("event_id", "props")))
    joined = F.array_join(F.transform(listed, lambda e: e["props"]), ", ")
    requests = (
        _read(spark, sf, "events").groupBy(F.expr("event_id div 5").alias("request_id"))
        .agg(F.concat(F.lit("["), joined, F.lit("]")).alias("request"))
    )
    records = files.records_of_request(requests, "request", "request_id")
    return records.select(
        "request_id", "pos",
        F.try_variant_get(F.try_parse_json("record"), F.lit("$.k"), "bigint").alias("k"),
    )


def csv_upload(spark, sf):
    """Documents written as CSV files, line breaks, commas and quotes in cells and all, and read again."""
    path = shared_folder(spark, "upload")
    uploaded = _uploaded(spark, sf)
    files.write_csv(uploaded, path)
    return files.read_csv(spark, path).select("response_id", "text", "department", "language")


def json_upload(spark, sf):
    """Documents written as printed JSON arrays, one a file, and read again with positions."""
    path = shared_folder(spark, "upload")
    record = F.to_json(F.struct(F.col("id"), F.col("response"), F.col("department"), F.col("lang")), {"pretty": "true"})
    share = _uploaded(spark, sf).withColumn("_file", F.floor(F.col("n") / 500))
    arrays = share.groupBy("_file").agg(F.array_sort(F.collect_list(F.struct("n", record.alias("record")))).alias("_r"))
    text = F.concat(F.lit("[\n"), F.array_join("_r.record", ",\n"), F.lit("\n]"))
    arrays.select(text.alias("value")).write.text(path)
    return files.read_json(spark, path).select("response_id", "text", "department", "language")


def _uploaded(spark, sf):
    """Records under the short column names; every third text has more than one line."""
    raw = views.survey_raw(spark, sf)
    lines = F.concat_ws("\n", "text", F.lit('second, "quoted" line'), F.lit(""))
    return raw.select(
        F.col("response_id").alias("id"),
        F.when(F.col("pos") % 3 == 0, lines).otherwise(F.col("text")).alias("response"),
        "department", F.col("language").alias("lang"), F.col("pos").alias("n"),
    )


def fill_ids(spark, sf):
    given = F.when(F.col("pos") % 3 == 0, F.lit("")).when(F.col("pos") % 3 == 1, F.col("response_id"))
    return files.fill_ids(
        views.survey_raw(spark, sf).withColumn("response_id", given)
    ).select("pos", "response_id")


def preview(spark, sf):
    return files.preview(views.survey_raw(spark, sf)).select("pos", "response_id", "text", "language")


def _document_kb(spark, sf):
    return views.documents(spark, sf).select(
        views.response_id().alias("id"), F.col("source").alias("topic"), "text", "lang"
    )


def kb_seeded(spark, sf):
    kb = _document_kb(spark, sf)

    def counted(name, rows):
        return tables.seeded(rows.select("id", "topic", "text")).groupBy("topic").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")
        ).select(F.lit(name).alias("kb"), "topic", "n", "chars")

    return counted("filled", kb).unionByName(
        counted("was_empty", kb.filter(F.col("lang") == "hi"))
    )


def _has_label(spark, sf):
    return _read(spark, sf, "labels").select("doc_id")


def kb_append(spark, sf):
    docs = views.documents(spark, sf)
    present = docs.join(_has_label(spark, sf), "doc_id", "left_semi").select(
        views.response_id().alias("id"), F.col("source").alias("topic"), "text"
    )
    offered = docs.select(
        views.response_id().alias("id"), F.col("source").alias("topic"), "text",
        F.col("doc_id").alias("pos"),
    ).unionByName(_read(spark, sf, "benchmark").select(
        F.concat(F.lit("b"), F.col("item_id")).alias("id"),
        F.lit(None).cast("string").alias("topic"), "text", F.col("item_id").alias("pos"),
    ))
    return present.unionByName(tables.new_documents(present, offered))


def embed_cache_reads(spark, sf):
    """Vectors from a cache: labelled documents are encoded first, then all; a vector tells by which
    of the two runs it was made."""
    docs, path = views.documents(spark, sf).select("doc_id", "text"), shared_folder(spark, "vectors")

    def encode(run):
        return lambda misses: misses.withColumn("vec", F.array(F.length("text"), F.lit(run)).cast("array<double>"))

    first = docs.join(_has_label(spark, sf), "doc_id", "left_semi")
    tables.with_vectors(spark, first, path, "length", encode(1), digits=1)
    tables.compact_cache(spark, path, digits=1)
    found = tables.with_vectors(spark, docs, path, "length", encode(2), digits=1)
    return found.select("doc_id", F.get("vec", F.lit(0)).alias("length"), F.get("vec", F.lit(1)).alias("run"))


def embed_cache_misses(spark, sf):
    docs = views.documents(spark, sf)
    cache = docs.join(_has_label(spark, sf), "doc_id", "left_semi").select(
        F.lit("tfidf").alias("encoder"), tables.text_key().alias("text_hash")
    )
    return tables.cache_misses(docs, cache, "tfidf").select(
        "text_hash", F.length("text").alias("n_chars")
    )


# -- validation -------------------------------------------------------------------

def _checked(spark, sf):
    return validate.check_rows(views.survey_raw(spark, sf))


def validate_rows(spark, sf):
    return validate.split(_checked(spark, sf)).select(
        "pos", "response_id", "text", (F.col("split") == "valid").alias("is_valid"),
        F.size("errors").alias("n_errors"),
        F.array_join(F.transform("errors", lambda e: e["msg"]), SEP).alias("errors"),
    )


def validate_split(spark, sf):
    return validate.split(_checked(spark, sf)).select("pos", "response_id", "split", "text")


def validate_errors(spark, sf):
    return validate.error_lines(_checked(spark, sf))


def validate_errors_top50(spark, sf):
    return validate.first_errors(_checked(spark, sf))


def validate_summary(spark, sf):
    return validate.summary(_checked(spark, sf))


def _record_json():
    """Records with one fault or none, by document number."""
    quoted = F.to_json(F.struct(F.col("doc_id").cast("string").alias("response_id"), "text"))
    body = F.substring(quoted, F.lit(1), F.length(quoted) - 1)
    kind = F.col("doc_id") % 8
    return (
        F.when(kind == 0, F.lit("{}"))
        .when(kind == 1, F.concat(F.lit('{"response_id": '), "doc_id", F.lit(', "text": null}')))
        .when(kind == 2, F.concat(body, F.lit(', "department": 7}')))
        .when(kind == 3, F.concat(body, F.lit(', "department": null, "extra": 1}')))
        .when(kind == 4, F.concat(F.lit('{"response_id": "'), "doc_id", F.lit('", "text": "     "}')))
        .when(kind == 5, F.concat(F.lit('{"response_id": null, "text": "'), "lang", F.lit('"}')))
        .otherwise(quoted)
    )


def validate_json(spark, sf):
    records = views.documents(spark, sf).select(
        F.col("doc_id").alias("pos"), _record_json().alias("record")
    )
    return validate.error_lines(validate.check_json(records))


# -- masking ------------------------------------------------------------------------

def pii_mask(spark, sf):
    return masking.mask(views.survey_raw(spark, sf)).select("response_id", "anonymized_text")


def pii_blank(spark, sf):
    """Two of three texts are missing or blank."""
    text = F.when(F.col("pos") % 3 == 1, F.lit("  ")).when(F.col("pos") % 3 == 2, F.col("text"))
    survey = views.survey_raw(spark, sf).withColumn("text", text)
    return masking.mask(survey).select(
        "response_id", "anonymized_text", F.col("pii_detected").alias("blank_detected")
    )


def pii_links(spark, sf):
    """Addresses of pages hold nothing personal and stay."""
    links = _read(spark, sf, "pages").select("page_id", F.col("url").alias("text"))
    return masking.mask(links).select("page_id", F.col("anonymized_text").alias("masked_url"))


def pii_types(spark, sf):
    masked = masking.masked_table(views.survey_raw(spark, sf), masking.EVERYTHING)
    return _flat(masked.select(
        "response_id", "pii_detected", "pii_types",
        F.transform("pii_types", pii.placeholder).alias("placeholders"),
        "department", "language", "survey_theme",
    ))


def pii_cards(spark, sf):
    return _flat(views.survey_raw(spark, sf).select(
        "response_id", pii.card_runs(F.col("text")).alias("cards"),
        pii.mask_card(F.col("text")).alias("masked"),
    ))


def pii_iban(spark, sf):
    """Documents name no accounts, so each text is followed by one made from its number;
    about one in 97 has the right check digits."""
    account = F.concat(
        F.lit(" DE"), F.format_string("%02d", (F.col("pos") % 97) + 2),
        F.format_string("%018d", (F.col("pos") * 7919) % 1000003),
    )
    texts = views.survey_raw(spark, sf).select(
        "response_id", F.concat("text", account).alias("text")
    )
    return _flat(texts.select(
        "response_id", pii.iban_runs(F.col("text")).alias("ibans"),
        pii.mask_iban(F.col("text")).alias("masked"),
    ))


# -- labels -----------------------------------------------------------------------

def _echo():
    def answer(asked):
        return json.dumps([{"id": a["id"], "response_id": a["response_id"]} for a in asked])

    return answer


def label_chunks(spark, sf):
    """What a model is given: ten records at a time, numbered from 0, in the order of positions."""
    scattered = views.survey_raw(spark, sf).repartition(7, F.hash("text"))
    given = labelling.ask_model(scattered, _echo(), "text")
    asked = F.from_json("raw", "array<struct<id:long,response_id:string>>")
    return given.select("chunk", F.inline_outer(asked)).select("response_id", "chunk", F.col("id").alias("id_in_chunk"))


def label_ledger(spark, sf):
    """Answers kept in a ledger: half the records are asked first, then all; how often a model was
    asked for each chunk."""
    survey, path = views.survey_raw(spark, sf), shared_folder(spark, "ledger")
    half = F.expr(f"pos div {K.LABEL_CHUNK} % 2 = 0")
    labelling.ask_model(survey.filter(half), _echo(), "text", ledger=path)
    answers = labelling.ask_model(survey, _echo(), "text", ledger=path)
    return answers.select("chunk", F.size("ids").alias("records"), F.md5("raw").alias("answer"))


def _length_labeller():
    """Stands in for an external model: labels a text by its length."""
    sentiments, actions = list(K.SENTIMENTS), list(K.ACTIONS)

    # A nested function travels to the workers whole; they need not have this package.
    def label(asked):
        return json.dumps([
            {
                "id": a["id"],
                "sentiment": sentiments[len(a["text"]) % 5],
                "sentiment_confidence": (len(a["text"]) % 101) / 100,
                "key_phrases": [a["response_id"]],
                "action_signal": actions[len(a["text"]) % 4],
            }
            for a in asked
        ])

    return label


def label_hook(spark, sf):
    answered = labelling.ask_model(views.survey_raw(spark, sf), _length_labeller(), "text")
    return _flat(labelling.read_answers(answered))


_ANSWERS = [
    "{}", '{"sentiment":"weird"}', '{"sentiment_confidence":"0.7"}',
    '{"sentiment_confidence":1.2}', '{"secondary_themes":null}',
    '{"key_phrases":["a","b"],"emotion_tags":["Stressed"]}', "not json", '{"primary_theme":5}',
    '{"sentiment":"negative","action_signal":"monitor","language_detected":"de","summary_en":"S"}',
    '{"sentiment_confidence":null}', '{"emotion_tags":["x",1]}', '"text"',
    '{"sentiment_confidence":true,"secondary_themes":[]}',
]


def _answer(number):
    return F.get(F.array(*[F.lit(a) for a in _ANSWERS]), (number % len(_ANSWERS)).cast("int"))


def label_parse(spark, sf):
    chunks = views.survey_raw(spark, sf).select(
        F.array("response_id").alias("ids"),
        F.concat(F.lit("["), _answer(F.col("pos")), F.lit("]")).alias("raw"),
    )
    return _flat(labelling.read_answers(chunks))


def _chunked(spark, sf, answer):
    """Ids and answers of ten neighbouring rows each."""
    return (
        views.survey_raw(spark, sf)
        .groupBy(F.expr(f"pos div {K.LABEL_CHUNK}").alias("chunk"))
        .agg(F.array_sort(F.collect_list(
            F.struct("pos", "response_id", answer.alias("answer"))
        )).alias("rows"))
        .withColumn("ids", F.transform("rows", lambda r: r["response_id"]))
    )


def label_chunk_fallback(spark, sf):
    answer = F.when(F.length("text") % 23 == 0, '{"sentiment":"weird"}').otherwise(
        F.concat(F.lit('{"summary_en":"'), "language", F.lit('"}'))
    )
    chunks = _chunked(spark, sf, answer).select("ids", F.concat(
        F.lit("["), F.array_join(F.transform("rows", lambda r: r["answer"]), ","), F.lit("]")
    ).alias("raw"))
    return _flat(labelling.read_answers(chunks))


def label_align(spark, sf):
    """Each chunk is answered with ``chunk % 13`` items, whose own ids run backwards."""
    items = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(
        F.lit('{"id":'), (12 - i).cast("string"), F.lit(',"summary_en":"answer '),
        i.cast("string"), F.lit('"}'),
    ))
    chunks = _chunked(spark, sf, F.lit("")).select("ids", F.concat(
        F.lit("["),
        F.array_join(F.slice(items, F.lit(1), (F.col("chunk") % 13).cast("int")), ","),
        F.lit("]"),
    ).alias("raw"))
    return labelling.read_answers(chunks).select("response_id", "summary_en")


def _with_hits(spark, sf):
    return labelling.with_hits(labelling.with_tokens(views.survey_raw(spark, sf)), PROSE)


def sentiment_lexicon(spark, sf):
    return labelling.sentiment(_with_hits(spark, sf), "text", PROSE).select(
        "response_id", F.col("pos_weight").cast("bigint").alias("pos_weight"),
        F.col("neg_weight").cast("bigint").alias("neg_weight"),
        "sentiment", "sentiment_confidence",
    )


def theme_tags(spark, sf):
    return _flat(labelling.themes(_with_hits(spark, sf), PROSE).select(
        "response_id", "primary_theme", "secondary_themes"
    ))


def emotion_tags(spark, sf):
    return _flat(_with_hits(spark, sf).select(
        "response_id", L.emotion_tags("hits", PROSE).alias("emotion_tags")
    ))


def key_phrases(spark, sf):
    return labelling.key_phrases(views.documents(spark, sf), "doc_id", "text", PROSE)


def run_words(spark, sf):
    """Words learned from runs without spaces; here the runs are the words of the documents, and
    what is learned are the parts that they are made of."""
    return cutting.learn_words(cutting.runs(views.documents(spark, sf), pattern=TOKEN))


def action_signal(spark, sf):
    rows = views.labelled(spark, sf)
    return rows.select("response_id", L.action_signal(
        F.col("sentiment"), F.array_insert("secondary_themes", 1, F.col("primary_theme")),
        L.wants_to_leave(F.col("text"), PROSE),
    ).alias("action_signal"))


def detect_language(spark, sf):
    rows = labelling.with_tokens(views.survey_raw(spark, sf))
    return labelling.language(rows, "text", PROSE).select(
        "response_id", "language", "language_detected"
    )


def lead_sentence(spark, sf):
    terms = labelling.with_tokens(views.survey_raw(spark, sf)).withColumn(
        "terms", L.key_terms("tokens", PROSE)
    )
    return _flat(terms.select(
        "response_id", "terms", L.lead_sentence(F.col("text"), F.col("terms")).alias("lead")
    ))


def sentiment_model(spark, sf):
    """Predictions of models that did not see a row's fold. The target, whether a text is English,
    follows from the text."""
    docs = views.documents(spark, sf).select("doc_id", "text", (F.col("lang") == "en").cast("int").alias("target"))
    found = labelling.cross_fit(docs, "doc_id", "text", "target", max_iter=10)
    right = F.count_if(F.col("predicted") == F.col("target")) / F.count(F.lit(1))
    return found.groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("target").alias("ones"),
        (right >= 0.85).alias("most_right"), (F.avg("calibrated") >= 0.8).alias("sure"),
    )


# -- scores and merging -----------------------------------------------------------

def burnout_score(spark, sf):
    return burnout.score(views.labelled(spark, sf)).select("response_id", "risk_score", "risk_level")


def burnout_emotion(spark, sf):
    return burnout.components(views.labelled(spark, sf)).select(
        "response_id", F.round("emotion_part", 4).alias("emotion_part"),
        "sentiment_part", "theme_part", "action_part",
    )


def burnout_factors(spark, sf):
    return _flat(burnout.score(views.labelled(spark, sf)).select(
        "response_id", "risk_factors", "protective_factors"
    ))


def merge_inner(spark, sf):
    records = validate.valid(_checked(spark, sf)).select("pos", "response_id", "department")
    known = _has_label(spark, sf).select(views.response_id().alias("response_id"))
    labels = burnout.score(views.labelled(spark, sf)).select(
        "response_id", "sentiment", "risk_score"
    ).join(known, "response_id", "left_semi")
    return merge.enrich(records, labels)


def merge_last_wins(spark, sf):
    answers = _read(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id")).alias("response_id"),
        F.col("turn").alias("pos"), F.col("role").alias("department"), "text",
    )
    last = merge.last_by_id(answers.withColumn("label", F.col("department")), ["label", "text"])
    return merge.enrich(answers.drop("text"), last).select(
        "response_id", "pos", "department", "label", "text"
    )


def merge_topics(spark, sf):
    assigned = views.embeddings(spark, sf).select(
        F.concat(F.lit("d"), F.col("vec_id")).alias("response_id"),
        F.col("label").alias("topic_id"),
        F.format_string("Topic %d", "label").alias("topic_label"),
        F.array(F.col("label").cast("string")).alias("topic_keywords"),
    )
    rows = views.survey_raw(spark, sf).select("pos", "response_id", "department")
    return _flat(merge.with_topics(rows, assigned))


def analyze(spark, sf):
    return _flat(views.analyzed_rows(spark, sf).select(*ANALYZED_FIELDS))


def _prose_labeller(rows):
    return labelling.lexicon_labels(rows, "anonymized_text", PROSE)


def analyze_lexicon(spark, sf):
    """The analysis with labels read from the texts."""
    return _flat(analysis.analyze(
        views.survey_raw(spark, sf), _prose_labeller, unique_ids=True
    ).select(*ANALYZED_FIELDS))


def analyze_repeated(spark, sf):
    """The analysis where ids repeat: every turn of a conversation carries the same id."""
    turns = _read(spark, sf, "conversations").select(
        F.col("turn").alias("pos"), F.concat(F.lit("c"), F.col("conv_id")).alias("response_id"),
        "text", F.col("role").alias("department"),
    )
    return _flat(analysis.analyze(turns, _prose_labeller))


def analyze_topics(spark, sf):
    """The analysis with topic modelling switched on."""
    return _flat(analysis.analyze(
        views.survey_raw(spark, sf), views.with_drawn_labels, run_topics=True,
        unique_ids=True,
    ))


def analyze_summary(spark, sf):
    """Every seventh record gets no label and is not processed."""
    survey = views.survey_raw(spark, sf)

    def some(rows):
        return views.with_drawn_labels(rows).filter("pos % 7 <> 3")

    analyzed = analysis.analyze(survey, some, unique_ids=True)
    return analysis.processed(_checked(spark, sf), analyzed)


# -- statistics ---------------------------------------------------------------------

def _counts(spark, sf):
    return stats.cohort_counts(views.analyzed_rows(spark, sf))


def _settled_counts(spark, sf):
    """For reports that read the counts more than once: the rows are scored a single time."""
    return settle(_counts(spark, sf))


def freq_tables(spark, sf):
    return stats.frequencies(_counts(spark, sf)).select("dim", "value", "n")


def cohort_stats(spark, sf):
    return stats.cohort_stats(_settled_counts(spark, sf)).select(
        "total", "avg_burnout_score", "urgent_action_count",
        F.array_join("top_themes", SEP).alias("top_themes"),
        *[_pairs(c).alias(c) for c in (
            "sentiment_dist", "theme_distribution", "burnout_summary",
            "action_distribution", "department_distribution",
        )],
    )


def cohort_empty(spark, sf):
    """A cohort without rows has no statistics, next to one with rows."""
    rows = views.analyzed_rows(spark, sf)

    def row(name, cohort):
        return stats.cohort_stats(stats.cohort_counts(cohort)).select(
            F.lit(name).alias("cohort"), "total", "avg_burnout_score"
        )

    return row("full", rows).unionByName(row("empty", rows.filter("pos < 0")))


def top_themes(spark, sf):
    return stats.top_values(stats.frequencies(_counts(spark, sf)), "theme")


def top_departments(spark, sf):
    return stats.top_values(stats.frequencies(_counts(spark, sf)), "department")


def kpi_tiles(spark, sf):
    return stats.kpi_tiles(_counts(spark, sf))


def value_counts(spark, sf):
    counts = _settled_counts(spark, sf)
    return stats.value_counts(counts, "sentiment").unionByName(
        stats.value_counts(counts, "burnout_risk_level")
    )


def urgent_rows(spark, sf):
    return stats.urgent_rows(views.analyzed_rows(spark, sf))


def business_counters(spark, sf):
    masked = masking.mask(validate.valid(_checked(spark, sf)))
    scored = burnout.score(views.with_drawn_labels(masked))
    reports = stats.totals(_settled_counts(spark, sf)).filter("total > 0")  # a cohort of any size has one
    return stats.business_counters(
        scored.withColumnRenamed("risk_level", "burnout_risk_level"), reports
    )


def stream_counters(spark, sf):
    """Counters over the batches of a stream of analysed records, each of which is sent twice."""
    source, mark, path = (shared_folder(spark, n) for n in ("records", "mark", "counters"))
    analyzed = views.analyzed_rows(spark, sf)
    analyzed.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(analyzed.schema).option("maxFilesPerTrigger", 1).parquet(source)

    def twice(batch, number):
        for _ in range(2):
            counters.add_batch(counters.counts_of(batch), number, path)

    stream.writeStream.foreachBatch(twice).option("checkpointLocation", mark).trigger(
        availableNow=True
    ).start().awaitTermination()
    return counters.totals(spark, path).select("counter", "labels", "n")


def labelled_counter(spark, sf):
    log = _read(spark, sf, "events").select(
        "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("status")
    )
    return stats.labelled_counter(log, ["event_type", "status"])


def latency_histogram(spark, sf):
    log = _read(spark, sf, "events").select("event_type", "value")
    return stats.histogram(log, "value", K.REQUEST_BUCKETS, ["event_type"])


def model_latency_histogram(spark, sf):
    log = _read(spark, sf, "events").select(F.col("event_type").alias("operation"), "value")
    return stats.histogram(log, "value", K.MODEL_CALL_BUCKETS, ["operation"])


# -- topics -------------------------------------------------------------------------

def vectors_unit_norm(spark, sf):
    v = V.doubles(F.col("embedding"))
    return views.embeddings(spark, sf).select(
        "vec_id", F.round(V.norm(v), 4).alias("norm_before"),
        F.round(V.norm(V.unit(F.transform(v, lambda x: x * 3))), 6).alias("norm_after"),
    )


def _made_vectors(spark, sf, fitted):
    """All documents with vectors made so that four classes of known size lie apart."""
    tens = F.col("doc_id") % 10
    docs = views.documents(spark, sf).select(
        "doc_id", "text", fitted.alias("fitted"),
        F.when(tens == 0, 0).when(tens < 3, 1).when(tens < 6, 2).otherwise(3).alias("cls"),
    )
    raw = F.array(*[
        F.when(F.col("cls") == i, 10.0).otherwise(0.0) + (F.col("doc_id") * 7 + i * 3) % 11 / 10.0
        for i in range(4)
    ])
    return docs, docs.select("doc_id", "fitted", array_to_vector(raw).alias("raw"))


def topic_fit(spark, sf):
    """Topics of all documents, fitted on all of them."""
    docs, vectors = _made_vectors(spark, sf, F.lit(True))
    units = Normalizer(inputCol="raw", outputCol="features").transform(vectors).select("doc_id", "features")
    found = topics.fit(docs.select("doc_id", "text"), units, "doc_id", n_topics=4)
    return _flat(topics.members_described(*found, "doc_id"))


def topic_reuse(spark, sf):
    """Topics fitted on every other ten documents, stored, loaded, and given to the rest."""
    docs, vectors = _made_vectors(spark, sf, F.expr("(doc_id div 10) % 2 = 0"))
    encoder = PipelineModel([Normalizer(inputCol="raw", outputCol="features")])
    known = encoder.transform(vectors.filter("fitted")).select("doc_id", "features")
    _, found = topics.fit(docs.filter("fitted").select("doc_id", "text"), known, "doc_id", n_topics=4)
    path = shared_folder(spark, "topics")
    tables.save_topic_model(encoder, found, path)
    loaded, found = tables.load_topic_model(spark, path)
    rest = loaded.transform(vectors.filter("not fitted")).select("doc_id", "features")
    return _flat(topics.assign_new(rest, found, "doc_id"))


def topic_outliers(spark, sf):
    return topics.fold_small(
        views.embeddings(spark, sf).select("vec_id", "label"), "label", min_size=50
    )


def topic_sparse(spark, sf):
    """Rows far from their neighbours: documents as points on a circle, in seven dense arcs, but for every
    97th, which lie by themselves."""
    at = F.when(F.col("doc_id") % 97 == 0, 4.5 + F.col("doc_id") / 97 * 0.13 % 1.5).otherwise(
        F.col("doc_id") % 7 * 0.6 + F.col("doc_id") * 7919 % 10007 / 10007 * 0.05
    )
    points = views.documents(spark, sf).select(
        F.col("doc_id").alias("id"), F.array(F.cos(at), F.sin(at)).alias("vec"), (F.col("doc_id") % 7).alias("topic_id")
    )
    found = topics.density(points.select("id", "vec"), shared_folder(spark, "density"))
    sparse = topics.sparse_rows(found)
    return topics.fold_sparse(points.select("id", "topic_id"), sparse).join(found, "id").select(
        "id", F.col("topic_id").cast("int").alias("topic_id"), F.round("density", 4).alias("density")
    )


def topic_keywords(spark, sf):
    return topics.keywords(views.documents(spark, sf), "source")


def topic_keywords_rerank(spark, sf):
    return topics.keywords_by_similarity(settle(topics.fold_small(views.prose_topics(spark, sf), "label")))


def topic_labels(spark, sf):
    return _flat(topics.labels(topics.keywords(views.documents(spark, sf), "source"), "source"))


def _folded(spark, sf):
    return topics.fold_small(views.embeddings(spark, sf), "label")


def topic_confidence(spark, sf):
    folded = _folded(spark, sf)
    return topics.confidence(folded, topics.centroids(folded)).select(
        "vec_id", "topic_id", "topic_confidence"
    )


def topic_predict(spark, sf):
    vectors = views.embeddings(spark, sf).select("vec_id", "embedding")
    return topics.predict(vectors, topics.centroids(_folded(spark, sf))).select(
        "vec_id", "topic_id"
    )


# -- retrieval and report -------------------------------------------------------------

def _vector_search(spark, sf):
    """All vectors, and as queries those whose number 20 divides."""
    vectors = views.embeddings(spark, sf)
    corpus = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    queries = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return corpus, queries


def cosine_topk(spark, sf):
    return retrieval.cosine_topk(*_vector_search(spark, sf))


def cosine_topk_lsh(spark, sf):
    # These vectors are nearly at right angles: fewer bits, or little would be found.
    return retrieval.cosine_topk_lsh(*_vector_search(spark, sf), tables=24, bits=4)


def cosine_topk_index(spark, sf):
    """About the nearest, from a fifth of the rows, by an index fitted to them."""
    corpus, queries = _vector_search(spark, sf)
    path = shared_folder(spark, "vector-index")
    vector_index.write_index(corpus, path)
    return vector_index.search(spark, path, queries, K.RETRIEVE_K)


def text_topk(spark, sf):
    """The documents nearest to each document whose number 20 divides, by a stored index."""
    docs = views.documents(spark, sf)
    asked = docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    every = replace(PROSE, function_words={})
    path = shared_folder(spark, "text-index")
    text_index.write_index(docs.select(F.col("doc_id").alias("id"), "text"), path, every)
    return text_index.search(spark, path, asked, K.RETRIEVE_K, every)


def report_queries(spark, sf):
    return report.queries(_settled_counts(spark, sf))


def report_context(spark, sf):
    return report.references(report.context(_settled_counts(spark, sf), tables.kb_seed(spark)))


def report_findings(spark, sf):
    return report.findings(_settled_counts(spark, sf))


def report_actions(spark, sf):
    return report.actions(_counts(spark, sf), tables.kb_seed(spark))


def report_json(spark, sf):
    return files.as_json(report.report(_settled_counts(spark, sf), tables.kb_seed(spark)), "report")


# -- synthetic data --------------------------------------------------------------------

def synth_survey(spark, sf):
    """One answer per language for every document number."""
    return synth.synthesize(_read(spark, sf, "documents").select("doc_id"), "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        analyze, analyze_lexicon, analyze_repeated, analyze_topics, analyze_summary,
        src_rename, json_records, csv_upload, json_upload, fill_ids, preview, kb_seeded, kb_append, embed_cache_misses, embed_cache_reads,
        validate_rows, validate_split, validate_errors, validate_errors_top50,
        validate_summary, validate_json,
        pii_mask, pii_blank, pii_links, pii_types, pii_cards, pii_iban,
        label_chunks, label_ledger, label_hook, label_parse, label_chunk_fallback, label_align,
        sentiment_lexicon, theme_tags, emotion_tags, key_phrases, run_words, action_signal,
        detect_language, lead_sentence, sentiment_model,
        burnout_score, burnout_emotion, burnout_factors,
        merge_inner, merge_last_wins, merge_topics,
        freq_tables, cohort_stats, cohort_empty, top_themes, top_departments, kpi_tiles, value_counts,
        urgent_rows, business_counters, stream_counters, labelled_counter, latency_histogram,
        model_latency_histogram,
        vectors_unit_norm, topic_fit, topic_reuse, topic_outliers, topic_sparse, topic_keywords, topic_keywords_rerank,
        topic_labels, topic_confidence, topic_predict,
        cosine_topk, cosine_topk_lsh, cosine_topk_index, text_topk,
        report_queries, report_context, report_findings, report_actions, report_json,
        synth_survey,
    )
}
