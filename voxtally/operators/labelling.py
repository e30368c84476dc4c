"""Labels for survey texts: from the lexicon, from an external model, or learned."""

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from voxtally import constants as K
from voxtally.functions import lexical as L
from voxtally.functions.labeljson import chunk_labels
from voxtally.functions.text import tokens
from voxtally.lexicon import DEFAULT, Lexicon
from voxtally.operators.joins import lookup_join
from voxtally.sources.checkpoints import settle
from voxtally.sources.files import dense_positions
from voxtally.sources.tables import read_if_there

#: Chunks that a task asks for where answers are kept: what a lost executor loses.
TASK_CHUNKS = 4
#: Chunks whose texts a worker has as Python's strings at a time.
ASKED = 8
#: Characters of the texts whose phrases a task holds.
PHRASE_BLOCK = 16_000_000


# -- lexicon ----------------------------------------------------------------

def with_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("tokens", tokens(F.col(text)))


def with_hits(df: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Adds ``hits``, the few tokens that are in any label list; the label rules read
    these and not the whole text again."""
    terms = {
        t
        for group in (lexicon.positive, lexicon.negative, lexicon.themes, lexicon.emotions)
        for words in group.values()
        for t in words
    }
    return df.withColumn("hits", L.matches("tokens", terms))


def sentiment(df: DataFrame, text: str = "text", lexicon: Lexicon = DEFAULT) -> DataFrame:
    pos, neg = L.polarity(F.col(text), "hits", lexicon)
    return df.withColumns({"pos_weight": pos, "neg_weight": neg}).withColumns({
        "sentiment": L.sentiment_class(F.col("pos_weight"), F.col("neg_weight")),
        "sentiment_confidence": L.sentiment_confidence(F.col("pos_weight"), F.col("neg_weight")),
    })


def themes(df: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """``primary_theme`` (the default theme without a hit) and up to two secondary ones."""
    return df.withColumn("_ranked", L.ranked_themes("hits", lexicon)).withColumns({
        "primary_theme": F.coalesce(
            F.get("_ranked", F.lit(0)), F.lit(K.LABEL_DEFAULTS["primary_theme"])
        ),
        "secondary_themes": F.slice("_ranked", 2, 2),
    }).drop("_ranked")


def language(df: DataFrame, text: str = "text", lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Adds ``language_detected``."""
    return df.withColumn("_words", L.function_words("tokens", lexicon)).withColumn(
        "language_detected", L.language(F.col(text), "_words", lexicon)
    ).drop("_words")


def lexicon_labels(df: DataFrame, text: str = "text", lexicon: Lexicon = DEFAULT) -> DataFrame:
    """All label columns, row by row: no join and no shuffle, and fit for streams."""
    df = with_hits(with_tokens(df, text), lexicon)
    df = language(themes(sentiment(df, text, lexicon), lexicon), text, lexicon)
    body = F.col(text)
    return (
        df.withColumns({
            "_terms": L.key_terms("tokens", lexicon),
            "emotion_tags": L.emotion_tags("hits", lexicon),
            "action_signal": L.action_signal(
                F.col("sentiment"),
                F.array_insert("secondary_themes", 1, F.col("primary_theme")),
                L.wants_to_leave(body, lexicon),
            ),
        })
        .withColumns({
            "key_phrases": F.slice("_terms", 1, 4),
            "summary_en": L.lead_sentence(body, F.col("_terms")),
        })
        .drop("tokens", "hits", "pos_weight", "neg_weight", "_terms")
    )


def phrases(
    df: DataFrame, id_: str, text: str = "text", lexicon: Lexicon = DEFAULT, cut: bool = False,
    also: tuple[str, ...] = (),
) -> DataFrame:
    """``(id, *also, term)`` for every content word of four letters or more and every pair of
    neighbouring ones, as often as they occur. With ``cut``, of the column ``tokens`` (see
    ``cutting.with_cut_tokens``), where Han words of two characters count too."""
    def content(name: str):
        long = L.is_content(name, lexicon, 4)
        return long | (F.col(name).rlike(r"^\p{IsHan}{2,}$") & L.is_content(name, lexicon, 2)) if cut else long

    terms = F.col("tokens") if cut else tokens(F.col(text))
    words = df.select(id_, *also, terms.alias("_t")).select(
        id_, *also, F.inline(F.arrays_zip(
            F.col("_t").alias("word"), F.slice("_t", 2, F.greatest(F.size("_t"), F.lit(1))).alias("next")
        ))
    ).filter(content("word"))
    pair = F.when(content("next"), F.concat_ws(" ", "word", "next"))
    return words.select(id_, *also, F.explode(F.array("word", pair)).alias("term")).filter(
        F.col("term").isNotNull()
    )


def key_phrases(
    df: DataFrame, id_: str, text: str = "text", lexicon: Lexicon = DEFAULT, n: int = 4,
    cut: bool = False, block: int = PHRASE_BLOCK,
) -> DataFrame:
    """The n phrases of each text with the best tf·ln(N/df): ``(id, phrase, rank)``. ``cut`` as in
    ``phrases``.

    Texts are dealt once, by id, to blocks of about ``block`` characters, and their phrases stay
    there. A block asks for the frequencies of its different phrases only, and those found in one
    text alone are not sent back. A phrase has a row per block at most, however many texts hold it.
    """
    size = F.length(F.array_join("tokens", " ") if cut else F.col(text))
    total, characters = df.agg(F.count(F.lit(1)), F.sum(size)).first()
    blocks = max(df.sparkSession.sparkContext.defaultParallelism, -(-(characters or 0) // block))
    texts = df.select(
        id_, "tokens" if cut else text, F.pmod(F.xxhash64(id_), F.lit(blocks)).cast("int").alias("_block")
    ).repartitionById(blocks, "_block")
    per_text = phrases(texts, id_, text, lexicon, cut, ("_block",)).groupBy("_block", id_, "term").agg(
        F.count(F.lit(1)).alias("tf")
    )
    asked = per_text.groupBy("_block", "term").agg(F.count(F.lit(1)).alias("n"))
    frequency = asked.select("_block", "term", F.sum("n").over(Window.partitionBy("term")).alias("df")).filter(
        "df > 1"
    ).repartitionById(blocks, "_block")
    # A block's frequencies fit a hash table, which spares putting all its phrases in order.
    scored = per_text.join(frequency.hint("shuffle_hash"), ["term", "_block"], "left").withColumn(
        "score", F.round(F.col("tf") * F.log(F.lit(total) / F.coalesce("df", F.lit(1))), 6)
    )
    best = Window.partitionBy(id_, "_block").orderBy(F.desc("score"), "term")
    return (
        scored.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= n)
        .select(id_, F.col("term").alias("phrase"), "rank")
    )


# -- external model -----------------------------------------------------------

def chunks_of(
    df: DataFrame, text: str = "anonymized_text", size: int = K.LABEL_CHUNK, order: str | None = None
) -> DataFrame:
    """``(chunk, ids, texts, key)``: rows in order, ``size`` to a chunk. ``order`` is a column (if not
    given, ``pos`` where there is one, otherwise the id); ties go by id and text. Which rows share a
    chunk depends on the rows alone, not on how they are dealt out. ``key`` is a hash of ids and texts."""
    order = order or ("pos" if "pos" in df.columns else "response_id")
    rows = df.select(F.col(order).alias("_o"), "response_id", F.col(text).alias("_text"))
    by = ("_o", "response_id", "_text")
    # Settled, as positions are those of the partitions' order.
    placed = dense_positions(settle(rows.repartitionByRange(*by).sortWithinPartitions(*by)), "_place")
    listed = placed.groupBy((F.col("_place") / size).cast("long").alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("_place", "response_id", "_text"))).alias("_rows")
    )
    ids, texts = F.col("_rows.response_id"), F.col("_rows._text")
    return listed.select(
        "chunk", ids.alias("ids"), texts.alias("texts"),
        F.sha2(F.to_json(F.struct(ids.alias("i"), texts.alias("t")), {"ignoreNullFields": "false"}), 256).alias("key"),
    )


def _answered(chunks: DataFrame, fn, attempts: int, wait_seconds: float) -> DataFrame:
    """``(chunk, ids, key, raw)``, raw null where every attempt failed."""
    def answer(ids, texts):
        asked = [{"id": i, "text": t, "response_id": r} for i, (r, t) in enumerate(zip(ids, texts))]
        for attempt in range(attempts):
            try:
                return fn(asked)
            except Exception:
                if attempt + 1 < attempts:
                    time.sleep(wait_seconds)
        return None

    several = ASKED  # the function travels whole

    # A batch may hold thousands of chunks: only a few are Python's strings at a time.
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, several) for i in range(0, len(batch), several)):
                raw = [answer(i, t) for i, t in zip(part.column("ids").to_pylist(), part.column("texts").to_pylist())]
                yield part.select(["chunk", "ids", "key"]).append_column("raw", pa.array(raw, pa.string()))

    return chunks.mapInArrow(ask, "chunk long, ids array<string>, key string, raw string")


def ask_model(
    df: DataFrame,
    fn: Callable[[list[dict]], str],
    text: str = "anonymized_text",
    chunk: int = K.LABEL_CHUNK,
    attempts: int = K.LABEL_ATTEMPTS,
    wait_seconds: float = K.LABEL_WAIT_SECONDS,
    order: str | None = None,
    ledger: str | None = None,
    task_chunks: int = TASK_CHUNKS,
) -> DataFrame:
    """Calls ``fn`` once per chunk of rows (``chunks_of``): ``(chunk, ids, raw)``, raw null if every
    attempt failed.

    ``fn`` takes ``[{"id", "text", "response_id"}, ...]``, ids counting from 0 within the chunk, and
    returns the answer as JSON text. With ``ledger``, a shared folder of one model, answers are kept
    there by their chunk's content, and chunks that it holds are not asked again: neither by a rerun,
    nor after a failure, as a task's answers are in the folder as soon as the task ends. A task asks
    about ``task_chunks`` chunks. Failed attempts are not kept. Without a ledger Spark may run a task
    twice, so ``fn`` must not mind being asked again.
    """
    chunks = chunks_of(df, text, chunk, order)
    if ledger is None:
        return _answered(chunks, fn, attempts, wait_seconds).select("chunk", "ids", "raw")
    spark, chunks = df.sparkSession, settle(chunks)
    kept = "key string, raw string"
    known = spark.read.schema(kept).parquet(ledger) if read_if_there(spark, ledger) is not None else None
    todo = chunks if known is None else chunks.join(known.select("key"), "key", "left_anti")
    first = todo.dropDuplicates(["key"]).select("chunk", "ids", "texts", "key")
    tasks = max(1, -(-first.count() // task_chunks))
    asked = _answered(first.repartition(tasks, "key"), fn, attempts, wait_seconds)
    asked.filter("raw IS NOT NULL").select("key", "raw").write.mode("append").option(
        "mapreduce.fileoutputcommitter.algorithm.version", "2"  # a task's file counts when the task ends
    ).parquet(ledger)
    # A key is there twice if a task was interrupted while its file was put in place.
    answers = spark.read.schema(kept).parquet(ledger).groupBy("key").agg(F.min("raw").alias("raw"))
    return chunks.join(answers, "key", "left").select("chunk", "ids", "raw")


def read_answers(chunks: DataFrame) -> DataFrame:
    """Label rows of ``(ids, raw)`` chunks, with the fallback rules of ``chunk_labels``."""
    return chunks.select(F.inline(chunk_labels(F.col("ids"), F.col("raw"))))


# -- learned ------------------------------------------------------------------

def fit_classifier(
    labelled: DataFrame, text: str, target: str, features: int = 1 << 14, max_iter: int = 20,
    reg: float = 0.1,
) -> PipelineModel:
    """TF-IDF and logistic regression on a numeric target column."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[\p{L}\p{M}]+", gaps=False),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        LogisticRegression(featuresCol="_tfidf", labelCol=target, maxIter=max_iter, regParam=reg),
    ]).fit(labelled)


def classify(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``predicted`` and its probability ``confidence``."""
    return (
        model.transform(df)
        .withColumns({
            "predicted": F.col("prediction").cast("int"),
            "confidence": F.array_max(vector_to_array("probability")),
        })
        .drop("_words", "_tf", "_tfidf", "rawPrediction", "probability", "prediction")
    )


def fold_of(id_: str, folds: int):
    """A fold from the first 32 bits of the id's MD5 hash."""
    bits = F.conv(F.substring(F.md5(F.coalesce(F.col(id_).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    return F.pmod(bits, F.lit(folds)).cast("int")


def cross_fit(
    labelled: DataFrame, id_: str, text: str, target: str, folds: int = 3, bins: int = 10, **options
) -> DataFrame:
    """Adds ``fold``, ``predicted``, ``confidence`` and ``calibrated`` to labelled rows, each predicted by a
    model that did not see its fold. ``calibrated`` is the smoothed share of right predictions among
    all rows whose confidence lies in the same of ``bins`` bins. A fold whose other rows have fewer
    than two classes gets their class."""
    rows = labelled.withColumn("fold", fold_of(id_, folds))
    parts = []
    for fold in range(folds):
        others = rows.filter(F.col("fold") != fold)
        classes = [r[0] for r in others.select(target).distinct().limit(2).collect()]
        own = rows.filter(F.col("fold") == fold)
        if len(classes) < 2:
            only = F.lit(classes[0] if classes else None).cast("int")
            parts.append(own.withColumns({"predicted": only, "confidence": F.lit(1.0)}))
        else:
            parts.append(classify(fit_classifier(others, text, target, **options), own))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every = settle(every.withColumn("_bin", F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))))
    right = F.count_if(F.col("predicted") == F.col(target))
    shares = every.groupBy("_bin").agg(((right + 1) / (F.count(F.lit(1)) + 2)).alias("calibrated"))
    return every.join(F.broadcast(shares), "_bin").drop("_bin")  # a row for each bin
