"""Stored tables: the knowledge base, the vector cache and fitted topic models."""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from voxtally import constants as K
from voxtally.operators.joins import lookup_join
from voxtally.schemas import KB
from voxtally.sources.checkpoints import settle


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, None if there is nothing there; what can't be read is an error."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


# -- knowledge base -----------------------------------------------------------

def kb_seed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.KB_SEED, KB)


def seeded(kb: DataFrame) -> DataFrame:
    """The knowledge rows, or the seed rows where there are none."""
    empty = F.lit(0) == kb.limit(1).agg(F.count(F.lit(1))).scalar()
    return kb.unionByName(kb_seed(kb.sparkSession).filter(empty))


def open_kb(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``, written from the seed rows if missing or empty."""
    table = read_if_there(spark, path)
    if table is None or table.isEmpty():
        kb_seed(spark).write.mode("append").parquet(path)
        table = spark.read.parquet(path)
    return table.select(*KB.fieldNames())


def new_documents(kb: DataFrame, documents: DataFrame, order: str = "pos") -> DataFrame:
    """Documents whose id the table lacks, one per id (the first), topic ``general`` unless
    given."""
    first = documents.groupBy("id").agg(F.min_by(F.struct("topic", "text"), order).alias("d"))
    return (
        first.join(kb.select("id"), "id", "left_anti")
        .select("id", F.coalesce("d.topic", F.lit(K.DEFAULT_KB_TOPIC)).alias("topic"), "d.text")
    )


def append_documents(spark: SparkSession, path: str, documents: DataFrame) -> None:
    new_documents(open_kb(spark, path), documents).write.mode("append").parquet(path)


# -- vector cache ---------------------------------------------------------------

#: Hexadecimal digits of a text's hash that name its folder in the cache: 256 folders.
PREFIX = 2


def text_key(text: str = "text"):
    return F.sha2(F.col(text), 256)


def cache_misses(texts: DataFrame, cache: DataFrame, encoder: str, text: str = "text") -> DataFrame:
    """``(text_hash, text)`` still to be encoded: each distinct text once, however many
    copies there are."""
    known = cache.filter(F.col("encoder") == encoder).select("text_hash")
    return (
        texts.select(text_key(text).alias("text_hash"), F.col(text).alias("text"))
        .groupBy("text_hash")
        .agg(F.min("text").alias("text"))
        .join(known, "text_hash", "left_anti")
    )


def cached(
    spark: SparkSession, path: str, encoder: str, keys: DataFrame, digits: int = PREFIX
) -> DataFrame | None:
    """The rows of the cache at ``path`` in the folders of ``keys`` (text_hash), None without a cache.

    The cache has a folder for each encoder and the first ``digits`` of hashes, the same number
    whenever it is used; of the batch only those that occur, at most 256 for two digits, come to the
    driver, and the scan leaves other folders out.
    """
    cache = read_if_there(spark, path)
    if cache is None:
        return None
    prefix = F.substring("text_hash", 1, digits)
    wanted = [r[0] for r in keys.select(prefix.alias("p")).distinct().collect()]
    # Names of folders are read as text or as numbers, as they look.
    return cache.filter((F.col("encoder").cast("string") == encoder) & F.col("prefix").cast("string").isin(
        [f"h{w}" for w in wanted if w is not None]
    ))


def _append(vectors: DataFrame, path: str, digits: int, mode: str = "append") -> None:
    folder = F.concat(F.lit("h"), F.substring("text_hash", 1, digits)).alias("prefix")
    rows = vectors.select("text_hash", "vec", "encoder", folder)
    rows.hint("rebalance", "encoder", "prefix").write.mode(mode).option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("encoder", "prefix").parquet(path)


def with_vectors(
    spark: SparkSession,
    texts: DataFrame,
    path: str,
    encoder: str,
    encode: Callable[[DataFrame], DataFrame],
    text: str = "text",
    digits: int = PREFIX,
) -> DataFrame:
    """Adds ``vec``; texts not in the cache at ``path`` are encoded and appended first.

    ``encode`` takes ``(text_hash, text)`` and adds ``vec``, an array or a vector. The key is the
    text itself under the encoder's name, so other texts never get these vectors. Only the folders
    of the batch's hashes are read. Null texts have no vector and drop out.
    """
    keyed = texts.withColumn("text_hash", text_key(text))
    keys = settle(keyed.filter(F.col("text_hash").isNotNull()).select("text_hash").distinct())
    known = cached(spark, path, encoder, keys, digits)
    if known is None:
        known = spark.createDataFrame([], "encoder string, text_hash string")
    misses = cache_misses(texts.filter(F.col(text).isNotNull()), known, encoder, text)
    _append(encode(misses).select(F.lit(encoder).alias("encoder"), "text_hash", "vec"), path, digits)
    # Two runs at a time may both have encoded a text.
    vectors = cached(spark, path, encoder, keys, digits).select("text_hash", "vec").dropDuplicates(["text_hash"])
    return lookup_join(keyed, vectors, "text_hash").drop("text_hash")


def compact_cache(spark: SparkSession, path: str, digits: int = PREFIX) -> None:
    """Rewrites each folder of the cache at ``path`` in few files with each text once. Nothing else
    may write to it meanwhile; what a failure loses is encoded anew when it is wanted."""
    cache = read_if_there(spark, path)
    if cache is not None:
        rows = settle(cache.withColumn("encoder", F.col("encoder").cast("string")).dropDuplicates(["encoder", "text_hash"]))
        _append(rows, path, digits, "overwrite")


# -- topic models ---------------------------------------------------------------

def save_topic_model(model: PipelineModel, topics: DataFrame, path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    topics.write.mode("overwrite").parquet(f"{path}/topics")


def load_topic_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    topics = read_if_there(spark, f"{path}/topics")
    if topics is None:
        raise RuntimeError("No fitted topic model found. Fit and save one first.")
    return PipelineModel.load(f"{path}/model"), topics


# -- input tables -----------------------------------------------------------------

def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
