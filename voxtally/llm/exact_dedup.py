"""Exact duplicates by skew-safe combining.

Texts combine in three steps, each of which groups by the digest *and* the whole text, so a
digest never decides alone:

1. locally: the map side of the first aggregate leaves one row per text and input task;
2. salted: those rows meet by (digest, text, salt), the salt being the input task modulo
   ``salts``, so the copies of one text from very many tasks meet in ``salts`` places;
3. globally: at most ``salts`` winners per text meet by (digest, text).

Whatever share of the rows one text has, no task gets more of it than its own split or
``salts`` rows. The winners, without texts, are then joined to all documents by digest, the rows
of a frequent digest being split; a digest under which step 3 found a single text is as good as the text itself. Should a digest
ever have two, the join compares whole texts instead.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtally.llm.common import lower_ascii, spare
from voxtally.operators.joins import lookup_join
from voxtally.sources.checkpoints import settle

SALTS = 16


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _contents(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    return docs.select("doc_id", lower_ascii(F.col("text")).alias("_content")).withColumn(
        "_digest", digest(F.col("_content"))
    )


def winners(
    docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row per different text: _digest, _content, keep_id, group_size."""
    task = F.pmod(F.spark_partition_id(), F.lit(salts))
    salted = (
        _contents(docs, digest).withColumn("_salt", task)
        .groupBy("_digest", "_content", "_salt")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return salted.groupBy("_digest", "_content").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )


def exact_groups(
    docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null and empty texts are one group.
    The largest doc_id stays; a null id stays only in a group without any other. Repeated rows
    count each and share their decision. Other columns of ``docs`` are not read. An empty
    table gives an empty result.
    """
    found = settle(winners(docs, salts, digest).drop("_content"))
    by_digest = found.groupBy("_digest").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"),
        F.count(F.lit(1)).alias("_texts"),
    )
    rows = _contents(docs, digest)
    if by_digest.filter("_texts > 1").take(1):
        joined = rows.join(winners(docs, salts, digest), ["_digest", "_content"])
    else:
        joined = lookup_join(rows.drop("_content"), by_digest.drop("_texts"), "_digest")
    return joined.select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of equal texts, that with the largest doc_id; of
    repeated rows with that id and text one stays, the first by its other columns."""
    decided = exact_groups(docs).filter("kept").select("doc_id", "text_sha256")

    def row(digest: Column) -> Column:
        return F.concat_ws(":", digest, F.col("doc_id").cast("string"))

    name, nth = spare(docs, "_row"), spare(docs, "_nth")
    staying = decided.select(row(F.col("text_sha256")).alias(name)).distinct()
    marked = docs.withColumn(name, row(sha256(lower_ascii(F.col("text")))))
    order = Window.partitionBy(name).orderBy(*[c for c in docs.columns if c != "text"])
    return (
        marked.join(staying, name, "left_semi")
        .withColumn(nth, F.row_number().over(order)).filter(F.col(nth) == 1).drop(name, nth)
    )
