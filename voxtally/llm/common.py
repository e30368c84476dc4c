"""What several corpus operators share."""

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space is what splits words: \x20 and \x09 to \x0D, nothing beyond ASCII.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character kept; null counts as empty.

    ``translate`` looks every character up, so texts of ASCII alone take ``lower``, which is
    the same thing there.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def spare(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_key(doc_id: Column, text: Column) -> Column:
    """A 64-bit hash of a row's id and text. With ``doc_id`` it tells rows apart that share an id or
    have none; what is decided of a row depends on these two, so equal rows share a decision."""
    return F.xxhash64(doc_id, text)


def by_row(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` whose doc_id and ``row_key`` are in ``rows`` (doc_id, _row) (left_semi)
    or not (left_anti); null equals null."""
    id_, key = spare(docs, "_id"), spare(docs, "_row")
    listed = rows.select(F.col("doc_id").alias(id_), F.col("_row").alias(key)).distinct()
    same = docs["doc_id"].eqNullSafe(listed[id_])
    return docs.join(listed, same & (row_key(docs["doc_id"], docs["text"]) == listed[key]), how)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))
