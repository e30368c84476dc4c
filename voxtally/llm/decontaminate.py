"""Benchmark decontamination: test items whose shingles a document holds.

Containment is the share of an item's different shingles that occur in the document. MinHash
bands over whole documents would miss it (an item of 40 words in a document of 20,000 has a
Jaccard similarity near 0.002), so the signature is taken of the small side only: of the n
shingles of an item, the n - ceil(threshold * n) + 1 with the least hashes. A document that
holds at least ceil(threshold * n) of the n holds one of these, whatever the document's length,
so no pair is lost. The items are partitioned by size, which sets the length of their
signatures and rules out documents too short to hold them; every partition is probed in one
pass over the documents' shingle hashes.

Documents that a signature hits are verified: their different shingles as text are matched with
all shingles of the items, and the matches counted. (``explode_outer`` throughout: the filter
that Spark infers for ``explode`` would compute the arrays once more.) Both lookups are plain equi-joins: Spark
broadcasts the items' side while its size is under the session's threshold, and shuffles both
sides with skew splitting beyond it.
"""

from pyspark.sql import Column, DataFrame, functions as F

from voxtally.llm.common import SPACE, by_row, lower_ascii, row_key

WORDS = 5
THRESHOLD = 0.8
_ENDS = " \t\n\x0b\f\r"


def _words(text: Column) -> Column:
    trimmed = F.btrim(lower_ascii(text), F.lit(_ENDS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def shingles(words: Column, size: int = WORDS) -> Column:
    """The different shingles, as text. A text with fewer words is one shingle; none for none."""
    count = F.size(words)
    return (
        F.when(
            count >= size,
            F.array_distinct(F.transform(
                F.sequence(F.lit(1), count - (size - 1)),
                lambda i: F.concat_ws(" ", F.slice(words, i, size)),
            )),
        )
        .when(count > 0, F.array(F.concat_ws(" ", words)))
        .otherwise(F.array().cast("array<string>"))
    )


def _hashes(words: Column, hashed: Column, size: int) -> Column:
    """The shingles' hashes with repeats; ``hashed`` has the hashes of the words."""
    count = F.size(words)
    return (
        F.when(
            count >= size,
            F.transform(
                F.sequence(F.lit(0), count - size),
                lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(size)]),
            ),
        )
        .when(count > 0, F.array(F.xxhash64(hashed)))
        .otherwise(F.array().cast("array<bigint>"))
    )


def _hashed(rows: DataFrame, text: str, size: int) -> DataFrame:
    """``rows`` with _words and _hashes."""
    return (
        rows.withColumn("_words", _words(F.col(text)))
        .withColumn("_hashed", F.transform("_words", lambda w: F.xxhash64(w)))
        .withColumn("_hashes", _hashes(F.col("_words"), F.col("_hashed"), size))
        .drop("_hashed")
    )


def signatures(items: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per different item (item_id, text): _item, item_id, _shingles, _n, _need, _probes."""
    rows = items.select(
        F.xxhash64("item_id", "text").alias("_item"), "item_id", F.col("text").alias("_text")
    ).dropDuplicates()
    sized = (
        _hashed(rows, "_text", words)
        .withColumn("_shingles", shingles(F.col("_words"), words))
        .withColumn("_n", F.size("_shingles"))
        .withColumn("_need", F.ceil(F.col("_n") * F.lit(str(threshold)).cast("decimal(9,8)")).cast("int"))
    )
    least = F.slice(F.sort_array(F.array_distinct("_hashes")), F.lit(1), F.col("_n") - F.col("_need") + 1)
    return sized.withColumn("_probes", least).select(
        "_item", "item_id", "_shingles", "_n", "_need", "_probes"
    )


def _found(docs: DataFrame, items: DataFrame, words: int, threshold: float) -> DataFrame:
    """Different rows (doc_id, _row) with the items (item_id, _item, _n, _need, _matched) they hold."""
    signed = signatures(items, words, threshold)
    rows = docs.select("doc_id", "text").select(
        "doc_id", row_key(F.col("doc_id"), F.col("text")).alias("_row"), F.col("text").alias("_text")
    )
    probes = signed.select(F.explode_outer("_probes").alias("_hash"), "_need").groupBy("_hash").agg(
        F.min("_need").alias("_need")
    )
    probed = (
        _hashed(rows, "_text", words)
        .select("_row", F.size("_hashes").alias("_m"), F.explode_outer("_hashes").alias("_hash"))
        .join(probes, "_hash")
        .filter("_m >= _need")
    )
    hit = probed.select("_row").distinct()
    members = signed.select("_item", "item_id", "_n", "_need", F.explode_outer("_shingles").alias("_shingle"))
    return (
        rows.join(hit, "_row", "left_semi")
        .withColumn("_words", _words(F.col("_text")))
        .select("doc_id", "_row", F.explode_outer(shingles(F.col("_words"), words)).alias("_shingle"))
        .join(members, "_shingle")
        .groupBy("doc_id", "_row", "item_id", "_item", "_n", "_need")
        .agg(F.count_distinct("_shingle").alias("_matched"))
        .filter("_matched >= _need")
    )


def contained(
    docs: DataFrame, items: DataFrame, words: int = WORDS, threshold: float = THRESHOLD
) -> DataFrame:
    """Pairs (doc_id, item_id, matched, shingles, containment) with containment >= threshold.

    ``docs`` is (doc_id, text), ``items`` (item_id, text); other columns are not read. Words are
    split at ASCII white space after lower-casing A-Z; a text of fewer than ``words`` words is
    a single shingle of all of them, and null or empty texts have none and match nothing.
    Repeated rows of a pair give one row, that with the highest containment; null ids are ids
    like others. Empty tables give an empty result.
    """
    found = _found(docs, items, words, threshold)
    best = found.groupBy("doc_id", "item_id").agg(
        F.max(F.struct((F.col("_matched") / F.col("_n")).alias("c"), "_matched", "_n")).alias("_b")
    )
    return best.select(
        "doc_id", "item_id", F.col("_b._matched").alias("matched"),
        F.col("_b._n").cast("long").alias("shingles"), F.col("_b.c").alias("containment"),
    )


def without_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they are. Each row is decided by its
    own text, also among rows that share an id or have none."""
    return by_row(docs, _found(docs, items, WORDS, THRESHOLD), "left_anti")
