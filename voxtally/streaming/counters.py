"""Counters that go on over runs: what each batch adds is kept under the batch's number.

A batch that is sent again, after a failure or by mistake, writes the same numbers in the same place, so
it changes nothing. Totals are sums over batches. Batches of different streams are told apart by the stream's
name.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from voxtally import constants as K
from voxtally.operators import stats
from voxtally.sources.tables import read_if_there

#: A counter is a number of a name under labels; a histogram's cells carry their upper bound.
COUNTS = "counter string, labels string, le string, n long, total decimal(38,9)"


def counts_of(results: DataFrame, bounds: list[float] = K.REQUEST_BUCKETS) -> DataFrame:
    """``COUNTS`` of rows of one batch: those of ``stats.business_counters`` over analysed rows, the rows
    of each sentiment and theme, and the histogram of ``seconds`` by ``operation`` where rows have
    these columns. One pass over the rows for each of the three."""
    none = F.lit(None)
    wide = results.agg(*stats.run_counters(results.columns))
    parts = [wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("counter"), F.lit("").alias("labels"), none.cast("string").alias("le"),
                 F.col(c).alias("n"), none.cast("decimal(38,9)").alias("total"))
        for c in wide.columns
    ])).alias("_c")).select("_c.*")]
    if "sentiment" in results.columns:
        by = stats.labelled_counter(results, ["sentiment", "primary_theme"])
        parts.append(by.select(
            F.lit("responses").alias("counter"), F.concat_ws("/", "sentiment", "primary_theme").alias("labels"),
            none.cast("string").alias("le"), "n", none.cast("decimal(38,9)").alias("total"),
        ))
    if "seconds" in results.columns:
        cells = stats.histogram(results, "seconds", bounds, ["operation"])
        parts.append(cells.select(
            F.lit("seconds").alias("counter"), F.col("operation").alias("labels"), "le", F.col("bucket_count").alias("n"),
            F.when(F.col("le") == "+Inf", F.col("total").cast("decimal(38,9)")).alias("total"),
        ))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def add_batch(counts: DataFrame, batch: int, path: str, stream: str = "survey") -> None:
    """Keeps the ``counts`` (``COUNTS``) of a batch in its folder, in place of what is there."""
    counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/stream={stream}/batch=b{batch}")


def totals(spark: SparkSession, path: str) -> DataFrame:
    """``(counter, labels, le, n, total)`` over all batches at ``path``; none if there is no batch."""
    if read_if_there(spark, path) is None:
        return spark.createDataFrame([], COUNTS)
    kept = spark.read.schema(f"{COUNTS}, stream string, batch string").parquet(path)
    return kept.groupBy("counter", "labels", "le").agg(
        F.sum("n").alias("n"), F.sum("total").cast("decimal(38,9)").alias("total")
    )


def count_stream(
    results: DataFrame, path: str, checkpoint: str, stream: str = "survey"
) -> StreamingQuery:
    """Adds what has arrived to the counters at ``path`` and stops; call again for the rest."""
    def add(batch: DataFrame, number: int) -> None:
        add_batch(counts_of(batch), number, path, stream)

    return (
        results.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
