"""The analysis of single records on a stream of them.

Validation, masking, lexicon labels and burnout scores work row by row, so the batch
functions run on a stream as they are. A record sent twice within the watermark is
dropped by id.
"""

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from voxtally.lexicon import DEFAULT, Lexicon
from voxtally.operators import labelling
from voxtally.plans.analysis import analyze


def analyze_stream(
    records: DataFrame,
    event_time: str | None = None,
    delay: str = "1 hour",
    lexicon: Lexicon = DEFAULT,
) -> DataFrame:
    """Result rows of a streaming survey table."""
    if event_time:
        records = records.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(
            ["response_id"]
        )
    return analyze(
        records,
        label=lambda rows: labelling.lexicon_labels(rows, "anonymized_text", lexicon),
        unique_ids=True,
    )


def write_stream(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived to a parquet table and stops; call again for the rest."""
    return (
        results.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
