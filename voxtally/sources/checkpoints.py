"""Results that several later steps read, computed once."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed now and kept in the shared checkpoint folder, its lineage cut.

    The folder is the session's ``spark.checkpoint.dir``; a session without one is an error
    wherever it runs, as a folder of one machine would not outlive that machine. Files go
    when nothing refers to the result any more if the session sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the session's checkpoint folder, for a table that queries of this
    session write and read. Nobody removes it; whoever owns the checkpoint folder does."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{folder}/{name}-{uuid.uuid4().hex}"
