"""Survey files in, result files out."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from voxtally import constants as K
from voxtally.schemas import SURVEY, SURVEY_FIELDS
from voxtally.sources import split_records

# Other column names the upload accepts.
RENAMES = {"id": "response_id", "response": "text", "lang": "language"}


def rename_columns(df: DataFrame) -> DataFrame:
    """Accepts the short names; where both are there, the full name's value comes first."""
    for short, full in RENAMES.items():
        if short in df.columns:
            if full in df.columns:
                df = df.withColumn(full, F.coalesce(full, short)).drop(short)
            else:
                df = df.withColumnRenamed(short, full)
    return df


def declared_fields(df: DataFrame) -> DataFrame:
    """The declared survey columns, absent ones as nulls; anything else is dropped."""
    have = [c for c in df.columns if c == "pos"]
    return df.select(*have, *[
        F.col(f).cast("string").alias(f) if f in df.columns
        else F.lit(None).cast("string").alias(f)
        for f in SURVEY_FIELDS
    ])


def read_csv(spark: SparkSession, path: str, positions: bool = False) -> DataFrame:
    """A CSV with a header. Every column is text: ids keep their zeros, empty cells are null.

    Files are read in splits, and cells may hold line breaks. The first record of each file is its
    header; the first file's counts. ``positions`` adds ``pos``: 0, 1, 2, ... in file order.
    """
    names = spark.read.csv(path, header=True, multiLine=True, escape='"').columns  # reads its first record
    found = split_records.records(spark, path, split_records.CsvLines)
    found = found.filter("NOT (start = 0 AND nth = 0)")
    if positions:
        found = split_records.numbered(found)
    options = {"escape": '"', "maxCharsPerColumn": "-1"}
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    rows = found.withColumn("_r", F.from_csv("record", ddl, options))
    return declared_fields(rename_columns(rows.select(*(["pos"] if positions else []), "_r.*")))


def read_json(
    spark: SparkSession, path: str, lines: bool | None = None, positions: bool = False
) -> DataFrame:
    """Records one per line, or those of JSON arrays however they are printed; unless ``lines`` says
    which, the first character of the files does. Both are read in splits.

    Rows that cannot be read come back with all fields null, so they fail validation.
    """
    if lines is None:
        first = spark.read.text(path, lineSep="}").filter(F.trim("value") != "").limit(1).collect()
        lines = not (first and first[0][0].lstrip().startswith("["))
    schema = T.StructType(SURVEY.fields + [T.StructField(n, T.StringType()) for n in RENAMES])
    if lines:
        df = spark.read.schema(schema).json(path, mode="PERMISSIVE")
        df = dense_positions(df) if positions else df
    else:
        found = split_records.records(spark, path, split_records.JsonChunks)
        found = split_records.numbered(found) if positions else found
        df = found.withColumn("_r", F.from_json("record", schema)).select(*(["pos"] if positions else []), "_r.*")
    return declared_fields(rename_columns(df))


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """One raw JSON record per line as ``record``, for ``validate.check_json``."""
    return spark.read.text(path).withColumnRenamed("value", "record")


def records_of_request(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """``(pos, record)`` of pasted JSON arrays, each record as JSON text."""
    items = F.try_variant_get(F.try_parse_json(column), F.lit("$"), "array<variant>")
    return df.select(*keep, F.posexplode(items).alias("pos", "_r")).select(
        *keep, "pos", F.to_json("_r").alias("record")
    )


def dense_positions(df: DataFrame, name: str = "pos") -> DataFrame:
    """Adds 0, 1, 2, ... in file order to a table as read, before any shuffle.

    A first pass counts the rows of each partition; the running totals are one row per
    partition, which is all that is ordered in one place and broadcast.
    """
    numbered = df.withColumn("_m", F.monotonically_increasing_id()).withColumns({
        "_part": F.shiftright("_m", 33),
        "_at": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)),
    })
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    return (
        numbered.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_base") + F.col("_at"))
        .drop("_m", "_part", "_at", "_base")
    )


def fill_ids(df: DataFrame) -> DataFrame:
    """Gives records without an id ``resp_{pos}_{6 hex digits of the text's hash}``."""
    made = F.format_string(
        "resp_%05d_%s", F.col("pos"),
        F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 6),
    )
    return df.withColumn(
        "response_id",
        F.when(F.coalesce("response_id", F.lit("")) == "", made).otherwise(F.col("response_id")),
    )


def preview(df: DataFrame, n: int = K.PREVIEW_ROWS) -> DataFrame:
    return df.orderBy("pos").limit(n)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; lists and maps are written as JSON text."""
    flat = [
        F.to_json(f.name).alias(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name)
        for f in df.schema
    ]
    df.select(*flat).write.csv(
        path, header=True, escape='"', encoding="UTF-8",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,  # else cells are trimmed
    )


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias(name))


def write_survey(df: DataFrame, path: str, format_: str = "parquet") -> None:
    """A survey table in one folder per language."""
    df.write.partitionBy("language").format(format_).option("header", True).save(path)
