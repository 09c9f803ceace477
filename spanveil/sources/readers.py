"""Sources: document, page, message and control tables; intake admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanveil.constants import MAX_FILE_BYTES, MAX_FILE_PAGES
from spanveil.functions.text import NOT_WS

RULE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("pattern", T.StringType()),
    T.StructField("flags", T.StringType()),
    T.StructField("capture_group", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("context_cues", T.ArrayType(T.StringType())),
    T.StructField("min_length", T.IntegerType()),
    T.StructField("max_length", T.IntegerType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("contribution_status", T.StringType()),
])
SETTINGS_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("enabled_categories", T.ArrayType(T.StringType())),
    T.StructField("thresholds", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("protection_mode", T.StringType()),
    T.StructField("max_visible_chars", T.LongType()),
    T.StructField("max_node_chars", T.LongType()),
])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Prompt and paste texts; blank ones are skipped."""
    return spark.read.parquet(path).filter(F.col("text").rlike(NOT_WS))


def read_control_json(
    spark: SparkSession, path: str, schema: T.StructType
) -> tuple[DataFrame, DataFrame]:
    """(good records, corrupt raw lines) of text files; a bad record never stops the load."""
    return parse_control_json(spark.read.text(path), schema)


def parse_control_json(lines: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The same for a table with one JSON record in each ``value``."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = F.from_json(
        "value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    )
    rows = lines.filter("trim(value) <> ''").select(parsed.alias("r")).select("r.*")
    bad = F.col("_corrupt_record")
    return rows.filter(bad.isNull()).drop("_corrupt_record"), rows.filter(
        bad.isNotNull()
    ).select("_corrupt_record")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Whole files with size and digest, for limits and the audit trail."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("content_hash"))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def admit(
    jobs: DataFrame, max_bytes: int = MAX_FILE_BYTES, max_pages: int = MAX_FILE_PAGES
) -> DataFrame:
    """Add ``refusal`` (null when accepted) in arrival order ``seq``.

    Only the first job of a key that meets the limits is accepted, so the earliest
    such arrival per key decides all; that is an aggregate with map-side combine,
    not a window over a possibly huge key.
    """
    fits = (F.col("byte_length") <= max_bytes) & (
        F.coalesce("page_count", F.lit(0)) <= max_pages
    )
    owner = jobs.groupBy("file_key").agg(F.min(F.when(fits, F.col("seq"))).alias("_first"))
    taken = F.coalesce(F.col("seq") > F.col("_first"), F.lit(False))
    return jobs.join(owner, "file_key").withColumn(
        "refusal",
        F.when(taken, "duplicate_key")
        .when(F.col("byte_length") > max_bytes, "too_large")
        .when(F.col("page_count") > max_pages, "too_many_pages"),
    ).drop("_first")


def keep_newest(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The ``n`` newest rows per key; Spark's window group limit prunes each task
    before the shuffle, so a hot key costs at most ``n`` rows per partition."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(newest)).filter(f"_rn <= {n}").drop("_rn")
