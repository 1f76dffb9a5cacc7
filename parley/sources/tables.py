"""Readers: model tables, the usage log, uploaded files, call payloads, fixed prompts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from parley import schemas
from parley.functions.text import _col


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A model table with its declared schema; no file is opened to infer one."""
    return spark.read.schema(schemas.TABLES[table]).parquet(path)


def read_or_empty(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """A table that a stream writes; no rows before its first batch."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def stream_table(spark: SparkSession, path: str, table: str, **options) -> DataFrame:
    """The same tables as a file stream: files added to ``path`` arrive as new rows."""
    return spark.readStream.schema(schemas.TABLES[table]).options(**options).parquet(path)


def read_usage_log(spark: SparkSession, path: str) -> DataFrame:
    """The typed usage-log CSV, with names that need no quoting."""
    return (
        spark.read.schema(schemas.USAGE_LOG)
        .option("header", True)
        .csv(path)
        .withColumnsRenamed({"Cost($)": "Cost", "Duration(ms)": "DurationMs"})
    )


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Uploaded files below ``path`` as (path, name, size, content).

    ``content`` is read only for the rows and queries that use it, so size and name tests
    on this frame cost a directory listing.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(path)
        .select(
            "path",
            F.element_at(F.split("path", "/"), -1).alias("name"),
            F.col("length").alias("size"),
            "content",
        )
    )


def decode_text(content) -> Column:
    """File bytes to text; malformed bytes become U+FFFD and a leading BOM is dropped."""
    text = F.make_valid_utf8(_col(content).cast("string"))
    return F.when(F.startswith(text, F.lit("\ufeff")), F.substring(text, 2, 2147483647)).otherwise(text)


def parse_payload(body, schema: T.StructType) -> Column:
    """A call's JSON body as a STRUCT; see ``schemas`` for the declared bodies."""
    return F.from_json(_col(body), schema)


def parse_ask(body) -> Column:
    """STRUCT<message, attachments> with a missing attachment list read as an empty one."""
    parsed = parse_payload(body, schemas.ASK_PAYLOAD)
    none = F.array().cast(T.ArrayType(schemas.ATTACHMENT))
    return F.struct(
        parsed["message"].alias("message"),
        F.coalesce(parsed["attachments"], none).alias("attachments"),
    )
