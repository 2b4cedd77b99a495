"""Sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: What stands for characters that would end a value or a line; a backslash is written twice.
ESCAPES = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))
#: Null, and the string that would read as null.
NULL, NOT_NULL = "null", "\\=null"


def _written(name: str) -> Column:
    text = F.col("`" + name.replace("`", "``") + "`").cast("string")
    for plain, escaped in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return F.coalesce(F.when(text == NULL, NOT_NULL).otherwise(text), F.lit(NULL))


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Writes tab-separated text with ``null`` for null; a row with ``row_count``, counted while writing.

    Values are written as they print, with tabs, line ends and backslashes in strings escaped by a backslash and the string
    "null" as ``\\=null``; ``read_tsv`` reads them back.
    """
    seen = Observation("written")
    lines = df.observe(seen, F.count(F.lit(1)).alias("row_count")).select(F.concat_ws("\t", *map(_written, df.columns)).alias("value"))
    lines.write.mode(mode).text(path)
    return df.sparkSession.createDataFrame([(seen.get.get("row_count", 0),)], StructType([StructField("row_count", LongType())]))


def read_tsv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``write_tsv`` wrote, of columns that cast from strings."""
    values = spark.read.schema("value string").text(path).select(F.split("value", "\t", -1).alias("v"))

    def read(k: int, field: StructField) -> Column:
        raw = F.col("v")[k]
        text = F.replace(raw, F.lit("\\\\"), F.lit("\0"))
        for plain, escaped in reversed(ESCAPES[1:]):
            text = F.replace(text, F.lit(escaped), F.lit(plain))
        text = F.replace(text, F.lit("\0"), F.lit("\\"))
        return F.when(raw == NOT_NULL, NULL).when(raw != NULL, text).cast(field.dataType).alias(field.name)

    return values.select(*(read(k, f) for k, f in enumerate(schema.fields)))


def to_rows(df: DataFrame) -> list[tuple]:
    """All rows at the driver, for small results and tests."""
    return [tuple(r) for r in df.collect()]
