"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import string
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.sources.shared import shared_folder

#: The word pattern of the contracts: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


#: Rows of a batch that a Python function works on at once. Documents are long, and executors run several functions.
BATCH_ROWS = 1000


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that Spark hands over, in slices of BATCH_ROWS rows at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def named(name: str) -> Column:
    """The column of exactly that name, with dots or whatever in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, /, without: str | None = None, **beside: Column) -> DataFrame:
    """The caller's rows in one column ``row`` with what an operator needs beside it, so that no name can clash."""
    return docs.select(F.struct(*(named(c) for c in docs.columns if c != without)).alias("row"), *(c.alias(name) for name, c in beside.items()))


def unpacked(columns: list[str], **instead: Column) -> list[Column]:
    """The caller's columns out of ``row``, some replaced, in their order and under their names."""
    return [instead[c].alias(c) if c in instead else F.col("row").getField(c).alias(c) for c in columns]


def text_key(text: Column) -> Column:
    """60 bits of a text's MD5, -1 for null: together with the id what tells documents apart whose ids are the same."""
    return F.coalesce(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(-1).cast("long"))


_scratch: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder. What is written there stays as long as a frame may read it: see ``temporaries``."""
    _scratch.append(f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return _scratch[-1]


@contextlib.contextmanager
def temporaries(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch paths made inside at its end, when the result has been written elsewhere."""
    before = len(_scratch)
    try:
        yield
    finally:
        for path in _scratch[before:]:
            remove(spark, path)
        del _scratch[before:]


def stored(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, survives lost executors, and is computed once.

    ``files`` is for tables whose size is known: their last step has no more tasks than that, each with one file. Hadoop's
    local file system starts processes for each file that it writes.
    """
    path = scratch(df.sparkSession, label)
    if files is not None:
        df = df.coalesce(files)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
