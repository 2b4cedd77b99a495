"""The corpus pipeline: stages over ``documents``, each written before the next one reads it.

Documents that the quality classifier rejects go; lines that stand in an earlier document, or almost, are taken out, and
documents left without any text go; of each group of near-duplicates one document stays; sources are mixed to their target
weights, which leaves documents out and repeats others; the last stage encodes and decodes what is left.

Defined cases are those of the operators: null texts and ids are carried along, an empty table gives no rows, columns
beside those of ``documents`` pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import bpe, line_dedup, mixing, near_dedup, quality
from lamella.llm.common import named, packed, scratch, stored, table, temporaries, text_key, unpacked


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: without the documents whose perplexity exceeds their language's threshold."""
    return quality.accept(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: texts without the lines that an earlier one equals or almost equals; ``n_chars`` follows.

    A document that had text and has only blank lines left goes.
    """
    blank = lambda text: F.length(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n"))) == 0
    # The text as it was stands beside the caller's row, which the operator carries along.
    rows = line_dedup.deduplicate(packed(docs, "text", doc_id=named("doc_id"), text=named("text"), had=~blank(named("text"))))
    rows = rows.where(~F.col("had") | ~blank(F.col("text")))
    instead = {"text": F.col("text")}
    for name in docs.columns:
        if name.lower() == "n_chars":
            instead[name] = F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("row").getField(name))
    return rows.select(*unpacked(docs.columns, **instead))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each group of near-duplicates, the one of the smallest id; five-word shingles, 0.8.

    Rows that repeat id and text are one document; rows of one id with other texts are documents of their own, and where
    several of them are near-duplicates the first by the text's key stays.
    """
    groups = stored(near_dedup.near_duplicates(docs, shingle=5, percent=80).where("doc_id IS NOT NULL"), "groups")
    named_by = F.col("kept") & (F.col("text_key") == F.col("component_key"))
    rows = groups.withColumn("stays", (F.col("n_shingles") == 0) | named_by)
    rows = rows.groupBy("doc_id", "text_key").agg(F.min("stays").alias("stays"), F.count(F.lit(1)).alias("times"))
    # Narrow tables, of the documents that go and of those that repeat; most documents are in neither.
    marked = stored(rows.where("NOT stays OR times > 1").select(F.col("doc_id").alias("m_doc"), F.col("text_key").alias("m_key"), "stays"), "near-copies")
    docs_ = packed(docs, doc=named("doc_id").cast("long"), text_key=text_key(named("text")))
    same = (F.col("doc") == F.col("m_doc")) & (F.col("text_key") == F.col("m_key"))
    repeated = docs_.join(marked.where("stays"), same, "left_semi").dropDuplicates(["doc", "text_key"])
    return docs_.join(marked, same, "left_anti").unionByName(repeated).select(*unpacked(docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: each document as often as the mix has it."""
    return mixing.repeat(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the digests of each document's ids and of its text decoded again."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", keep_distinct),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The quality classifier's model has no form in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, one after another, each stored in the shared folder.

    What a stage has stored for itself goes once its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        target = scratch(spark, name)
        with temporaries(spark):
            stage(spark, docs, sf_dir).write.parquet(target)
        docs = spark.read.parquet(target)
    return STAGES[-1][1](spark, docs, sf_dir)
