"""Exact deduplication: 128-bit content hash, one stable survivor a group, bytes compared inside the groups.

Texts are grouped by ``(hash, bytes)``: the hash deals the rows out, and the grouping compares the bytes, so two texts
that collide in the hash stay two groups. The grouping is partially aggregated before the shuffle: a group of any size
leaves a task as one row. What is joined back is narrow (ids and digests), and there the survivor's side has one row a
group, so Spark's skew join may split a hot group at will.

Defined cases: a null text counts as the empty text; a null id sorts below all others, and a group of nothing but null
ids has a null ``keep_id``; of repeated rows (same id, same text) one is kept; an empty table gives no rows; columns
other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import ascii_lower


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z only. ``keep`` is ``"smallest"`` or ``"largest"`` id.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    rows = rows.select("doc_id", "text", content_hash(F.col("text")).alias("h"), F.unhex(F.sha2("text", 256)).alias("sha"))
    # A group is a hash and the bytes; the digest is the same for all of them, and names the group once the bytes are dropped.
    groups = rows.groupBy("h", "text").agg(F.first("sha").alias("sha"), best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).drop("text")
    ids = rows.groupBy("h", "sha", "doc_id").agg(F.count(F.lit(1)).alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return ids.join(groups, ["h", "sha"]).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
