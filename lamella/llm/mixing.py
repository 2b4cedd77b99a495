"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions alone.

Every document of a source, in a shuffled order, gets a virtual finish time: the tokens of its source up to and with it,
divided by the source's target. A source whose target is above its size queues its documents again, after all of them
have been queued once, up to ``max_repeats`` times. All documents in order of finish time, cut where the tokens reach
the total budget, are the mix: at any finish time each source has had the same share of its target.

Nothing sorts a whole source or the whole corpus in one task. Cumulative sums come in two levels: the sums of
``(source, bucket)``, buckets being leading digits of the shuffle key, as many as the number of rows asks for, give each
bucket its start, and windows run inside the buckets, so a hot source is dealt over the cluster. The global cut is found the same way: a histogram of finish times
names the bin that the budget ends in, a second one the fine bin, and only the rows of that fine bin are sorted. The cut
is then one boundary row that every document is compared with; no join or shuffle follows. The only windows without a
partition are over one row a source and one row a bin.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a null id is shuffled by
the text, so that rows without ids are dealt over the buckets; repeated rows each take part with their own place; sources of size 0 get target 0 and nothing is taken
from them; an empty table gives no rows; columns with other names are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.common import WORD, named, packed, stored, unpacked

#: Rows of a bucket, about.
BUCKET_ROWS = 1 << 14
#: Bins a unit of finish time, and fine bins a bin. All that the budget can reach ends at time 1, or just after.
BINS = 4096


def word_count(text: Column) -> Column:
    """How many ``[^\\x20\\x09-\\x0D]+`` a text has; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], max_repeats: int) -> DataFrame:
    """``source, source_size, target`` from one row a source; targets share the sum of all sizes by weight.

    A target above ``max_repeats`` times its source's size stops there and the excess is shared again by weight. That
    ends at one level for which the targets ``min(cap, weight * level)`` add up. With the sources in order of
    ``cap / weight`` let ``level_i`` be what the rest would get if just those before ``i`` had stopped; it rises while
    sources stop and falls afterwards, so the largest is the one sought.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_source) - 1, F.lit(len(weights))) + 1).cast("int"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0))
    share = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * max_repeats)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", left / share)
        .withColumn("level", F.max("level").over(every))
        .select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))
    )


def bucket_digits(rows: int) -> int:
    """Hexadecimal digits of the shuffle key that make a bucket: as many as leave BUCKET_ROWS rows or fewer in one."""
    return max(1, -(-(max(1, -(-rows // BUCKET_ROWS)) - 1).bit_length() // 4))


def _cut(slots: DataFrame, budget: int, value: Column, bins: int) -> tuple[int, int] | None:
    """The bin of ``value`` that the budget ends in and the tokens before it; None if all fits."""
    sums = slots.groupBy(value.alias("bin")).agg(F.sum("size").alias("tokens"))
    running = sums.withColumn("through", F.sum("tokens").over(Window.orderBy("bin"))).where(F.col("through") > budget)
    row = running.agg(F.min(F.struct("bin", "through", "tokens")).alias("m")).select("m.*").first()
    return None if row["bin"] is None else (row["bin"], row["through"] - row["tokens"])


def repeat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix has it; those that it leaves out are gone.

    The mix is decided on narrow rows and meets the texts again by id, source and size, in one shuffle. Rows that are
    alike in all three share their copies evenly, in the order of their texts.
    """

    def key(doc_id: Column, source: Column, size: Column) -> Column:
        """Never null, so that the join and the window below share a shuffle."""
        return F.concat_ws("/", size.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("="), source), F.lit("")))

    decided = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    decided = decided.groupBy(key(F.col("doc_id"), F.col("source"), F.col("size")).alias("key")).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("alike"))
    decided = stored(decided.where("copies > 0"), "mix-copies")
    joined = packed(docs, key=key(named(id_col).cast("long"), named(source_col), word_count(named(text_col)))).join(decided, "key")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.col("row").getField(text_col)))
    joined = joined.withColumn("own", F.floor(F.col("copies") / F.col("alike")) + (place <= F.col("copies") % F.col("alike")).cast("long"))
    return joined.where("own > 0").withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("own")))).select(*unpacked(docs.columns))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, copies, taken``.

    ``weights`` go to the sources in code point order, null last, repeating. ``copies`` is how often the mix has the
    document and ``taken`` the words of all of them. The order is the one of the MD5 of the id, so reruns agree.
    """
    key = F.md5(F.coalesce(named(id_col).cast("long").cast("string"), named(text_col), F.lit("")).cast("binary"))
    rows = stored(docs.select(named(id_col).cast("long").alias("doc_id"), named(source_col).alias("source"), word_count(named(text_col)).alias("size"), key.alias("key")), "mix-sizes")
    rows = rows.withColumn("bucket", F.substring("key", 1, bucket_digits(rows.count())))

    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("tokens"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("source", "bucket", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats)
    starts = starts.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "start", "source_size", "target")

    inside = Window.partitionBy("source", "bucket").orderBy("key", "size")
    rows = rows.select("*", F.row_number().over(inside).alias("place"), F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("through"))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).select(
        "doc_id", "source", "key", "place", "size", "source_size", "target", (F.col("start") + F.col("through")).alias("through")
    )
    rows = stored(rows, "mix-queue")

    def finish(turn: Column) -> Column:
        return (turn * F.col("source_size") + F.col("through")) / F.col("target")

    def order(turn: Column) -> list[Column]:
        """What the global sort is by; no two slots are equal in all of it but those of rows that are."""
        return [finish(turn).alias("finish"), F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("source"), F.col("key").alias("key"), F.col("place").alias("place"), turn.alias("turn")]

    turns = F.ceil(F.col("target") / F.col("source_size")).cast("long")
    slots = rows.where("source_size > 0 AND size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), turns - 1)))
    slots = slots.select("size", F.struct(*order(F.col("turn"))).alias("at"))
    slots = slots.withColumn("bin", F.floor(F.least(F.col("at.finish"), F.lit(2.0)) * BINS)).withColumn("fine", F.floor((F.least(F.col("at.finish"), F.lit(2.0)) * BINS - F.col("bin")) * BINS))

    budget = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    taken_until = None
    if coarse := _cut(slots, budget, F.col("bin"), BINS):
        inner = slots.where(F.col("bin") == coarse[0])
        fine = _cut(inner, budget - coarse[1], F.col("fine"), BINS)
        last = inner.where(F.col("fine") == fine[0]).withColumn("sum", F.sum("size").over(Window.orderBy("at")))
        # The first slot that no longer fits; all that is before it in the order is taken.
        taken_until = last.where(F.col("sum") > budget - coarse[1] - fine[1]).agg(F.min("at").alias("at")).first()["at"]

    def fits(turn: int) -> Column:
        here = (F.col("source_size") > 0) & (F.lit(turn) < turns)
        if taken_until is None:
            return here
        edge = F.struct(*[F.lit(v).cast(t) for v, t in zip(taken_until, ("double", "boolean", "string", "string", "int", "long"), strict=True)])
        return here & (F.struct(*order(F.lit(turn).cast("long"))) < edge)

    copies = sum((F.when(fits(turn), 1).otherwise(0) for turn in range(max_repeats)), F.lit(0))
    return rows.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("int").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))
