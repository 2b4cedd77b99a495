import contextlib
import glob
import os
import pathlib

import pyarrow as pa
from pyspark.sql import functions as F

from lamella.llm import common, components, quality


def test_scratch_goes_and_results_stay(spark):
    kept = common.stored(spark.range(5), "kept")
    with common.temporaries(spark):
        gone = common.stored(spark.range(3), "gone")
        assert gone.count() == 3
        path = gone.inputFiles()[0]
    assert kept.count() == 5
    assert not pathlib.Path(path.removeprefix("file://")).exists()


def test_a_stored_table_has_no_lineage_and_keeps_its_columns(spark):
    df = spark.range(4).selectExpr("id", "id % 2 AS k").repartition(3, "k")
    again = common.stored(df, "cut")
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert again.dtypes == df.dtypes and "Exchange" not in plan and "parquet" in plan.lower()


def test_pieces_are_all_rows_in_order():
    batches = [pa.record_batch([pa.array(range(n))], ["x"]) for n in (0, 1, 2500)]
    got = list(common.pieces(iter(batches)))
    assert max(b.num_rows for b in got) <= common.BATCH_ROWS
    assert [x for b in got for x in b.column(0).to_pylist()] == [0, *range(2500)]


def test_packed_rows_come_back_whatever_their_names(spark):
    df = spark.range(2).selectExpr("id AS `a.b`", "id AS row", "'x' AS `k``y`", "id AS text_key")
    again = common.packed(df, text_key=common.named("a.b") + 5).select(*common.unpacked(df.columns, row=F.col("text_key")))
    assert again.columns == df.columns and sorted(map(tuple, again.collect())) == [(0, 5, "x", 0), (1, 6, "x", 1)]


def test_only_ascii_is_lowered(spark):
    assert spark.createDataFrame([("AbZ ÄÉ İ",)], "t string").select(common.ascii_lower(F.col("t"))).first()[0] == "abz ÄÉ İ"


@contextlib.contextmanager
def files_written(spark, shuffle_partitions):
    """A dictionary from the label of each stored table to the largest number of its files, filled at the end."""
    conf = {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    found, before = {}, len(common._scratch)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield found
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    for path in common._scratch[before:]:
        label = os.path.basename(path).rpartition("-")[0]
        found[label] = max(found.get(label, 0), len(glob.glob(f"{path.removeprefix('file:')}/part-*")))


def test_tables_of_known_size_are_few_files(spark):
    """However many partitions the shuffles have: each file that is written costs executors processes of their own."""
    links = spark.range(300).selectExpr("id + 1 AS a", "id - id % 3 AS b")
    with files_written(spark, 60) as found:
        parts = {r.node: r.component for r in components.components(links).collect()}
    assert parts == {k: 0 for k in range(301)}
    assert found["links"] > 8 and 0 < found["stars"] <= components.FILES and 0 < found["least"] <= components.FILES  # the first links' number isn't known
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('text number ', id * id, md5(cast(id AS string))) AS text")
    with files_written(spark, 60) as found:
        quality.train(docs, docs.selectExpr("doc_id AS trusted_id"))
    assert found and all(0 < found[k] <= quality.FILES for k in ("grams", "continuations", "contexts", "orders", "model"))
