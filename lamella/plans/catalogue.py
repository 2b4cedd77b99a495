"""The queries of the analytics operators and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions.aggregates import count_all, count_column, custom, first_value, max_value, min_value, sum_f64, sum_i64
from lamella.functions.scalar import add, bucket, int_div, multiply, negate, null_aware, vectorized
from lamella.operators.accumulators import accumulate
from lamella.operators.relational import aggregate, chain, cross, filter_rows, group_aggregate, limit_rows, project, theta_count, top_n, with_group_id
from lamella.operators.sinks import to_rows, write_tsv
from lamella.sources.generators import generated, table_function
from lamella.sources.shared import shared_folder
from lamella.sources.tables import Constant, Counting, live_rows, sequence, table, values

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NULLED = "nullif(user_id % 5, 0)"


def query(sql: str):
    def register(function):
        QUERIES[function.__name__], SQL[function.__name__] = function, sql
        return function

    return register


class Squares:
    """Squares modulo 97, each from the one before; every seventh is null."""

    def __init__(self):
        self.at, self.square = -1, 1

    def next(self) -> None:
        self.square = (self.square + 2 * self.at + 1) % 97
        self.at += 1

    def value(self) -> int:
        return self.square

    def is_null(self) -> bool:
        return self.at % 7 == 6

    def skip(self, n: int) -> None:
        if n:
            self.at += n
            self.square = self.at**2 % 97


class Span:
    """The largest value less the smallest; null without any."""

    def zero(self) -> tuple:
        return None, None

    def add(self, state: tuple, rows: pa.RecordBatch) -> tuple:
        found = pc.min_max(rows.column(0)).as_py()
        return self.merge(state, (found["min"], found["max"]))

    def merge(self, one: tuple, other: tuple) -> tuple:
        if one[0] is None or other[0] is None:
            return other if one[0] is None else one
        return min(one[0], other[0]), max(one[1], other[1])

    def result(self, state: tuple) -> int | None:
        return None if state[0] is None else state[1] - state[0]


def _count_up(n: int) -> Iterator[tuple[int]]:
    for k in range(n):
        yield (k,)


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with ``v``, null where the user's number is a multiple of 5."""
    return table(spark, folder, "events").withColumn("v", F.expr(NULLED))


@query("SELECT * FROM (VALUES (1::BIGINT, 10::BIGINT, 100::BIGINT), (2, 20, 200), (NULL, 30, 300), (4, NULL, 400), (5, 50, NULL)) t(a, b, c)")
def constant_table(spark, folder):
    return values(spark, [(1, 10, 100), (2, 20, 200), (None, 30, 300), (4, None, 400), (5, 50, None)], ["a", "b", "c"])


@query("SELECT n_nationkey, n_name FROM nation")
def table_scan(spark, folder):
    return project(table(spark, folder, "nation"), "n_nationkey", "n_name")


@query("SELECT event_id, event_type FROM events WHERE event_id % 3 <> 0")
def table_live_rows(spark, folder):
    pages = table(spark, folder, "events").withColumn("live", F.col("event_id") % 3 != 0)
    return project(live_rows(pages), "event_id", "event_type")


@query("SELECT i AS id, 3 + i % 4 AS v, 100 + i AS w FROM range(50) t(i)")
def sequence_cyclic(spark, folder):
    return sequence(spark, 50, order="id", v=Counting(3, 7), w=Counting(100))


@query("SELECT i AS id, 7::BIGINT AS k FROM range(5) t(i)")
def constant_column(spark, folder):
    return sequence(spark, 5, order="id", k=Constant(7))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < 20 OR o_orderkey > 40")
def filter_range_or(spark, folder):
    return project(filter_rows(table(spark, folder, "orders"), (F.col("o_orderkey") < 20) | (F.col("o_orderkey") > 40)), "o_orderkey", "o_custkey")


@query(f"SELECT event_id, {NULLED} AS v FROM events WHERE {NULLED} < 3")
def filter_null_false(spark, folder):
    return project(filter_rows(_events(spark, folder), F.col("v") < 3), "event_id", "v")


@query("SELECT event_id FROM events WHERE event_id % 3 = 0 AND event_id % 2 = 0")
def filter_stacked(spark, folder):
    return project(filter_rows(table(spark, folder, "events"), F.col("event_id") % 3 == 0, F.col("event_id") % 2 == 0), "event_id")


@query("SELECT event_id, user_id FROM (SELECT * FROM events ORDER BY event_id LIMIT 15) WHERE event_id % 2 = 0")
def filter_over_limit(spark, folder):
    return project(filter_rows(limit_rows(table(spark, folder, "events"), 15, "event_id"), F.col("event_id") % 2 == 0), "event_id", "user_id")


@query("SELECT event_id AS x, 2 * event_id * event_id AS twice_square, -(event_id * event_id) AS minus_square FROM events")
def project_dag(spark, folder):
    square = multiply("event_id", "event_id")
    return project(table(spark, folder, "events"), x=F.col("event_id"), twice_square=multiply(square, 2), minus_square=negate(square))


@query("SELECT event_id, event_id // 3 AS third, (event_id - 50) // 7 AS signed, event_id % 10 + 13 AS bucket FROM events")
def project_int_div_mod(spark, folder):
    return project(table(spark, folder, "events"), "event_id", third=int_div("event_id", 3), signed=int_div(F.col("event_id") - 50, 7), bucket=bucket("event_id"))


@query("SELECT event_id, -user_id AS negated FROM events")
def project_pandas_udf(spark, folder):
    minus = vectorized(_minus, "long")
    return project(table(spark, folder, "events"), "event_id", negated=minus("user_id"))


def _minus(x: pd.Series) -> pd.Series:
    return -x


@query("SELECT min_by(user_id, event_id) AS first, min(user_id) AS least, max(user_id) AS most, CAST(coalesce(sum(user_id), 0) AS BIGINT) AS total, count(*) AS n FROM events")
def agg_global(spark, folder):
    return aggregate(table(spark, folder, "events"), first=first_value("user_id", "event_id"), least=min_value("user_id"), most=max_value("user_id"), total=sum_i64("user_id"), n=count_all())


@query(f"SELECT count({NULLED}) AS n, count(*) AS n_all FROM events")
def agg_count_column(spark, folder):
    return aggregate(_events(spark, folder), n=count_column("v"), n_all=count_all())


@query("SELECT CAST(coalesce(sum(user_id), 0) AS BIGINT) AS total, min(user_id) AS least, count(*) AS n FROM events WHERE event_id < 0")
def agg_sum_empty(spark, folder):
    return aggregate(filter_rows(table(spark, folder, "events"), F.col("event_id") < 0), total=sum_i64("user_id"), least=min_value("user_id"), n=count_all())


@query("SELECT user_id % 5 AS k, CAST(coalesce(sum(CASE WHEN user_id % 5 > 0 THEN event_id END), 0) AS BIGINT) AS total, count(CASE WHEN user_id % 5 > 0 THEN event_id END) AS n FROM events GROUP BY 1")
def agg_sum_all_null(spark, folder):
    rows = project(table(spark, folder, "events"), k=F.col("user_id") % 5, x=F.when(F.col("user_id") % 5 > 0, F.col("event_id")))
    return group_aggregate(rows, "k", total=sum_i64("x"), n=count_column("x"))


@query("SELECT round(coalesce(sum(l_extendedprice), 0.0), 2) AS total FROM lineitem")
def agg_sum_f64(spark, folder):
    return aggregate(table(spark, folder, "lineitem"), total=F.round(sum_f64("l_extendedprice"), 2))


@query(f"SELECT event_type, min_by({NULLED}, event_id) FILTER (WHERE {NULLED} IS NOT NULL) AS first FROM events GROUP BY event_type")
def agg_first_nonnull(spark, folder):
    return group_aggregate(_events(spark, folder), "event_type", first=first_value("v", "event_id"))


@query("SELECT user_id % 10 + 13 AS k, min(event_id) AS least, max(event_id) AS most, CAST(coalesce(sum(event_id), 0) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1")
def agg_grouped(spark, folder):
    rows = project(table(spark, folder, "events"), "event_id", k=bucket("user_id"))
    return group_aggregate(rows, "k", least=min_value("event_id"), most=max_value("event_id"), total=sum_i64("event_id"), n=count_all())


@query("SELECT event_type, count(*) AS n, CAST(coalesce(sum(user_id), 0) AS BIGINT) AS total FROM events GROUP BY event_type")
def agg_grouped_string_key(spark, folder):
    return group_aggregate(table(spark, folder, "events"), "event_type", n=count_all(), total=sum_i64("user_id"))


@query("SELECT count(*) AS n FROM (SELECT * FROM events ORDER BY event_id LIMIT 15)")
def agg_over_limit(spark, folder):
    return aggregate(limit_rows(table(spark, folder, "events"), 15, "event_id"), n=count_all())


@query(f"SELECT {NULLED} AS v, count(*) AS n, CAST(coalesce(sum(event_id), 0) AS BIGINT) AS total FROM events GROUP BY 1")
def group_null_key(spark, folder):
    return group_aggregate(_events(spark, folder), "v", n=count_all(), total=sum_i64("event_id"))


@query(f"""
    SELECT CASE WHEN v IS NOT NULL THEN dense_rank() OVER (ORDER BY CASE WHEN v IS NULL THEN NULL ELSE f END NULLS LAST) - 1 END AS group_id, event_id, v
    FROM (SELECT event_id, v, min(event_id) OVER (PARTITION BY v) AS f FROM (SELECT event_id, {NULLED} AS v FROM events))""")
def group_id_first_seen(spark, folder):
    return with_group_id(project(_events(spark, folder), "event_id", "v"), "v", "event_id")


@query("SELECT r_regionkey, n_nationkey, r_name, n_name FROM region CROSS JOIN nation")
def cross_join(spark, folder):
    return project(cross(table(spark, folder, "region"), table(spark, folder, "nation")), "r_regionkey", "n_nationkey", "r_name", "n_name")


@query("SELECT r_regionkey, n_nationkey FROM region CROSS JOIN (SELECT * FROM nation WHERE n_nationkey < 0)")
def cross_join_empty(spark, folder):
    return project(cross(table(spark, folder, "region"), filter_rows(table(spark, folder, "nation"), F.col("n_nationkey") < 0)), "r_regionkey", "n_nationkey")


@query("SELECT s_suppkey, count(*) AS n FROM supplier JOIN customer ON s_acctbal < c_acctbal GROUP BY s_suppkey")
def theta_join(spark, folder):
    return theta_count(table(spark, folder, "supplier"), table(spark, folder, "customer"), "s_acctbal", "c_acctbal", "s_suppkey")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 15")
def limit_ordered(spark, folder):
    return project(limit_rows(table(spark, folder, "orders"), 15, "o_orderkey"), "o_orderkey", "o_custkey")


@query("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey LIMIT 100")
def limit_beyond_end(spark, folder):
    return project(limit_rows(table(spark, folder, "region"), 100, "r_regionkey"), "r_regionkey", "r_name")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 5")
def top_n_orders(spark, folder):
    return project(top_n(table(spark, folder, "orders"), 5, "o_orderkey", "o_custkey"), "o_orderkey", "o_custkey")


@query(f"SELECT event_id, {NULLED} AS v FROM events WHERE {NULLED} IS NOT NULL ORDER BY v DESC, event_id LIMIT 7")
def top_n_null_key(spark, folder):
    return project(top_n(_events(spark, folder), 7, "v", "event_id"), "event_id", "v")


@query("SELECT count(*) AS row_count FROM region")
def sink_row_count(spark, folder):
    return write_tsv(table(spark, folder, "region"), f"{shared_folder(spark).rstrip('/')}/region-{uuid.uuid4().hex}.tsv")


@query("SELECT i AS id, CASE WHEN i % 7 <> 6 THEN i * i % 97 END AS value FROM range(1000) t(i)")
def generator_custom(spark, folder):
    return generated(spark, 1000, Squares, partitions=5)


@query("SELECT n_nationkey, k FROM (SELECT n_nationkey, unnest(range(n_regionkey)) AS k FROM nation)")
def table_function_rows(spark, folder):
    nations = table(spark, folder, "nation")
    return project(nations.lateralJoin(table_function(_count_up, "k long")(F.col("n_regionkey").outer())), "n_nationkey", "k")


@query(f"SELECT event_id, {NULLED} AS v FROM events WHERE {NULLED} IS NULL OR {NULLED} > 3")
def filter_null_accepting(spark, folder):
    test = null_aware(lambda x: x.isna() | (x > 3))
    return project(filter_rows(_events(spark, folder), test("v")), "event_id", "v")


@query("SELECT event_type, max(event_id) - min(event_id) AS span FROM events GROUP BY event_type")
def agg_custom(spark, folder):
    return accumulate(table(spark, folder, "events"), "event_type", ["event_id"], Span(), "long", "span")


@query("SELECT event_type, max(event_id) - min(event_id) AS span FROM events GROUP BY event_type")
def agg_custom_whole(spark, folder):
    span = custom(lambda x: int(x.max() - x.min()), "long")
    return group_aggregate(table(spark, folder, "events"), "event_type", span=span("event_id"))


@query("SELECT event_id, event_id + user_id AS total FROM events")
def project_add(spark, folder):
    return project(table(spark, folder, "events"), "event_id", total=add("event_id", "user_id"))


@query("SELECT CAST(r_regionkey AS BIGINT) AS k FROM region")
def rows_drained(spark, folder):
    return values(spark, to_rows(project(table(spark, folder, "region"), k=F.col("r_regionkey").cast("long"))), ["k"])


@query("SELECT k, count(*) AS n FROM (SELECT event_id % 3 AS k FROM (SELECT * FROM events WHERE event_id > 5 ORDER BY event_id LIMIT 100)) GROUP BY k")
def chained_operators(spark, folder):
    return chain(
        table(spark, folder, "events"),
        lambda df: filter_rows(df, F.col("event_id") > 5),
        lambda df: limit_rows(df, 100, "event_id"),
        lambda df: project(df, k=F.col("event_id") % 3),
        lambda df: group_aggregate(df, "k", n=count_all()),
    )


@query("""
    SELECT dense_rank() OVER (ORDER BY f, event_type) - 1 AS group_id, event_id, event_type
    FROM (SELECT event_id, event_type, min(ts) OVER (PARTITION BY event_type) AS f FROM events)""")
def group_id_by_time(spark, folder):
    return project(with_group_id(table(spark, folder, "events"), "event_type", "ts"), "group_id", "event_id", "event_type")


@query("SELECT min(z) AS least, max(z) AS most, CAST(coalesce(sum(z), 0) AS BIGINT) AS total, count(*) AS n FROM (SELECT o_custkey * 2 AS z FROM orders WHERE o_orderkey < 20 OR o_orderkey > 40 ORDER BY o_orderkey LIMIT 5)")
def complex_pipeline(spark, folder):
    rows = filter_rows(table(spark, folder, "orders"), (F.col("o_orderkey") < 20) | (F.col("o_orderkey") > 40))
    rows = limit_rows(project(rows, "o_orderkey", z=multiply("o_custkey", 2)), 5, "o_orderkey")
    return aggregate(rows, least=min_value("z"), most=max_value("z"), total=sum_i64("z"), n=count_all())
