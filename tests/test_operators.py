"""Golden rows of the operators, and the cases of nulls, no rows and order that they define."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lamella.functions.aggregates import count_all, count_column, custom, first_value, max_value, min_value, sum_f64, sum_i64
from lamella.functions.scalar import add, bucket, int_div, multiply, negate, null_rejecting, vectorized
from lamella.operators.accumulators import accumulate
from lamella.operators.relational import aggregate, chain, cross, filter_rows, group_aggregate, limit_rows, project, theta, top_n, with_group_id
from lamella.operators.sinks import read_tsv, to_rows, write_tsv
from lamella.sources.tables import Constant, Counting, live_rows, sequence, values
from lamella.streaming.pages import arriving, drain, running_aggregate


def five():
    return {"first": first_value("x", "x"), "least": min_value("x"), "most": max_value("x"), "total": sum_i64("x"), "n": count_all()}


def seq(spark, n, *starts):
    return sequence(spark, n, 3, **{c: Counting(s) for c, s in zip("xyz", starts)})


def test_complex(spark):
    rows = filter_rows(seq(spark, 50, 0, 100), (F.col("x") < 20) | (F.col("x") > 40))
    rows = limit_rows(project(rows, "x", z=multiply("y", 2)), 5, "x")
    assert to_rows(aggregate(rows, least=min_value("z"), most=max_value("z"), total=sum_i64("z"), n=count_all())) == [(200, 208, 1020, 5)]


def test_filter_over_limit_is_not_pushed_below(spark):
    rows = limit_rows(seq(spark, 50, 0, 100), 15, "x")
    assert to_rows(filter_rows(rows, (F.col("x") < 10) | (F.col("x") > 40))) == [(k, 100 + k) for k in range(10)]
    assert to_rows(filter_rows(rows, F.col("x") % 2 == 0)) == [(k, 100 + k) for k in range(0, 15, 2)]


def test_aggregation_over_limit(spark):
    assert to_rows(aggregate(limit_rows(seq(spark, 50, 0), 15, "x"), n=count_all())) == [(15,)]


def test_filter_over_filter(spark):
    assert sorted(to_rows(filter_rows(filter_rows(seq(spark, 50, 0), F.col("x") % 3 == 0), F.col("x") % 2 == 0))) == [(k,) for k in range(0, 50, 6)]


def test_group_ids(spark):
    rows = seq(spark, 10, 100).select("x", int_div("x", 3).alias("k"))
    out = with_group_id(rows, "k", "x").orderBy("x").collect()
    assert [(r.group_id, r.k) for r in out] == [(0, 33)] * 2 + [(1, 34)] * 3 + [(2, 35)] * 3 + [(3, 36)] * 2


def test_group_ids_in_order_of_appearance(spark):
    rows = values(spark, [(0, None), (1, 5), (2, 5), (3, None), (4, 7), (5, -1), (6, 5)], ["at", "k"])
    assert [r.group_id for r in with_group_id(rows, "k", "at").orderBy("at").collect()] == [None, 0, 0, None, 1, 2, 0]
    assert with_group_id(rows.where("at < 0"), "k", "at").count() == 0
    assert with_group_id(rows, "k", "at").columns == ["group_id", "at", "k"]
    many = seq(spark, 3000, 0).select("x", (299 - F.col("x") % 300).alias("k"))
    assert to_rows(with_group_id(many, "k", "x").agg(F.count_distinct("group_id"), F.max("group_id"), F.sum((F.col("group_id") != F.col("x") % 300).cast("int")))) == [(300, 299, 0)]


@pytest.mark.parametrize(("n", "limit", "expected"), [(50, 5, 5), (50, 15, 15), (12, 15, 12), (12, 0, 0)])
def test_limit(spark, n, limit, expected):
    assert to_rows(limit_rows(seq(spark, n, 0), limit, "x")) == [(k,) for k in range(expected)]


def test_top_n(spark):
    assert to_rows(top_n(seq(spark, 50, 0, 100), 5, "x", "y")) == [(k, 100 + k) for k in range(49, 44, -1)]
    rows = values(spark, [(None, 1), (3, None), (1, 2), (2, 5), (3, 0)], ["k", "p"])
    assert to_rows(top_n(rows, 3, "k", "p")) == [(3, None), (3, 0), (2, 5)]
    assert to_rows(top_n(rows, 0, "k", "p")) == []
    assert to_rows(top_n(rows, 9, "k", "p"))[-1] == (1, 2)


def test_aggregation(spark):
    rows = seq(spark, 50, 100)
    assert to_rows(aggregate(rows, **five())) == [(100, 100, 149, 6225, 50)]
    assert to_rows(aggregate(filter_rows(rows, F.col("x") % 2 == 0), **five())) == [(100, 100, 148, 3100, 25)]
    assert to_rows(aggregate(filter_rows(rows, F.col("x") < 0), **five())) == [(None, None, None, 0, 0)]
    assert to_rows(group_aggregate(filter_rows(rows, F.col("x") < 0), "x", n=count_all())) == []


def test_count_column(spark):
    rows = values(spark, [(1, None, 10), (2, None, 20), (None, None, 30), (4, None, 40), (5, None, 50)], ["a", "b", "c"])
    assert to_rows(aggregate(rows, a=count_column("a"), b=count_column("b"), c=count_column("c"))) == [(4, 0, 5)]


def test_nothing_but_nulls(spark):
    rows = values(spark, [(None,), (None,)], ["x"])
    assert to_rows(aggregate(rows, **five())) == [(None, None, None, 0, 2)]
    assert to_rows(aggregate(rows, n=count_column("x"))) == [(0,)]


def test_first_skips_nulls(spark):
    rows = values(spark, [(1, 0, None), (1, 1, 7), (1, 2, 8), (2, 3, None)], ["k", "at", "v"])
    assert to_rows(aggregate(rows, v=first_value("v", "at"))) == [(7,)]
    assert sorted(to_rows(group_aggregate(rows, "k", v=first_value("v", "at")))) == [(1, 7), (2, None)]


def test_grouped_aggregation(spark):
    rows = project(seq(spark, 50, 100), "x", k=bucket("x"))
    out = to_rows(group_aggregate(rows, "k", least=min_value("x"), most=max_value("x"), total=sum_i64("x"), n=count_all()).orderBy("k"))
    assert out == [(13 + k, 100 + k, 140 + k, 600 + 5 * k, 5) for k in range(10)]


def test_null_is_a_group(spark):
    rows = values(spark, [(None, 1), (5, 2), (None, 3)], ["k", "v"])
    assert sorted(to_rows(group_aggregate(rows, "k", total=sum_i64("v"))), key=str) == [(5, 2), (None, 4)]


def test_sum_of_doubles(spark):
    rows = values(spark, [(0.5,), (None,), (1.25,)], ["v"], [DoubleType()])
    assert to_rows(aggregate(rows, total=sum_f64("v"))) == [(1.75,)]
    assert to_rows(aggregate(filter_rows(rows, F.lit(False)), total=sum_f64("v"))) == [(0.0,)]


def test_constant_table(spark):
    rows = [(1, 10, 100), (2, 20, 200), (None, 30, 300), (4, None, 400), (5, 50, None)]
    assert to_rows(values(spark, rows, ["a", "b", "c"])) == rows
    assert to_rows(values(spark, [], ["a"])) == []
    for row in ((1,), (1, 2, 3)):
        with pytest.raises(ValueError):
            values(spark, [row], ["a", "b"])


@pytest.mark.parametrize(("n", "m"), [(3, 3), (1, 10), (6, 3), (3, 6), (10, 1034), (10, 0), (0, 10)])
def test_cross(spark, n, m):
    out = cross(seq(spark, n, 0), sequence(spark, m, i=Counting(10)))
    assert out.columns == ["x", "i"]
    assert sorted(to_rows(out)) == [(a, 10 + b) for a in range(n) for b in range(m)]


def test_theta(spark):
    out = theta(seq(spark, 4, 0), sequence(spark, 4, i=Counting(0)), F.col("x") < F.col("i"))
    assert sorted(to_rows(out)) == [(a, b) for a in range(4) for b in range(4) if a < b]


def test_project(spark):
    square = multiply("x", "x")
    out = project(seq(spark, 10, 0, 100), x=F.col("x"), twice=add(square, square), minus=negate(square))
    assert sorted(to_rows(out)) == [(k, 2 * k * k, -k * k) for k in range(10)]
    assert project(seq(spark, 2, 0, 1), "y", "x", again=F.col("x")).columns == ["y", "x", "again"]


def test_scalars_and_nulls(spark):
    rows = values(spark, [(-7, 2), (7, None), (None, 1)], ["x", "y"])
    out = to_rows(project(rows, a=add("x", "y"), m=multiply("x", "y"), d=int_div("x", 2), b=bucket("x"), n=negate("x")))
    assert out == [(-5, -14, -3, 6, 7), (None, None, 3, 20, -7), (None, None, None, None, None)]


def test_generators(spark):
    out = to_rows(sequence(spark, 12, 4, v=Counting(3, 7), w=Constant(7), n=Constant(None), f=F.col("id") * 2).orderBy("f"))
    assert out == [(3 + k % 4, 7, None, 2 * k) for k in range(12)]
    with pytest.raises(ValueError):
        sequence(spark, 1, v=Counting(3, 3))


def test_live_rows(spark):
    rows = values(spark, [(1, 1), (2, 0), (3, None)], ["x", "f"]).select("x", (F.col("f") == 1).alias("live"))
    assert to_rows(live_rows(rows)) == [(1,)]


def test_tsv(spark, tmp_path):
    rows = values(spark, [(1, None, 10), (2, 3, 4)], ["a", "b", "c"]).coalesce(1)
    assert to_rows(write_tsv(rows, str(tmp_path / "t"))) == [(2,)]
    text = "".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*")))
    assert text == "1\tnull\t10\n2\t3\t4\n"
    assert to_rows(write_tsv(rows.where("a < 0"), str(tmp_path / "t"))) == [(0,)]


def test_functions_in_python(spark):
    def minus(x: pd.Series) -> pd.Series:
        return -x

    rows = values(spark, [(1, 5), (1, None), (2, -4)], ["k", "v"])
    assert to_rows(project(rows, a=vectorized(minus, "double")("v"))) == [(-5.0,), (None,), (4.0,)]
    assert to_rows(filter_rows(rows, null_rejecting(lambda x: x > -10)(F.col("v")))) == [(1, 5), (2, -4)]
    spread = custom(lambda x: float(x.max() - x.min()), "double")
    assert sorted(to_rows(group_aggregate(seq(spark, 10, 0).select((F.col("x") % 2).alias("k"), "x"), "k", s=spread("x")))) == [(0, 8.0), (1, 8.0)]


def test_files_that_arrive(spark, tmp_path):
    seq(spark, 50, 0).write.parquet(str(tmp_path / "in"))
    stream = arriving(spark, str(tmp_path / "in"), seq(spark, 1, 0).schema, files_per_batch=1)
    totals = running_aggregate(filter_rows(stream, F.col("x") % 2 == 0).select((F.col("x") % 4).alias("k"), "x"), ["k"], total=sum_i64("x"))
    seen = {}
    drain(totals, lambda df, _: seen.update({r.k: r.total for r in df.collect()}), str(tmp_path / "c"), complete=True)
    assert seen == {0: sum(range(0, 50, 4)), 2: sum(range(2, 50, 4))}


def test_plans(spark):
    """Filters and columns reach the scan; top-n is one operator; a stacked filter is one filter."""
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = project(filter_rows(orders, F.col("o_orderkey") > 5, F.col("o_custkey") < 9), "o_orderkey")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), IsNotNull(o_custkey), GreaterThan(o_orderkey,5), LessThan(o_custkey,9)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
    assert "TakeOrderedAndProject" in top_n(orders, 3, "o_orderkey", "o_custkey")._jdf.queryExecution().executedPlan().toString()


def test_tsv_reads_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb\nc\\d\r", 0.5), (None, None, None), (3, "null", 2.0), (4, "", -1.0), (5, "\\=null", 0.0), (6, "\\t\"q\"", 1.0)], "`a.b` long, s string, d double")
    assert to_rows(write_tsv(df, str(tmp_path / "t"))) == [(6,)]
    assert sorted(to_rows(read_tsv(spark, str(tmp_path / "t"), df.schema)), key=repr) == sorted(to_rows(df), key=repr)


def test_group_ids_by_any_order_and_among_any_names(spark):
    rows = [(k % 7, f"{(k * 37) % 100:03d}", k) for k in range(100)]
    df = spark.createDataFrame(rows, "k long, at string, group_id long").withColumnsRenamed({}).selectExpr("k", "at", "group_id", "k AS `a.b`", "at AS row", "k AS key", "k AS __key", "k AS of").repartition(5)
    out = with_group_id(df, "k", "at")
    assert out.columns == ["group_id", "k", "at", "a.b", "row", "key", "__key", "of"]
    first = {}
    for k, at, _ in sorted(rows, key=lambda r: r[1]):
        first.setdefault(k, len(first))
    assert {(r.group_id, r.k) for r in out.collect()} == {(v, k) for k, v in first.items()} and out.count() == 100
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= plan.count("Window [sum(n")  # only one row a range meets in a task
    ties = spark.createDataFrame([(3, 1.5), (1, 1.5), (2, 0.5)], "k long, at double")
    assert sorted(to_rows(with_group_id(ties, "k", "at").select("k", "group_id"))) == [(1, 1), (2, 0), (3, 2)]


def test_generators_skip_to_their_rows(spark):
    from lamella.plans.catalogue import Squares
    from lamella.sources.generators import generated

    expected = [(k, None if k % 7 == 6 else k * k % 97) for k in range(50)]
    for partitions in (1, 4, 50):
        assert sorted(to_rows(generated(spark, 50, Squares, partitions=partitions))) == expected
    assert to_rows(generated(spark, 0, Squares)) == []


def test_table_functions_on_their_own(spark):
    from lamella.sources.generators import table_function

    pairs = table_function(lambda n: ((k, k * k) for k in range(n)), "k int, square int")
    assert sorted(to_rows(pairs(F.lit(3)))) == [(0, 0), (1, 1), (2, 4)]


def test_predicates_that_see_nulls(spark):
    from lamella.functions.scalar import null_aware

    df = spark.createDataFrame([(1,), (None,), (5,)], "x long")
    assert sorted(to_rows(filter_rows(df, null_aware(lambda x: x.isna() | (x > 3))("x"))), key=repr) == [(5,), (None,)]


def test_accumulators_merge(spark):
    class Longest:
        """The longest string and how many there are; states merge."""

        def zero(self):
            return None, 0

        def add(self, state, rows):
            for x in rows.column(0).to_pylist():
                state = self.merge(state, (x, 1))
            return state

        def merge(self, one, other):
            found = sorted((s for s in (one[0], other[0]) if s is not None), key=lambda s: (-len(s), s))
            return (found[0] if found else None), one[1] + other[1]

        def result(self, state):
            return f"{state[0]}/{state[1]}"

    rows = [(k % 3 or None, "b" * (k % 5), k) for k in range(60)]
    df = spark.createDataFrame(rows, "`k.1` long, s string, k0 long").repartition(6).withColumnRenamed("k.1", "k")
    found = dict(to_rows(accumulate(df, "k", ["s"], Longest(), "string")))
    assert found == {None: "bbbb/20", 1: "bbbb/20", 2: "bbbb/20"}
    assert to_rows(accumulate(df.where("k0 < 0"), ["k", "k0"], ["s"], Longest(), "string")) == []
    assert len(to_rows(accumulate(df, ["k", "k0"], ["s"], Longest(), "string"))) == 60


def test_operators_in_a_chain(spark):
    out = chain(sequence(spark, 50, x=Counting(0)), lambda df: filter_rows(df, F.col("x") % 2 == 0), lambda df: limit_rows(df, 3, "x"))
    assert to_rows(out) == [(0,), (2,), (4,)]


def test_pairs_of_an_inequality_are_counted_unmade(spark):
    from lamella.operators.relational import theta_count
    from lamella.plans import catalogue

    lows = [0.0, -0.0, 1.5, None, float("nan"), float("-inf"), float("inf"), 2.5]
    outer = spark.createDataFrame([(k % 5 or None, f"{k % 2}", lows[k % 8]) for k in range(60)], "`k.1` long, n string, low double").repartition(3)
    inner = spark.createDataFrame([(float(k % 9) / 2 - 1,) for k in range(100)] + [(x,) for x in lows], "row double").repartition(2)
    pairs = theta(outer, inner, F.col("low") < F.col("row"))
    for keys in ("k.1", ["n", "k.1"], ["low"]):
        names = [keys] if isinstance(keys, str) else keys
        out = theta_count(outer, inner, "low", "row", keys, "pairs")
        assert out.columns == [*names, "pairs"]
        expected = group_aggregate(pairs, [f"`{c}`" for c in names], pairs=count_all())
        assert sorted(to_rows(out), key=repr) == sorted(to_rows(expected), key=repr) != []
    for o, i in ((outer.where("false"), inner), (outer, inner.where("false")), (outer.where("low IS NULL"), inner), (outer.where("isnan(low)"), inner)):
        assert to_rows(theta_count(o, i, "low", "row", "n")) == []
    whole = sequence(spark, 7, a=Counting(0)), sequence(spark, 7, b=F.col("id") + 0.5)
    assert sorted(to_rows(theta_count(*whole, "a", "b", "a"))) == [(k, 7 - k) for k in range(7)]
    a, b = 40_000, 50_000  # two thousand million pairs
    many = theta_count(sequence(spark, a, x=F.col("id") * 7 % a), sequence(spark, b, y=F.col("id") * 3 % b), "x", "y", "x")
    assert to_rows(many.agg(F.count("x"), F.sum("n"), F.max(F.abs(F.col("n") + F.col("x") + 1 - b)))) == [(a, a * b - a * (a + 1) // 2, 0)]
    plan = catalogue.theta_join(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan  # there was one, of 54 thousand million pairs on 60 times sf0.1
    assert plan.count("SinglePartition") <= plan.count("Window [sum(n")


def test_entry_without_the_corpus_operators(monkeypatch):
    """Whatever module of theirs is missing, the other queries are there."""
    import importlib
    import sys
    import warnings

    import __spark_entry__

    for name in [m for m in sys.modules if m.startswith(("lamella.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found = importlib.reload(__spark_entry__)
    assert "complex_pipeline" in found.queries() and not [q for q in found.queries() if q.startswith("op")]
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
