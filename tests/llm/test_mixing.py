import hashlib
import random
import re
from collections import defaultdict

import pytest

from lamella.llm import mixing


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets_by_hand(sizes, weights, most):
    """Sharing by weight, capping, and sharing the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, free, goal = float(sum(sizes.values())), set(order), {}
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not over:
            return goal | {s: left * weight[s] / total for s in free}
        for s in over:
            goal[s] = float(most * sizes[s])
            left -= goal[s]
        free -= over


def by_hand(rows, weights=(1, 2, 3), most=3):
    """Every document's copies in the sorted queue, cut at the budget."""
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size_of(text)
    goal = targets_by_hand(sizes, weights, most) if rows else {}
    queue = []
    for source in sizes:
        own = sorted((hashlib.md5((str(i) if i is not None else t or "").encode()).hexdigest(), size_of(t), k) for k, (i, t, s) in enumerate(rows) if s == source)
        for turn in range(most):
            at = 0
            for place, (key, size, k) in enumerate(own):
                at += size
                if size and turn * sizes[source] < goal[source]:
                    queue.append(((turn * sizes[source] + at) / goal[source], source is None, source or "", key, place, turn, k, size))
    copies, used = defaultdict(int), 0
    for slot in sorted(queue):
        used += slot[-1]
        if used > sum(sizes.values()):
            break
        copies[slot[-2]] += 1
    return [(i, size_of(t), sizes[s], goal[s], copies[k] * size_of(t)) for k, (i, t, s) in enumerate(rows)]


def corpus(chance, n, sources):
    return [(k, " ".join("w" * chance.randint(1, 3) for _ in range(chance.choice([0, 1, 5, 30, 200]))), chance.choice(sources)) for k in range(n)]


SOURCES = ["a"] * 20 + ["b", "c", "d", None, "é", "Z"]


def same(out, expected):
    a = sorted(((r.doc_id is None, r.doc_id or 0, r.size, r.source_size, r.taken, r.target) for r in out))
    b = sorted(((i is None, i or 0, n, s, t, g) for i, n, s, g, t in expected))
    assert [x[:5] for x in a] == [x[:5] for x in b]
    assert [x[5] for x in a] == pytest.approx([x[5] for x in b])


@pytest.mark.parametrize("seed", [1, 2])
def test_as_sorting_the_whole_queue(spark, seed):
    rows = corpus(random.Random(seed), 600, SOURCES)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "'k' AS key", "2 AS target").repartition(5)
    out = mixing.mix(docs).collect()
    same(out, by_hand(rows))
    taken, goal = defaultdict(int), {}
    for r in out:
        taken[r.source] += r.taken
        goal[r.source] = r.target
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - goal[s]) <= 600 for s in goal)


def test_cases(spark):
    schema = "doc_id long, text string, source string"
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (3, "x y", None), (None, "x", "a"), (None, "y", "a"), (4, "w " * 5000, "b"), (5, " \n", "zero")]
    docs = spark.createDataFrame(rows, schema)
    same(mixing.mix(docs).collect(), by_hand(rows))
    assert mixing.mix(docs.limit(0)).count() == 0
    same(mixing.mix(docs.where("text IS NULL")).collect(), [(1, 0, 0, 0.0, 0)])


def test_one_source_alone_is_taken_once(spark):
    rows = corpus(random.Random(3), 50, ["only"])
    assert all(r.copies == (r.size > 0) for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())


def test_rows_are_repeated_as_decided(spark):
    rows = [(i, t, s) for i, t, s in corpus(random.Random(4), 300, SOURCES)] + [(9000, "same row", "d")] * 3 + [(9001, "one two", "d"), (9001, "two one", "d"), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "doc_id AS copies", "1 AS size")
    out = mixing.repeat(docs)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.doc_id] += size_of(r.text)
    expected = defaultdict(int)
    for i, _, _, _, taken in by_hand(rows):
        expected[i] += taken
    assert {k: v for k, v in expected.items() if v} == dict(words)
    assert mixing.repeat(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (mixing.mix(docs), mixing.repeat(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
