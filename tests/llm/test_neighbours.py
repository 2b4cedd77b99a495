import math

import numpy as np
from pyspark.sql import functions as F

from lamella.llm import neighbours


def by_hand(rows, k, query=lambda i: i % 100 == 0):
    """(query, rank, id, distance) by comparing everything."""
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, a in fine:
        if query(q):
            near = sorted((math.dist(a, b), i) for i, b in fine if i != q and len(a) == len(b))[:k]
            out += [(q, r, i, d) for r, (d, i) in enumerate(near, 1)]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def same(a, b):
    return len(a) == len(b) and all(x[:3] == y[:3] and abs(x[3] - y[3]) < 1e-9 for x, y in zip(a, b))


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.5]), (3, None), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [None, 1.0]), (7, [0.0, 0.0]), (8, []), (None, [1.0, 2.0]), (100, [3.0, 4.0]), (200, [1.0, 1.0, 1.0]), (9, [1.0, 2.0]), (300, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit("x")).withColumn("rank", F.lit(7))
    out = found(neighbours.nearest(vectors, F.col("vec_id") % 100 == 0, k=3))
    assert same(out, by_hand(rows, 3))
    assert [x[2] for x in out if x[0] == 0] == [1, 9, 2]
    assert found(neighbours.nearest(vectors.limit(0), F.col("vec_id") % 100 == 0)) == []
    assert found(neighbours.nearest(vectors.where("vec_id = 0"), F.col("vec_id") % 100 == 0)) == []


def test_repeated_rows_count_once(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.0, 3.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert same(found(neighbours.nearest(vectors, F.col("vec_id") % 100 == 0)), by_hand([*{i: (i, v) for i, v in rows}.values()], 10))


def recall(out, true):
    reach = {}
    for q, r, _, d in true:
        reach[q] = max(reach.get(q, 0), d)
    return sum(d <= reach[q] + 1e-9 for q, _, _, d in out) / len(true)


def test_recall_without_structure_and_in_many_blocks(spark):
    chance = np.random.default_rng(3)
    for dim, blocks in ((64, 4096), (64, 300), (5, 4096), (150, 4096)):
        rows = [(k, [float(x) for x in v]) for k, v in enumerate(chance.standard_normal((1500, dim)).astype(np.float32))]
        out, true = found(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0, block=blocks)), by_hand(rows, 10)
        assert len(out) == len(true) and recall(out, true) >= 0.95, (dim, blocks)


def test_exact_search_is_brute_force(spark):
    """With ties, copies, several lengths, and ids that repeat with vectors of other lengths, in one block and in many."""
    chance = np.random.default_rng(6)
    rows = [(k, [float(x) for x in chance.integers(-3, 4, 3 + k % 2)]) for k in range(700)] + [(k, [9.0]) for k in range(100, 130)] + [(k, [0.5, 0.5]) for k in range(0, 30, 10)]
    least = {}
    for i, v in rows:
        if any(v) and (i not in least or v < least[i]):
            least[i] = v
    for block in (100, 10**6):
        out = found(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, exact=True, block=block))
        assert same(out, by_hand(list(least.items()), 10, lambda i: i % 20 == 0))


def test_recall_on_the_test_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    matrix, out = np.array([v for _, v in rows], np.float64), found(neighbours.nearest(vectors, F.col("vec_id") % 100 == 0))
    true = []
    for k, (i, v) in enumerate(rows):
        if i % 100 == 0:
            distance = np.sqrt(((matrix - matrix[k]) ** 2).sum(axis=1))
            distance[k] = np.inf
            true += [(i, r, None, d) for r, d in enumerate(np.sort(distance)[:10], 1)]
    assert len(out) == len(true) and recall(out, true) >= 0.95


def test_one_vector_that_is_very_common(spark):
    chance = np.random.default_rng(4)
    common = [float(x) for x in chance.standard_normal(16).astype(np.float32)]
    rows = [(k, common if k % 3 == 0 else [float(x) for x in chance.standard_normal(16).astype(np.float32)]) for k in range(900)]
    out, true = found(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0)), by_hand(rows, 10)
    assert [x for x in out if x[0] % 3 == 0] == [x for x in true if x[0] % 3 == 0] and recall(out, true) >= 0.95


def test_copies_of_one_vector_do_not_end_a_search():
    """A third of the block is one vector beside a cluster; each query of the cluster still finds its neighbours."""
    chance = np.random.default_rng(5)
    vectors = chance.standard_normal((6000, 64))
    centre = chance.standard_normal(64)
    vectors[:200] = centre + 0.5 * chance.standard_normal((200, 64))
    vectors[4000:] = centre + 0.3 * chance.standard_normal(64)
    index = neighbours.Index(np.arange(6000), vectors)
    for q in range(40):
        distance = index.search(q, vectors[q], 10)[1]
        true = np.sort(np.delete(np.linalg.norm(vectors - vectors[q], axis=1), q))[:10]
        assert (distance <= true[-1] + 1e-9).mean() >= 0.9, q
