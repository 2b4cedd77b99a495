import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lamella.llm import exact_dedup


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def by_hand(rows, best):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = best(known) if known else None
        for k, i in enumerate(sorted(ids, key=lambda i: (i is None, i or 0))):
            first = sorted(ids, key=lambda i: (i is None, i or 0)).index(i) == k
            out.append((i, keep, len(ids), i == keep and first, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, "Abc é"), (2, "aBC é"), (3, "abc É"), (4, None), (5, ""), (6, "x" * 100_000), (7, "X" * 100_000), (8, "same"), (8, "same"), (9, "SAME"), (None, "alone"), (None, "alone"), (None, "abc é"), (10, "other"), (10, "text")]


@pytest.mark.parametrize(("keep", "best"), [("largest", max), ("smallest", min)])
@pytest.mark.parametrize("weak", [False, True])
def test_as_by_hand_even_where_hashes_collide(spark, keep, best, weak):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS h", "'s' AS sha", "2 AS keep_id").repartition(3)
    options = {"content_hash": lambda t: F.substring(F.unhex(F.md5(t)), 1, 0)} if weak else {}
    out = exact_dedup.exact_dedup(docs, keep=keep, **options).collect()
    assert sorted((tuple(r) for r in out), key=repr) == by_hand(ROWS, best)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
