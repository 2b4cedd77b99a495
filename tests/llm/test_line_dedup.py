import hashlib
import random

import numpy as np
import pytest

from lamella.llm import line_dedup


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t)


def by_hand(rows, bound=1, least=1, near_least=10):
    """(id, text, lines, equal, near) of each row, by comparing every line with all before it; equal rows are one document."""
    before, out = {}, {}
    key = lambda t: -1 if t is None else int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    for i, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, key(r[1]))):
        if text is None:
            out[i, text] = (i, None, 0, 0, 0)
            continue
        kept, equal, near = [], 0, 0
        for line in text.split("\n"):
            t = lower(line.strip(" \t\r"))
            if len(t) < least:
                kept.append(line)
                continue
            if t in before:
                equal += 1
            elif len(t) >= near_least and any(len(o) >= near_least and abs(len(t) - len(o)) <= bound and edits(t, o) <= bound for o in before):
                near += 1
            else:
                kept.append(line)
            before[t] = 1
        out[i, text] = (i, "\n".join(kept), len(text.split("\n")), equal, near)
    return sorted((out[r] for r in rows), key=repr)


def found(docs, **bounds):
    return sorted((tuple(r) for r in line_dedup.deduplicate(docs, report=True, **bounds).select("doc_id", "text", "n_lines", "n_equal", "n_near").collect()), key=repr)


def corpus(chance, n):
    pool = ["".join(chance.choice("abcé 漢😀") for _ in range(chance.randint(8, 24))) for _ in range(12)]
    rows = []
    for k in range(n):
        lines = []
        for _ in range(chance.randint(0, 8)):
            t = chance.choice(pool)
            for _ in range(chance.choice([0, 0, 1, 1, 2])):
                i = chance.randrange(len(t))
                t = chance.choice([t[:i] + t[i + 1 :], t[:i] + chance.choice("abzé") + t[i:], t[:i] + chance.choice("abz😀") + t[i + 1 :]]) or "x"
            lines.append(chance.choice([t, t.upper() if t.isascii() else t, f"  {t}\r"]))
        rows.append((k * 37 % 1009, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_as_comparing_everything(spark, seed):
    rows = corpus(random.Random(seed), 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(docs) == by_hand(rows)


@pytest.mark.parametrize("seed", [4, 5])
def test_two_edits_as_comparing_everything(spark, seed):
    rows = corpus(random.Random(seed), 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(docs, edits=2, min_chars=4, near_chars=9) == by_hand(rows, 2, 4, 9)
    with pytest.raises(ValueError):
        line_dedup.dropped_lines(docs, edits=3)


def test_rows_that_share_an_id_lose_their_own_lines_only(spark):
    chance = random.Random(7)
    rows = [(chance.choice([None, None, 1, 2, 3]), text) for _, text in corpus(chance, 60)]
    rows += [(None, "alpha line number one\nunique second line of A"), (None, "beta something else\nalpha line number one"), (7, "first text here\nshared"), (7, "second text line here\nshared"), (1, None), (None, None), (None, "")]
    rows += rows[:5] + rows[-3:]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(docs) == by_hand(rows)
    texts = "\n".join(t or "" for _, t, *_ in found(docs))
    assert "unique second line of A" in texts and "second text line here" in texts


def test_no_line_that_is_not_blank_stands_twice(spark):
    rows = [(k, t) for k, t in enumerate(["a\n\nb\n", "b\n \nc", "C\nab", "abc\nabd"])]
    assert [t for _, t, *_ in found(spark.createDataFrame(rows, "doc_id long, text string"))] == ["a\n\nb\n", " \nc", "ab", "abc\nabd"]


def test_of_a_chain_the_first_stays(spark):
    rows = [(1, "a" * 12), (2, "a" * 11 + "b"), (3, "a" * 10 + "bb")]
    assert [t for _, t, *_ in found(spark.createDataFrame(rows, "doc_id long, text string"))] == ["a" * 12, "", ""]


def test_cases(spark):
    long = "word " * 3000
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "a line of text\nA LINE OF TEXT \nshort\nshort"), (5, long + "x"), (6, long + "y"), (7, "a line of texts\nanother line here"), (None, "another line herE")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' AS line", "1 AS doc", "text AS h1")
    assert found(docs) == by_hand(rows)
    assert line_dedup.deduplicate(docs).columns == docs.columns
    assert found(docs.limit(0)) == []


def test_repeated_rows_are_one_document(spark):
    docs = spark.createDataFrame([(1, "the first line\nthe other one"), (1, "the first line\nthe other one"), (2, "the first line")], "doc_id long, text string")
    assert found(docs) == [(1, "the first line\nthe other one", 2, 0, 0)] * 2 + [(2, "", 1, 1, 0)]


def test_variants_meet_exactly_for_one_edit():
    chance = random.Random(6)
    for _ in range(300):
        a = "".join(chance.choice("ab漢") for _ in range(chance.randint(10, 14)))
        b = "".join(chance.choice("ab漢") for _ in range(chance.randint(10, 14))) if chance.random() < 0.3 else a[: (i := chance.randrange(10))] + chance.choice(["", "a", "ab"]) + a[i + chance.choice([0, 1]) :]
        if a == b or len(b) < 10:
            continue
        block = line_dedup.Block([a, b])
        whole = block.whole()
        cut = [block.deletions(k, 0, len(t)) for k, t in enumerate((a, b))]
        n = min(len(a), len(b))
        meets = (len(a) == len(b) and bool((cut[0] == cut[1]).any())) or whole[1] in cut[0] or whole[0] in cut[1]
        assert meets == (edits(a, b) <= 1) and n
        if edits(a, b) <= 1:
            parts = block.parts()[0]
            assert set(parts[0]) & set(parts[1])


def test_parts_are_no_more_than_half():
    n = np.arange(1, 5000)
    p = line_dedup.part(n)
    assert (p >= 1).all() and (2 * p[1:] <= n[1:]).all() and (p[20:] >= 0.4 * n[20:]).all()
