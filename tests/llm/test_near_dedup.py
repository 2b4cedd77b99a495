import itertools
import random
import re

import numpy as np
import pytest

from lamella.llm import near_dedup, words
from lamella.llm.components import components


def sets_by_hand(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def by_hand(rows, n, percent):
    """(doc_id, set size, component) by comparing all pairs."""
    sets = [sets_by_hand(t, n) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            label[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), None if i is None else least[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


def texts(n, chance):
    vocabulary = ["ab", "Cd", "éa", "X.", "zz"] + [f"w{k}" for k in range(300)]
    rows = []
    for k in range(n):
        if rows and chance.random() < 0.6:
            w = chance.choice(rows)[1].split(" ")
            for _ in range(chance.randint(0, 1 + len(w) // 25)):
                w[chance.randrange(len(w))] = chance.choice(vocabulary)
        else:
            w = [chance.choice(vocabulary) for _ in range(chance.randint(0, 80))] or [""]
        rows.append((1000 + (k * 7919) % 10007, " ".join(w)))
    return rows


def test_as_all_pairs_would_have_it(spark):
    rows = texts(400, random.Random(2)) + [(5, None), (6, ""), (7, " \n"), (8, "A b"), (9, "a B"), (10, "a b c"), (None, "a b"), (11, "the same\x0bone"), (11, "the same\x0bone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "'k' AS key", "2 AS component")
    out = near_dedup.near_duplicates(docs, shingle=4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr) == by_hand(rows, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_a_large_group_in_chunks(spark):
    """Three groups whose documents share passages, so that buckets hold several components, and rows that share ids."""
    chance = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(chance.randint(0, 4)):
            w[chance.randrange(60)] = f"x{chance.randrange(10**6)}"
        if k % 3:
            w[42:] = [f"y{k % 3}{i}" for i in range(18)]
        rows.append((k // 2 if k > 100 else k, " ".join(w)))
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4, chunk=8).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr) == by_hand(rows, 4, 80)


def test_nothing(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in near_dedup.near_duplicates(spark.createDataFrame([(3, None)], "doc_id long, text string")).collect()] == [(3, 0, 3, True, -1, None)]


def test_signatures_estimate_similarity():
    chance = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        n = 1000
        common = int(2 * n * share / (1 + share))
        a = words.mix(chance.integers(0, 2**63, n).astype(np.uint64))
        b = np.concatenate((a[:common], words.mix(chance.integers(0, 2**63, n - common).astype(np.uint64))))
        sig = near_dedup.min_max([a, b])
        assert abs((sig[0] == sig[1]).mean() - share) < 0.12


def test_components_of_chains(spark):
    chance = random.Random(1)
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 150)] + [(chance.randrange(200, 260), chance.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    label = {x: x for link in links for x in link}
    for _ in range(300):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    out = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {k: v for k, v in label.items() if any(a != b and k in (a, b) for a, b in links)}


@pytest.mark.parametrize("n", [1, 3, 4])
def test_hashes_are_of_words(n):
    rows = texts(50, random.Random(n)) + [(0, "a b c"), (1, "\x1f x"), (2, "")]
    seen = {}
    raw = [t.encode() for _, t in rows]
    for block in words.blocks(raw):
        hashes, counts = words.shingles(block, n)
        at = 0
        for text, c in zip(block, counts):
            w = text.lower().split()
            runs = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else ([tuple(w)] if w else [])
            assert len(runs) == c
            for run, h in zip(runs, hashes[at : at + c]):
                assert seen.setdefault(run, h) == h
            at += c
    assert len(set(seen.values())) == len(seen)
