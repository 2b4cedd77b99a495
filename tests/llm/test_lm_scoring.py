import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lamella.llm import lm_scoring, words

FOLDER = "/root/testdata/sf0.001"


def tokens_by_hand(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def out_by_hand(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def base_by_hand(rows):
    c = Counter(t for i, text in rows if not out_by_hand(i) for t in tokens_by_hand(text))
    n, v = sum(c.values()), len(c)
    for i, text in rows:
        t = tokens_by_hand(text)
        yield i, out_by_hand(i), len(t), sum(x in c for x in t), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)


def same(out, rows):
    a = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.held_out, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out))
    b = sorted(((i is None, i or 0, n, h, k, t, round(s, 6)) for i, h, n, k, t, s in base_by_hand(rows)))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:6] == y[:6] and x[6] == pytest.approx(y[6], abs=1e-5)


def corpus(chance, n):
    follows = {w: [f"{w}{k}" for k in range(3)] for w in ("the", "of", "é", "and")}
    rows = []
    for k in range(n):
        t = []
        for _ in range(chance.randint(0, 60)):
            w = chance.choice(list(follows))
            t += [w, chance.choice(follows[w])]
        rows.append((k, " ".join(t) + (f" odd{k}" if k % 7 == 0 else "")))
    return rows


@pytest.mark.parametrize(("frequent", "shard_tokens"), [(1 << 19, 1 << 21), (3, 1 << 21), (50, 400)])
def test_base_and_cases(spark, frequent, shard_tokens):
    settings = lm_scoring.Settings(bands=((1, 1), (1, 2)), frequent=frequent, shard_tokens=shard_tokens)
    rows = corpus(random.Random(1), 150) + [(500, None), (501, ""), (502, " \n\t "), (503, "Never\x0bseen THE"), (504, "the of " * 20000), (505, "same row"), (505, "same row"), (505, "another row"), (None, "the x"), (None, "of x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS c", "3 AS row", "'x' AS held_out", "7 AS text_key", "1 AS `a.b`")
    out = lm_scoring.score(docs, settings=settings).collect()
    same(out, rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert len({round(r.score, 9) for r in out if r.doc_id == 505 and r.n_tokens == 3}) == 2  # of three rows two are the same
    assert lm_scoring.score(docs.limit(0)).count() == 0


def test_without_training_documents(spark):
    rows = [(i, "some text") for i in range(200) if out_by_hand(i)][:3]
    out = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same(out, rows)
    assert all(math.isfinite(r.score) for r in out)


def test_test_documents(spark):
    """The base as counted by hand, and the model above it on documents that it has not seen."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    out = lm_scoring.score(docs).collect()
    same(out, rows)
    unseen = [r for r in out if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


class ByHand:
    """The model over dictionaries, a token at a time."""

    def __init__(self, rows, settings):
        self.settings = settings
        self.count = Counter(t for i, text in rows if not out_by_hand(i) for t in tokens_by_hand(text))
        self.hash = {t: int(lm_scoring.tokens([b"" if t is None else t.encode()])[0][0]) for _, text in rows for t in tokens_by_hand(text)}
        ranked = sorted(self.count, key=lambda t: (-self.count[t], self.hash[t]))
        self.rank, place = {}, 0
        self.mass, self.path = defaultdict(float), {}
        first_class = 0
        for band, (classes, depth) in enumerate(self.settings.bands):
            for q in range(classes * self.settings.branch**depth):
                if place < len(ranked):
                    t = ranked[place]
                    self.rank[t] = place
                    digits = [q // self.settings.branch**d for d in range(depth, -1, -1)]
                    self.path[t] = [("root", first_class + digits[0])] + [((band, d, digits[d]), digits[d + 1] % self.settings.branch) for d in range(depth)]
                    for node in self.path[t]:
                        self.mass[node] += self.count[t]
                place += 1
            first_class += classes
        self.first_rare, self.rare_total = first_class, {}
        for r in range(lm_scoring.RARE_CLASSES):
            rest = [self.count[t] for t in self.count if t not in self.rank and self.hash[t] % lm_scoring.RARE_CLASSES == r]
            self.rare_total[r] = self.mass["root", first_class + r] = sum(rest) + lm_scoring.ADDED * (len(rest) + 1)
        self.weights, self.squares = defaultdict(float), defaultdict(lambda: 0.01)

    def steps(self, t):
        return self.path.get(t) or [("root", self.first_rare + self.hash[t] % lm_scoring.RARE_CLASSES)]

    def probabilities(self, before, node):
        options = {o: m for (n, o), m in self.mass.items() if n == node}
        rows = [(k, *before[: (1, 2, 1)[k]], before[2] if k == 2 else None, node) for k in range(3)]
        logits = {o: math.log(m) + sum(self.weights[r, o] for r in rows) for o, m in options.items()}
        top = max(logits.values())
        total = sum(math.exp(x - top) for x in logits.values())
        return rows, {o: math.exp(x - top) / total for o, x in logits.items()}

    def train(self, events):
        """A batch of events and their weights: first the classes, then the steps below, by band and depth, in runs of BATCH."""
        below = [(before, step, w) for band in range(len(self.settings.bands)) for d in range(3) for before, t, w in events for step in self.steps(t)[1:] if step[0][:2] == (band, d)]
        for run in [[(before, self.steps(t)[0], w) for before, t, w in events], *(below[a : a + self.settings.batch] for a in range(0, len(below), self.settings.batch))]:
            gradient = defaultdict(lambda: defaultdict(float))
            for before, (node, choice), w in run:
                rows, p = self.probabilities(before, node)
                for r in rows:
                    for o in p:
                        gradient[r][o] += w * (p[o] - (o == choice))
            for r, g in gradient.items():
                self.squares[r] += sum(x * x for x in g.values())
                for o, x in g.items():
                    self.weights[r, o] -= x * self.settings.step / math.sqrt(self.squares[r])

    def log10(self, before, t):
        p = sum(math.log10(self.probabilities(before, node)[1][choice]) for node, choice in self.steps(t))
        return p if t in self.rank else p + math.log10((self.count[t] + lm_scoring.ADDED) / self.rare_total[self.hash[t] % lm_scoring.RARE_CLASSES])


def events_by_hand(text):
    t = ["START"] * 3 + tokens_by_hand(text)
    return [((t[k - 1], t[k - 2], t[k - 3]), t[k]) for k in range(3, len(t))]


def test_scores_as_dictionaries_have_them(spark):
    settings = lm_scoring.Settings(branch=3, bands=((1, 1), (1, 2)), batch=16, rows=(1 << 21, 1 << 21))
    rows = corpus(random.Random(3), 12)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = {r.doc_id: r.score for r in lm_scoring.score(docs, settings=settings).collect()}
    model = ByHand(rows, settings)
    assert len(model.rank) < len(model.count)  # some words have no rank
    events = Counter(e for i, text in rows if not out_by_hand(i) for e in events_by_hand(text))
    assert max(events.values()) > 1
    v = lm_scoring.Vocabulary(lm_scoring.count_tokens(spark.createDataFrame([(t,) for i, t in rows if not out_by_hand(i)], "text string").selectExpr("CAST(text AS BINARY) AS text")), settings)
    number = {t: int(v.ids(np.array([h], np.uint64))[0]) for t, h in model.hash.items()} | {"START": lm_scoring.START}
    order = sorted(events, key=lambda e: lm_scoring.event_keys(np.array([[number[t]] for t in e[0]]), np.array([number[e[1]]]))[0])
    for a in range(0, len(order), 16):
        model.train([(*e, events[e]) for e in order[a : a + 16]])
    for i, text in rows:
        assert out[i] == pytest.approx(sum(model.log10(*e) for e in events_by_hand(text)), rel=1e-3), i


def test_probabilities_of_what_may_follow_add_up(spark):
    rows = corpus(random.Random(2), 60)
    training = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("CAST(text AS BINARY) AS text")
    for frequent in (1 << 19, 10):
        v = lm_scoring.Vocabulary(lm_scoring.count_tokens(training), lm_scoring.Settings(frequent=frequent))
        model = lm_scoring.Model(v)
        for _, text in rows:
            h, n = lm_scoring.tokens([text.encode()])
            model.train(lm_scoring.history(v.ids(h), n), v.ids(h), np.ones(len(h)))
        known = Counter(t for _, text in rows for t in tokens_by_hand(text) if t)
        unseen = v.first_class[-1] + np.arange(lm_scoring.RARE_CLASSES)  # a word that is not known, in each rare class
        for past in ("", "the the0 ", "of "):
            h, n = lm_scoring.tokens([past.encode()])
            ids = v.ids(h)
            before = lm_scoring.history(ids, n)[:, -1:]
            total = 10 ** model.log10(before, ids[-1:])[0] * (0.1 / v.rare_total[lm_scoring.rare_class(h[-1:])[0]] if ids[-1] >= lm_scoring.UNRANKED else 1)
            if ids[-1] >= lm_scoring.UNRANKED:
                total *= (len(rows) + 0.1) / 0.1
            for t, c in known.items():
                h = lm_scoring.tokens([t.encode()])[0][:1]
                ids = v.ids(h)
                total += 10 ** model.log10(before, ids)[0] * ((c + 0.1) / v.rare_total[lm_scoring.rare_class(h)[0]] if ids[0] >= lm_scoring.UNRANKED else 1)
            p = model._softmax(0, v.bias[0], model.rows(0, lm_scoring.features(before)))[0]
            total += sum(p[unseen] * 0.1 / v.rare_total)
            assert total == pytest.approx(1, abs=1e-3)


def test_tokens_and_features():
    h, n = lm_scoring.tokens([b"a B", b"", b"b"])
    assert n.tolist() == [3, 1, 2] and h[2] == h[3] == h[5] == lm_scoring.END and h[1] == h[4]
    assert lm_scoring.RARE_CLASSES & (lm_scoring.RARE_CLASSES - 1) == 0 and (lm_scoring.rare_class(h) < lm_scoring.RARE_CLASSES).all()
    S = lm_scoring.START
    before = lm_scoring.history(np.array([5, 6, 9, 9, 6, 9]), n)
    assert before.T.tolist() == [[S, S, S], [5, S, S], [6, 5, S], [S, S, S], [S, S, S], [6, S, S]]
    f = lm_scoring.features(before)
    assert (f[:, 0] == f[:, 3]).all() and (f[:, 0] == f[:, 4]).all() and (f[:, 1] != f[:, 2]).all()  # the starts of texts are alike
    assert len(np.unique(words.mix(np.arange(1000, dtype=np.uint64)))) == 1000


def test_packed_numbers_come_back():
    x = np.random.default_rng(1).integers(0, 2**21, 5000)
    assert (lm_scoring._unpack(lm_scoring._pack(x), 5000) == x).all() and len(lm_scoring._unpack(lm_scoring._pack(x[:0]), 0)) == 0


def test_all_frequent_words_are_modelled_and_shards_are_bounded(spark):
    """Every word with a rank has a path of its own, and no shard has much more than its share, hot words or not."""
    assert lm_scoring.Settings().capacity >= lm_scoring.Settings().frequent >= 500_000 and lm_scoring.RARE_CLASSES >= 24
    rows = [(k, " ".join(["hot"] * 100 + [f"w{(k * i) % 997}" for i in range(100)])) for k in range(300)]
    v = lm_scoring.Vocabulary(lm_scoring.count_tokens(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("CAST(text AS BINARY) AS text")), lm_scoring.Settings(shard_tokens=2000))
    h, n = lm_scoring.tokens([t.encode() for _, t in rows])
    ids = v.ids(h)
    classes, which, node, choice = v.paths(ids)
    first, last = [which == k for k in range(5)], {}
    for k in range(5):
        last[int(ids[k])] = (int(classes[k]), *zip(node[first[k]].tolist(), choice[first[k]].tolist()))
    assert len(set(last.values())) == len(last) and (ids < lm_scoring.UNRANKED).all() and (classes < v.first_class[-1]).all()
    shards = -(-v.n // 2000)
    load = np.bincount(v.shard(lm_scoring.history(ids, n), words.mix(np.repeat(np.arange(300, dtype=np.uint64), n)), shards), minlength=shards)
    assert load.max() <= 4 * 2000 and load.sum() == len(ids)
