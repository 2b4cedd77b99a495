"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax, sharded by history.

A token's probability given its history is that of its class, times those of its subclasses down to the word. Words are
ranked by count and dealt into the classes of ``Settings.bands``: a class of a band of depth d holds ``branch ** d`` words, in d
steps of a softmax over ``branch`` each, so frequent words are reached in two steps and rare ones in four. The words with
a rank are those whose counts are broadcast, ``frequent`` at most; all others fall into ``RARE_CLASSES`` by their last two
bytes, and within these the words keep to their counts. Features of the history are the word before, the two words
before, and the word before with the one third from the end (a skip); each is hashed, together with the node of the tree that is
decided, to a row of weights over its choices. Biases are the logarithms of the counts.

All features hold the word before. So the weights are dealt out by that word: a task has all tokens of the corpus that
follow its words, takes gradient steps over those in training in small sparse batches, and then scores all of them. Each weight has one
owner; weights are neither averaged, broadcast nor collected, and there are as many shards as ``shard_tokens`` asks for, each with
its own tables of ``rows`` rows: the model grows with the corpus. A word before that is very common is dealt out further,
by the word before it and, beyond that, by the document. Tokens are packed by shard in the task that reads the text, and
what a task hands on of a run of documents is a few packs. Within a shard, tokens that are the same with the same history are one
event with a weight; events are taken in the order of their hash, so the result does not depend on that of the packs.

The counts of words, on which the base score rests, grow with the corpus and are not broadcast: those of the ``frequent``
most frequent words at most are, and the other words of the documents are joined with the table of counts. Words are
told apart by 59 bits of their hash and their rare class; of n different words some two are taken for one with a
probability of n ** 2 / 2 ** 65.

Defined cases: a null or blank text is its end token alone; a null id counts as the empty text where ids decide what is
held out; repeated rows are trained on and scored each; without training documents every word is
unknown; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm import words
from lamella.llm.common import named, pieces, stored, text_key

@dataclass(frozen=True)
class Settings:
    """The sizes of the model and of its training."""

    #: Choices of a softmax below the classes; classes and depth of each band, frequent words first.
    branch: int = 32
    bands: tuple[tuple[int, int], ...] = ((8, 1), (8, 2), (16, 3))
    #: Rows of a shard's two tables of weights: classes, and all below.
    rows: tuple[int, int] = (1 << 16, 1 << 18)
    #: Tokens of a gradient step, the step's size, and passes over a shard's training tokens.
    batch: int = 4096
    step: float = 1.0
    passes: int = 1
    #: Training tokens of a shard, about.
    shard_tokens: int = 1 << 21
    #: Words whose counts are broadcast, at most.
    frequent: int = 1 << 19

    @property
    def capacity(self) -> int:
        """Words that the bands hold."""
        return sum(classes * self.branch**depth for classes, depth in self.bands)


#: Classes of words without a rank, a power of two; features of a history; what is added to every count.
RARE_CLASSES, FEATURES, ADDED = 32, 3, 0.1
#: Tokens that are packed, and decoded, at once.
PACKED, DECODED = 1 << 21, 1 << 16
#: Pieces that a common word is dealt into by the word before, before documents are told apart.
BY_WORD = 4
#: Tokens that a task counts before it hands the counts on.
COUNTED = 1 << 21
#: Groups of rows that are added up together.
SEVERAL = 16
#: The largest sum of weights and bias.
LARGEST = 60.0

U = np.uint64
END = U(0x1B873593CC9E2D51)
#: Ids of words without a rank begin here, and end with their rare class; the id of what is before a text.
UNRANKED, START = 1 << 20, (1 << 21) - 1


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and its end, and how many each text has.

    The lowest bits of a hash are the token's rare class.
    """
    hashes, tails, counts = words.word_table(texts)
    ends = np.cumsum(counts + 1) - 1
    h = np.empty(len(hashes) + len(texts), np.uint64)
    inner = np.ones(len(h), bool)
    inner[ends] = False
    rare = ((tails.astype(np.uint32) * np.uint32(40503)) & np.uint32(0xFFFF)) * np.uint32(RARE_CLASSES) >> np.uint32(16)
    h[inner] = (hashes & ~U(RARE_CLASSES - 1)) | rare.astype(np.uint64)
    h[ends] = END
    return h, counts + 1


def rare_class(h: np.ndarray) -> np.ndarray:
    return (h & U(RARE_CLASSES - 1)).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.to_pylist()]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def count_tokens(training: DataFrame) -> DataFrame:
    """``h, c``: every token of the column ``text`` with its count; counted in the partitions first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            some, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.record_batch([_signed(some), pa.array(c.astype(np.int64))], ["h", "c"])

        for batch in pieces(batches):
            for block in words.blocks(_bytes(batch.column(0))):
                held.append(tokens(block)[0])
                if sum(map(len, held)) >= COUNTED:
                    yield counted()
        if held:
            yield counted()

    return training.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The ranked words and their counts, the tree of classes with its biases, and the constants of the base; of bounded size."""

    def __init__(self, counts: DataFrame, settings: Settings = Settings()):
        self.settings = settings
        total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.n, self.v = total["n"], total["v"]
        texts = counts.where(F.col("h") == int(END)).first()
        self.texts = texts["c"] if texts else 0
        # All counts above one that leaves ``frequent`` words at most.
        level = F.floor(F.log2("c") * 64)
        levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect()
        many, least = 0, None
        for row in levels:
            many += row["n"]
            if many > settings.frequent:
                break
            least = row["level"]
        frequent = counts.where(level >= least if least is not None else F.lit(False)).select("h", "c").toPandas()
        h, c = frequent["h"].to_numpy().astype(np.int64).view(np.uint64), frequent["c"].to_numpy().astype(np.float64)
        order = np.lexsort((h, -c))[: settings.capacity]
        h, self.counts = h[order], c[order]
        order = np.argsort(h)
        self.hashes, self.rank = h[order], order.astype(np.int32)
        # Mass and words of each rare class, without those that have a rank.
        rare = counts.groupBy(F.col("h").bitwiseAND(F.lit(RARE_CLASSES - 1)).alias("rare")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()
        mass, types = np.zeros(RARE_CLASSES), np.zeros(RARE_CLASSES)
        mass[rare["rare"].to_numpy(int)], types[rare["rare"].to_numpy(int)] = rare["n"].to_numpy(float), rare["v"].to_numpy(float)
        np.subtract.at(mass, rare_class(h), self.counts)
        np.subtract.at(types, rare_class(h), 1.0)
        self.rare_total = mass + ADDED * (types + 1)
        self._grow()

    def _grow(self) -> None:
        """The biases of the classes and of all nodes below, and where the nodes of each band and depth begin."""
        branch, bands = self.settings.branch, self.settings.bands
        sizes = [classes * branch**depth for classes, depth in bands]
        padded = np.zeros(sum(sizes))
        padded[: len(self.counts)] = self.counts
        masses, inner, self.first_node, nodes = [], [], [], 0
        for (classes, depth), band in zip(bands, np.split(padded, np.cumsum(sizes)[:-1]), strict=True):
            masses.append(band.reshape(classes, -1).sum(axis=1))
            self.first_node.append([])
            for d in range(depth):
                inner.append(band.reshape(classes * branch**d, branch, -1).sum(axis=2))
                self.first_node[-1].append(nodes)
                nodes += len(inner[-1])
        self.bias = [_log_shares(np.concatenate((*masses, self.rare_total))[None])[0], _log_shares(np.concatenate(inner))]
        self.ends = np.cumsum(sizes)
        self.first_class = np.cumsum([0, *(classes for classes, _ in bands)])

    @property
    def log_total(self) -> float:
        return float(np.log10(self.n + ADDED * (self.v + 1)))

    def ids(self, h: np.ndarray) -> np.ndarray:
        """The rank of each token, or for those without one an id from UNRANKED up that ends with the rare class."""
        other = UNRANKED + ((h >> U(44)) & U((1 << 19) - 1)).astype(np.int64) // RARE_CLASSES * RARE_CLASSES + rare_class(h)
        if not len(self.hashes):
            return other
        at = np.minimum(self.hashes.searchsorted(h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.rank[at], other)

    def count_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of the ranked words, 0 for others."""
        out = np.zeros(len(ids))
        ranked = ids < UNRANKED
        out[ranked] = self.counts[ids[ranked]]
        return out

    def paths(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The class of each token; and of all steps below, which token, which node, and which of its choices."""
        branch = self.settings.branch
        band = np.searchsorted(self.ends, ids, "right")  # behind the last for a word without a rank
        classes = self.first_class[-1] + (ids & (RARE_CLASSES - 1))
        steps = []
        for k, (_, depth) in enumerate(self.settings.bands):
            which = np.flatnonzero(band == k)
            place = ids[which] - (self.ends[k - 1] if k else 0)
            classes[which] = self.first_class[k] + place // branch**depth
            for d in range(depth):
                steps.append((which, self.first_node[k][d] + place // branch ** (depth - d), place // branch ** (depth - d - 1) % branch))
        which, node, choice = (np.concatenate(x) for x in zip(*steps, strict=True))
        return classes, which, node, choice

    def shard(self, ids: np.ndarray, docs: np.ndarray, shards: int) -> np.ndarray:
        """The shard of each token by its history; ``ids`` are those of the three words before, ``docs`` hashes of the documents."""
        one, two = ids[0], ids[1]
        count = np.where(one == START, self.texts, 0.0)
        ranked = one < UNRANKED
        count[ranked] = self.counts[one[ranked]]
        many = np.maximum(np.ceil(count * 4 / self.settings.shard_tokens), 1).astype(np.int64)
        by_word = np.minimum(many, BY_WORD)
        by_doc = -(-many // by_word)
        hashed = words.mix(two.astype(np.uint64) * words.FACTORS[45])
        piece = (hashed % by_word.astype(np.uint64)) * by_doc.astype(np.uint64) + docs % by_doc.astype(np.uint64)
        return (words.mix(one.astype(np.uint64) * words.FACTORS[46] + piece * words.FACTORS[47]) % U(shards)).astype(np.int32)


def _log_shares(counts: np.ndarray) -> np.ndarray:
    """Logarithms of each row's counts against its largest, and something very small for 0."""
    with np.errstate(divide="ignore"):
        return np.where(counts > 0, np.log(counts) - np.log(np.maximum(counts.max(axis=1, keepdims=True), ADDED)), -1e9).astype(np.float32)


def history(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ids of the three words before each token, nearest first; START before a text."""
    starts = np.repeat(np.cumsum(counts) - counts, counts)
    place = np.arange(len(ids)) - starts
    return np.stack([np.where(place >= k, np.roll(ids, k), START) for k in (1, 2, 3)])


def features(before: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of FEATURES features of each token's history."""
    one, two, three = before.astype(np.uint64) + U(1)
    return np.stack((words.mix(one * words.FACTORS[40]), words.mix(one * words.FACTORS[41] + two * words.FACTORS[42]), words.mix(one * words.FACTORS[41] + three * words.FACTORS[43])))


class Model:
    """A shard's weights, adaptive gradient steps over them, and scores."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.settings = vocabulary, vocabulary.settings
        self.tables = [np.zeros((rows, bias.shape[-1]), np.float32) for rows, bias in zip(self.settings.rows, vocabulary.bias, strict=True)]
        self.squares = [np.full(len(t), 1e-2, np.float32) for t in self.tables]
        self._held: dict[tuple[str, int], np.ndarray] = {}

    def _space(self, use: str, k: int, n: int) -> np.ndarray:
        """Room for ``n`` rows of a table, the same at each call, as new memory costs more than what is done in it."""
        held = self._held.get((use, k))
        if held is None or len(held) < n:
            held = self._held[use, k] = np.empty((max(n, self.settings.batch), self.tables[k].shape[1]), np.float32)
        return held[:n]

    def _rows_of(self, table: np.ndarray, rows: np.ndarray, use: str, k: int) -> np.ndarray:
        # All rows lie in the table; any other mode than "raise" writes to ``out`` directly.
        return np.take(table, rows, axis=0, out=self._space(use, k, len(rows)), mode="clip")

    def rows(self, k: int, hashed: np.ndarray, node: np.ndarray | None = None) -> np.ndarray:
        """Rows of a table: of the features, and of the features and a node."""
        if node is not None:
            hashed = words.mix(hashed ^ (node.astype(np.uint64) + U(1)) * words.FACTORS[44])
        return (hashed >> U(40)).astype(np.int64) & (len(self.tables[k]) - 1)

    def _softmax(self, k: int, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Probabilities of all choices, which stand until the next call."""
        table = self.tables[k]
        p = self._rows_of(table, rows[0], "p", k)
        for r in rows[1:]:
            p += self._rows_of(table, r, "row", k)
        p += bias
        if p.size and p.max() > LARGEST:  # biases are 0 at most, so no more is needed against overflow
            np.minimum(p, LARGEST, out=p)
        np.exp(p, out=p)
        p /= (p @ np.ones(p.shape[1], np.float32))[:, None]
        return p

    def _steps(self, before: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
        """For the classes and for all steps below them: the table, the tokens, the rows, the choices and their probabilities."""
        hashed = features(before)
        classes, which, node, choice = self.vocabulary.paths(ids)
        rows = self.rows(0, hashed)
        yield 0, np.arange(len(ids)), rows, classes, self._softmax(0, self.vocabulary.bias[0], rows)
        for a in range(0, len(which), self.settings.batch):
            b = slice(a, a + self.settings.batch)
            rows = self.rows(1, hashed[:, which[b]], node[b])
            yield 1, which[b], rows, choice[b], self._softmax(1, self._rows_of(self.vocabulary.bias[1], node[b], "bias", 1), rows)

    def train(self, before: np.ndarray, ids: np.ndarray, times: np.ndarray) -> None:
        """Steps over events, each of which counts as often as ``times`` says."""
        for a in range(0, len(ids), self.settings.batch):
            b = slice(a, a + self.settings.batch)
            weights = times[b].astype(np.float32)
            for k, which, rows, choice, p in self._steps(before[:, b], ids[b]):
                p[np.arange(len(choice)), choice] -= 1
                p *= weights[which][:, None]
                self._step(k, rows, p)

    def log10(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The log10 of the probability of each token's class and of all choices below it."""
        out = np.zeros(len(ids))
        for a in range(0, len(ids), self.settings.batch):
            own = out[a : a + self.settings.batch]
            for _, which, _, choice, p in self._steps(before[:, a : a + self.settings.batch], ids[a : a + self.settings.batch]):
                own += np.bincount(which, np.log10(np.maximum(p[np.arange(len(choice)), choice].astype(np.float64), 1e-30)), len(own))
        return out

    def _step(self, k: int, rows: np.ndarray, wrong: np.ndarray) -> None:
        """The gradient of each row, summed over the batch's tokens that have it."""
        n = len(wrong)
        # Rows and tokens in one number sort faster than an order does.
        keys = (rows * n + np.arange(n)).ravel()
        keys.sort()
        flat, token = np.divmod(keys, n)
        first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        times = np.diff(first, append=len(flat))
        alone = times == 1
        norms, of = _norms(wrong), token[first[alone]]
        self._update(k, flat[first[alone]], self._rows_of(wrong, of, "gradient", k), norms[of])
        if not alone.all():
            sums = _sums(wrong, token, first[~alone], times[~alone])
            self._update(k, flat[first[~alone]], sums, _norms(sums))

    def _update(self, k: int, touched: np.ndarray, gradient: np.ndarray, norms: np.ndarray) -> None:
        """A step along the gradients of different rows, which are scaled in place; ``norms`` are their squared lengths."""
        squares = self.squares[k][touched] + norms
        self.squares[k][touched] = squares
        gradient *= (self.settings.step / np.sqrt(squares))[:, None]
        weights = self._rows_of(self.tables[k], touched, "row", k)
        weights -= gradient
        _whole(self.tables[k])[touched] = _whole(weights)


def _sums(rows: np.ndarray, of: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of the rows of each group, which are those that ``of`` names from its start on.

    All groups take their next row at once, while there are many with one; the rest of the large ones is added up by group.
    """
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], -sizes[order]
    sums, taken = rows[of[starts]], 1
    while (many := np.searchsorted(sizes, -taken)) >= SEVERAL:
        sums[:many] += rows[of[starts[:many] + taken]]
        taken += 1
    for group in range(many):
        sums[group] += rows[of[starts[group] + taken : starts[group] - sizes[group]]].sum(axis=0)
    out = np.empty_like(sums)
    out[order] = sums
    return out


def _norms(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows, rows)


def _whole(rows: np.ndarray) -> np.ndarray:
    """Rows as single values, which are written in one piece."""
    return rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel()


# Packed tokens


def _pack(values: np.ndarray) -> bytes:
    """The bytes of numbers by significance, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 4 * n, asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


DOCUMENT = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("rare", pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32())])))]
DOCUMENT_DDL = "doc_id: long, held_out: boolean, n_tokens: long, n_known: long, base: double, model: double, rare: array<struct<h: long, n: int>>"
PACKS = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("number", pa.int32()), ("n", pa.int32()), ("docs", pa.binary()), ("ids", pa.binary()), ("before", pa.list_(pa.binary())), ("documents", pa.list_(pa.struct(DOCUMENT)))])
PACKS_DDL = f"shard int, part int, number int, n int, docs binary, ids binary, before array<binary>, documents array<struct<{DOCUMENT_DDL}>>"
SUMS = f"part int, number int, docs binary, sums binary, documents array<struct<{DOCUMENT_DDL}>>"


def described(rows: pa.RecordBatch, h: np.ndarray, n: np.ndarray, ids: np.ndarray, v: Vocabulary) -> pa.StructArray:
    """What is known of some documents without the model: DOCUMENT, with the words whose counts come with a join."""
    first = np.cumsum(n) - n
    c = v.count_of(ids)
    known = c > 0
    own = np.log10(np.where(known, c + ADDED, 1.0))  # the others' come with the join
    share = np.where(known, 0.0, -np.log10(v.rare_total)[ids & (RARE_CLASSES - 1)])  # of a rare word in its class
    unknown = np.flatnonzero(~known)
    doc = np.repeat(np.arange(len(n)), n)[unknown]
    order = np.lexsort((h[unknown], doc))
    doc, other = doc[order], h[unknown][order]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (other[1:] != other[:-1])))) if len(doc) else np.empty(0, np.int64)
    pairs = pa.StructArray.from_arrays([_signed(other[new]), pa.array(np.diff(new, append=len(doc)).astype(np.int32))], ["h", "n"])
    rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[new], np.arange(len(n) + 1)).astype(np.int32)), pairs)
    sums = [np.add.reduceat(x, first) for x in (known.astype(np.int64), own, share)]
    columns = [rows.column("doc_id"), rows.column("held_out"), pa.array(n), pa.array(sums[0]), pa.array(sums[1] - n * v.log_total), pa.array(sums[2]), rare]
    return pa.StructArray.from_arrays(columns, fields=[pa.field(*f) for f in DOCUMENT])


def pack_tokens(rows: DataFrame, vocabulary, shards: int) -> DataFrame:
    """All tokens with their histories, packed by shard; the first pack of some documents describes them. ``vocabulary`` is a broadcast one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        context = TaskContext.get()
        part, number = context.partitionId() if context else 0, 0
        held: list[tuple] = []
        documents: list[pa.StructArray] = []
        n_docs = size = 0

        def packed() -> Iterator[pa.RecordBatch]:
            of, ids, keys, before = (np.concatenate(x, axis=-1) for x in zip(*held, strict=True))
            shard = v.shard(before, words.mix(keys), shards)
            order = np.argsort(shard, kind="stable")
            of, ids, before = of[order], ids[order], before[:, order]
            bounds = np.searchsorted(shard[order], np.arange(shards + 1))
            some = pa.concat_arrays(documents)
            lists = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some)
            for s in np.flatnonzero(np.diff(bounds)):
                own = slice(bounds[s], bounds[s + 1])
                values = [int(s), part, number, int(bounds[s + 1] - bounds[s]), _pack(of[own]), _pack(ids[own]), [_pack(x) for x in before[:, own]]]
                arrays = [pa.array([x], t) for x, t in zip(values, PACKS.types[:-1], strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, lists if lists is not None else pa.nulls(1, PACKS.types[-1])], schema=PACKS)
                lists = None

        for batch in pieces(batches):
            at = 0
            for block in words.blocks(_bytes(batch.column(3))):
                own = batch.slice(at, len(block))
                h, n = tokens(block)
                ids = v.ids(h)
                # A document's number, and in the lowest bit whether it is held out.
                of = 2 * np.arange(n_docs, n_docs + len(block)) + own.column("held_out").to_numpy(zero_copy_only=False)
                held.append((np.repeat(of, n), ids, np.repeat(own.column("text_key").to_numpy().astype(np.uint64), n), history(ids, n)))
                documents.append(described(own, h, n, ids, v))
                at += len(block)
                n_docs += len(block)
                size += len(h)
                if size >= PACKED:
                    yield from packed()
                    held, documents, n_docs, size = [], [], 0, 0
                    number += 1
        if held:
            yield from packed()

    return rows.mapInArrow(run, PACKS_DDL)


def event_keys(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each token with its history, which also is the order in which events are taken."""
    one, two, three = before.astype(np.uint64)
    return words.mix(one * words.FACTORS[50] + two * words.FACTORS[51] + three * words.FACTORS[52] + ids.astype(np.uint64) * words.FACTORS[53])


def train_and_score(vocabulary):
    """The sum of the log10 probabilities of each document's tokens in a shard, by a model of those not held out."""

    def whole(packs: list[dict]) -> Iterator[pa.RecordBatch]:
        n = [row["n"] for row in packs]
        of = np.concatenate([_unpack(row["docs"], row["n"]) for row in packs])
        ids = np.concatenate([_unpack(row["ids"], row["n"]) for row in packs])
        before = np.concatenate([np.stack([_unpack(x, row["n"]) for x in row["before"]]) for row in packs], axis=1)
        keys = event_keys(before, ids)
        order = np.argsort(keys)
        new = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
        event = np.empty(len(keys), np.int64)
        event[order] = np.cumsum(new) - 1
        first = order[new]
        times = np.bincount(event, of & 1 == 0, len(first))  # in training documents
        ids, before = ids[first], before[:, first]
        model, training = Model(vocabulary.value), np.flatnonzero(times)
        for _ in range(model.settings.passes):
            for a in range(0, len(training), DECODED):
                some = training[a : a + DECODED]
                model.train(before[:, some], ids[some], times[some])
        score = model.log10(before, ids)
        at = 0
        for row, size in zip(packs, n, strict=True):
            own = slice(at, at + size)
            docs, place = np.unique(of[own] >> 1, return_inverse=True)
            sums = np.bincount(place, score[event[own]])
            arrays = [pa.array([x], t) for x, t in ((row["part"], pa.int32()), (row["number"], pa.int32()), (docs.astype(np.int32).tobytes(), pa.binary()), (sums.tobytes(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*arrays, row["documents"]], ["part", "number", "docs", "sums", "documents"])
            at += size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: list[dict] = []  # compressed, of one shard
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                row = {name: one.column(name)[0].as_py() for name in one.schema.names if name != "documents"} | {"documents": one.column("documents")}
                if packs and packs[0]["shard"] != row["shard"]:
                    yield from whole(packs)
                    packs = []
                packs.append(row)
        if packs:
            yield from whole(packs)

    return run


SCORED = f"row long, {DOCUMENT_DDL.replace(': ', ' ', 6).replace('rare: ', 'rare ')}, total double"


def documents_of(packs: pa.Table) -> pa.Table:
    """The documents of some packs, as they were described, with their sums over all shards."""
    lists = packs.column("documents").combine_chunks()
    rows = lists.filter(lists.is_valid()).flatten()
    total = np.zeros(len(rows))
    for docs, sums in zip(packs.column("docs"), packs.column("sums"), strict=True):
        total[np.frombuffer(docs.as_py(), np.int32)] += np.frombuffer(sums.as_py())
    number = (packs.column("part")[0].as_py() << 42) + (packs.column("number")[0].as_py() << 21)
    return pa.table([pa.array(number + np.arange(len(rows))), *rows.flatten(), pa.array(total)], ["row", *(name for name, _ in DOCUMENT), "total"])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Both scores are log10 probabilities of the whole text; the model and the counts come from the rows not held out.
    """
    text = named(text_col)
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), text_key(text).alias("text_key"), held_out(named(id_col)).alias("held_out"), text.cast("binary").alias("text"))
    counts = stored(count_tokens(rows.where("NOT held_out")), "counts")
    vocabulary = Vocabulary(counts, settings)
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    shards = max(1, -(-vocabulary.n // settings.shard_tokens))
    packs = pack_tokens(rows, held, shards).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "part", "number")
    scored = packs.mapInArrow(train_and_score(held), SUMS).groupBy("part", "number").applyInArrow(documents_of, SCORED)
    scored = stored(scored, "scored")
    # Words that are not among the frequent ones are all rare to the model, whose part of them is linear in the same logarithm.
    looked = scored.select("row", F.inline("rare")).join(counts.select("h", "c"), "h", "left")
    more = looked.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADDED)) * F.col("n")).alias("own"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"))
    out = scored.drop("rare").join(more, "row", "left")
    own = F.coalesce("own", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        (F.col("base") + own).alias("base_score"), (F.col("total") + F.col("model") + own).alias("score"),
    )
