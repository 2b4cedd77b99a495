"""Near-duplicate detection by min-max hashing, links confirmed on full shingle sets.

1. Each document's set of word shingles is hashed under ``BANDS * ROWS / 2`` permutations, and of each both the minimum
   and the maximum are kept: half the evaluations for the same number of values. A byte of each value is the signature.
2. Documents with equal sets (by 128 bits and the size) are one class, of which the smallest id stands for all; copies
   go no further.
3. A band is ROWS signature bytes; classes that share one meet in a bucket. Were bands independent, two sets of similarity
   0.8 would share none of them with probability (1 - 0.8**5)**40 = 1e-7; a minimum and a maximum of one permutation are
   nearly so.
4. First each class is compared with the smallest of its buckets, which is work in proportion to the buckets, however
   large: signatures, where sizes must permit the similarity and no less than ``margin`` below it of the bytes must be equal (over
   five deviations), then the full sets, made again from the texts. The links found are contracted to components.
5. Only buckets that still hold several components go on, and of these only pairs of classes in different ones. The classes
   outside of the smallest one's component are dealt into chunks of CHUNK classes or CHUNK_SHINGLES shingles, as are those
   inside, and each pair of chunks with one outside is a task's work of bounded size. Signatures are compared as before, a pair
   only in its first common band; classes without a partner drop out, and the sets of the others meet in the same chunk
   pairs. Of pairs not connected yet intersections are counted, and the components that links connect are handed on.
6. Components of these links, by star contraction in DataFrame operations, as in 4.

A shingle is the 64-bit hash of ``words.shingles``.

Defined cases: a null or blank text has an empty set and is linked with nothing; a text with fewer words than a shingle
has its whole sequence as one; a row with a null id is linked with nothing, has a null component and is kept; rows with
the same id and text share their component, rows with the same id and other texts are documents of their own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm import words
from lamella.llm.common import named, pieces, stored, text_key
from lamella.llm.components import components

BANDS, ROWS = 40, 5
VALUES = BANDS * ROWS
#: A pair whose share of equal signature bytes is this far below the similarity isn't looked at further; see 4. above.
MARGIN = 0.15
#: Classes of a bucket that one side of a task holds, and shingles of these.
CHUNK, CHUNK_SHINGLES = 256, 1 << 22
#: Rows that are compared at once.
BATCH = 4096

_random = np.random.default_rng(5)
XORS = _random.integers(0, 2**32, VALUES // 2, dtype=np.uint32)
FACTORS = _random.integers(0, 2**31, VALUES // 2, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

SIGNATURE = "doc_id long, text_key long, n long, fp_a long, fp_b long, sig binary"


def _as_bytes(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.to_pylist()]


def distinct_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    hashes, counts = words.shingles(texts, size)
    ends = np.cumsum(counts)
    return [np.unique(hashes[e - c : e]) for e, c in zip(ends, counts, strict=True)]


def min_max(sets: list[np.ndarray]) -> np.ndarray:
    """A row of VALUES bytes for each set that isn't empty: minimum and maximum of each permutation."""
    joined = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), VALUES), np.uint8)
    for k in range(VALUES // 2):
        values = (joined ^ XORS[k]) * FACTORS[k]
        # All bits of a value go into its byte: those of a minimum are not random at the top.
        out[:, k] = (np.minimum.reduceat(values, starts) * np.uint32(0x9E3779B1)) >> np.uint32(24)
        out[:, VALUES // 2 + k] = (np.maximum.reduceat(values, starts) * np.uint32(0x85EBCA77)) >> np.uint32(24)
    return out


def signatures(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the text's key, the size of the set, 128 bits of its content, and its signature (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            at = 0
            for block in words.blocks(_as_bytes(batch.column(2))):
                sets = distinct_sets(block, size)
                full = [s for s in sets if len(s)]
                rows = iter(min_max(full) if full else ())
                yield pa.record_batch(
                    [
                        batch.column(0).slice(at, len(block)),
                        batch.column(1).slice(at, len(block)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([int(words.mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()),
                        pa.array([int(words.mix(s ^ words.BASE).sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()),
                        pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "text_key", "n", "fp_a", "fp_b", "sig"],
                )
                at += len(block)

    return docs.select(named(id_col).cast("long").alias("doc_id"), text_key(named(text_col)).alias("text_key"), named(text_col).cast("binary").alias("text")).mapInArrow(run, SIGNATURE)


def band_keys(classes: DataFrame) -> DataFrame:
    """A row for each class and band: ``key`` is the band's number and bytes."""
    weights = (256 ** np.arange(ROWS)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, BANDS, ROWS)
            keys = (sig * weights).sum(axis=2) + (np.arange(BANDS, dtype=np.int64) << (8 * ROWS))
            yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "id"])

    return classes.select("id", "sig").mapInArrow(run, "key long, id long")


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by their first columns, in tables of whole groups, with the groups' bounds."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy() for k in range(n_keys)]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        first, end = tuple(k[0] for k in keys), tuple(k[-1] for k in keys)
        cut = int(change[-1]) if len(change) else 0  # the last group may go on
        if held and first != last:
            yield _bounded(held, n_keys)
            held = []
        if cut:
            held.append(batch.slice(0, cut))
            yield _bounded(held, n_keys)
            held = []
        held.append(batch.slice(cut))
        last = end
    if held:
        yield _bounded(held, n_keys)


def _bounded(held: list[pa.RecordBatch], n_keys: int) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(held)
    keys = [table.column(k).to_numpy() for k in range(n_keys)]
    change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    return table, np.concatenate(([0], change, [table.num_rows]))


def promising(sig: np.ndarray, sizes: np.ndarray, bands: np.ndarray, sides: np.ndarray, bounds: np.ndarray, percent: int, labels: np.ndarray | None = None, margin: float = MARGIN) -> np.ndarray:
    """Which rows have a partner in their group that is worth a look at the full sets.

    ``sides`` is 0 or 1 where a group is a pair of different chunks, whose inner pairs are looked at elsewhere, and 2
    where it is a chunk with itself. Rows of the same label are connected already.
    """
    n = len(sig)
    end = np.repeat(bounds[1:], np.diff(bounds))
    found = np.zeros(n, bool)
    rows, lag = np.arange(n), 1
    floor = int((percent / 100 - margin) * VALUES)
    labels = np.arange(n) if labels is None else labels
    while len(rows := rows[rows + lag < end[rows]]):
        a, b = rows, rows + lag
        fits = (percent * np.maximum(sizes[a], sizes[b]) <= 100 * np.minimum(sizes[a], sizes[b])) & ((sides[a] == 2) | (sides[a] != sides[b])) & (labels[a] != labels[b]) & ~(found[a] & found[b])
        a, b = a[fits], b[fits]
        for k in range(0, len(a), BATCH):
            x, y = a[k : k + BATCH], b[k : k + BATCH]
            equal = sig[x] == sig[y]
            close = equal.sum(axis=1) >= floor
            x, y, equal = x[close], y[close], equal[close]
            first = equal.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == bands[x]
            found[x[first]] = found[y[first]] = True
        lag += 1
    return found


def connect(sets: list[np.ndarray], percent: int, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between positions that connect all sets of at least that similarity: a spanning forest of the true links.

    Sets of the same label are connected already.
    """
    n = len(sets)
    label = np.arange(n) if labels is None else np.unique(labels, return_inverse=True)[1]
    if len(np.unique(label)) < 2:
        return []
    sizes = np.fromiter(map(len, sets), np.int64, n)
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * common >= percent * (sizes.sum() - common) else []
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    marked = np.zeros(codes.max() + 1, np.int64)
    links = []
    for a in range(n):
        other = label != label[a]
        other[:a] = False  # tested from the other side
        if not other.any():
            continue
        own = codes[starts[a] : starts[a] + sizes[a]]
        marked[own] = 1
        common = np.add.reduceat(marked[codes], starts)
        marked[own] = 0
        for b in np.flatnonzero(other & (100 * common >= percent * (sizes[a] + sizes - common))):
            if label[b] != label[a]:
                links.append((a, int(b)))
                label[label == max(label[a], label[b])] = min(label[a], label[b])
    return links


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept, text_key, component_key``.

    Documents are linked where 100 * common shingles >= ``percent`` * all shingles of both; the component is named by its
    smallest id, whose document is kept. The text's key tells documents of one id apart, and the component's key is that of
    the document that it is named by.
    """
    sigs = stored(signatures(docs, shingle, id_col, text_col), "signatures")
    content = ["fp_a", "fp_b", "n"]
    # A copy's signature is the one of its class. Ids may repeat over classes, so these get numbers of their own, once.
    classes = sigs.where("n > 0 AND doc_id IS NOT NULL").groupBy(*content).agg(F.min(F.struct("doc_id", "text_key")).alias("of"), F.min("sig").alias("sig"))
    classes = stored(classes.select(*content, "of.doc_id", "of.text_key", "sig", F.monotonically_increasing_id().alias("id")), "classes")

    keys = stored(band_keys(classes), "bands")
    shared = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("centre")).where("m > 1"), "buckets")
    members = stored(keys.join(shared, "key").select("key", "id", "centre"), "members")

    texts = docs.select(named(id_col).cast("long").alias("doc_id"), text_key(named(text_col)).alias("text_key"), named(text_col).cast("binary").alias("text"))

    def sets_of(ids: DataFrame) -> DataFrame:
        """``id, shingles`` of classes."""

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                at = 0
                for block in words.blocks(_as_bytes(batch.column(1))):
                    yield pa.record_batch([batch.column(0).slice(at, len(block)), pa.array([s.tobytes() for s in distinct_sets(block, shingle)], pa.binary())], ["id", "shingles"])
                    at += len(block)

        wanted = classes.join(ids, "id", "left_semi").select("id", "doc_id", "text_key")
        found = texts.join(wanted, ["doc_id", "text_key"]).select("id", "text")
        # Rows that repeat a document bring its set again.
        return stored(found.mapInArrow(whole, "id long, shingles binary").groupBy("id").agg(F.first("shingles").alias("shingles")), "shingles")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs whose sizes and signatures permit the similarity."""
        floor = int((percent / 100 - margin) * VALUES)
        for batch in pieces(batches):
            x, y = (batch.column(k).to_numpy() for k in (1, 4))
            sig = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, VALUES) for k in (2, 5)]
            close = (percent * np.maximum(x, y) <= 100 * np.minimum(x, y)) & ((sig[0] == sig[1]).sum(axis=1) >= floor)
            yield pa.record_batch([c.filter(pa.array(close)) for c in (batch.column(0), batch.column(3))], ["id", "centre"])

    own = classes.select("id", "n", "sig")
    centres = classes.select(F.col("id").alias("centre"), F.col("n").alias("c_n"), F.col("sig").alias("c_sig"))
    spokes = members.where("id <> centre").select("id", "centre").distinct().join(own, "id").join(centres, "centre").select("id", "n", "sig", "centre", "c_n", "c_sig")
    spokes = stored(spokes.mapInArrow(alike, "id long, centre long"), "spokes")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs whose sets have the similarity."""
        for batch in pieces(batches):
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.record_batch([c.filter(pa.array(linked, pa.bool_())) for c in (batch.column(0), batch.column(1))], ["a", "b"])

    sets = sets_of(spokes.select("id").union(spokes.select("centre")).distinct())
    both = spokes.join(sets, "id").join(sets.select(F.col("id").alias("centre"), F.col("shingles").alias("c_shingles")), "centre").select("id", "centre", "shingles", "c_shingles")
    links = stored(both.mapInArrow(similar, "a long, b long"), "star-links")
    found = stored(components(links), "stars").select(F.col("node").alias("id"), "component")

    # What the stars left apart.
    members = members.join(classes.select("id", "n"), "id").join(found, "id", "left").withColumn("label", F.coalesce("component", "id"))
    members = stored(members.select("key", "id", "centre", "n", "label"), "labels")
    homes = members.where("id = centre").select("key", F.col("label").alias("home"))
    outside = F.col("label") != F.col("home")
    parts = lambda mine: F.greatest(F.ceil(F.count_if(mine) / chunk), F.ceil(F.sum(F.when(mine, F.col("n")).otherwise(0)) / CHUNK_SHINGLES)).cast("int")
    members = members.join(homes, "key")
    mixed = stored(members.groupBy("key").agg(parts(outside).alias("out"), parts(~outside).alias("in")).where("out > 0"), "mixed-buckets")
    members = members.join(mixed, "key")
    dealt = F.when(outside, F.pmod(F.xxhash64("id"), F.col("out"))).otherwise(F.col("out") + F.pmod(F.xxhash64("id"), F.col("in"))).cast("int")
    members = members.withColumn("chunk", dealt).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(outside, F.col("out") + F.col("in")).otherwise(F.col("out")) - 1)))
    side = F.when(F.col("chunk") == F.col("other"), 2).when(F.col("chunk") < F.col("other"), 0).otherwise(1).cast("byte")
    members = members.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), side.alias("side"), "id", "label")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in groups(batches, 3):
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, VALUES)
            bands = table.column("key").to_numpy() >> (8 * ROWS)
            found = promising(sig, table.column("n").to_numpy(), bands, table.column("side").to_numpy(), bounds, percent, table.column("label").to_numpy(), margin)
            yield from table.select(["key", "i", "j", "id", "label"]).filter(pa.array(found)).combine_chunks().to_batches()

    signed = members.join(own, "id").select("key", "i", "j", "side", "id", "label", "n", "sig")
    hopeful = signed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, "key long, i int, j int, id long, label long")
    hopeful = stored(hopeful, "candidates")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in groups(batches, 3):
            labels, raw = table.column("label").to_numpy(), table.column("shingles")
            out = []
            for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                if y - x > 1:
                    own = [np.frombuffer(raw[int(k)].as_py(), np.uint64) for k in range(x, y)]
                    out += [(labels[x + a], labels[x + b]) for a, b in connect(own, percent, labels[x:y])]
            a, b = np.array(out, np.int64).reshape(-1, 2).T
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    met = hopeful.join(sets_of(hopeful.select("id").distinct()), "id").select("key", "i", "j", "id", "label", "shingles")
    more = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(confirm, "a long, b long")
    # Links between components of the stars, and with single classes.
    wider = stored(components(stored(more, "links")), "components").select(F.col("node").alias("component"), F.col("component").alias("wider"))

    joined = classes.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")).join(wider, "component", "left").withColumn("component", F.coalesce("wider", "component")).drop("wider")
    least = joined.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("least")).select("component", F.col("least.doc_id").alias("least"), F.col("least.text_key").alias("component_key"))
    labelled = joined.select(*content, "component").join(least, "component").select(*content, "least", "component_key")
    out = sigs.select("doc_id", "text_key", *content).join(labelled, content, "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "text_key", "component_key")
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key", "component_key")
