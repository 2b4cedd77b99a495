"""Line deduplication within an edit bound, by a deletion-neighbourhood join.

A line counts as it is without blanks, tabs and carriage returns at its ends and with A-Z in lower case. A line of
``min_chars`` characters or more (1: all but blank ones) goes if an equal line stands earlier. One of ``near_chars`` or more goes
as well if a line of that length within ``edits`` (1 or 2; characters inserted, deleted or replaced) stands earlier. Earlier is in a
document with a smaller id, or before it in the same one. It does not matter whether the earlier line goes itself: of a
chain of lines, each an edit from the one before, only the first stays.

1. Every line is hashed (128 bits); the first place of each hash is kept, and equal lines elsewhere go.
2. Of ``edits + 1`` parts of a line one is left as it is by so many edits: its first, its last, or (with two edits) its
   middle characters. Lines that share no part with any other line have no neighbour; which do is found by counting the
   hashes of these parts.
3. The others emit their neighbourhood: the hash of the line, and of each line that deletions make of it outside of the
   part it shares. Equal variants meet. A replaced character shows as a deletion on both sides at one place, an inserted one
   as a deletion on one side alone, so the places tell how many edits apart two lines are; only the earliest of the
   others matters, so a group hands on one earlier partner a line, never its pairs.
4. The edit distance to that partner is computed, and the line goes if it is within the bound.

The parts' and variants' hashes come from prefix sums over the code points of many lines at once. The texts of candidate
lines are fetched by joining their first places with the documents, so what is shuffled for them grows with the candidates.
Lines meet by hash in joins whose other side has one row a line, which Spark may split, so a line that holds a third of
all rows is no task of its own. A group of equal variants holds lines that are within ``edits`` of one string, at most a power of
line length times alphabet. With two edits a line of n characters has n**2 / 2 variants; that bound is for short lines.

Defined cases: a null text stays null and has no lines; an empty text has one empty line, which stays; a document whose lines all
go has an empty text; a null id is before all others; rows that repeat an id are documents of their own, in the order of
60 bits of their texts' MD5, and rows that repeat both id and text are one document and lose the same lines; an empty
table gives no rows; other columns pass through in ``deduplicate``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lamella.llm.common import ascii_lower, named, packed, pieces, stored, text_key, unpacked
from lamella.llm.near_dedup import groups
from lamella.llm.words import mix, powers

#: The shortest lines that go for an equal one, and for a near one; and the edit bound.
MIN_CHARS, NEAR_CHARS, EDITS = 1, 10, 1
#: Characters that are hashed at once, and variants that are handed on at once.
BLOCK, VARIANTS = 1 << 18, 100_000

U = np.uint64
CODE_POINTS = np.random.default_rng(17).integers(0, 2**63, 1 << 16, dtype=np.uint64) * U(2) + U(1)
LENGTH, POSITION = np.array([0xA0761D6478BD642F], np.uint64), np.array([0xE7037ED1A0B428DB], np.uint64)
SIDES = {side: np.array([side * 0x8EBC6AF09C88C6E3 % 2**64], np.uint64) for side in (1, 2, 4)}
#: No rank.
NONE = np.iinfo(np.int64).max


def lines_of(text: str) -> list[str]:
    return [line.strip(" \t\r") for line in text.split("\n")]


def digest(line: str) -> bytes:
    """128 bits of a line, A-Z in lower case."""
    return hashlib.blake2b(line.encode().lower(), digest_size=16).digest()


class Block:
    """Prefix sums over the characters of some lines; hashes of any runs of them."""

    def __init__(self, lines: list[str]):
        points = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
        points = np.where((points >= 65) & (points <= 90), points + np.uint32(32), points)
        self.lengths = np.fromiter(map(len, lines), np.int64, len(lines))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.up, self.down = powers(len(points) + 2)
        values = CODE_POINTS[points & np.uint32(0xFFFF)] + (points >> np.uint32(16)).astype(np.uint64) * LENGTH
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(values * self.up[: len(points)], out=self.sums[1:])

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def parts(self, edits: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Of each line the keys of its parts, for its own length and for each shorter one within the bound; and the
        side of each column: 1 the first characters, 2 the last, 4 those in the middle, where one edit before may have moved them."""
        keys, sides = [], []
        for less in range(edits + 1):
            p = part(self.lengths - less, edits + 1)
            places = [(1, self.starts), (2, self.starts + self.lengths - p)]
            if edits == 2:
                places += [(4, self.starts + (self.lengths - less - p) // 2 + shift) for shift in (-1, 0, 1)]
            for side, start in places:
                keys.append(mix(self.run(start, start + p) + p.astype(np.uint64) * LENGTH + SIDES[side]))
                sides.append(side)
        return np.stack(keys, axis=1), np.array(sides, np.int8)

    def deletions(self, k: int, low: int, high: int) -> np.ndarray:
        """Of line k, the hashes of what is left without the character at low, low + 1, ... high - 1."""
        s, n = self.starts[k], self.lengths[k]
        at = np.arange(low, high)
        left = self.run(s, s + at)
        right = self.run(s + at + 1, s + n) * self.up[at]
        return mix(left + right + np.full(1, n - 1, np.uint64) * POSITION)

    def pairs(self, k: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of line k, the hashes of what is left without two of the characters low ... high - 1, and where they stood in that."""
        s, n = self.starts[k], self.lengths[k]
        step = max(1, VARIANTS // max(1, high - low))
        for a in range(low, high - 1, step):
            i, j = np.meshgrid(np.arange(a, min(a + step, high - 1)), np.arange(low, high), indexing="ij")
            i, j = i[i < j], j[i < j]
            left, middle, right = self.run(s, s + i), self.run(s + i + 1, s + j) * self.up[i], self.run(s + j + 1, s + n) * self.up[j - 1]
            yield mix(left + middle + right + np.full(1, n - 2, np.uint64) * POSITION), i, j - 1

    def whole(self) -> np.ndarray:
        """The hashes of the lines themselves, comparable with those of deletions."""
        return mix(self.run(self.starts, self.starts + self.lengths) + self.lengths.astype(np.uint64) * POSITION)


def part(length: np.ndarray, number: int = 2) -> np.ndarray:
    """That part of a length or a little less, the same for most neighbouring lengths."""
    share = np.maximum(length // number, 1)
    step = 2 ** np.maximum(np.floor(np.log2(share)).astype(np.int64) - 3, 0)
    return share // step * step


def blocks(lines: list[str]) -> Iterator[tuple[int, Block]]:
    """Blocks of lines and where they begin."""
    first, size = 0, 0
    for k, line in enumerate(lines):
        if size and size + len(line) > BLOCK:
            yield first, Block(lines[first:k])
            first, size = k, 0
        size += len(line)
    if first < len(lines):
        yield first, Block(lines[first:])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _lines(texts: pa.Array, least: int) -> tuple[list[int], list[int], list[str]]:
    """Rows, numbers and texts of the lines that are long enough."""
    rows, numbers, kept = [], [], []
    for row, text in enumerate(texts.to_pylist()):
        if text is not None:
            for k, line in enumerate(lines_of(text)):
                if len(line) >= least:
                    rows.append(row)
                    numbers.append(k)
                    kept.append(line)
    return rows, numbers, kept


def _hash_columns(lines: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(map(digest, lines)), np.int64).reshape(-1, 2)


def neighbourhood(edits: int):
    """``key, cut, cut2, doc, text_key, line``: each line itself (cuts -1) and what deletions at the cuts make of it."""
    names = ["key", "cut", "cut2", "doc", "text_key", "line"]

    def variants(block: Block, k: int, side: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        length = int(block.lengths[k])
        # Shared parts are of the line's length or of less; outside of the shortest lies all that may differ.
        p = int(min(part(np.arange(length - edits, length + 1), edits + 1)))
        low, high = (p if side == 1 else 0), (length - p if side == 2 else length)
        yield block.deletions(k, low, high), np.arange(low, high), np.full(high - low, -1)
        if edits == 2:
            yield from block.pairs(k, low, high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            places = [batch.column(c) for c in ("doc", "text_key", "line")]
            sides = batch.column("sides").to_pylist()

            def handed(held: list[tuple], places=places) -> pa.RecordBatch:
                keys, cut, cut2, rows = (np.concatenate(x) for x in zip(*held, strict=True))
                at = pa.array(rows)
                return pa.record_batch([_signed(keys), pa.array(cut.astype(np.int32)), pa.array(cut2.astype(np.int32)), *(x.take(at) for x in places)], names)

            for first, block in blocks(batch.column("text").to_pylist()):
                n = len(block.lengths)
                held, size = [(block.whole(), np.full(n, -1), np.full(n, -1), np.arange(first, first + n))], n
                for k in range(n):
                    for keys, cut, cut2 in variants(block, k, sides[first + k]):
                        held.append((keys, cut, cut2, np.full(len(keys), first + k)))
                        size += len(keys)
                        if size >= VARIANTS:
                            yield handed(held)
                            held, size = [], 0
                if held:
                    yield handed(held)

    return run


def _least(keys: np.ndarray, ranks: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The smallest rank of each key that is asked for, or NONE."""
    if not len(keys):
        return np.full(len(asked), NONE)
    order = np.lexsort((ranks, keys))
    keys, ranks = keys[order], ranks[order]
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    keys, ranks = keys[first], ranks[first]
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, ranks[at], NONE)


def earliest(group: np.ndarray, cut: np.ndarray, cut2: np.ndarray, rank: np.ndarray, edits: int) -> np.ndarray:
    """For each variant the smallest rank of those in its group that the cuts show to be within the bound.

    Cuts at the same place of both are one edit, others one each.
    """
    width = int(max(cut.max(), cut2.max())) + 2
    wide = group.astype(np.int64) * width
    none, one, two = cut < 0, (cut >= 0) & (cut2 < 0), cut2 >= 0
    best = _least(group[none], rank[none], group)  # a line itself is as many edits away as the other has cuts
    any_one, same_one = _least(group[one], rank[one], group), _least((wide + cut)[one], rank[one], wide + cut)
    if edits == 1:
        return np.minimum(best, np.where(none, any_one, same_one))
    any_two = _least(group[two], rank[two], group)
    same_two = _least(((wide + cut) * width + cut2)[two], rank[two], (wide + cut) * width + cut2)
    with_cut = _least(np.concatenate(((wide + cut)[two], (wide + cut2)[two])), np.concatenate((rank[two], rank[two])), wide + cut)
    of_second = _least((wide + cut)[one], rank[one], wide + cut2)
    of_none, of_one, of_two = np.minimum(any_one, any_two), np.minimum(any_one, with_cut), np.minimum(np.minimum(same_one, of_second), same_two)
    return np.minimum(best, np.where(none, of_none, np.where(one, of_one, of_two)))


def partners(edits: int):
    """Place and earlier place: for rows sorted by key, the earliest other line that each may be within the bound of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in groups(batches, 1):
            sizes = np.diff(bounds)
            if not (sizes > 1).any():
                continue
            # Only groups of several rows matter.
            keep = np.flatnonzero(np.repeat(sizes > 1, sizes))
            rows = table.take(pa.array(keep)).combine_chunks()
            group = np.repeat(np.arange(len(sizes)), sizes)[keep]
            docs, keys, lines = (rows.column(c) for c in ("doc", "text_key", "line"))
            place = [x.to_numpy() for x in (lines, keys, docs.fill_null(0), docs.is_valid())]  # null ids first
            order = np.lexsort(place)
            new = np.any([x[order][1:] != x[order][:-1] for x in place], axis=0)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(new)))  # the variants of one line have one rank
            line_of = order[np.concatenate(([True], new))]
            best = earliest(group, rows.column("cut").to_numpy(), rows.column("cut2").to_numpy(), rank, edits)
            found = np.flatnonzero(best < rank)
            own, other = pa.array(found), pa.array(line_of[best[found]])
            columns = [x.take(at) for at in (own, other) for x in (docs, keys, lines)]
            yield from pa.table(columns, ["doc", "text_key", "line", "p_doc", "p_key", "p_line"]).combine_chunks().to_batches()

    return run


def _same(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Whether two documents, id and key of the text, are one."""
    return a[0].eqNullSafe(b[0]) & (a[1] == b[1])


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """``doc, text_key, line, near``: the lines that go, numbered from 0, and whether for a neighbour rather than an equal line."""
    if edits not in (1, 2):
        raise ValueError("edits is 1 or 2")
    min_chars, near_chars = max(1, min_chars), max(near_chars, min_chars, 2 * edits + 2)
    texts = docs.select(named(id_col).cast("long").alias("doc"), text_key(named(text_col)).alias("text_key"), named(text_col).alias("text"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows, numbers, lines = _lines(batch.column(2), min_chars)
            h, at = _hash_columns(lines), pa.array(rows, pa.int64())
            long_enough = pa.array([len(x) >= near_chars for x in lines], pa.bool_())
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1]), long_enough], ["doc", "text_key", "line", "h1", "h2", "long"])

    occurrences = stored(texts.mapInArrow(places, "doc long, text_key long, line int, h1 long, h2 long, long boolean"), "lines")
    first = occurrences.groupBy("h1", "h2").agg(F.min(F.struct("doc", "text_key", "line")).alias("at"), F.first("long").alias("long"))
    first = stored(first.select("h1", "h2", "at.*", "long"), "first-lines")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            lines = list(dict.fromkeys(_lines(batch.column(0), near_chars)[2]))
            h = _hash_columns(lines)
            for start, block in blocks(lines):
                own = h[start : start + len(block.lengths)]
                keys, sides = block.parts(edits)
                new = np.ones(keys.shape, bool)  # mostly several lengths have the same parts
                for j in range(1, keys.shape[1]):
                    new[:, j] = (keys[:, :j] != keys[:, j : j + 1]).all(axis=1)
                at, which = np.nonzero(new)
                yield pa.record_batch([_signed(keys[new]), pa.array(sides[which]), pa.array(own[at, 0]), pa.array(own[at, 1])], ["key", "side", "h1", "h2"])

    keyed = texts.select("text").mapInArrow(parts, "key long, side byte, h1 long, h2 long")
    shared = stored(keyed.groupBy("key").agg(F.min(F.struct("h1", "h2")).alias("a"), F.max(F.struct("h1", "h2")).alias("b")).where("a <> b").select("key"), "parts")
    candidates = keyed.join(shared, "key", "left_semi").groupBy("h1", "h2").agg(F.bit_or("side").alias("sides"))

    # A document's candidates are no more than its lines.
    wanted = candidates.join(first.where("long"), ["h1", "h2"]).groupBy("doc", "text_key").agg(F.collect_list(F.struct("line", "sides", "h1", "h2")).alias("wanted"))
    wanted = stored(wanted, "candidates").withColumnsRenamed({"doc": "w_doc", "text_key": "w_key"})

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows, found = [], []
            for row, (text, some) in enumerate(zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True)):
                lines = lines_of(text)
                found += [{"text": lines[x["line"]], **x} for x in some]
                rows += [row] * len(some)
            at, own = pa.array(rows, pa.int64()), pa.Table.from_pylist(found, pa.schema([("line", pa.int32()), ("text", pa.string()), ("sides", pa.int8()), ("h1", pa.int64()), ("h2", pa.int64())]))
            yield from pa.table([batch.column("doc").take(at), batch.column("text_key").take(at), *own.columns], ["doc", "text_key", *own.column_names]).combine_chunks().to_batches()

    fetched = texts.join(wanted, _same((F.col("doc"), F.col("text_key")), (F.col("w_doc"), F.col("w_key")))).select("doc", "text_key", "text", "wanted")
    fetched = fetched.mapInArrow(fetch, "doc long, text_key long, line int, text string, sides byte, h1 long, h2 long")
    fetched = stored(fetched.dropDuplicates(["h1", "h2"]), "line-texts")  # repeated rows bring a line twice

    variants = fetched.select("doc", "text_key", "line", "text", "sides").mapInArrow(neighbourhood(edits), "key long, cut int, cut2 int, doc long, text_key long, line int")
    met = variants.repartition("key").sortWithinPartitions("key").mapInArrow(partners(edits), "doc long, text_key long, line int, p_doc long, p_key long, p_line int")
    met = met.groupBy("doc", "text_key", "line").agg(F.min(F.struct("p_doc", "p_key", "p_line")).alias("p")).select("doc", "text_key", "line", "p.*")

    def at(side: str, doc: str, key: str, line: str) -> Column:
        return _same((F.col(f"{side}.doc"), F.col(f"{side}.text_key")), (F.col(doc), F.col(key))) & (F.col(f"{side}.line") == F.col(line))

    near = (
        met.alias("e")
        .join(fetched.alias("own"), at("own", "e.doc", "e.text_key", "e.line"))
        .join(fetched.alias("other"), at("other", "e.p_doc", "e.p_key", "e.p_line"))
        .where(F.levenshtein(ascii_lower(F.col("own.text")), ascii_lower(F.col("other.text")), edits).between(0, edits))
        .select("own.h1", "own.h2", F.lit(True).alias("near"))
        .distinct()
    )
    judged = first.select("h1", "h2", F.col("doc").alias("f_doc"), F.col("text_key").alias("f_key"), F.col("line").alias("f_line"))
    judged = stored(judged.join(near, ["h1", "h2"], "left"), "judged")
    again = ~(_same((F.col("doc"), F.col("text_key")), (F.col("f_doc"), F.col("f_key"))) & (F.col("line") == F.col("f_line")))
    return occurrences.join(judged, ["h1", "h2"]).where(again | F.col("near")).select("doc", "text_key", "line", (~again).alias("near"))


@F.pandas_udf(StringType())
def _without(texts: pd.Series, numbers: pd.Series) -> pd.Series:
    out = []
    for text, some in zip(texts, numbers, strict=True):
        some = set(some)
        out.append("\n".join(line for k, line in enumerate(text.split("\n")) if k not in some))
    return pd.Series(out, dtype=object)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: bool = False, **bounds: int) -> DataFrame:
    """``docs`` with the lines that go taken out of ``text_col``; all rows stay. ``bounds`` are those of ``dropped_lines``.

    ``report`` adds ``n_lines``, ``n_equal`` and ``n_near``, the lines that were there and those that went, in place of
    columns of these names.
    """
    # A document's lines fit wherever its text does. Rows that are the same document count a line once.
    gone = dropped_lines(docs, id_col, text_col, **bounds).distinct().groupBy("doc", "text_key")
    gone = gone.agg(F.collect_list("line").alias("gone"), F.count_if(~F.col("near")).alias("n_equal"), F.count_if("near").alias("n_near")).withColumnsRenamed({"doc": "g_doc", "text_key": "g_key"})
    rows = packed(docs, doc=named(id_col).cast("long"), text_key=text_key(named(text_col)))
    rows = rows.join(gone, _same((F.col("doc"), F.col("text_key")), (F.col("g_doc"), F.col("g_key"))), "left")
    text, loses = F.col("row").getField(text_col), F.col("gone").isNotNull()
    # Only documents that lose a line go through Python.
    kept = F.when(~loses, text).otherwise(_without(F.when(loses, text).otherwise(""), F.coalesce("gone", F.array().cast("array<int>"))))
    if not report:
        return rows.select(*unpacked(docs.columns, **{text_col: kept}))
    n_lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    counts = [n_lines.alias("n_lines"), F.coalesce("n_equal", F.lit(0)).alias("n_equal"), F.coalesce("n_near", F.lit(0)).alias("n_near")]
    return rows.select(*unpacked([c for c in docs.columns if c.lower() not in ("n_lines", "n_equal", "n_near")], **{text_col: kept}), *counts)
