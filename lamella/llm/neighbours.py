"""Approximate nearest neighbours by collision counting over query-centred windows.

Every vector is indexed: random lines, at least ``PROJECTIONS`` and orthogonal in runs of the dimension, and for each the vectors
of a block sorted by their place on it.
A query's window on a line is centred on the query's own place. All windows start narrow and widen together by ``GROWTH``
(virtual rehashing: the index stays as it is, and only what a window gains is counted). A vector that has been in the
windows of ``COLLISIONS`` of the lines or more is a candidate, and its distance is computed from the original vectors in double
precision. The search ends when the k-th best distance is so small against the window's radius that a nearer vector would
have collided often enough by now, however many vectors that takes; on data without near neighbours it may be all of the
block. This is set for a recall of 0.95 or more on vectors without structure. An ``exact`` search goes on until the windows
hold the whole block, so that every vector is verified.

Vectors are dealt into blocks by their id, each once, and the queries are repeated for every block. A task first gets a
block's vectors, sorts its index once, and then takes the queries as they come, in batches, handing on k rows a query; what it
holds is one block, however many queries there are. The best k of all blocks are ranked per query.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
without an id; of rows that repeat an id the smallest vector counts, whatever its length; vectors of different lengths
are never compared;
with fewer candidates than k all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.common import named

#: Lines at least (vectors of more components get one each), the first radius as a share of a line's middle half, and the windows' growth.
PROJECTIONS, FIRST, GROWTH = 64, 0.3, 1.25
#: The share of the lines that a candidate must have met.
COLLISIONS = 0.5
#: Ends the search: this many standard deviations of a k-th best neighbour's place on a line, as the radius. A nearer
#: vector is within two of them on 95 % of the lines, twice what COLLISIONS asks for.
ENOUGH = 2.0
#: Rows of a block.
BLOCK = 16384

FOUND = "query_id long, vec_id long, score double"


def directions(n: int, dim: int, seed: int) -> np.ndarray:
    """Random unit vectors, orthogonal in runs of ``dim``: collisions on orthogonal lines tell more of the distance."""
    chance = np.random.default_rng(seed)
    bases = [np.linalg.qr(chance.standard_normal((dim, dim)))[0].T for _ in range(-(-n // dim))]
    return np.concatenate(bases)[:n]


class Index:
    """A block of vectors, sorted along each line."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 11):
        self.ids, self.vectors = ids, vectors
        self.lines = directions(max(PROJECTIONS, vectors.shape[1]), vectors.shape[1], seed)
        places = self.lines @ vectors.T
        self.order = np.argsort(places, axis=1, kind="stable").astype(np.int32)
        self.places = np.take_along_axis(places, self.order, axis=1)
        # The first windows hold a few vectors of a line in the middle.
        spread = np.quantile(self.places, 0.75, axis=1) - np.quantile(self.places, 0.25, axis=1)
        self.first = float(np.median(spread)) * FIRST

    def search(self, query_id: int, query: np.ndarray, k: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest found, nearest first; of all, if the search is to be exact."""
        n = len(self.ids)
        centre = self.lines @ query
        met, enough = np.zeros(n, np.uint16), COLLISIONS * len(self.lines)
        done = np.zeros(n, bool)
        done[self.ids == query_id] = True
        best_ids, best = np.empty(0, np.int64), np.empty(0)
        left = np.array([np.searchsorted(p, c) for p, c in zip(self.places, centre, strict=True)])
        right = left.copy()
        everything = 1.001 * max(abs(self.places[:, -1] - centre).max(), abs(self.places[:, 0] - centre).max())
        radius = min(self.first, everything) or everything
        while True:
            for j in range(len(self.lines)):
                row, order = self.places[j], self.order[j]
                lo, hi = row.searchsorted(centre[j] - radius, "left"), row.searchsorted(centre[j] + radius, "right")
                if lo < left[j]:
                    met[order[lo : left[j]]] += 1
                    left[j] = lo
                if hi > right[j]:
                    met[order[right[j] : hi]] += 1
                    right[j] = hi
            new = np.flatnonzero((met >= enough) & ~done)
            if len(new):
                done[new] = True
                distance = np.sqrt(((self.vectors[new] - query) ** 2).sum(axis=1))
                best_ids, best = np.concatenate((best_ids, self.ids[new])), np.concatenate((best, distance))
                first = np.lexsort((best_ids, best))[:k]
                best_ids, best = best_ids[first], best[first]
            if not exact and len(best) >= k and best[-1] * ENOUGH <= radius * np.sqrt(len(query)):
                break
            if radius >= everything:
                break
            radius = min(radius * GROWTH, everything)
        return best_ids, best


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def indexes(ids: np.ndarray, vectors: list[pa.Array]) -> dict[int, Index]:
    """An index for each length of the vectors of a block; of an id that repeats, the smallest vector counts."""
    column = pa.concat_arrays(vectors)
    dims = column.value_lengths().to_numpy()
    again = np.isin(ids, np.sort(ids)[1:][np.diff(np.sort(ids)) == 0])
    keep = ~again
    best: dict[int, int] = {}
    for k in np.flatnonzero(again).tolist():
        if ids[k] not in best or column[k].as_py() < column[best[ids[k]]].as_py():
            best[ids[k]] = k
    keep[list(best.values())] = True
    out = {}
    for dim in np.unique(dims[keep]).tolist():
        own = np.flatnonzero(keep & (dims == dim))
        own = own[np.argsort(ids[own])]
        out[dim] = Index(ids[own], _matrix(column.take(pa.array(own))))
    return out


def searching(k: int, exact: bool):
    """For rows sorted by block, vectors before queries: the nearest of each query in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, vectors = None, [], []
        index: dict[int, Index] | None = None
        for batch in batches:
            of, query, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "query", "vec_id"))
            out = []
            # Runs of one block, of vectors or of queries.
            bounds = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (query[1:] != query[:-1]), [True])))
            for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if of[x] != block:
                    block, ids, vectors, index = of[x], [], [], None
                own = batch.column("vector").slice(x, y - x)
                if not query[x]:
                    ids.append(number[x:y])
                    vectors.append(own)
                elif ids:
                    if index is None:
                        index = indexes(np.concatenate(ids), vectors)
                    for query_id, vector in zip(number[x:y].tolist(), own, strict=True):
                        if len(vector) in index:
                            found, distance = index[len(vector)].search(query_id, np.array(vector.as_py(), np.float64), k, exact)
                            out.append((np.full(len(found), query_id), found, distance))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", exact: bool = False, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``is_query`` accepts, the k nearest other ids found.

    ``score`` is the Euclidean distance; nearest first, ties to the smaller id.
    """
    rows = vectors.where(usable(named(vector_col)) & named(id_col).isNotNull())
    queries = rows.where(is_query).groupBy(named(id_col).cast("long").alias("vec_id")).agg(F.min(named(vector_col)).alias("vector"))
    rows = rows.select(named(id_col).cast("long").alias("vec_id"), named(vector_col).alias("vector"))
    blocks = max(1, -(-rows.count() // block))
    rows = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("query"), "vec_id", "vector")
    queries = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("query"), "vec_id", "vector")
    dealt = rows.unionByName(queries).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "query")
    found = dealt.mapInArrow(searching(k, exact), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
