"""Nearest vectors by cosine: exact, by products of blocks, and approximate, by cells with residual codes.

Exact search deals vectors and queries to blocks that meet once in a grid; each pair of blocks is one matrix product, made in slices, which keeps its best hits. The
index assigns every vector to the nearest of its centroids (the cell) and keeps what is left over as a code of one byte for each CODE_DIMS
dimensions; it lies in shards by hash, each with the vectors of a block. A query looks into its nearest cells of each shard, ranks what is in them by codes, and only its best
candidates, of each shard as many as it has of the vectors and some more, are scored by their vectors, where they lie. So neither candidates nor pairs are ever dealt.
Centroids, code words and the number of cells to look into are fitted on a sample of at most SAMPLE vectors; every vector is indexed.

A null vector has no hits and is none; a zero vector has cosine 0 with every other. Ties are by id; all that tie with the k-th are kept until ids decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.store import stored

#: Vectors (most, and least where there are cores for more blocks) and queries in a block, scores that are held at once, and rows that are handed on at once.
VECTOR_BLOCK, LEAST_BLOCK, QUERY_BLOCK, HELD, ROWS_AT_ONCE = 1 << 15, 1 << 11, 1 << 13, 1 << 21, 1 << 19
#: The index: vectors of the sample, most cells, rows of a cell's block, queries and share of hits that settle how many cells are looked into.
SAMPLE, MOST_CELLS, CELL_BLOCK, TRIED, REACHED = 20_000, 4096, 1024, 200, 0.96
#: Dimensions of a byte of code, words of each code book, least candidates scored exactly for each hit wanted, and share of hits that settle how many more are.
CODE_DIMS, CODE_WORDS, RESCORED, RANKED = 4, 256, 3, 0.98


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit rows of a column of vectors, from its flat values; zero vectors stay zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def best(scores: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k highest scores, with all that tie with the last by nine digits."""
    if k is None or scores.shape[1] <= k:
        return np.nonzero(np.ones(scores.shape, dtype=bool))
    rounded = np.round(scores, 9)
    cut = np.partition(rounded, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return np.nonzero(rounded >= cut[:, None])


def blocks(c: str, n: int, size: int):
    return F.pmod(F.xxhash64(c), F.lit(max(1, -(-n // size)))).cast("int")


def kind(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def met(queries: DataFrame, held: DataFrame, across: int, down: int):
    """Groups of queries (query_id, asked) and rows of held, whose block is p: each block of either meets each of the other once, and each row is dealt to as many groups as
    the other side has blocks. One side's columns are null in the other's rows."""
    both = F.explode(F.sequence(F.lit(0), F.lit(across - 1)))
    left = held.withColumn("s", both)
    right = queries.withColumn("s", F.pmod(F.xxhash64("query_id"), F.lit(across)).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    tasks = min(4 * across * down, 16 * queries.sparkSession.sparkContext.defaultParallelism)
    return left.unionByName(right, allowMissingColumns=True).repartition(tasks, "p", "s").groupBy("p", "s")


def sides(batches: Iterator[pa.RecordBatch], held: str) -> tuple[pa.Table, pa.Table] | None:
    """A group's queries and its rows of the other side, which have a value in held; None where either is missing."""
    t = pa.Table.from_batches(list(batches))
    q, v = t.filter(pc.is_valid(t.column("asked"))).combine_chunks(), t.filter(pc.is_valid(t.column(held))).combine_chunks()
    return (q, v) if len(q) and len(v) else None


def handed(query_ids: pa.ChunkedArray, chunk_ids: pa.Array | pa.ChunkedArray, r: np.ndarray, c: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(r), ROWS_AT_ONCE):
        of = slice(at, at + ROWS_AT_ONCE)
        t = pa.table([query_ids.take(pa.array(r[of])), chunk_ids.take(pa.array(c[of])), pa.array(score[of])], ["query_id", "chunk_id", "score"])
        yield from t.combine_chunks().to_batches()


def block_product(queries: DataFrame, vectors: DataFrame, k: int | None) -> DataFrame:
    """Rows (query_id, chunk_id, score): each query's k best hits in every block of vectors, or all pairs of a stated query set where k is None. The products leave
    a pair of blocks slice by slice, so blocks are large, and few copies of a vector are dealt."""
    # other names on either side, as both can come from one table
    q = queries.where("vector IS NOT NULL").select("query_id", F.col("vector").alias("asked"))
    v = vectors.where("vector IS NOT NULL").select("chunk_id", F.col("vector").alias("held"))
    n_q, n_v = q.count(), v.count()
    across, cores = max(1, -(-n_q // QUERY_BLOCK)), q.sparkSession.sparkContext.defaultParallelism
    down = max(1, -(-n_v // VECTOR_BLOCK), min(-(-cores // across), -(-n_v // LEAST_BLOCK)))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (both := sides(batches, "held")) is None:
            return
        q, v = both
        held, asked = matrix(v.column("held")), matrix(q.column("asked"))
        step = max(1, HELD // len(held))
        for at in range(0, len(asked), step):  # a slice of the queries at a time
            scores = asked[at : at + step] @ held.T
            r, c = best(scores, k)
            yield from handed(q.column("query_id"), v.column("chunk_id"), r + at, c, scores[r, c])

    groups = met(q, v.withColumn("p", F.pmod(F.xxhash64("chunk_id"), F.lit(down)).cast("int")), across, down)
    return groups.applyInArrow(product, f"query_id {kind(q, 'query_id')}, chunk_id {kind(v, 'chunk_id')}, score double")


def k_means(points: np.ndarray, k: int, rounds: int, unit: bool) -> np.ndarray:
    """Centroids of a bounded sample; unit: directions."""
    centres = points[np.random.default_rng(7).permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        at = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, points)
        n = np.bincount(at, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)


@dataclass
class Codes:
    """Centroids, code books of the residuals' slices, how many cells a query looks into, and how many candidates it scores."""

    centres: np.ndarray
    books: list[np.ndarray]
    probes: int
    rescored: int = 0

    def slices(self) -> list[slice]:
        edges = np.cumsum([0, *[b.shape[1] for b in self.books]]).tolist()
        return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def encode(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells = nearest(m, self.centres)
        rest = m - self.centres[cells]
        return cells, np.stack([nearest(rest[:, s], b) for s, b in zip(self.slices(), self.books, strict=True)], axis=1).astype(np.uint8)

    def estimate(self, q: np.ndarray, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Products of the queries with vectors of these cells, as far as their codes tell."""
        out = (q @ self.centres.T)[:, cells]
        for j, (s, b) in enumerate(zip(self.slices(), self.books, strict=True)):
            out += (q[:, s] @ b.T)[:, codes[:, j]]
        return out

    def chosen(self, q: np.ndarray, cells: np.ndarray, codes: np.ndarray, looked: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of each query's `most` best vectors by their codes in its `looked` nearest cells; of equal ones the first."""
        told = self.estimate(q, cells, codes)
        if looked < len(self.centres):
            near = np.argpartition(-(q @ self.centres.T), looked - 1, axis=1)[:, :looked]
            shut = np.ones((len(q), len(self.centres)), dtype=bool)
            np.put_along_axis(shut, near, False, axis=1)
            told[shut[:, cells]] = -np.inf
        kept = told > -np.inf
        if most < told.shape[1]:
            cut = np.partition(told, told.shape[1] - most, axis=1)[:, told.shape[1] - most, None]
            above, level = told > cut, kept & (told == cut)
            kept = above | level & (np.cumsum(level, axis=1) <= most - above.sum(axis=1, keepdims=True))
        return np.nonzero(kept)


def fit_codes(sample: np.ndarray, n: int, k: int) -> Codes:
    """Cells: the root of n, as far as the sample has eight vectors for each. Probes: so many that REACHED of the hits of TRIED sample vectors among the sample are within.
    Candidates: so many that RANKED of these hits are among them in the order by codes, in proportion to n."""
    cells = max(1, min(int(n**0.5), MOST_CELLS, max(1, len(sample) // 8)))
    centres = k_means(sample, cells, 12, unit=True)
    rest = sample - centres[nearest(sample, centres)]
    books = [k_means(x, min(CODE_WORDS, len(x)), 8, unit=False) for x in np.array_split(rest, max(1, sample.shape[1] // CODE_DIMS), axis=1)]
    tried = sample[:TRIED]
    turn = np.argsort(np.argsort(-(tried @ centres.T), axis=1), axis=1)  # place of each cell in a query's order
    r, c = best(tried @ sample.T, min(k, len(sample)))
    needed = np.sort(turn[r, nearest(sample, centres)[c]])
    made = Codes(centres, books, int(needed[min(len(needed) - 1, int(REACHED * len(needed)))]) + 1)
    cells_of, marks = made.encode(sample)
    told = made.estimate(tried, cells_of, marks)
    deep = np.sort([(told[i] > told[i, j]).sum() + 1 for i, j in zip(r, c, strict=True)])
    made.rescored = max(RESCORED * k, -(-int(deep[min(len(deep) - 1, int(RANKED * len(deep)))]) * n // len(sample)))
    return made


@dataclass
class CellIndex:
    """codes, and the written table cells (p, cell, block, ids, codes, vectors), p being the shard, of `shards`."""

    codes: Codes
    cells: DataFrame
    n: int
    shards: int


def cell_index(vectors: DataFrame, k: int) -> CellIndex | None:
    """An index of vectors (chunk_id, vector), tuned for k hits; None for an empty table."""
    v = vectors.where("vector IS NOT NULL").select("chunk_id", "vector")
    n = v.count()
    if not n:
        return None
    sample = v.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).toArrow()  # the fit's bounded sample
    codes = fit_codes(matrix(sample.column("vector")), n, k)
    shared = v.sparkSession.sparkContext.broadcast(codes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cells, marks = shared.value.encode(matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells.astype(np.int32)), pa.array([m.tobytes() for m in marks], pa.binary())], ["chunk_id", "vector", "cell", "code"])

    rows = v.mapInArrow(assign, f"chunk_id {kind(v, 'chunk_id')}, vector {kind(v, 'vector')}, cell int, code binary").withColumn("p", blocks("chunk_id", n, VECTOR_BLOCK))
    rows = stored(rows, "codes")
    sizes = rows.groupBy("p", "cell").agg(F.ceil(F.count(F.lit(1)) / CELL_BLOCK).cast("int").alias("parts"))  # at most MOST_CELLS rows of each shard
    dealt = rows.join(F.broadcast(sizes), ["p", "cell"]).withColumn("block", F.expr("cast(pmod(xxhash64(chunk_id, 1), parts) as int)"))
    cells = dealt.groupBy("p", "cell", "block").agg(F.collect_list(F.struct("chunk_id", "code", "vector")).alias("of"))
    cells = cells.select("p", "cell", "block", F.col("of.chunk_id").alias("ids"), F.col("of.code").alias("codes"), F.col("of.vector").alias("vectors"))
    return CellIndex(codes, stored(cells, "cells"), n, max(1, -(-n // VECTOR_BLOCK)))


def looked_up(queries: DataFrame, index: CellIndex, k: int | None, most: int, probes: int | None = None) -> DataFrame:
    """Rows (query_id, chunk_id, score): of each query's nearest cells the best rows by their codes, `most` in all where there is one shard and some more where there are several,
    scored by their vectors; of these the k best of each shard, or all where k is None. A shard and a block of queries meet once."""
    q = queries.where("vector IS NOT NULL").select("query_id", F.col("vector").alias("asked"))
    across, n, n_shards = max(1, -(-q.count() // QUERY_BLOCK)), index.n, index.shards
    shared, looked = q.sparkSession.sparkContext.broadcast(index.codes), min(probes or index.codes.probes, len(index.codes.centres))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (both := sides(batches, "ids")) is None:
            return
        q, v = both
        of, made = [v.column(c).chunk(0) for c in ("ids", "codes", "vectors")], shared.value
        order = pc.sort_indices(of[0].flatten())  # of equal ones the first by id
        ids, held, at_order = of[0].flatten().take(order), matrix(of[2].flatten().take(order)), order.to_numpy()
        cells = np.repeat(v.column("cell").to_numpy(), of[0].value_lengths().to_numpy())[at_order]
        marks = np.frombuffer(b"".join(of[1].flatten().to_pylist()), dtype=np.uint8).reshape(len(ids), -1)[at_order]
        share = most * len(ids) / n
        mine_most = most if n_shards == 1 else min(most, math.ceil(share + 2 * share**0.5))
        asked, step = matrix(q.column("asked")), max(1, HELD // len(ids))
        for at in range(0, len(asked), step):
            mine = asked[at : at + step]
            r, c = made.chosen(mine, cells, marks, looked, mine_most)
            scores = np.concatenate([np.zeros(0), *((mine[r[i : i + ROWS_AT_ONCE // 8]] * held[c[i : i + ROWS_AT_ONCE // 8]]).sum(axis=1) for i in range(0, len(r), ROWS_AT_ONCE // 8))])
            if k is not None:
                full = np.full((len(mine), len(ids)), -np.inf)
                full[r, c] = scores
                r, c = best(full, k)
                r, c = r[(found := full[r, c] > -np.inf)], c[found]
                scores = full[r, c]
            yield from handed(q.column("query_id"), ids, r + at, c, scores)

    held = index.cells.select("p", "cell", "ids", "codes", "vectors")
    return met(q, held, across, n_shards).applyInArrow(search, f"query_id {kind(q, 'query_id')}, chunk_id {index.cells.schema['ids'].dataType.elementType.simpleString()}, score double")


def candidates(queries: DataFrame, index: CellIndex, most: int, probes: int | None = None) -> DataFrame:
    """Rows (query_id, chunk_id): what the search scores by vectors."""
    return looked_up(queries, index, None, most, probes).select("query_id", "chunk_id")
