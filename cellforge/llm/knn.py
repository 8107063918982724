"""Exact top-k search by inner product as a Voronoi join.

Pivots, chosen from a bounded sample of the data, divide the vectors into cells. A cell's summary (number of vectors,
radius, greatest norm) bounds every score between a query and the cell, below and above. A query's k-th score is bounded
below by the sample, whose rows are data, and by the summaries; the query goes to just those cells whose upper bound
reaches that. There each pair is bounded once more, by the product of its leading principal components and the norms of
the rest, and only pairs that reach the query's bound are scored, in integers.

Cells and the queries that reach them are cut into blocks, so that a cell with a third of all vectors is many tasks, and
data are copied only for blocks of queries that reach their cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Cells, about the square root of the number of vectors, between these; rows of the sample for each.
LEAST_PIVOTS, MOST_PIVOTS, SAMPLE = 16, 1024, 1024
#: Vectors and queries of one local solution.
BLOCK = 4096
#: Share of the components, the leading principal ones, that a pair is bounded by.
LEADING = 0.75


def quantised(vectors: DataFrame, id_col: str, vector_col: str, steps: int = 256) -> DataFrame:
    """``id, v``: floor(steps * x) of each component; rows without an id or with a null or non-finite component are left out."""
    v = F.col(f"`{vector_col}`")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & (F.size(v) > 0) & whole).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * steps)).alias("v")
    )


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(np.int64)


def sampled(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a bounded sample, by a hash of the id."""
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(size).select("id", "v").collect()
    return np.array([r["id"] for r in picked], dtype=np.int64), np.array([r["v"] for r in picked], dtype=np.int64)


def pivots(vectors: np.ndarray, count: int) -> np.ndarray:
    """Spread-out pivots: the farthest-first choice among different vectors."""
    pool = np.unique(vectors.astype(np.float64), axis=0)
    chosen = [0]
    gap = ((pool - pool[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(pool)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((pool - pool[chosen[-1]]) ** 2).sum(axis=1))
    return pool[chosen]


def principal(vectors: np.ndarray) -> np.ndarray:
    """Directions of the sample's greatest mean squares first, as columns. Any orthonormal basis gives valid bounds."""
    x = vectors.astype(np.float64)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()


def assigned(rows: DataFrame, at: np.ndarray) -> DataFrame:
    """Add ``cell`` (the nearest pivot), ``gap`` (its distance) and ``norm``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v")).astype(np.float64)
            square = (x**2).sum(axis=1)
            far = square[:, None] - 2 * (x @ at.T) + (at**2).sum(axis=1)
            cell = far.argmin(axis=1)
            gap = np.sqrt(((x - at[cell]) ** 2).sum(axis=1))
            yield pa.record_batch([batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(gap), pa.array(np.sqrt(square))], names=["id", "v", "cell", "gap", "norm"])

    return rows.mapInArrow(run, "id long, v array<long>, cell int, gap double, norm double")


def sample_bound(q: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th score within the sample, itself left out; -inf with fewer."""
    score = q.astype(np.float64) @ vectors.T.astype(np.float64)
    score[own[:, None] == ids[None, :]] = -np.inf
    if score.shape[1] < k:
        return np.full(len(q), -np.inf)
    return np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]


def summary_bound(lower: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """What k + 1 vectors reach at least (the query itself may be one), by the lower bounds of whole cells."""
    order = np.argsort(-lower, axis=1)
    enough = np.cumsum(size[order], axis=1) > k
    at = enough.argmax(axis=1)
    found = np.take_along_axis(lower, order, axis=1)[np.arange(len(lower)), at]
    return np.where(enough.any(axis=1), found, -np.inf)


def reaching(q: np.ndarray, x: np.ndarray, least: np.ndarray, basis: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) of the pairs whose score can reach the query's bound: by leading components and norms of the rest."""
    a, b = q.astype(np.float64) @ basis, x.astype(np.float64) @ basis
    rest = lambda y: np.sqrt((y[:, leading:] ** 2).sum(axis=1))
    most = a[:, :leading] @ b[:, :leading].T + rest(a)[:, None] * rest(b)[None, :]
    slack = 1e-9 * np.sqrt((a**2).sum(axis=1))[:, None] * np.sqrt((b**2).sum(axis=1).max(initial=0.0)) + 1e-6  # bounds are rounded, scores aren't
    return np.nonzero(most + slack >= least[:, None])


def solved(queries: DataFrame, data: DataFrame, k: int, basis: np.ndarray, leading: int) -> DataFrame:
    """The best k of each query in each block of data: ``query_id, vec_id, score``.

    ``queries(query_id, v, least, cell, part, q_part)`` and ``data(id, v, cell, part, q_part)`` meet by cell and blocks.
    """
    q = queries.select("cell", "part", "q_part", F.lit(True).alias("asks"), F.col("query_id").alias("id"), "v", "least")
    own = data.select("cell", "part", "q_part", F.lit(False).alias("asks"), "id", "v", F.lit(None).cast("double").alias("least"))

    def run(table: pa.Table) -> pa.Table:
        asks = np.asarray(table.column("asks"))
        ids, v = np.asarray(table.column("id")), matrix(table.column("v"))
        ask, have, mine, x = ids[asks], ids[~asks], v[asks], v[~asks]
        least = table.column("least").to_numpy()[asks].astype(np.float64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a in range(0, len(ask), 512):
            i, j = reaching(mine[a : a + 512], x, np.where(np.isnan(least[a : a + 512]), -np.inf, least[a : a + 512]), basis, leading)
            i += a
            other = ask[i] != have[j]
            i, j = i[other], j[other]
            score = np.concatenate([np.einsum("ij,ij->i", mine[i[c : c + 65536]], x[j[c : c + 65536]]) for c in range(0, len(i), 65536)] or [np.zeros(0, dtype=np.int64)])
            order = np.lexsort((have[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            begin = np.searchsorted(i, i)  # where each query's pairs begin
            first = np.arange(len(i)) - begin < k
            parts.append((ask[i[first]], have[j[first]], score[first]))
        columns = [np.concatenate(c) if parts else np.zeros(0, dtype=np.int64) for c in (zip(*parts, strict=True) if parts else ((), (), ()))]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (pa.array(c, pa.int64()) for c in columns), strict=True)))

    return q.union(own).groupBy("cell", "part", "q_part").applyInArrow(run, "query_id long, vec_id long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def of_length(rows: DataFrame, is_query: Column, n: int, k: int, block: int, leading: float) -> DataFrame:
    """The best k, unranked but for those of a block, of vectors of one length, of which there are ``n``."""
    count = max(LEAST_PIVOTS, min(MOST_PIVOTS, math.isqrt(n)))
    ids, sample = sampled(rows, max(SAMPLE, 2 * count))
    at, basis = pivots(sample, count), principal(sample)
    cells = stored(assigned(rows, at))
    # one row a cell, at most count
    summary = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius"), F.max("norm").alias("norm")).collect()
    size = np.zeros(len(at), dtype=np.int64)
    radius, norm = np.full(len(at), -np.inf), np.full(len(at), -np.inf)
    for r in summary:
        size[r["cell"]], radius[r["cell"]], norm[r["cell"]] = r["n"], r["radius"], r["norm"]
    blocks = -(-size // block)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, q = np.asarray(batch.column("id")), matrix(batch.column("v")).astype(np.float64)
            length = np.sqrt((q**2).sum(axis=1))[:, None]
            full = size > 0
            with np.errstate(invalid="ignore"):
                middle = q @ at.T
                upper = np.where(full, np.minimum(middle + length * radius, length * norm), -np.inf)
                lower = np.where(full, np.maximum(middle - length * radius, -length * norm), -np.inf)
            slack = 1e-9 * length * np.maximum(1.0, norm[full].max(initial=0.0)) + 1e-6
            least = np.maximum(sample_bound(q, ids, sample, own, k), summary_bound(lower, size, k) - slack[:, 0])
            row, cell = np.nonzero(full & (upper + slack >= least[:, None]))
            copies = blocks[cell]  # a query goes to every block of a cell
            part = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            row, cell = np.repeat(row, copies), np.repeat(cell, copies)
            taken = pa.array(row)
            yield pa.record_batch([batch.column("id").take(taken), batch.column("v").take(taken), pa.array(least[row]), pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32))], names=["query_id", "v", "least", "cell", "part"])

    asking = cells.where(is_query).select("id", "v").mapInArrow(spread, "query_id long, v array<long>, least double, cell int, part int")
    asking = stored(asking)
    # blocks of queries by cell: at most a row a cell, and cells are bounded
    shares = asking.where("part = 0").groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("shares"))
    sizes = cells.sparkSession.createDataFrame([(j, int(b)) for j, b in enumerate(blocks) if b], "cell int, blocks int")
    known = F.broadcast(stored(shares.join(F.broadcast(sizes), "cell")))
    queries = asking.join(known, "cell").withColumn("q_part", F.pmod(F.xxhash64("query_id"), F.col("shares")).cast("int"))
    data = cells.join(known, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("q_part", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    return solved(queries, data, k, basis, max(1, math.ceil(leading * len(basis))))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", steps: int = 256, block: int = BLOCK, leading: float = LEADING) -> DataFrame:
    """The k greatest integer inner products of each query with the other rows: ``query_id, rank, vec_id, score``.

    ``is_query`` tells queries by ``id``; ids should be unique (rows that repeat an id are candidates each, never of
    their own id). Ties go to the smaller id. Vectors of different lengths have no product: each length is searched by
    itself. Vectors that are null or have a null or non-finite component take no part; a query with fewer than k
    candidates gets all; an empty table, none.
    """
    rows = quantised(vectors, id_col, vector_col, steps)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy("n").collect()  # a row for each length
    if not lengths:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score"))
    parts = [of_length(rows.where(F.size("v") == r["n"]) if len(lengths) > 1 else rows, is_query, r["count"], k, block, leading) for r in lengths]
    return best(reduce(DataFrame.union, parts), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
