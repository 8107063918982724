"""Near-duplicate vectors: Euclidean p-stable hashing, then exact cosines.

Equal vectors are one class. Classes are normalised and hashed into tables; a key is a number of projections onto
Gaussian directions, shifted and quantised in steps. Both numbers follow from the number of vectors: projections, so that
a vector meets less than one unrelated vector in all tables, and tables, so that a pair at the threshold is missed with a
fixed small probability. Vectors that share a bucket of few are listed as pairs, each pair once whatever the tables that
it meets in, and compared by cosine in double precision; larger buckets are compared in blocks, which return a spanning
forest of their links, so what leaves a group grows with its size and not with its pairs. Links are then counted exactly
within each component, again in blocks: a link joins two vectors of one component, so none found is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import groups as runs
from .common import mixed, stored, tasks
from .graph import components

STEP = 2.0
#: Probability that a pair at the threshold shares no bucket.
MISS = 1e-3
#: Members of a bucket up to which pairs are listed, and of one block of a larger bucket or component.
SMALL, BLOCK = 16, 512


def collision(distance: float, step: float) -> float:
    """Probability that one shifted projection of two vectors at this distance falls into the same step."""
    x = step / distance
    return math.erf(x / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-(x**2) / 2))


def parameters(n: int, least: float, step: float = STEP, miss: float = MISS) -> tuple[int, int]:
    """Tables and projections a key for ``n`` vectors: unrelated ones are at right angles."""
    near, far = collision(math.sqrt(max(2 - 2 * least, 1e-9)), step), collision(math.sqrt(2), step)
    width = 8
    while True:
        tables = math.ceil(math.log(miss) / math.log1p(-(near**width)))
        if n * tables * far**width < 1:
            return tables, width
        width += 1


def usable(vector_col: str) -> Column:
    """Whether a vector can link: not null, empty or zero, and without null and non-finite components."""
    v = F.col(f"`{vector_col}`")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & whole & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(column: pa.Array) -> list[np.ndarray]:
    """The vectors of a list column at length one; as rows of one matrix if all have as many components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.asarray(column.offsets)
    sizes = np.diff(at)
    flat = np.asarray(column.flatten()).astype(np.float64)
    if len(sizes) and (sizes == sizes[0]).all():
        x = flat.reshape(len(sizes), -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return list(x / np.sqrt((x * x).sum(axis=1, keepdims=True)))
    at = at - at[0]
    return [row for a, b in zip(at[:-1], at[1:], strict=True) for row in unit(pa.array([flat[a:b]]))]


def projections(dimension: int, tables: int, width: int, step: float) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng((11, dimension))
    return random.standard_normal((dimension, tables * width)), random.uniform(0, step, tables * width)


def hashed(rows: DataFrame, tables: int, width: int, step: float) -> DataFrame:
    """``id, keys``: a 64-bit key for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            xs = unit(batch.column("x"))
            keys = np.zeros((len(xs), tables), dtype=np.uint64)
            sizes = np.array([len(x) for x in xs])
            for n in np.unique(sizes):
                own = np.flatnonzero(sizes == n)
                turn, shift = projections(int(n), tables, width, step)
                for part in np.array_split(own, -(-len(own) // 2048)):
                    cells = np.floor((np.stack([xs[i] for i in part]) @ turn + shift) / step).astype(np.int64).reshape(len(part), tables, width)
                    h = np.full((len(part), tables), np.uint64(n))
                    for j in range(width):
                        h = mixed(h ^ cells[:, :, j].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j))
                    keys[part] = h
            flat = pa.array(keys.view(np.int64).reshape(-1))
            yield pa.record_batch([batch.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), flat)], names=["id", "keys"])

    return rows.mapInArrow(run, "id long, keys array<long>")


def paired(members: DataFrame, group: list[str], size: str, block: int) -> DataFrame:
    """Deal groups into pairs of blocks: every two members of a group meet in one (``p``, ``q``), in a block ``side``."""
    parts = F.ceil(F.col(size) / block).cast("long")
    own = F.pmod(F.xxhash64("id"), parts)
    dealt = members.withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return dealt.withColumn("p", F.least("side", "other")).withColumn("q", F.greatest("side", "other"))


def compared(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    ids = np.asarray(table.column("id"))
    xs = unit(table.column("x").combine_chunks())
    side = np.asarray(table.column("side"))
    cross = len(table) > 0 and table.column("p")[0].as_py() != table.column("q")[0].as_py()
    return ids, np.stack(xs) if xs else np.zeros((0, 1)), side, cross


def linked(rows: DataFrame, least: float, tables: int, width: int, step: float, block: int) -> DataFrame:
    """Links ``a, b`` of ``rows(id, x)`` with a cosine of at least ``least``: all that were found, or a forest that spans them."""
    keys = stored(hashed(rows, tables, width, step)).select("id", F.posexplode("keys").alias("t", "key"))
    shared = stored(keys.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"))
    members = stored(keys.join(shared, ["t", "key"]))

    lists = members.where(F.col("n") <= SMALL).groupBy("t", "key").agg(F.sort_array(F.collect_list("id")).alias("of")).select("of").distinct()
    pairs = lists.select("of", F.posexplode("of").alias("i", "a")).select("a", F.explode(F.slice("of", F.col("i") + 2, SMALL)).alias("b")).distinct()
    both = pairs.join(rows.select(F.col("id").alias("a"), F.col("x").alias("x")), "a").join(rows.select(F.col("id").alias("b"), F.col("x").alias("y")), "b").select("a", "b", "x", "y")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = [float(x @ y) >= least for x, y in zip(unit(batch.column("x")), unit(batch.column("y")), strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(near))

    few = both.where(F.size("x") == F.size("y")).mapInArrow(judge, "a long, b long")

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["t", "key", "p", "q"]):
            a: list[int] = []
            b: list[int] = []
            ids, x, side, cross = compared(table)
            near = x @ x.T >= least
            if cross:
                near &= side[:, None] != side[None, :]
            np.fill_diagonal(near, False)
            left = np.ones(len(ids), dtype=bool)
            for first in range(len(ids)):
                if not left[first]:
                    continue
                left[first] = False
                wave = [first]
                while wave:
                    i = wave.pop()
                    new = np.flatnonzero(near[i] & left)
                    left[new] = False
                    a += [int(ids[i])] * len(new)
                    b += ids[new].tolist()
                    wave += new.tolist()
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = paired(members.where(F.col("n") > SMALL).join(rows, "id"), ["t", "key"], "n", block).select("t", "key", "p", "q", "side", "id", "x")
    many = dealt.repartition(tasks(dealt), "t", "key", "p", "q").sortWithinPartitions("t", "key", "p", "q").mapInArrow(span, "a long, b long")
    return few.union(many)


def counted(members: DataFrame, least: float, block: int) -> DataFrame:
    """``id, n``: for each of ``members(component_id, size, id, x, copies)`` the vectors of its component it links with."""

    def run(table: pa.Table) -> pa.Table:
        ids, x, side, cross = compared(table)
        copies = np.asarray(table.column("copies"))
        near = x @ x.T >= least
        if cross:
            near &= side[:, None] != side[None, :]
        np.fill_diagonal(near, False)
        return pa.table({"id": pa.array(ids), "n": pa.array((near * copies[None, :]).sum(axis=1), pa.int64())})

    dealt = paired(members, ["component_id"], "size", block)
    found = dealt.select("component_id", "p", "q", "side", "id", "x", "copies").groupBy("component_id", "p", "q").applyInArrow(run, "id long, n long")
    return found.groupBy("id").agg(F.sum("n").alias("n"))


def deduplicate(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", step: float = STEP, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """One row a vector: ``vec_id, n_links, component_id, kept``.

    Vectors that are null, empty or zero or have a null or non-finite component link with nothing; vectors of different
    lengths never link. Equal vectors link. Rows that repeat an id are vectors of their own, each with its own number of
    links, but in one component; a null id is a component of its own without links. An empty table gives an empty one.
    """
    name = F.col(f"`{id_col}`").cast("long")
    some = usable(vector_col) & F.col(f"`{id_col}`").isNotNull()
    x = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    digest = F.sha2(F.array_join(F.transform(x, lambda c: c.cast("string")), ","), 256)
    member = stored(vectors.where(some).select(name.alias("id"), digest.alias("class"), x.alias("x")))
    # copies are combined first, and a class goes by a number of its own, since an id may have several vectors
    kind = stored(member.groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("x").alias("x")).withColumn("node", F.monotonically_increasing_id()))
    nodes = kind.select(F.col("node").alias("id"), "x", "copies")
    tables, width = parameters(kind.count(), least, step, miss)
    near = linked(nodes.select("id", "x"), least, tables, width, step, block)
    several = stored(member.groupBy("id").agg(F.min("class").alias("one"), F.max("class").alias("other")).where("one <> other").select("id"))
    if several.head(1):
        of_id = member.join(several, "id").join(kind.select("class", "node"), "class").select("id", "node").distinct()
        near = near.union(of_id.join(of_id.groupBy("id").agg(F.min("node").alias("a")), "id").select("a", F.col("node").alias("b")))
    groups = stored(components(near.distinct()))
    sizes = groups.groupBy("component_id").agg(F.count("*").alias("size"))
    links = counted(groups.join(sizes, "component_id").join(nodes, "id"), least, block)
    smallest = groups.join(kind.select(F.col("node").alias("id"), "rep"), "id").groupBy("component_id").agg(F.min("rep").alias("smallest"))
    of_node = groups.join(smallest, "component_id").join(links, "id", "left")
    of_class = kind.join(of_node, kind["node"] == of_node["id"], "left").select(
        "class", F.coalesce("smallest", "rep").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")
    )
    out = member.select("id", "class").join(stored(of_class), "class").select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    alone = vectors.where(~some).select(name.alias("vec_id"), F.lit(0).cast("long").alias("n_links"), name.alias("component_id"), F.lit(True).alias("kept"))
    return out.union(alone)
