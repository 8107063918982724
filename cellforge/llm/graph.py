"""Connected components of links, without collecting links or components anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Links that a task contracts at once.
HELD = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id but the smallest of its component among these links, and that smallest."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        x, y = label[left], label[right]
        apart = x != y
        if not apart.any():
            break
        left, right = left[apart], right[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]
    own = np.flatnonzero(label != np.arange(len(ids)))
    return ids[own], ids[label[own]]


def contracted(links: DataFrame) -> DataFrame:
    """``u, v``: links that connect the same ids, those that a task has at hand as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= HELD:
                yield out(held)
                held = []
        if held:
            yield out(held)

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        return pa.record_batch([pa.array(x) for x in stars(np.asarray(table.column(0)), np.asarray(table.column(1)))], names=["u", "v"])

    return links.mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """``id, component_id`` (the smallest id reachable) for every id that occurs in ``links(a, b)``.

    Tasks contract the links they have at hand; then large-star and small-star steps alternate until every id hangs on
    its component's smallest, after about log2 of the longest path rounds. Minima are combined before they are shuffled
    and stored before they are joined with the links: such a join of two stored tables is one whose hot keys Spark
    splits, so an id with very many links is no single task. What a round has read is deleted after it.
    """
    pairs = stored(contracted(contracted(links.select("a", "b").where("a <> b")).distinct()))
    while True:
        ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up")))).alias("x")).select("x.*")
        if not ends.groupBy("id").agg(F.sum("up").alias("up"), F.min("up").alias("least")).where("up > 1 OR up > 0 AND least = 0").head(1):
            break
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, F.col("u") == F.col("at")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, after=[pairs, least])
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "at"))
        small = large.join(least, F.col("u") == F.col("at"))
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        pairs = stored(contracted(small.where("u <> v").distinct()), after=[large, least])
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(pairs.select("v", "v").distinct())
