"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..storage import discard, stored

__all__ = ["discard", "fresh", "gathered", "groups", "mixed", "stored", "tasks"]


def tasks(df: DataFrame) -> int:
    """Partitions for a shuffle made by hand."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, whatever the case: the given ones, with underscores added as needed."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def gathered(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the ragged rows ``values[offsets[r]:offsets[r + 1]]`` in the order of ``rows``."""
    start = offsets[:-1][rows]
    counts = offsets[1:][rows] - start
    out = np.zeros(len(rows) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    at = np.arange(out[-1], dtype=np.int64)
    at += np.repeat(start - out[:-1], counts)
    return values[at], out


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table for each run of rows that agree in ``keys``, which come sorted; runs may span batches."""
    held: list[pa.RecordBatch] = []  # the last run so far
    for batch in batches:
        if not batch.num_rows:
            continue
        changes = np.zeros(batch.num_rows, dtype=bool)
        for key in keys:
            column = batch.column(key)
            changes[1:] |= ~np.asarray(pc.equal(column[1:], column[:-1]))
            if held and not changes[0]:
                changes[0] = held[-1].column(key)[-1].as_py() != column[0].as_py()
        begin = 0
        for cut in np.flatnonzero(changes).tolist():
            if cut > begin:
                held.append(batch.slice(begin, cut - begin))
            if held:
                yield pa.Table.from_batches(held)
            held, begin = [], cut
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)
