"""Best-fit packing of token sequences under several capacities.

A sequence has three capacities: tokens, documents (pieces) and attention cost (the sum of squared lengths). Pieces are
placed in descending length into the open sequence that scores best among those where every constraint still holds:
either the least weighted norm of what would remain, or the greatest weighted dot product of need and remainder.

Pieces of one length are alike, so the driver packs the histogram of lengths (at most ``max_tokens`` entries, whatever
the number of documents) and gets runs: "pieces number a to b of length l go to sequences s, s + 1, ... at offset o".
Executors number the pieces of each length and look their run up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import stored, tasks


class Run(NamedTuple):
    """Pieces ``first`` to ``last`` (exclusive) of ``length`` go to sequences from ``sequence`` on, one each, at ``offset``."""

    length: int
    first: int
    last: int
    sequence: int
    offset: int


class Capacities(NamedTuple):
    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048


def plan(histogram: dict[int, int], capacities: Capacities, weights: tuple[float, float, float] = (1.0, 0.1, 0.1), rule: str = "norm") -> list[Run]:
    """Pack a histogram {length: pieces} by vector best fit; the runs, sequences numbered from 0.

    ``rule``: "norm" takes the least weighted squared norm of the residual capacities, "dot" the greatest weighted dot
    product of a piece's needs and the residual capacities, each relative to the full ones. Ties go to the sequences
    opened first. A piece that fits no empty sequence is an error.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule}")
    full = np.array(capacities, dtype=np.int64)
    scale = np.sqrt(np.array(weights)) / full
    kinds = np.zeros((0, 3), dtype=np.int64)  # residual capacities of each class of open sequences
    order = np.zeros(0, dtype=np.int64)
    members: list[list[tuple[int, int]]] = []  # of each class: ranges of sequences
    index: dict[tuple[int, int, int], int] = {}
    runs: list[Run] = []
    opened = 0

    def room(residual: np.ndarray, need: np.ndarray) -> int:
        return int((residual // need).min())

    def put(residual: np.ndarray, ranges: list[tuple[int, int]]) -> None:
        nonlocal kinds, order
        if not ranges or residual[0] <= 0 or residual[1] <= 0 or residual[2] <= 0:
            return
        key = tuple(residual.tolist())
        if key in index:
            members[index[key]] += ranges
            return
        if not unused:
            index[key] = len(kinds)
            kinds, order = np.vstack((kinds, residual)), np.append(order, ranges[0][0])
            members.append(list(ranges))
        else:
            free = unused.pop()
            index[key] = free
            kinds[free], order[free], members[free] = residual, ranges[0][0], list(ranges)

    unused: list[int] = []
    for length in sorted(histogram, reverse=True):
        left, done = histogram[length], 0
        need = np.array((length, 1, length * length), dtype=np.int64)
        if left and (length < 1 or room(full, need) < 1):
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left:
            fits = np.flatnonzero((kinds >= need).all(axis=1)) if len(kinds) else []
            if len(fits):
                if rule == "norm":
                    score = (((kinds[fits] - need) * scale) ** 2).sum(axis=1)
                else:
                    score = -((kinds[fits] * scale) * (need * scale)).sum(axis=1)
                best = fits[np.lexsort((order[fits], score))[0]]
                residual = kinds[best].copy()
                ranges = members[best]
                del index[tuple(residual.tolist())]
                kinds[best], members[best] = 0, []
                unused.append(int(best))
            else:
                each = room(full, need)
                residual, ranges = full, [(opened, -(-left // each))]
                opened += ranges[0][1]
            each, used = room(residual, need), int(full[0] - residual[0])
            rest: list[tuple[int, int]] = []
            packed: list[tuple[int, int]] = []
            for start, count in ranges:
                whole = min(count, left // each)
                for slot in range(each if whole else 0):
                    runs.append(Run(length, done, done + whole, start, used + slot * length))
                    done += whole
                if whole:
                    left -= whole * each
                    packed.append((start, whole))
                start, count = start + whole, count - whole
                if count and left:  # fewer pieces than one more sequence would take
                    for slot in range(left):
                        runs.append(Run(length, done + slot, done + slot + 1, start, used + slot * length))
                    done += left
                    put(residual - left * need, [(start, 1)])
                    start, count, left = start + 1, count - 1, 0
                if count:
                    rest.append((start, count))
            put(residual - each * need, packed)
            put(residual, rest)
    return runs


def pieces(docs: DataFrame, path: str, max_tokens: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text, end it with ``end_id`` and cut what is longer than ``max_tokens``; the first piece takes the remainder.

    Gives ``doc_id, piece, start, length, ids_crc32``. A null text is empty and gives one piece of one token; repeated
    rows give repeated pieces; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = bpe.vocabulary(path)
        for whole in batches:
            for batch in bpe.blocks(whole, "text"):
                ids, at = bpe.encoded(batch.column("text"), vocab)
                ids = np.insert(ids, at[1:], end_id).astype("<u4")
                at = at + np.arange(len(at))
                totals = np.diff(at)
                counts = -(-totals // max_tokens)
                row = np.repeat(np.arange(len(totals)), counts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                first = totals - (counts - 1) * max_tokens
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * max_tokens)
                length = np.where(piece == 0, first[row], max_tokens)
                data = memoryview(ids).cast("B")
                begin = at[row] + start
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                yield pa.record_batch(
                    [batch.column("id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


#: Runs up to this number are broadcast (40 bytes each); beyond it, they are joined by a shuffle.
MOST_RUNS = 200_000
#: Ranks of a block in which runs and pieces meet.
RANKS = 100_000


def pack(cut: DataFrame, capacities: Capacities = Capacities(), weights: tuple[float, float, float] = (1.0, 0.1, 0.1), rule: str = "norm") -> DataFrame:
    """Give each piece (``doc_id, piece, length`` and more) a ``sequence_id`` and its ``offset`` there.

    ``cut`` is read several times and so must be stored. Pieces without a length don't take part. Which of several
    pieces of one length goes where follows doc_id, piece and so is the same on each run; equal rows are interchangeable.
    Other columns stay, whatever their names, but for those of the added ones, which are replaced.
    """
    spark = cut.sparkSession
    rows = cut.where(F.col("length").isNotNull()).select(F.struct(*(F.col(f"`{c}`") for c in cut.columns)).alias("row"), "doc_id", "piece", "length", "start")
    counts = rows.groupBy("length").count().collect()  # one row a length: at most capacities.tokens
    runs = plan({r["length"]: r["count"] for r in counts}, capacities, weights, rule)
    buckets = max(64, tasks(cut), sum(r["count"] for r in counts) // 100_000)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    by_bucket = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = by_bucket.select(
        F.col("length").alias("in_length"), F.col("bucket").alias("in_bucket"),
        (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"),
    )
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start"))
    ranked = (
        dealt.withColumn("within", within)
        .join(before, (F.col("length") == F.col("in_length")) & (F.col("bucket") == F.col("in_bucket")))
        .withColumn("rank", F.col("before") + F.col("within") - 1)
    )
    # runs of one length in blocks of ranks, so that a piece meets only those near its rank
    table = pa.table({k: pa.array([r[i] for r in runs], pa.int64()) for i, k in enumerate(("of_length", "first", "last", "sequence", "offset"))})
    known = spark.createDataFrame(table).withColumn("near", F.explode(F.sequence(F.floor(F.col("first") / RANKS), F.floor((F.col("last") - 1) / RANKS))))
    known = F.broadcast(known) if len(runs) <= MOST_RUNS else known
    met = (F.col("length") == F.col("of_length")) & (F.floor(F.col("rank") / RANKS) == F.col("near")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    placed = ranked.join(known, met).withColumn("at", F.struct((F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset"))
    return placed.select(*(F.col("row")[c].alias(c) for c in cut.columns if c.lower() not in ("sequence_id", "offset")), "at.sequence_id", "at.offset")


def pack_documents(docs: DataFrame, path: str, capacities: Capacities = Capacities(), end_id: int = 0) -> DataFrame:
    """Cut and pack whole documents: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return pack(stored(pieces(docs, path, capacities.tokens, end_id)), capacities)
