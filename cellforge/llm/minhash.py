"""Near-duplicate documents: SetSketch registers, banding, joint likelihood, exact confirmation.

A document's set is its distinct shingles of five words. Its sketch has one register per hash function: the least of
exponentially distributed hash values, kept as its exponent to a base close to one and truncated to 16 bits. Sketches
merge by the greater register and equal sets have equal sketches. Documents that agree in a band of registers are
candidates; the similarity of a candidate pair is estimated by maximum likelihood from how many registers are greater,
less and equal, jointly with both set sizes. Plausible pairs make groups, in which all pairs that could still connect
are confirmed on full sets.

Documents with equal sets are one class from the start. Buckets and groups are cut into blocks, and what a block returns
is a spanning forest, so no task holds a whole large group and nothing grows with its pairs. In a large group every
member is first compared with the group's first, which takes one pass; only members that aren't linked to it, mostly few,
meet all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import groups, mixed, stored, tasks
from .graph import components

WORDS = 5
BANDS, ROWS = 32, 4
#: The sketch: base and rate of the exponential spacing, and the greatest register.
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
#: Standard deviations below the threshold at which an estimate is no longer plausible.
SLACK = 4.0
#: Members of a block where sketches, and where full sets are compared; buckets up to SMALL members become plain pairs.
SKETCH_BLOCK, SET_BLOCK, SMALL = 512, 128, 16

_ODD = np.random.default_rng(5).integers(0, 1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.random.default_rng(6).integers(0, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct shingles of each text (null: none), sorted, and offsets of each text's."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    at = np.asarray(split.offsets).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False)
    code = np.asarray(coded.indices)
    of_word = pd.util.hash_array(distinct, categorize=False).astype(np.uint64) if len(distinct) else np.zeros(0, dtype=np.uint64)
    filled = np.array([bool(w) for w in distinct], dtype=bool)[code] if len(distinct) else np.zeros(0, dtype=bool)
    kept = np.concatenate(([0], np.cumsum(filled)))
    at = kept[at - at[0]]
    h = of_word[code[filled]]
    n = len(h)
    joined = np.zeros(n, dtype=np.uint64)
    for k in range(words):
        joined[: max(0, n - k)] += mixed(h[k:] + np.uint64(k)) * _PLACE[k]
    joined = mixed(joined)
    out: list[np.ndarray] = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            own = np.sort(joined[a : b - words + 1])
            if (own[1:] == own[:-1]).any():
                own = np.unique(own)
        elif b > a:
            part = h[a:b]
            own = mixed((mixed(part + np.arange(b - a, dtype=np.uint64)) * _PLACE[: b - a]).sum(keepdims=True) + _PLACE[63:] * np.uint64(b - a))
        else:
            own = h[:0]
        out.append(own)
    offsets = np.zeros(len(out) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in out], out=offsets[1:])
    return np.concatenate(out) if out else h[:0], offsets


def sketches(elements: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The registers of each set: uint16, all zero for an empty one."""
    full = np.flatnonzero(np.diff(offsets) > 0)
    registers = np.zeros((len(offsets) - 1, len(_ODD)), dtype=np.uint16)
    starts = offsets[:-1][full]
    ends = offsets[1:][full]
    a = 0
    while a < len(full):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + (1 << 15), side="right")))
        part = elements[starts[a] : ends[b - 1]]
        cuts = starts[a:b] - starts[a]
        top = np.empty((b - a, len(_ODD)), dtype=np.uint64)
        for j, odd in enumerate(_ODD):
            top[:, j] = np.maximum.reduceat(part * odd, cuts)
        least = -np.log1p(-((~top).astype(np.float64) + 0.5) / 2.0**64) / RATE
        registers[full[a:b]] = np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)
        a = b
    return registers


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def band_keys(registers: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(registers), BANDS), dtype=np.uint64)
    for k in range(ROWS):
        keys = mixed(keys ^ registers[:, k::ROWS].astype(np.uint64) + np.uint64(k << 20))
    return keys.view(np.int64)


def estimated(greater: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity by maximum likelihood: of all registers, ``greater`` are greater in a and ``less`` in b."""
    m = len(_ODD)
    equal = m - greater - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    scale = (BASE - 1) / BASE
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * scale) / np.log(BASE)

    def slope(x: np.ndarray) -> np.ndarray:
        return scale / (1 - x * scale) / np.log(BASE)

    for _ in range(24):  # the likelihood has one maximum: halve towards where its derivative changes sign
        middle = (low + high) / 2
        x, y = np.maximum(u - v * middle, 1e-12), np.maximum(v - u * middle, 1e-12)
        px, py = np.maximum(p(x), 1e-12), np.maximum(p(y), 1e-12)
        grows = -greater * v * slope(x) / px - less * u * slope(y) / py + equal * (v * slope(x) + u * slope(y)) / np.maximum(1 - px - py, 1e-12) > 0
        low, high = np.where(grows, middle, low), np.where(grows, high, middle)
    return (low + high) / 2


def plausible_pairs(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, percent: int) -> np.ndarray:
    """Row by row: the estimate where sizes and registers allow for a link, else -1."""
    least = percent / 100
    floor = least - SLACK * np.sqrt(least * (1 - least) / left.shape[1])
    fits = 100 * np.minimum(n_left, n_right) >= percent * np.maximum(n_left, n_right)
    equal = (left == right).sum(axis=1)
    fits &= equal >= (floor - 0.1) * left.shape[1]
    out = np.full(len(left), -1.0)
    at = np.flatnonzero(fits)
    if len(at):
        greater, less = (left[at] > right[at]).sum(axis=1), (left[at] < right[at]).sum(axis=1)
        value = estimated(greater, less, n_left[at].astype(float), n_right[at].astype(float))
        out[at] = np.where(value >= floor, value, -1.0)
    return out


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """``id, mark, n, digest, registers, keys`` of every row; ``mark`` is a hash of the text as given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bpe.blocks(whole, "text"):
                elements, at = shingles(batch.column("text"), words)
                registers = sketches(elements, at)
                data = memoryview(np.ascontiguousarray(elements)).cast("B")
                digest = [hashlib.blake2b(data[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(digest) * BANDS + 1, BANDS), pa.int32()), pa.array(band_keys(registers).reshape(-1)))
                yield pa.record_batch([batch.column("id"), batch.column("mark"), pa.array(np.diff(at)), pa.array(digest, pa.binary()), pa.array([r.tobytes() for r in registers], pa.binary()), keys], names=["id", "mark", "n", "digest", "registers", "keys"])

    return docs.withColumn("mark", F.xxhash64("text")).mapInArrow(run, "id long, mark long, n long, digest binary, registers binary, keys array<long>")


def registers_of(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), -1)


def candidates(own: DataFrame, percent: int) -> DataFrame:
    """Plausible links ``a, b`` of the sketches ``own(id, n, registers, keys)``: all, or a forest that spans them."""
    keys = own.select("id", "n", F.posexplode("keys").alias("t", "key"))
    # stored first: a join of two stored tables is one whose hot keys Spark splits
    shared = stored(keys.groupBy("t", "key").agg(F.count("*").alias("size")).where("size > 1"))
    members = stored(keys.join(shared, ["t", "key"]), after=[shared])

    lists = members.where(F.col("size") <= SMALL).groupBy("t", "key").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("of")).select("of").distinct()
    first = lists.select("of", F.posexplode("of").alias("i", "x"))
    pairs = first.select("x", F.explode(F.slice("of", F.col("i") + 2, SMALL)).alias("y"))
    fits = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    pairs = pairs.where(fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b")).distinct()
    sketch = own.select("id", "registers")
    both = pairs.join(sketch.withColumnsRenamed({"id": "a", "registers": "r_a"}), "a").join(sketch.withColumnsRenamed({"id": "b", "registers": "r_b"}), "b")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                value = plausible_pairs(registers_of(batch.column("r_a")), registers_of(batch.column("r_b")), np.asarray(batch.column("n_a")), np.asarray(batch.column("n_b")), percent)
                good = pa.array(value >= 0)
                yield pa.record_batch([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])

    few = both.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(judge, "a long, b long")

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["t", "key", "p", "q"]):
            ids, n, side = (np.asarray(table.column(c)) for c in ("id", "n", "side"))
            registers = registers_of(table.column("registers"))
            cross = table.column("p")[0].as_py() != table.column("q")[0].as_py()
            value = np.full((len(ids), len(ids)), -1.0)
            i, j = np.triu_indices(len(ids), 1)
            if cross:
                i, j = i[side[i] != side[j]], j[side[i] != side[j]]
            fits = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            i, j = i[fits], j[fits]
            for k in range(0, len(i), 1 << 13):
                x, y = i[k : k + (1 << 13)], j[k : k + (1 << 13)]
                value[x, y] = value[y, x] = plausible_pairs(registers[x], registers[y], n[x], n[y], percent)
            yield pa.record_batch([pa.array(x) for x in greatest_forest(ids, value)], names=["a", "b"])

    parts = F.ceil(F.col("size") / SKETCH_BLOCK).cast("long")
    dealt = members.where(F.col("size") > SMALL).join(sketch, "id")
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("id"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    dealt = dealt.select("t", "key", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"), "side", "id", "n", "registers")
    many = dealt.repartition(tasks(dealt), "t", "key", "p", "q").sortWithinPartitions("t", "key", "p", "q").mapInArrow(span, "a long, b long")
    return few.union(many).distinct()


def greatest_forest(ids: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of a greatest spanning forest over pairs with a value of 0 or more."""
    a: list[int] = []
    b: list[int] = []
    out = np.ones(len(ids), dtype=bool)
    best, source = np.full(len(ids), -1.0), np.zeros(len(ids), dtype=np.int64)
    for _ in range(len(ids)):
        i = int(np.where(out, best, -2.0).argmax())
        if best[i] >= 0:
            a.append(int(ids[source[i]]))
            b.append(int(ids[i]))
        out[i] = False
        closer = value[i] > best
        best, source = np.where(closer, value[i], best), np.where(closer, i, source)
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def overlaps(x: frozenset[int], y: frozenset[int], percent: int) -> bool:
    common = len(x & y)
    return common > 0 and 100 * common >= percent * (len(x) + len(y) - common)


def sets_of(table: pa.Table, words: int) -> list[frozenset[int]]:
    elements, at = shingles(table.column("text").combine_chunks(), words)
    return [frozenset(elements[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]


def linked_to_first(members: DataFrame, percent: int, words: int) -> DataFrame:
    """Links ``a, b`` of the first of each group (its id is the group's) with others in ``members(group, size, id, text)``."""
    parts = F.ceil(F.col("size") / SET_BLOCK).cast("long")
    first = members.where("id = group").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    dealt = members.where("id <> group").withColumn("part", F.pmod(F.xxhash64("id"), parts)).union(first).select("group", "part", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["group", "part"]):
            ids, sets = np.asarray(table.column("id")), sets_of(table, words)
            hub = int(np.flatnonzero(ids == table.column("group")[0].as_py())[0])
            good = [i for i in range(len(ids)) if i != hub and overlaps(sets[hub], sets[i], percent)]
            yield pa.record_batch([pa.array(np.full(len(good), ids[hub])), pa.array(ids[good])], names=["a", "b"])

    return dealt.repartition(tasks(dealt), "group", "part").sortWithinPartitions("group", "part").mapInArrow(run, "a long, b long")


def confirmed(members: DataFrame, percent: int, words: int) -> DataFrame:
    """Links ``a, b`` confirmed on full sets that connect what is connected in ``members(group, open, size, id, text, free)``.

    ``free`` tells members that aren't known to be connected with the group's first; ``open`` counts these, ``size`` all.
    Blocks of free members meet one another and those of the others.
    """
    parts, others = F.ceil(F.col("open") / SET_BLOCK).cast("long"), F.ceil((F.col("size") - F.col("open")) / SET_BLOCK).cast("long")
    side = F.when(F.col("free"), F.pmod(F.xxhash64("id"), parts)).otherwise(parts + F.pmod(F.xxhash64("id"), F.greatest(others, F.lit(1))))
    last = F.when(F.col("free"), parts + others).otherwise(parts) - 1
    dealt = members.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    dealt = dealt.select("group", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"), "side", "id", "free", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["group", "p", "q"]):
            ids, side, free = (np.asarray(table.column(c)) for c in ("id", "side", "free"))
            sets = sets_of(table, words)
            sizes = np.array([len(x) for x in sets])
            cross = table.column("p")[0].as_py() != table.column("q")[0].as_py()
            label = np.where(free, np.arange(len(ids)), -1)  # the others are connected already
            a: list[int] = []
            b: list[int] = []
            for i in range(len(ids)):
                open_ = label != label[i]
                open_[: i + 1] = False
                if cross:
                    open_ &= side != side[i]
                open_ &= 100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])
                for j in np.flatnonzero(open_).tolist():
                    if label[i] != label[j] and overlaps(sets[i], sets[j], percent):
                        label[label == label[j]] = label[i]
                        a.append(int(ids[i]))
                        b.append(int(ids[j]))
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.repartition(tasks(dealt), "group", "p", "q").sortWithinPartitions("group", "p", "q").mapInArrow(run, "a long, b long")


def deduplicate(docs: DataFrame, percent: int = 75, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, n_shingles, component_id, kept``.

    Documents link if 100 * shared >= percent * all of their shingles. A text that is null or has no words has no
    shingles and links with nothing; one with fewer words than a shingle is one shingle. Rows that share an id are one
    document in the graph, with the links of all their texts, and are all returned; a null id is a component of its own
    that is kept. An empty table gives an empty one; other columns don't matter.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    every = stored(sketched(slim, words))
    some = every.where(F.col("n") > 0).where(F.col("id").isNotNull())
    # a class goes by a number of its own, since an id may have several texts
    kind = stored(some.groupBy("digest").agg(F.min_by(F.struct("id", "mark", "n", "registers", "keys"), "id").alias("x")).select("digest", "x.*").withColumn("node", F.monotonically_increasing_id()))
    near = stored(candidates(kind.select(F.col("node").alias("id"), "n", "registers", "keys"), percent))
    grouped = stored(components(near))
    sizes = grouped.groupBy("component_id").agg(F.count("*").alias("size"))
    inside = grouped.join(sizes, "component_id").join(kind, grouped["id"] == kind["node"]).select(F.col("component_id").alias("group"), "size", "node", kind["id"].alias("rep"), F.col("mark").alias("of_mark"))
    # texts are shuffled at every size
    members = slim.join(inside.hint("shuffle_hash"), (F.col("id") == F.col("rep")) & (F.xxhash64("text") == F.col("of_mark"))).select("group", "size", F.col("node").alias("id"), "text")
    several = stored(some.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id"))
    repeats = bool(several.head(1))
    members = stored(members.dropDuplicates(["id"]) if repeats else members)
    large = members.where(F.col("size") > SET_BLOCK)
    first = stored(linked_to_first(large, percent, words))
    known = first.select(F.col("b").alias("known"))
    judged = large.join(known, F.col("id") == F.col("known"), "left").select("group", "size", "id", "text", (F.col("known").isNull() & (F.col("id") != F.col("group"))).alias("free"))
    open_ = judged.where("free").groupBy("group").agg(F.count("*").alias("open"))
    rest = judged.join(open_, "group").select("group", "open", "size", "id", "text", "free")
    small = members.where(F.col("size") <= SET_BLOCK).select("group", F.col("size").alias("open"), "size", "id", "text", F.lit(True).alias("free"))
    links = stored(first.union(confirmed(small.union(rest), percent, words)), after=[members])
    if repeats:
        of_id = some.join(several, "id").select("id", "digest").join(kind.select("digest", "node"), "digest").select("id", "node").distinct()
        links = links.union(of_id.join(of_id.groupBy("id").agg(F.min("node").alias("a")), "id").select("a", F.col("node").alias("b")))
    linked = stored(components(links))
    smallest = linked.join(kind.select("node", F.col("id").alias("rep")), F.col("id") == F.col("node")).groupBy("component_id").agg(F.min("rep").alias("smallest"))
    of_node = linked.join(smallest, "component_id").select(F.col("id").alias("of_node"), "smallest")
    of_kind = stored(kind.join(of_node, F.col("node") == F.col("of_node"), "left").select(F.col("digest").alias("of_digest"), F.coalesce("smallest", "id").alias("smallest")))
    out = every.select("id", "n", "digest").join(of_kind, F.col("digest") == F.col("of_digest"), "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("smallest", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
