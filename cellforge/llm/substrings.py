"""Removal of long repeated substrings, exact to the byte.

A byte goes if it is covered by a string of ``size`` bytes that also starts in a document with a smaller id.

Of every ``size`` bytes the k-gram with the least hash is the anchor, so equal strings have equal anchors at equal
places, and strings that follow one another share theirs: such a run of strings is a piece, and every string lies in
just one. Documents are dealt into blocks by id. Blocks send the hashes of their anchors, and nothing else, to buckets,
which answer which of them occur elsewhere; only pieces of such anchors are sent on. In a bucket equal pieces, compared
byte by byte, become one, and where an anchor has several, a suffix array finds the strings that they share: the
Burrows-Wheeler order of all pieces is refined breadth first. A cut between two neighbours of the order at common prefix
l is extended backward by one character to a cut at l + 1; after ``size`` - 1 rounds, what is not cut apart shares
``size`` bytes. Buckets answer to blocks, which cut their documents.

What a block has several times it sends once. An anchor of very many blocks would still bring too many different pieces
to one bucket: its strings are sent one by one, to buckets by their own hash, where only equal ones meet. So no task
holds more than a block, a bucket of about as many bytes, or one hash for each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import gathered, mixed, stored

SIZE = 50
GRAM = 24
#: Bytes of documents in a block, and of documents whose anchors one bucket gets.
BLOCK, BUCKET = 1 << 22, 1 << 23
#: Bytes of pieces whose suffixes are ordered at once; all pieces of an anchor stay together.
ORDERED = 1 << 18
#: Blocks from which on an anchor's strings are sent one by one.
COMMON = 4096

_PLACE = np.random.default_rng(8).integers(0, 1 << 63, size=8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def octets(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as an integer (zeros beyond the end)."""
    w = np.zeros(len(data) + 8, dtype=np.uint64)
    w[: len(data)] = data
    for shift in (1, 2, 4):
        w[:-shift] |= w[shift:] << np.uint64(8 * shift)
    return w


def string_hashes(w: np.ndarray, at: np.ndarray | slice, size: int, n: int) -> np.ndarray:
    """Hashes of the ``size`` bytes from places ``at`` on, of ``n`` bytes whose octets are ``w``. They only bring equals together."""
    total = np.zeros(n if isinstance(at, slice) else len(at), dtype=np.uint64)
    w = np.append(w, np.zeros(max(0, n + size - len(w)), dtype=np.uint64))
    for i, k in enumerate([*range(0, size - 8, 8), size - 8]):
        part = w[k : k + n][at]
        total += (part ^ (part >> np.uint64(29))) * _PLACE[i % 8] + np.uint64(i)
    return mixed(total)


def anchors(data: np.ndarray, at: np.ndarray, size: int = SIZE, gram: int = GRAM, chunk: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, number of strings, hash of the anchor) of the pieces of documents ``data[at[i]:at[i + 1]]``."""
    if not 8 <= gram <= size:
        raise ValueError("grams have 8 bytes or more, and no more than the strings")
    span = size - gram + 1
    starts = np.ones(len(data), dtype=bool)  # where a string of ``size`` bytes of one document starts
    for k in range(1, size):
        tail = at[1:] - k
        starts[tail[tail >= at[:-1]]] = False
    first, index, hashes = [[np.zeros(0, dtype=t)] for t in (np.int64, np.int64, np.uint64)]
    low = np.uint64((1 << 25) - 1)
    count, last_start, last_place = 0, -2, -1
    for base in range(0, len(data), chunk):  # of a size that stays in the processor's cache
        part = data[base : base + chunk + size - 1]
        n = len(part)
        h = string_hashes(octets(part), slice(None), gram, n)
        least = (h & ~low) | np.arange(n, dtype=np.uint64)  # the place below the hash: of equal grams the first is least
        reach = 1
        while reach < span:
            step = min(reach, span - reach)
            if step < n:
                least[: n - step] = np.minimum(least[: n - step], least[step:])
            reach += step
        start = np.flatnonzero(starts[base : base + chunk])
        if not len(start):
            continue
        place = (least[start] & low).astype(np.int64)
        new = np.ones(len(start), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
        new[0] = base + start[0] != last_start + 1 or base + place[0] != last_place
        head = np.flatnonzero(new)
        first.append(base + start[head])
        index.append(count + head)
        hashes.append(h[place[head]])
        count, last_start, last_place = count + len(start), base + int(start[-1]), base + int(place[-1])
    start, head, h = np.concatenate(first), np.concatenate(index), np.concatenate(hashes)
    return start, np.diff(np.append(head, count)), mixed(h + np.uint64(1))  # mixed again: the least of several aren't uniform


class Block:
    """The documents of a block in order of their ids. Ids whose rows have different texts are not compared."""

    def __init__(self, table: pa.Table) -> None:
        table = table.select(["id", "text"]).sort_by([("id", "ascending"), ("text", "ascending")])
        self.ids = np.asarray(table.column("id"))
        texts = table.column("text").combine_chunks()
        self.data, self.at = bpe.string_bytes(texts)
        n = len(self.ids)
        again = np.flatnonzero(self.ids[1:] == self.ids[:-1])
        unclear = [self.ids[i] for i in again.tolist() if texts[i].as_py() != texts[i + 1].as_py()]
        self.compared = ~np.isin(self.ids, np.array(unclear, dtype=np.int64)) if n else np.zeros(0, dtype=bool)

    def pieces(self, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``anchors``, and the row of the document."""
        start, count, h = anchors(self.data, self.at, size, gram)
        row = np.searchsorted(self.at, start, side="right") - 1
        some = self.compared[row]
        return start[some], count[some], h[some], row[some]


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by ranges of hashes."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def distinct_hashes(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes in order, and whether each is in several rows, which come in order."""
    order = np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, dtype=np.int64)
    other = np.zeros(len(h), dtype=np.int64)
    other[1:] = (h[1:] == h[:-1]) & (row[1:] != row[:-1])
    return h[head], np.add.reduceat(other, head) > 0 if len(h) else np.zeros(0, dtype=bool)


def cuts(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of equal values of a sorted array: values, begins, ends."""
    if not len(buckets):
        return buckets, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    head = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
    return buckets[head], head, np.append(head[1:], len(buckets))


CODE = 5  # bytes of a hash within a bucket, the lowest bit telling of several documents


def sent_hashes(docs: DataFrame, size: int, gram: int, buckets: int) -> DataFrame:
    """``bucket, block, codes``: the different anchors of a block."""

    def run(table: pa.Table) -> pa.Table:
        block = Block(table)
        _, _, h, row = block.pieces(size, gram)
        h, several = distinct_hashes(h, row)
        codes = ((h << np.uint64(1) | several) & np.uint64((1 << 8 * CODE) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CODE]
        which, a, b = cuts(bucket_of(h, buckets))
        blobs = [codes[i:j].tobytes() for i, j in zip(a, b, strict=True)]
        own = table.column("block")[0].as_py()
        return pa.table({"bucket": pa.array(which), "block": pa.array(np.full(len(which), own)), "codes": pa.array(blobs, pa.binary())})

    return docs.groupBy("block").applyInArrow(run, "bucket long, block long, codes binary")


def met_hashes(sent: DataFrame, common: int) -> DataFrame:
    """``block, bucket, marks``: for each hash sent 0 if it is in one document only, 2 if in very many blocks, else 1."""

    def run(table: pa.Table) -> pa.Table:
        blobs = table.column("codes").to_pylist()
        sizes = np.array([len(x) // CODE for x in blobs])
        wide = np.zeros((int(sizes.sum()), 8), dtype=np.uint8)
        wide[:, :CODE] = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, CODE)
        code = wide.view("<u8")[:, 0]
        order = np.argsort(code)
        ordered = code[order] >> np.uint64(1)
        _, a, b = cuts(ordered)
        several = np.maximum.reduceat(code[order] & np.uint64(1), a) > 0
        marks = np.empty(len(code), dtype=np.uint8)
        marks[order] = np.repeat(np.where(b - a >= common, 2, (b - a > 1) | several).astype(np.uint8), b - a)
        ends = np.cumsum(sizes)
        out = [marks[j - n : j].tobytes() for j, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        some = np.array([any(x) for x in out])
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "marks": pa.array(out, pa.binary())}).filter(pa.array(some))

    return sent.groupBy("bucket").applyInArrow(run, "block long, bucket long, marks binary")


def lists(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """List rows ``values[begin[i]:end[i]]`` that follow one another."""
    offsets = np.append(begin, end[-1:]) if len(begin) else np.zeros(1, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int64)))


SENT = "bucket long, block long, h array<long>, id array<long>, length array<long>, copies array<long>, place array<long>, bytes binary"


def sent_pieces(docs: DataFrame, marks: DataFrame, size: int, gram: int, buckets: int) -> DataFrame:
    """Pieces of the anchors marked, by bucket: each different one of a block once, with its least id and places there.

    Rows with a negative bucket tell places and lengths of pieces that repeat an earlier document of the same block.
    """

    def run(table: pa.Table, noted: pa.Table) -> pa.Table:
        block = Block(table)
        start, count, h, row = block.pieces(size, gram)
        known, _ = distinct_hashes(h, row)
        which, a, b = cuts(bucket_of(known, buckets))
        mark = np.zeros(len(known), dtype=np.uint8)
        at = {k: (i, j) for k, i, j in zip(which.tolist(), a.tolist(), b.tolist(), strict=True)}
        for k, m in zip(noted.column("bucket").to_pylist(), noted.column("marks").to_pylist(), strict=True):
            i, j = at[k]
            mark[i:j] = np.frombuffer(m, dtype=np.uint8)
        mark = mark[np.searchsorted(known, h)]
        own = table.column("block")[0].as_py() if len(table) else 0
        whole, single = np.flatnonzero(mark == 1), np.flatnonzero(mark == 2)
        each = np.repeat(single, count[single])
        shift = np.arange(len(each)) - np.repeat(np.cumsum(count[single]) - count[single], count[single])
        begin = np.concatenate((start[whole], start[each] + shift))
        length = np.concatenate((count[whole], np.ones(len(each), dtype=np.int64))) + size - 1
        row = np.concatenate((row[whole], row[each]))
        h = np.concatenate((h[whole], string_hashes(octets(block.data), start[each] + shift, size, len(block.data)) if len(each) else h[:0]))
        raw = block.data.tobytes()
        coded = pa.array([raw[i:j] for i, j in zip(begin.tolist(), (begin + length).tolist(), strict=True)], pa.binary()).dictionary_encode()
        code, n = np.asarray(coded.indices), len(coded.dictionary)
        order = np.argsort(code, kind="stable")  # of equal pieces the rows, and with them the ids, are in order
        _, a, b = cuts(code[order])
        ids = block.ids[row[order]]
        least = np.repeat(ids[a], b - a)
        later = order[ids > least]
        mine = order[ids == least]
        first = order[a]  # of each piece, in order of codes
        by_bucket = np.argsort(bucket_of(h[first], buckets), kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[by_bucket] = np.arange(n)
        mine = mine[np.argsort(rank[code[mine]], kind="stable")]
        copies = np.bincount(rank[code[mine]], minlength=n)
        places = np.concatenate(([0], np.cumsum(copies)))
        first = first[by_bucket]
        which, a, b = cuts(bucket_of(h[first], buckets))
        joined = [b"".join([raw[x:y] for x, y in zip(begin[first[i:j]].tolist(), (begin + length)[first[i:j]].tolist(), strict=True)]) for i, j in zip(a, b, strict=True)]
        columns = [pa.array(which), pa.array(np.full(len(which), own)), lists(h[first].view(np.int64), a, b), lists(block.ids[row[first]], a, b), lists(length[first], a, b), lists(copies, a, b), lists(begin[mine], places[a], places[b]), pa.array(joined, pa.binary())]
        names = ["bucket", "block", "h", "id", "length", "copies", "place", "bytes"]
        out = pa.table(dict(zip(names, columns, strict=True)))
        if not len(later):
            return out
        none, one = pa.array([[]], pa.list_(pa.int64())), np.zeros(1, dtype=np.int64)
        local = [pa.array([-1 - own]), pa.array([own]), none, none, lists(length[later], one, one + len(later)), none, lists(begin[later], one, one + len(later)), pa.array([b""], pa.binary())]
        return pa.concat_tables([out, pa.table(dict(zip(names, local, strict=True)))])

    return docs.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(run, SENT)


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes in order of their first ``depth`` symbols (0 to 256) at least, by prefix doubling."""
    n = len(symbols)
    occurs = np.bincount(symbols, minlength=1) > 0
    base = int(occurs.sum()) + 1
    codes = np.append((np.cumsum(occurs))[symbols], np.zeros(64, dtype=np.int64))  # 0 stands for the end
    key, reach = codes[:n].copy(), 1
    while base ** (reach + 1) < 1 << 63 and reach < 64:
        key *= base
        key += codes[reach : reach + n]
        reach += 1
    while True:
        order = np.argsort(key)
        if reach >= depth:
            return order
        ordered = key[order]
        ranks = np.empty(n, dtype=np.int64)
        ranks[0] = 1
        np.cumsum(ordered[1:] != ordered[:-1], out=ranks[1:])
        ranks[1:] += 1
        if ranks[-1] == n:
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = ranks
        key, one = rank.copy(), reach
        for k in (1, 2):  # as many ranks as an integer has room for
            if (n + 1) ** (k + 1) < 1 << 63 and reach < depth:
                key *= n + 1
                key[: max(0, n - k * one)] += rank[k * one :]
                reach += one


def least_ids(data: np.ndarray, lengths: np.ndarray, ids: np.ndarray, size: int = SIZE) -> np.ndarray:
    """For each string of ``size`` bytes of parts of ``lengths`` in ``data``, in order: the least id of a part that has it."""
    starts = np.cumsum(lengths + 1) - lengths - 1
    symbols = np.zeros(int((lengths + 1).sum()), dtype=np.int16)  # 0 ends each part
    inside = np.ones(len(symbols), dtype=bool)
    inside[starts + lengths] = False
    symbols[inside] = data.astype(np.int16) + 1
    n = len(symbols)
    order = suffix_order(symbols, size)
    rank = np.empty(n + 1, dtype=np.int64)
    rank[order] = np.arange(n)
    rank[n] = 0
    behind = rank[order + 1].astype(np.int32)  # where the order has the suffix one character shorter
    ahead = rank[order - 1].astype(np.int32)  # and the one a character longer, by which backward extension goes
    ahead[order == 0] = 0
    cut = np.ones(n, dtype=bool)
    first = symbols[order]
    cut[1:] = first[1:] != first[:-1]
    follows = np.zeros(n, dtype=bool)  # the neighbours come from neighbours: a cut there becomes the cut here
    follows[1:] = behind[1:] == behind[:-1] + 1
    whole = np.flatnonzero(~cut & ~follows)  # the others come from an interval: any cut in it becomes the cut here
    low, high = np.minimum(behind[whole - 1], behind[whole]), np.maximum(behind[whole - 1], behind[whole])
    fresh = np.flatnonzero(cut)
    for _ in range(1, size):  # cuts at common prefix l become cuts at l + 1
        reached = ahead[fresh]
        reached = reached[follows[reached] & ~cut[reached]]
        if len(whole):
            passed = np.cumsum(cut, dtype=np.int32)
            apart = passed[high] > passed[low]
            fresh = np.concatenate((reached, whole[apart]))
            whole, low, high = whole[~apart], low[~apart], high[~apart]
        else:
            fresh = reached
        if not len(fresh):
            break
        cut[fresh] = True
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)
    fits = (starts + lengths)[owner] - np.arange(n) >= size
    of = np.where(fits, ids[owner], np.iinfo(np.int64).max)[order]
    heads = np.flatnonzero(cut)
    least = np.empty(n, dtype=np.int64)
    least[order] = np.repeat(np.minimum.reduceat(of, heads), np.diff(np.append(heads, n)))
    return least[fits]


def solved(data: np.ndarray, lengths: np.ndarray, h: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string of each different piece the least id that has it, and offsets of each piece's strings."""
    strings = np.concatenate(([0], np.cumsum(lengths - size + 1)))
    at = np.concatenate(([0], np.cumsum(lengths)))
    least = np.repeat(ids, lengths - size + 1)
    order = np.argsort(h, kind="stable")
    _, a, b = cuts(h[order])
    open_ = np.repeat(b - a > 1, b - a)  # an anchor's only piece has no string of another piece
    order = order[open_]
    begins = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1]))) if len(order) else np.zeros(0, dtype=np.int64)
    reach = np.concatenate(([0], np.cumsum(lengths[order])))
    i = 0
    while i < len(order):
        far = begins[np.searchsorted(reach[begins], reach[i] + ORDERED, side="right") :]
        far = far[far > i]
        j = int(far[0]) if len(far) else len(order)
        some = order[i:j]
        found = least_ids(gathered(data, at, some)[0], lengths[some], ids[some], size)
        places = gathered(np.arange(strings[-1]), strings, some)[0]
        least[places] = found
        i = j
    return least, strings


def flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = table.column(name).combine_chunks()
    return np.asarray(column.flatten()), np.diff(np.asarray(column.offsets))


def answered(sent: DataFrame, size: int) -> DataFrame:
    """``block, begin, end``: intervals of blocks that repeat earlier documents."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            place, counts = flat(table, "place")
            begin, end = place, place + flat(table, "length")[0]
            of = np.repeat(np.asarray(table.column("block")), counts)
        else:
            h, counts = flat(table, "h")
            ids, lengths, copies, place = (flat(table, c)[0] for c in ("id", "length", "copies", "place"))
            block = np.repeat(np.asarray(table.column("block")), counts)
            raw = b"".join(table.column("bytes").to_pylist())
            ends = np.cumsum(lengths)
            coded = pa.array([raw[i:j] for i, j in zip((ends - lengths).tolist(), ends.tolist(), strict=True)], pa.binary()).dictionary_encode()
            code, n = np.asarray(coded.indices), len(coded.dictionary)
            order = np.lexsort((ids, code))
            _, a, _ = cuts(code[order])
            first = order[a]  # of each different piece, that with the least id
            data = np.frombuffer(b"".join(coded.dictionary.to_pylist()), dtype=np.uint8)
            least, strings = solved(data, lengths[first], h[first], ids[first], size)
            found, at = gathered(least, strings, code)
            piece = np.repeat(np.arange(len(code)), np.diff(at))
            gone = found < ids[piece]
            head = gone.copy()
            head[1:] &= ~(gone[:-1] & (piece[1:] == piece[:-1]))
            tail = gone.copy()
            tail[:-1] &= ~(gone[1:] & (piece[1:] == piece[:-1]))
            head, tail = np.flatnonzero(head), np.flatnonzero(tail)
            of_run = piece[head]
            from_, to = head - at[of_run], tail - at[of_run] + size
            offsets = np.concatenate(([0], np.cumsum(copies)))
            base, at = gathered(place, offsets, of_run)
            again = np.repeat(np.arange(len(of_run)), np.diff(at))
            begin, end, of = base + from_[again], base + to[again], block[of_run][again]
        order = np.argsort(of, kind="stable")
        which, a, b = cuts(of[order])
        return pa.table({"block": pa.array(which, pa.int64()), "begin": lists(begin[order], a, b), "end": lists(end[order], a, b)})

    return sent.groupBy("bucket").applyInArrow(run, "block long, begin array<long>, end array<long>")


def cleaned(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """``id, n_bytes, runs, kept`` of every document of ``docs(block, id, text)``."""

    def run(table: pa.Table, noted: pa.Table) -> pa.Table:
        block = Block(table)
        change = np.zeros(len(block.data) + 1, dtype=np.int32)
        np.add.at(change, flat(noted, "begin")[0], 1)
        np.add.at(change, flat(noted, "end")[0], -1)
        gone = (np.cumsum(change[:-1]) > 0).astype(np.int8)
        edge = np.diff(gone, prepend=np.int8(0))
        edge[block.at[:-1][block.at[:-1] < len(gone)]] = 0
        starts = block.at[:-1][block.at[:-1] < block.at[1:]]  # where a document begins a run may begin, and one before it ends
        begin = np.union1d(np.flatnonzero(edge > 0), starts[gone[starts] > 0])
        last = starts[starts > 0]
        end = np.union1d(np.flatnonzero(edge < 0), last[gone[last - 1] > 0])
        if len(gone) and gone[-1]:
            end = np.append(end, len(gone))
        doc = np.searchsorted(block.at, begin, side="right") - 1
        offsets = np.searchsorted(doc, np.arange(len(block.ids) + 1))
        runs = pa.StructArray.from_arrays([pa.array(begin - block.at[doc]), pa.array(end - block.at[doc])], names=["start", "end"])
        left = block.data[gone == 0].tobytes()
        stay = np.concatenate(([0], np.cumsum(gone == 0)))[block.at]
        kept = [left[i:j] for i, j in zip(stay[:-1].tolist(), stay[1:].tolist(), strict=True)]
        return pa.table({"id": pa.array(block.ids), "n_bytes": pa.array(np.diff(block.at)), "runs": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), runs), "kept": pa.array(kept, pa.binary())})

    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "id long, n_bytes long, runs array<struct<start:long,end:long>>, kept binary")


def strip(docs: DataFrame, size: int = SIZE, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, bucket: int = BUCKET, common: int = COMMON) -> DataFrame:
    """``doc_id, n_bytes, runs, kept``: each text's length, the maximal runs of bytes removed, and the bytes that stay.

    A null text is empty. A null id is before and after nothing: such a document stays whole, and so do documents that
    share an id but not the text; equal rows are one document and get equal results. Texts of fewer than ``size`` bytes
    lose nothing. An empty table gives an empty one; other columns don't matter.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = -(-total // block) or 1, -(-total // bucket) or 1
    dealt = slim.where("id IS NOT NULL").select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "id", "text")
    marks = stored(met_hashes(sent_hashes(dealt, size, gram, buckets), common))
    answers = stored(answered(sent_pieces(dealt, marks, size, gram, buckets), size), after=[marks])
    nothing = F.array().cast("array<struct<start:long,end:long>>")
    unnamed = slim.where("id IS NULL").select("id", F.octet_length("text").cast("long").alias("n_bytes"), nothing.alias("runs"), F.encode("text", "UTF-8").alias("kept"))
    return cleaned(dealt, answers).union(unnamed).withColumnRenamed("id", "doc_id")


def digest(docs: DataFrame) -> DataFrame:
    """One row a document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    total = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return strip(docs).select("doc_id", "n_bytes", total.alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
