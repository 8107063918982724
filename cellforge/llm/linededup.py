"""Near-duplicate lines: segment-partition edit join.

Two lines within ``threshold`` edits share one of threshold + 1 segments of the shorter, at nearly the same place. Every
distinct line is split into such segments; the substrings where a longer line could hold a shorter one's segment are
probed, by length and place. Lines that meet under a key are verified by a banded bit-parallel edit distance.

Without a fixed threshold the edits allowed grow with the shorter line (``allowed``). Segments of lines of ``SPAN``
characters or more would be probed too often at that many edits: such lines meet by minimizers instead. The longest run
of characters that the edits leave alone has a guaranteed length, and equal runs of that length have an equal minimizer
at nearly the same place, so nothing is missed. Keys are made in rounds by the shorter line's length, to bound the disk.
Keys of shorter lines are made from lines that were stored once a task, the longest lines' from the documents. Rows of
keys carry the line's length, the place and counts of its characters: most lines that meet by chance are told apart by
these, before any text is fetched. Places of lines, keys and pairs go through Spark as arrays, each for a part of the hashes.

A line occurrence is removed if an equal or linked line occurs earlier (by document id, then place); lines of fewer than
``min_chars`` characters allow no edits, and unless ``short`` is set aren't compared at all. Equal lines are combined before anything else. Keys with many
lines are dealt in blocks, whose tasks return the lines that have an earlier neighbour, so nothing grows with pairs.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import bpe
from .common import groups, mixed, stored, tasks

THRESHOLD = 1
MIN_CHARS = 20
#: Edits allowed by length: a tenth of the shorter line, at least and at most these.
LEAST_EDITS, MOST_EDITS = 2, 8
#: Shorter lines from this length on meet by minimizers; rounds of keys begin at these lengths of the shorter line.
SPAN = 112
ROUNDS = (0, SPAN, 218)
#: Classes of the shorter line's length below; all of a class allow as many edits.
CLASSES = (3, 6, 12, 20, 30, 40, 50, 60, 70, 80, 96, SPAN)
#: Of lines from this length on only the beginning makes keys, of as many characters and those that edits can add.
BEGINNING = 425
#: Minimizers meet within buckets of this many places.
PLACES = 64
#: Under one key, pairs are listed up to half of this for each line; and lines of a block beyond.
SMALL, BLOCK = 16, 256
#: Pairs of similar length for each line under a key up to which marks are compared, and pairs that are compared at once.
TRIED, PAIRS = 4096, 1 << 18
#: Rows of keys that a task holds before it hands them on, and sorted rows whose pairs are listed at once.
HELD, MEETING = 1 << 18, 1 << 15
#: Bits of a mark: counts of characters by group, modulo 16; the length; the place; whether the key is the line's own; and
#: whether only the beginning's characters are counted.
GROUPS, LENGTH_BITS, PLACE_BITS = 10, 15, 7
#: Lines that a task has met and leaves out when they come again.
SEEN = 1 << 18
#: Characters of one side of the pairs that are verified at once.
CELLS = 1 << 18
#: Bytes of text whose substrings are hashed at once; the arrays take some fifty times that.
KEY_BYTES = 1 << 20


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Substrings:
    """Hashes of substrings of an array of characters, each in constant time."""

    def __init__(self, codes: np.ndarray) -> None:
        size = 1 << max(10, int(len(codes)).bit_length())
        self.power, self.inverse = powers(size)
        self.prefix = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(1)) * self.power[: len(codes)], out=self.prefix[1:])

    def of(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[start + size] - self.prefix[start]) * self.inverse[start])


def segment(length: np.ndarray, i: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i of threshold + 1 even ones; the longer ones come last."""
    count = threshold + 1
    size, longer = length // count, length % count
    shift = np.maximum(0, i - (count - longer))
    return i * size + shift, size + (i >= count - longer)


def allowed(length: np.ndarray, threshold: int | None) -> np.ndarray:
    """Edits allowed to pairs whose shorter line has this length."""
    return np.clip(length // 10, LEAST_EDITS, MOST_EDITS) if threshold is None else np.full(len(length), threshold)


def most(threshold: int | None) -> int:
    return MOST_EDITS if threshold is None else threshold


def rounds(threshold: int | None) -> list[tuple[int, int]]:
    """Ranges of the shorter line's length whose keys are made together."""
    return list(zip(ROUNDS, (*ROUNDS[1:], 1 << 40), strict=True)) if threshold is None else [(0, 1 << 40)]


def keys_by_length(codes: np.ndarray, start: np.ndarray, length: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(lines, keys, places, indexed) for pairs whose shorter line has ``low`` to ``high - 1`` characters and allows edits
    by its length; lines just beyond a class have its keys also."""
    for _, found in keys_by_class(codes, start, length, low, high):
        yield found


def keys_by_class(codes: np.ndarray, start: np.ndarray, length: np.ndarray, low: int, high: int) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """The least length of each class, and its keys."""
    for a, b in zip(CLASSES, CLASSES[1:], strict=False):
        lines = np.flatnonzero((length >= a) & (length < b + most_edits(b - 1))) if max(a, low) < min(b, high) else np.zeros(0, dtype=np.int64)
        if (length[lines] < b).any():
            yield a, grid_keys(codes, start, length, lines, a, b)
    a, longest = SPAN, int(length.max(initial=0))
    while a < min(high, longest + 1):
        b = a + a // 4 if a < BEGINNING else 1 << 40
        if a < low < b:
            raise ValueError("a round begins within a class of lengths")
        lines = np.flatnonzero((length >= a) & (length < b + MOST_EDITS)) if a >= low else np.zeros(0, dtype=np.int64)
        if (length[lines] < b).any():
            yield a, minimizer_keys(codes, start, np.minimum(length, a + MOST_EDITS) if a >= BEGINNING else length, lines, a)
        a = b


def most_edits(length: int) -> int:
    return int(allowed(np.array([length]), None)[0])


@lru_cache(maxsize=64)
def probes(edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and shift of the substrings in which a longer line can hold a segment of a shorter one.

    Of one segment more than edits, take the first up to which there are no more edits than segments before it: it is
    whole, as many edits as its number come before it, and those left make up the rest of the difference in length.
    """
    found = [(i, shift) for i in range(edits + 1) for shift in range(-min(i, edits - i), i + 1)]
    return np.array([x for x, _ in found]), np.array([x for _, x in found])


def grid_keys(codes: np.ndarray, start: np.ndarray, length: np.ndarray, lines: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a class of lines, of ``a`` to ``b - 1`` characters: segments at places that don't depend on the length, so
    that one probe finds them in shorter lines of any length."""
    edits = most_edits(b - 1)
    segments, shifts = probes(edits)
    size = a // (edits + 1)
    at, own = segments * size + shifts, shifts == 0
    chars, first = packed(codes, start, length, lines)
    gram = grams(chars, size)
    line, probe = np.nonzero((at[None, :] + size <= length[lines][:, None]) & (own[None, :] | (length[lines] > a)[:, None]))
    key = mixed(gram[first[line] + at[probe]] ^ mixed((segments + 4096 * a + (1 << 40)).astype(np.uint64))[probe]).view(np.int64)
    return lines[line], key, at[probe], own[probe] & (length[lines] < b)[line]


def packed(codes: np.ndarray, start: np.ndarray, length: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of these lines alone, up to these lengths, and where each begins."""
    first = np.cumsum(length[lines]) - length[lines]
    total = int(length[lines].sum())
    if len(lines) and (start[lines] - first == start[lines[0]]).all():  # they lie side by side
        return codes[start[lines[0]] : start[lines[0]] + total], first
    at = np.arange(total)
    at += np.repeat(start[lines] - first, length[lines])
    return codes[at], first


def grams(chars: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the substrings of this size at each place, whose upper bits are mixed best."""
    base = 0x9E3779B97F4A7C15
    step, width = characteristic()[chars & 0xFFFF], 1  # of substrings of width characters; out: of done characters
    out, done = None, 0
    while True:
        if size & width:
            if out is None:
                out = step
            else:
                out = out[: len(out) - width] * np.uint64(pow(base, width, 1 << 64))
                out += step[done : done + len(out)]
            done += width
        if done == size:
            return out
        longer = step[: len(step) - width] * np.uint64(pow(base, width, 1 << 64))
        longer += step[width:]
        step, width = longer, 2 * width


@lru_cache(maxsize=1)
def characteristic() -> np.ndarray:
    """A number for each character; those that agree in 16 bits share one, as keys only name candidates."""
    return mixed(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def minimizer_keys(codes: np.ndarray, start: np.ndarray, length: np.ndarray, lines: np.ndarray, a: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the minimizers of a class of lines, the shortest of which has ``a`` characters."""
    run = -(-(a - MOST_EDITS) // (MOST_EDITS + 1))  # characters in a row that no edit touches, at least
    size = min(12, 3 * run // 4)
    window = run - size + 1
    chars, first = packed(codes, start, length, lines)
    gram = grams(chars, size)
    within_line = np.arange(len(chars), dtype=np.int32)
    within_line -= np.repeat(first.astype(np.int32), length[lines])
    # the hash above the place, which is below 512: of equal hashes the first is least
    least = ((gram >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFFE00)) | within_line[: len(gram)].astype(np.uint32)
    width = 1
    while width < window:
        step = min(width, window - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    whole = within_line[run - 1 : run - 1 + len(least)] >= run - 1  # within one line
    new = np.append(True, least[1:] != least[:-1])
    new[1:] |= ~whole[:-1]
    windows = np.flatnonzero(whole & new)
    line = np.repeat(np.arange(len(lines)), np.diff(np.searchsorted(windows, np.append(first, len(chars)))))
    place = (least[windows] & np.uint32(511)).astype(np.int64)
    chosen = first[line] + place
    bucket = (place - MOST_EDITS // 2) // PLACES
    beyond = np.flatnonzero((place + MOST_EDITS // 2) // PLACES != bucket)
    at = np.append(np.arange(len(chosen)), beyond)
    bucket = np.append(bucket, bucket[beyond] + 1)
    key = mixed(gram[chosen[at]] ^ mixed((bucket * 4096 + a * (1 << 30)).astype(np.uint64))).view(np.int64)
    return lines[line[at]], key, place[at], np.ones(len(at), dtype=bool)


def line_keys(codes: np.ndarray, start: np.ndarray, length: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(lines, keys, places, indexed): keys of each line's own segments, then of the substrings it probes for shorter lines' ones."""
    sub = Substrings(codes)

    def key(of_length: np.ndarray, i: int, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mixed(sub.of(at, size) ^ mixed(of_length.astype(np.uint64) * np.uint64(64) + np.uint64(i))).view(np.int64)

    every = np.arange(len(length))
    for i in range(threshold + 1):
        at, size = segment(length, i, threshold)
        yield every, key(length, i, start + at, size), at, True
    for gap in range(threshold + 1):
        short = length - gap
        for i in range(threshold + 1):
            at, size = segment(short, i, threshold)
            for shift in range(max(-i, gap - (threshold - i)), min(i, gap + threshold - i) + 1):
                if gap == 0 and shift == 0:
                    continue  # that is the line's own segment
                can = (short > threshold) & (at + shift >= 0) & (at + shift + size <= length)
                yield np.flatnonzero(can), key(short[can], i, (start + at + shift)[can], size[can]), (at + shift)[can], False


@lru_cache(maxsize=1)
def lanes() -> tuple[np.ndarray, np.ndarray]:
    """For each character one in the lane of its group, of 12 bits; the groups of the lower half, and of the upper."""
    group = np.arange(1 << 16, dtype=np.uint64) % np.uint64(GROUPS)
    half = np.uint64(GROUPS // 2)
    lane = np.uint64(1) << (group % half * np.uint64(12))
    return np.where(group < half, lane, np.uint64(0)), np.where(group < half, np.uint64(0), lane)


def counts(codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How often each line has characters of each group, modulo 16, in four bits each."""
    out = np.zeros(len(length), dtype=np.uint64)
    some = np.flatnonzero(length)
    if length.max(initial=0) >> 12:  # a lane can't hold so many
        line = np.repeat(np.arange(len(length)), length)
        at = np.arange(len(line)) + np.repeat(start - (np.cumsum(length) - length), length)
        found = np.bincount(line * GROUPS + (codes[at] & 0xFFFF) % GROUPS, minlength=GROUPS * len(length)).reshape(-1, GROUPS)
        return ((found & 15).astype(np.uint64) << (np.arange(GROUPS, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)
    if not len(some):
        return out
    begin, end = int(start[some[0]]), int(start[some[-1]] + length[some[-1]])
    bounds = np.stack((start[some], start[some] + length[some]), axis=1).ravel() - begin
    low = np.append(codes[begin:end] & 0xFFFF, 0)  # the last bound lies beyond
    for k, table in enumerate(lanes()):
        sums = np.add.reduceat(table[low], bounds)[::2]
        for g in range(GROUPS // 2):
            out[some] |= (sums >> np.uint64(12 * g) & np.uint64(15)) << np.uint64(4 * (g + k * (GROUPS // 2)))
    return out


def marks(held: np.ndarray, length: np.ndarray, place: np.ndarray | int, own: np.ndarray | bool, begun: bool = False) -> np.ndarray:
    """What a row of a key tells of its line, in 64 bits."""
    at = 4 * GROUPS
    out = held.view(np.int64) | ((length & ((1 << LENGTH_BITS) - 1)) << at) | (np.asarray(place, dtype=np.int64) & ((1 << PLACE_BITS) - 1)) << (at + LENGTH_BITS)
    out |= np.asarray(own, dtype=np.int64) << (at + LENGTH_BITS + PLACE_BITS)
    return out | np.int64(-1 << 63) if begun else out


def mark_length(mark: np.ndarray) -> np.ndarray:
    return (mark >> (4 * GROUPS)) & ((1 << LENGTH_BITS) - 1)


def mark_own(mark: np.ndarray) -> np.ndarray:
    return (mark >> (4 * GROUPS + LENGTH_BITS + PLACE_BITS)) & 1 == 1


def may_link(a: np.ndarray, b: np.ndarray, threshold: int | None, long: bool) -> np.ndarray:
    """Which pairs of marks can be of lines within the edits allowed that agree at these places; ``long``: of lines whose
    length may be beyond its field.

    Edits before the place shift it, those after it make up the rest of the difference in length; an edit changes one
    count, or two if it leaves the length; in the beginnings, which are of one length, it changes two at most. Differences
    are taken modulo the fields' ranges, so they are never too large.
    """

    def gap(shift: int, bits: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        half = 1 << (bits - 1)
        return ((((a >> shift) - (b >> shift)) + half) & ((1 << bits) - 1)) - half

    longer, moved = gap(4 * GROUPS, LENGTH_BITS, a, b), gap(4 * GROUPS + LENGTH_BITS, PLACE_BITS, a, b)
    edits = np.full(len(a), most(threshold)) if long else allowed(np.minimum(mark_length(a), mark_length(b)), threshold)
    out = np.abs(moved) + np.abs(longer - moved) <= edits
    some = np.flatnonzero(out)
    a, b = a[some], b[some]
    spare = 2 * edits[some] - np.where(a & b < 0, 0, np.abs(longer[some]))  # below zero: both begun
    for k in range(GROUPS):
        spare = spare - np.abs(gap(4 * k, 4, a, b))
    out[some] = spare >= 0
    return out


def pair_histograms(lines: list[np.ndarray]) -> np.ndarray:
    """How often each line has pairs of neighbouring characters, by 64 hashes of pairs."""
    size = np.array([len(x) for x in lines], dtype=np.int64)
    codes = np.concatenate(lines).astype(np.int64) if len(lines) else np.zeros(0, dtype=np.int64)
    pair = (codes[:-1] * 31 + codes[1:] * 17 + (codes[1:] >> 3)) & 63 if len(codes) else codes
    line = np.repeat(np.arange(len(lines)), size)
    whole = line[:-1] == line[1:] if len(codes) else np.zeros(0, dtype=bool)
    return np.bincount(line[:-1][whole] * 64 + pair[whole], minlength=64 * len(lines)).reshape(-1, 64).astype(np.int16) if len(lines) else np.zeros((0, 64), dtype=np.int16)


def similar(a: np.ndarray, b: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """Which rows of two histograms can be of lines within these edits: an edit takes away or adds two pairs at most."""
    gap = a - b
    more = np.maximum(gap, 0).sum(axis=1)
    return (more <= 2 * edits) & (more - gap.sum(axis=1) <= 2 * edits)


def within(a: list[np.ndarray], b: list[np.ndarray], threshold: int | None) -> np.ndarray:
    """Whether each pair (characters of a and b) is within the threshold (None: within the edits its length allows).

    The band of 2 * threshold + 1 diagonals is one machine word a pair. A column's word is updated for all pairs at
    once: first along the lowest diagonal of the band, then along the last row.
    """
    n = len(a)
    m_len, n_len = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    swap = m_len < n_len
    a, b = [y if s else x for x, y, s in zip(a, b, swap, strict=True)], [x if s else y for x, y, s in zip(a, b, swap, strict=True)]
    m_len, n_len = np.maximum(m_len, n_len), np.minimum(m_len, n_len)  # a is the longer
    out = np.zeros(n, dtype=bool)
    edits = allowed(n_len, threshold)
    gap = m_len - n_len
    for k in np.flatnonzero(gap <= edits).tolist():
        a[k], b[k], out[k] = trimmed(a[k], b[k], edits[k])
    m_len = np.array([len(x) for x in a], dtype=np.int64)
    n_len = m_len - gap
    order = np.flatnonzero((gap <= edits) & ~out)
    order = order[np.argsort(m_len[order], kind="stable")]
    for part in np.split(order, np.flatnonzero(np.diff(np.cumsum(m_len[order] + 64) // CELLS)) + 1):
        if len(part):
            out[part] = _within([a[i] for i in part], [b[i] for i in part], m_len[part], n_len[part], most(threshold)) <= edits[part]
    return out


def trimmed(a: np.ndarray, b: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Two lines, a the longer, less what they begin and end with alike; and whether they are known to be within the edits,
    being of one length and different at few places."""
    n, gap = len(b), len(a) - len(b)
    other = a[:n] != b
    begin = int(other.argmax()) if n else 0
    if not n or not other[begin]:  # one begins with the other
        return a[n:], b[n:], gap <= edits
    if not gap and np.count_nonzero(other) <= edits:
        return a, b, True
    if gap:
        other = a[gap:] != b
    end = int(other[: begin - n - 1 : -1].argmax() if begin else other[::-1].argmax())
    if not other[n - 1 - end]:
        end = n - begin
    return a[begin : len(a) - end], b[begin : n - end], False


def _within(a: list[np.ndarray], b: list[np.ndarray], m: np.ndarray, n: np.ndarray, t: int) -> np.ndarray:
    width = int(m.max()) + 2 * t + 2
    # rows of a from -t on; columns of b; what lies outside equals nothing
    rows = np.full((len(a), width), -1, dtype=np.int32)
    columns = np.full((len(b), int(m.max()) + t + 1), -2, dtype=np.int32)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        rows[k, t : t + len(x)] = x
        columns[k, : len(y)] = y
    rows, columns = np.ascontiguousarray(rows.T), np.ascontiguousarray(columns.T)
    word = np.uint32 if 2 * t + 2 <= 32 else np.uint64
    full, one, highest = word((1 << (2 * t + 1)) - 1), word(1), word(2 * t)
    # before column j, bit k stands for row j - t + k: up (down) where the last column rises (falls) to that row
    up = np.full(len(a), word(((1 << (t + 1)) - 1) << t), dtype=word)
    down = np.zeros(len(a), dtype=word)
    m, n = m.astype(np.int32), n.astype(np.int32)
    cost = np.minimum(m, t)  # of row j + t in column j; of row m once that is passed
    out, left = np.full(len(a), t + 1), np.arange(len(a))
    end = int(n.max(initial=0))
    for j in range(1, end + 1):
        if j % 16 == 1:  # the cost falls by 2 * t at most from here
            keep = cost <= 3 * t
            if 2 * keep.sum() < len(keep):
                rows, columns = rows[:, keep], columns[:, keep]
                up, down, cost, m, n, left = (x[keep] for x in (up, down, cost, m, n, left))
            if not len(left):
                break
            ahead = min(16, end + 1 - j)
            equals = np.zeros((ahead, len(left)), dtype=word)
            for low in range(0, 2 * t + 1, 8):  # eight diagonals in a byte, the last first
                some = np.zeros((ahead, len(left)), dtype=np.uint8)
                for k in range(min(low + 8, 2 * t + 1) - 1, low - 1, -1):
                    some += some
                    some |= (rows[j - 1 + k : j - 1 + k + ahead] == columns[j - 1 : j - 1 + ahead]).view(np.uint8)
                equals |= some.astype(word) << word(low)
        equal = equals[(j - 1) % 16]
        same = ((((equal & up) + up) ^ up) | equal | down) & full
        rises = (down | ~(same | up)) & full
        falls = same & up
        live = j <= n
        below = live & (j + t <= m)
        cost = cost + (below & ((same >> highest) & one == 0))
        along = live & ~below
        if along.any():
            last = np.minimum(np.maximum(m - j + t, 0), 2 * t).astype(word)
            cost += along & ((rises >> last) & one == 1)
            cost -= along & ((falls >> last) & one == 1)
        up = (falls | ~((same >> one) | rises)) & full
        down = (same >> one) & rises
    out[left] = cost
    return out


LINE = "h1 long, h2 long"


def split_lines(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All lines of a batch with columns id and text: the lines, the row of each, and its number there."""
    lists = pc.split_pattern(pc.fill_null(batch.column("text"), ""), "\n")
    at = np.asarray(lists.offsets).astype(np.int64)
    counts = np.diff(at)
    row = np.repeat(np.arange(len(counts)), counts)
    return lists.flatten(), row, np.arange(len(row)) - np.repeat(at[:-1] - at[0], counts)


def digests(lines: list[bytes]) -> list[bytes]:
    """128 bits of each line."""
    return [hashlib.blake2b(x, digest_size=16).digest() for x in lines]


def hashes(lines: list[str]) -> np.ndarray:
    """128 bits of each line, as two 64-bit integers."""
    return np.frombuffer(b"".join(digests([x.encode() for x in lines])), dtype=np.int64).reshape(-1, 2)


def occurrences(docs: DataFrame, min_chars: int, short: bool = False, texts: int = 0) -> DataFrame:
    """``part, rows, gone, text, of`` of every line that is long enough; ``short``: and of every shorter one that isn't
    blank. Spark gets arrays: ``rows`` of h1, h2, id and line, for a part of h1, of the earliest of the equal lines that a
    task has at hand; ``gone`` of id, line and h1 of the others. Lines of fewer than ``texts`` characters have their
    ``text``, where a task meets them first: many in one, by length, and ``of`` with their h1."""
    parts = tasks(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held, count = [], 0
        for whole in batches:
            for batch in bpe.blocks(whole, "text"):
                lines, row, number = split_lines(batch)
                size = pc.utf8_length(lines)
                long = np.array(pc.greater_equal(size, min_chars))
                if short:
                    under = np.flatnonzero(~long)
                    long[under] = np.asarray(pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(lines.take(pa.array(under)))), 0))
                number, ids = number[long], np.asarray(batch.column("id"))[row[long]]
                if not len(ids):
                    continue
                coded = lines.filter(pa.array(long)).dictionary_encode()
                distinct, at = coded.dictionary.cast(pa.binary()).to_pylist(), np.asarray(coded.indices)
                named = digests(distinct)
                h = np.frombuffer(b"".join(named), dtype=np.int64).reshape(-1, 2)
                lead = earliest(at, ids, number)
                other = np.flatnonzero((ids != ids[lead][at]) | (number != number[lead][at]))
                held.append((h[:, 0], h[:, 1], ids[lead], number[lead]))
                count += len(h)
                if len(other):
                    yield arrays(gone=[np.stack((ids[other], number[other], h[at[other], 0]), axis=1)])
                if texts:
                    length = np.asarray(pc.utf8_length(coded.dictionary))
                    kept = [k for k in np.flatnonzero((length >= min_chars) & (length < texts)).tolist() if named[k] not in seen]
                    seen.update(named[k] for k in kept)
                    if len(seen) > SEEN:
                        seen.clear()
                    kept = np.array(kept, dtype=np.int64)
                    kept = kept[np.argsort(length[kept], kind="stable")]
                    for some in np.split(kept, np.flatnonzero(np.diff(np.cumsum(length[kept]) // KEY_BYTES)) + 1):
                        if len(some):
                            yield arrays(text=[b"\n".join([distinct[k] for k in some.tolist()])], of=[h[some, 0]])
                if count >= HELD:
                    yield arrays(**dealt(held, parts))
                    held, count = [], 0
        if count:
            yield arrays(**dealt(held, parts))

    return docs.mapInArrow(run, "part int, rows binary, gone binary, text binary, of binary")


def arrays(part: np.ndarray | None = None, **given: list[np.ndarray | bytes]) -> pa.RecordBatch:
    """Rows of what ``occurrences`` gives to Spark."""
    n = len(next(iter(given.values())))
    columns = [pa.nulls(n, pa.int32()) if part is None else pa.array(part, pa.int32())]
    for name in ("rows", "gone", "text", "of"):
        columns.append(pa.array([x if isinstance(x, bytes) else x.tobytes() for x in given[name]], pa.binary()) if name in given else pa.nulls(n, pa.binary()))
    return pa.record_batch(columns, names=["part", "rows", "gone", "text", "of"])


def earliest(at: np.ndarray, ids: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Where each code, numbered from 0 as they first come, is earliest by id and number."""
    if (np.diff(ids) >= 0).all() and ((np.diff(ids) > 0) | (np.diff(number) > 0)).all():  # as they come
        return np.flatnonzero(np.diff(np.maximum.accumulate(at), prepend=-1))
    order = np.lexsort((number, ids, at))
    return order[np.flatnonzero(np.diff(at[order], prepend=-1))]


def frames(column: pa.Array, width: int) -> np.ndarray:
    """The rows of all arrays of a column, which have so many columns."""
    return np.frombuffer(b"".join(column.drop_null().to_pylist()), dtype=np.int64).reshape(-1, width)


def firsts(places: DataFrame) -> DataFrame:
    """``part, rows, gone``, as of ``occurrences``: the first occurrence of every line, and all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(batch.column("part"), batch.column("rows")) for batch in batches if batch.num_rows]
        if not held:
            return
        part = np.concatenate([np.repeat(np.asarray(p), np.asarray(pc.binary_length(x)) // 32) for p, x in held])
        rows = np.concatenate([frames(x, 4) for _, x in held])
        order = np.argsort(rows[:, 0], kind="stable")
        if (np.diff(rows[order, 0]) == 0).any():
            order = np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))
        part, rows = part[order], rows[order]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        of = rows[new][np.cumsum(new) - 1]
        other = rows[(rows[:, 2:] != of[:, 2:]).any(axis=1)]
        part, rows = part[new], rows[new]
        cut = np.flatnonzero(np.diff(part, prepend=-1))  # parts are ranges of h1, if not in its order
        yield arrays(part[cut], rows=np.split(rows, cut[1:])).select(["part", "rows", "gone"])
        for x in range(0, len(other), HELD):
            yield arrays(gone=[other[x : x + HELD][:, [2, 3, 0]]]).select(["part", "rows", "gone"])

    return places.where("rows IS NOT NULL").select("part", "rows").repartitionById(tasks(places), "part").mapInArrow(run, "part int, rows binary, gone binary")


def unpacked(packed: DataFrame, *names: str) -> DataFrame:
    """Rows of the arrays in a single column, whose columns have these names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bpe.blocks(whole, whole.schema.names[0]):
                yield pa.record_batch(list(map(pa.array, frames(batch.column(0), len(names)).T)), names=list(names))

    return packed.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def keyed(docs: DataFrame, threshold: int | None, min_chars: int, low: int = 0, high: int = 1 << 40) -> DataFrame:
    """``part, rows``: the keys of every line (of ``text``, or of the lines that ``occurrences`` stored, with ``of``) in a
    round from ``low`` to ``high``, with h1 and a mark, each line about once a task. Spark gets them as arrays (of key, h1 and mark), one for each part of the keys that a task met."""
    least, beyond, parts = max(low, min_chars), high + most(threshold), tasks(docs)
    own_at, most_held = 4 * GROUPS + LENGTH_BITS + PLACE_BITS, BEGINNING + MOST_EDITS if threshold is None else 1 << 40

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count, seen = 0, set()
        for whole in batches:
            for batch in bpe.blocks(whole, "text", KEY_BYTES):
                if "of" in batch.schema.names:
                    length, h1, codes = stored_lines(batch, least, beyond)
                else:
                    length, h1, codes = fresh_lines(batch, least, beyond, most_held, seen)
                if not len(length):
                    continue
                held_of = int(min(most_held, length[-1]))  # longer lines make keys of no more
                start = np.cumsum(np.minimum(length, held_of)) - np.minimum(length, held_of)
                if threshold is None:
                    found = keys_by_class(codes, start, length, low, high)
                else:
                    found = ((0, x) for x in line_keys(codes, start, length, threshold))
                x, y = np.searchsorted(length, (BEGINNING, held_of + 1))  # those before y make keys whole, those from x by their beginnings
                plain, begun = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
                plain[:y] = marks(counts(codes, start[:y], length[:y]), length[:y], 0, False)
                begun[x:] = marks(counts(codes, start[x:], np.full(len(length) - x, BEGINNING)), length[x:], 0, False, True) if threshold is None else 0
                for a, (at, key, place, own) in found:
                    mark = (begun if a >= BEGINNING else plain)[at]
                    mark |= (place & ((1 << PLACE_BITS) - 1)) << (4 * GROUPS + LENGTH_BITS) | np.asarray(own, dtype=np.int64) << own_at
                    held.append((key, h1[at], mark))
                    count += len(key)
                    if count >= HELD:
                        yield pa.record_batch(dealt(held, parts))
                        held, count = [], 0
        if count:
            yield pa.record_batch(dealt(held, parts))

    return docs.mapInArrow(run, "part int, rows binary")


def fresh_lines(batch: pa.RecordBatch, least: int, beyond: int, most_held: int, seen: set[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths (rising), h1, and the first characters of the lines of these lengths that haven't been seen."""
    lines, _, _ = split_lines(batch)
    size = pc.utf8_length(lines)
    lines = pc.unique(lines.filter(pc.and_(pc.greater_equal(size, least), pc.less(size, beyond))))
    named = digests(lines.cast(pa.binary()).to_pylist())
    fresh = np.array([k for k, d in enumerate(named) if d not in seen], dtype=np.int64)
    seen.update(named)
    if len(seen) > SEEN:
        seen.clear()
    length = np.asarray(pc.utf8_length(lines)).astype(np.int64)[fresh]
    order = np.argsort(length, kind="stable")  # lines of a class side by side
    length, fresh = length[order], fresh[order]
    h1 = np.frombuffer(b"".join(named), dtype=np.int64)[::2][fresh]
    lines = lines.take(pa.array(fresh))
    if len(length) and length[-1] > most_held:
        lines = pc.utf8_slice_codeunits(lines, 0, most_held)
    return length, h1, code_points(b"".join(lines.cast(pa.binary()).to_pylist()))


def stored_lines(batch: pa.RecordBatch, least: int, beyond: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of lines that were stored, each once a task."""
    lengths, names, codes = [], [], []
    for text, of in zip(batch.column("text").to_pylist(), batch.column("of").to_pylist(), strict=True):
        found = code_points(text)
        end = np.append(np.flatnonzero(found == 10), len(found))
        length = np.diff(end, prepend=-1) - 1
        x, y = np.searchsorted(length, (least, beyond))
        if x < y:
            found = found[end[x] - length[x] : end[y - 1]]
            lengths.append(length[x:y])
            names.append(np.frombuffer(of, dtype=np.int64)[x:y])
            codes.append(found[found != 10])
    if not lengths:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    length, h1, codes = (np.concatenate(x) for x in (lengths, names, codes))
    if len(lengths) > 1:
        order = np.argsort(length, kind="stable")
        codes, _ = packed(codes, np.cumsum(length) - length, length, order)
        length, h1 = length[order], h1[order]
    return length, h1, codes


def code_points(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode().encode("utf-32-le"), dtype=np.uint32).astype(np.int64)


def dealt(held: list[tuple[np.ndarray, ...]], parts: int, by: np.ndarray | None = None) -> dict:
    """Rows (columns of the arrays) as one array for each part, by the first column if not by another one."""
    key = np.concatenate([x[0] for x in held])
    by = key if by is None else by
    part = (((by.view(np.uint64) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.uint16 if parts <= 1 << 16 else np.int32)
    order = np.argsort(part, kind="stable")
    part, rows = part[order], np.empty((len(key), len(held[0])), dtype=np.int64)
    rows[:, 0] = key
    for c in range(1, len(held[0])):
        np.concatenate([x[c] for x in held], out=rows[:, c])
    rows = rows.take(order, axis=0)
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    ends = np.append(cut[1:], len(part))
    return {"part": part[cut].astype(np.int32), "rows": [rows[x:y].tobytes() for x, y in zip(cut, ends, strict=True)]}


def met(keys: DataFrame, threshold: int | None, long: bool) -> DataFrame:
    """``part, key, a, b``: in ``b`` arrays of pairs of lines (by h1) under a key whose marks allow a link, for a part of the
    pairs; under keys with many of them each line alone in ``a``, b null. Lines that share an h1 are verified all, so half of
    the hash is enough here."""
    parts = tasks(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x, dtype=np.int64).reshape(-1, 3) for batch in batches for x in batch.column("rows").to_pylist()]
        if not held:
            return
        rows = np.concatenate(held)
        held = []
        # keys but for their last bits, which give way to the row's number; keys that agree so far are one group
        bits = np.uint64(max(1, (len(rows) - 1).bit_length()))
        order = np.sort(((rows[:, 0].view(np.uint64) >> bits) << bits) | np.arange(len(rows), dtype=np.uint64))
        group = order >> bits
        again = group[1:] == group[:-1]
        some = np.append(again, False) | np.insert(again, 0, False)
        if not some.any():
            return
        group = group[some]
        rows = rows.take((order[some] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), axis=0)
        del order, again, some
        group = np.cumsum(np.append(False, group[1:] != group[:-1]))
        first = np.flatnonzero(np.diff(group, prepend=-1))
        begins = first[np.flatnonzero(np.diff(first // MEETING, prepend=-1))]  # no key spans two slices
        count = 0
        for x, y in zip(begins, np.append(begins[1:], len(rows)), strict=True):
            alone, *pairs = of(group[x:y] - group[x], *rows[x:y].T)
            if len(alone[0]):
                yield pa.record_batch([pa.nulls(len(alone[0]), pa.int32()), *map(pa.array, alone), pa.nulls(len(alone[0]), pa.binary())], names=["part", "key", "a", "b"])
            held.append(pairs)
            count += len(pairs[0])
            if count >= HELD:
                yield joined(held)
                held, count = [], 0
        if count:
            yield joined(held)

    def joined(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        found = distinct(np.concatenate([np.stack(x, axis=1) for x in held]))
        packed_ = dealt([tuple(found.T)], parts, found[:, 0] ^ found[:, 1])
        nulls = pa.nulls(len(packed_["part"]), pa.int64())
        return pa.record_batch([pa.array(packed_["part"]), nulls, nulls, pa.array(packed_["rows"], pa.binary())], names=["part", "key", "a", "b"])

    def of(group: np.ndarray, key: np.ndarray, h1: np.ndarray, mark: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
        order = np.argsort(((group << LENGTH_BITS | mark_length(mark)) << 24) | ((h1 ^ mark >> 32) & ((1 << 24) - 1)))
        group, key, h1, mark = group[order], key[order], h1[order], mark[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (mark[1:] != mark[:-1]) | (key[1:] != key[:-1])
        group, key, h1, mark = group[new], key[new], h1[new], mark[new]
        cut = np.flatnonzero(np.diff(group, prepend=-1))
        size = np.diff(np.append(cut, len(key)))
        length, own = mark_length(mark), mark_own(mark)
        place = (group << (LENGTH_BITS + 4)) + length
        near = np.searchsorted(place, place + most(threshold), "right") - np.arange(len(key)) - 1
        round_ = length >= (1 << LENGTH_BITS) - most(threshold)  # the lengths that follow begin at 0 again
        large = (np.add.reduceat(near, cut) > TRIED * size) | (np.bincount(group[round_], minlength=len(size)) > 0)
        near[large[group]] = 0
        listed, found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))], np.zeros(len(size), dtype=np.int64)
        with_ = np.flatnonzero(near)
        for rows in np.split(with_, np.flatnonzero(np.diff(np.cumsum(near[with_]) // PAIRS)) + 1):
            rows = rows[~large[group[rows]]]
            if not len(rows):
                continue
            a = np.repeat(rows, near[rows])
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(near[rows]) - near[rows], near[rows])
            good = (own[a] | own[b]) & (h1[a] != h1[b])
            a, b = a[good], b[good]
            good = may_link(mark[a], mark[b], threshold, long)
            a, b = a[good], b[good]
            listed.append((a, b))
            found += np.bincount(group[a], minlength=len(size))
            large |= found > SMALL // 2 * size
        a, b = (np.concatenate(x) for x in zip(*listed, strict=True))
        small = ~large[group[a]]
        a, b = a[small], b[small]
        alone = np.flatnonzero((large & (np.bincount(group[own], minlength=len(size)) > 0))[group])
        alone = alone[np.unique(np.stack((key[alone], h1[alone])), axis=1, return_index=True)[1]]
        least, greatest = np.minimum(h1[a], h1[b]), np.maximum(h1[a], h1[b])
        return (key[alone], h1[alone]), least, greatest

    return keys.repartitionById(parts, "part").mapInArrow(run, "part int, key long, a long, b binary")


def distinct(pairs: np.ndarray) -> np.ndarray:
    """The rows of two columns, each once."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))[: len(pairs)]]


def listed_once(pairs: DataFrame) -> DataFrame:
    """``a, b``: the pairs of all rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [frames(batch.column("b"), 2) for batch in batches]
        if held:
            found = distinct(np.concatenate(held))
            for x in range(0, len(found), HELD):
                yield pa.record_batch(list(map(pa.array, found[x : x + HELD].T)), names=["a", "b"])

    return pairs.where("b IS NOT NULL").select("part", "b").repartitionById(tasks(pairs), "part").mapInArrow(run, "a long, b long")


def located(wanted: DataFrame, first: DataFrame) -> DataFrame:
    """``h1, h2, id, line`` of the first occurrence of each line with an h1 of ``wanted`` (arrays of it)."""

    parts = tasks(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(batch.column("rows"), batch.column("sought")) for batch in batches]
        if held:
            rows, sought = (np.concatenate([frames(x[k], width) for x in held]) for k, width in ((0, 4), (1, 1)))
            found = rows[np.isin(rows[:, 0], sought)]
            yield pa.record_batch(list(map(pa.array, found.T)), names=["h1", "h2", "id", "line"])

    def sought(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = [np.asarray(pc.drop_null(batch.column(c))) for c in ("a", "b")]
                found = dealt([(np.unique(np.concatenate(columns)),)], parts)
                yield pa.record_batch([pa.array(found["part"]), pa.array(found["rows"], pa.binary())], names=["part", "sought"])

    none = F.lit(None).cast("binary")
    rows = first.where("rows IS NOT NULL").select("part", "rows", none.alias("sought"))
    both = rows.union(wanted.mapInArrow(sought, "part int, sought binary").select("part", none, "sought"))
    return both.repartitionById(parts, "part").mapInArrow(run, f"{LINE}, id long, line long")


def fetched(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``h1, h2, id, line, text``: the lines at these places (``h1, h2, id, line``), with their texts."""
    by_doc = places.groupBy("id").agg(F.collect_list(F.struct("line", "h1", "h2")).alias("of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bpe.blocks(whole, "text"):
                out = []
                for i, text, of in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), batch.column("of").to_pylist(), strict=True):
                    lines = (text or "").split("\n")
                    for x in of:
                        if x["line"] < len(lines):
                            out.append((x["h1"], x["h2"], i, x["line"], lines[x["line"]]))
                if out:
                    h = hashes([x[4] for x in out])
                    right = [k for k, x in enumerate(out) if (x[0], x[1]) == (int(h[k, 0]), int(h[k, 1]))]  # rows may share an id
                    columns = list(zip(*(out[k] for k in right), strict=True)) or [(), (), (), (), ()]
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["h1", "h2", "id", "line", "text"])

    found = docs.join(by_doc.hint("shuffle_hash"), "id").select("id", "text", "of").mapInArrow(run, f"{LINE}, id long, line long, text string")
    return found.dropDuplicates(["h1", "h2"])


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.int32)


def later_of(pairs: DataFrame, threshold: int | None) -> DataFrame:
    """``h1, h2, id, line`` of the line of each verified pair (structs a and b of h1, h2, id, line, text) that occurs later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            texts = pa.chunked_array([pc.struct_field(side, "text") for side in (a, b)]).combine_chunks().dictionary_encode()
            codes = [characters(x) for x in texts.dictionary.to_pylist()]  # a line is in many pairs
            x, y = np.asarray(texts.indices)[: len(a)], np.asarray(texts.indices)[len(a) :]
            size = np.array([len(c) for c in codes], dtype=np.int64)
            pairs = pair_histograms(codes)
            near = np.flatnonzero(similar(pairs[x], pairs[y], allowed(np.minimum(size[x], size[y]), threshold)))
            good = near[within([codes[k] for k in x[near]], [codes[k] for k in y[near]], threshold)] if len(near) else near
            (a_id, a_line, *of_a), (b_id, b_line, *of_b) = ([np.asarray(pc.struct_field(side, c))[good] for c in ("id", "line", "h1", "h2")] for side in (a, b))
            second = (b_id > a_id) | ((b_id == a_id) & (b_line > a_line))
            yield pa.record_batch([pa.array(np.where(second, q, p)) for p, q in zip((*of_a, a_id, a_line), (*of_b, b_id, b_line), strict=True)], names=["h1", "h2", "id", "line"])

    return pairs.mapInArrow(run, f"{LINE}, id long, line long")


def met_before(keys: pa.ChunkedArray, key: int) -> np.ndarray:
    """Which lines of a group share a key below its own; ``keys``: a list for each line."""
    lists = keys.combine_chunks()
    row, values = np.asarray(pc.list_parent_indices(lists)), np.asarray(lists.flatten())
    row, values = row[values < key], values[values < key]
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    common = np.flatnonzero(times > 1)
    out = np.zeros((len(lists), len(lists)), dtype=bool)
    for k in range(0, len(common), 1 << 12):
        number = np.full(len(times), -1)
        number[common[k : k + (1 << 12)]] = np.arange(len(common[k : k + (1 << 12)]))
        some = number[column] >= 0
        has = np.zeros((len(lists), len(common[k : k + (1 << 12)])), dtype=np.float32)
        has[row[some], number[column[some]]] = 1
        out |= has @ has.T > 0
    return out


def later_in(members: DataFrame, threshold: int | None) -> DataFrame:
    """``h1, h2, id, line`` of the ``open`` lines of ``members(key, size, open, keys, h1, h2, id, line, text)`` with an earlier neighbour
    under their key. Two lines are compared under the least of the ``keys`` that both are members of."""
    parts = F.ceil(F.col("size") / BLOCK).cast("long")
    dealt = members.withColumn("side", F.pmod(F.xxhash64("h1"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    dealt = dealt.select("key", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"), "open", "keys", "h1", "h2", "id", "line", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["key", "p", "q"]):
            order = np.lexsort((np.asarray(table.column("line")), np.asarray(table.column("id"))))
            keys = table.column("keys").take(order)
            rows = table.drop_columns(["keys"]).take(order).to_pylist()
            codes = [characters(r["text"]) for r in rows]
            size = np.array([len(x) for x in codes])
            sought = np.array([r["open"] for r in rows])
            after, before = np.tril_indices(len(rows), -1)
            first = sought[after] & ~met_before(keys, rows[0]["key"])[after, before]
            after, before = after[first], before[first]
            some = np.abs(size[after] - size[before]) <= allowed(np.minimum(size[after], size[before]), threshold)
            after, before = after[some], before[some]
            earliest = np.argsort(before, kind="stable")  # most lines are settled by early ones
            after, before = after[earliest], before[earliest]
            found = np.zeros(len(rows), dtype=bool)
            pairs = pair_histograms(codes)
            for k in range(0, len(after), 1 << 12):
                a, b = after[k : k + (1 << 12)], before[k : k + (1 << 12)]
                open_ = ~found[a]
                a, b = a[open_], b[open_]
                near = similar(pairs[a], pairs[b], allowed(np.minimum(size[a], size[b]), threshold))
                a, b = a[near], b[near]
                found[a[within([codes[i] for i in a], [codes[j] for j in b], threshold)]] = True
            late = [rows[i] for i in np.flatnonzero(found)]
            yield pa.record_batch([pa.array([x[c] for x in late], pa.int64()) for c in ("h1", "h2", "id", "line")], names=["h1", "h2", "id", "line"])

    return dealt.repartition(tasks(dealt), "key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(run, f"{LINE}, id long, line long")


def removals(docs: DataFrame, threshold: int | None, min_chars: int, short: bool = False) -> DataFrame:
    """``id, gone``: for each document that loses lines, their numbers and hashes."""
    held = ROUNDS[-1] + MOST_EDITS if threshold is None else 0
    places = stored(occurrences(docs, min_chars, short, held))
    brief = places.where("text IS NOT NULL").select("text", "of")
    first = stored(firsts(places))
    found = reduce(DataFrame.union, [stored(met(keyed(brief if b + most(threshold) <= held else docs, threshold, min_chars, a, b), threshold, b > SPAN)) for a, b in rounds(threshold)])
    pairs = stored(listed_once(found))
    alone = found.where("b IS NULL").select("key", F.col("a").alias("h1"))
    wanted = pairs.union(alone.select("h1", F.lit(None).cast("long")))
    lines = stored(fetched(docs, located(wanted, first)))
    # under common keys all lines are compared with the first, which many keys share; then those left open with all others
    members = alone.join(lines.select("h1", "h2", "id", "line"), "h1").select("key", "h1", "h2", "id", "line")
    of_key = Window.partitionBy("key")
    members = members.select("key", "h1", "h2", "id", "line", F.count("*").over(of_key).alias("size"), F.min(F.struct("id", "line", "h1")).over(of_key).alias("head"))
    members = stored(members.withColumn("later", (F.col("id") != F.col("head.id")) | (F.col("line") != F.col("head.line"))))
    headed = members.where("later AND h1 <> head.h1").select(F.least("h1", "head.h1").alias("of_a"), F.greatest("h1", "head.h1").alias("of_b"))
    listed = pairs.select(F.col("a").alias("of_a"), F.col("b").alias("of_b")).union(headed).distinct()
    whole = F.struct("h1", "h2", "id", "line", "text")
    a, b = (lines.select(F.col("h1").alias(f"of_{x}"), whole.alias(x)) for x in "ab")
    by_pair = stored(later_of(listed.join(a, "of_a").join(b, "of_b").select("a", "b"), threshold).distinct().withColumn("late", F.lit(True)))
    members = members.join(by_pair.select("h1", "h2", "late"), ["h1", "h2"], "left").select("key", "size", (F.col("later") & F.col("late").isNull()).alias("open"), "h1", "h2")
    unsettled = members.withColumn("unsettled", F.max("open").over(of_key)).where("unsettled")
    by_line = unsettled.groupBy("h1", "h2").agg(F.collect_list(F.struct("key", "size", "open")).alias("of"))
    shared = by_line.join(lines, ["h1", "h2"]).select(F.explode("of").alias("x"), F.col("of.key").alias("keys"), "h1", "h2", "id", "line", "text")
    by_key = later_in(shared.select("x.*", "keys", "h1", "h2", "id", "line", "text"), threshold)
    late = by_pair.select("id", "line", "h1").union(stored(by_key).select("id", "line", "h1")).distinct()
    repeated = places.select("gone").union(first.select("gone")).where("gone IS NOT NULL")
    return late.union(unpacked(repeated, "id", "line", "h1")).groupBy("id").agg(F.collect_list(F.struct("line", "h1")).alias("gone"))


def deduplicate(docs: DataFrame, threshold: int | None = THRESHOLD, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", short: bool = False, added: tuple[str, str] = ("_n_lines", "_n_removed")) -> DataFrame:
    """Every row with its text less the removed lines, and ``_n_lines`` and ``_n_removed`` (or the names ``added``) added.

    A threshold of None allows edits by the length of the shorter line. ``short``: lines under ``min_chars`` that repeat
    an equal one go also, unless they are blank.

    A null text stays null (no lines); an empty one has one empty line. Rows with a null id take no part and stay as
    they are; rows that share an id are one document: an equal line at the same place of both counts as one occurrence.
    Other columns stay, whatever their names, but for those of the added ones, which are replaced; an empty table stays
    empty.
    """
    key = F.col(f"`{id_col}`").cast("long")
    slim = docs.select(key.alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    others = [c for c in docs.columns if c != text_col and c.lower() not in [a.lower() for a in added]]
    gone = removals(slim, threshold, min_chars, short).select(F.col("id").alias("of_id"), "gone")
    rows = docs.select(key.alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), (F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.struct(F.lit(0).alias("none"))).alias("row"))
    joined = rows.join(gone.hint("shuffle_hash"), F.col("id") == F.col("of_id"), "left").select("row", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bpe.blocks(whole, "text"):
                texts, counts, removed = batch.column("text").to_pylist(), [], []
                of = batch.column("gone")
                end = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(of), 0))).tolist()
                place, h1 = (x.to_pylist() for x in of.flatten().flatten())
                begin = 0
                for i, (text, stop) in enumerate(zip(texts, end, strict=True)):
                    if begin == stop:
                        counts.append(0 if text is None else text.count("\n") + 1)
                        removed.append(0)
                        continue
                    lines = [] if text is None else text.split("\n")
                    drop = set()
                    for k, name in zip(place[begin:stop], h1[begin:stop], strict=True):
                        if k < len(lines) and int.from_bytes(digests([lines[k].encode()])[0][:8], sys.byteorder, signed=True) == name:
                            drop.add(k)
                    begin = stop
                    if drop:
                        texts[i] = "\n".join(x for k, x in enumerate(lines) if k not in drop)
                    counts.append(len(lines))
                    removed.append(len(drop))
                yield pa.record_batch([batch.column("row"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=["row", "text", "n_lines", "n_removed"])

    kinds = StructType([joined.schema["row"], StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_removed", LongType())])
    out = joined.mapInArrow(run, kinds)
    kept = (F.col("text") if c == text_col else F.col("row")[c] for c in docs.columns if c == text_col or c in others)
    names = [c for c in docs.columns if c == text_col or c in others]
    return out.select(*(column.alias(c) for column, c in zip(kept, names, strict=True)), F.col("n_lines").alias(added[0]), F.col("n_removed").alias(added[1]))


def digest(docs: DataFrame) -> DataFrame:
    """One row a document: ``doc_id, n_lines, n_removed, kept_sha256`` (of the text left; null: empty)."""
    clean = deduplicate(docs.select("doc_id", "text"), None, short=True, added=("n_lines", "n_removed"))
    return clean.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
