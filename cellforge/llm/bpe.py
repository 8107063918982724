"""Byte-level BPE encoding and decoding with a pair occurrence index.

A batch of texts is cut into words, the words into pre-tokens, and each distinct pre-token is encoded once. All
distinct pre-tokens of the batch form one array of symbols; an index maps every adjacent pair that has a merge rank to
all its positions. Ranks that are active are applied in ascending order, each at all its positions at once, and only
the lists of the pairs next to a merged position change.

The result equals ``tokenizers``' ``encode(text, add_special_tokens=False)``; special tokens that occur in a text are
recognised as that library does by default.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered

#: Fixed value: the pre-tokenisation pattern of byte-level BPE files whose pre-tokenizer is ByteLevel with use_regex.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class Vocabulary:
    """Ids, bytes, merges and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        vocab: dict[str, int] = parts["model"]["vocab"]
        letters = byte_characters()
        to_byte = {c: b for b, c in enumerate(letters)}
        self.specials = {x["content"]: x["id"] for x in parts["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        token_bytes = [b""] * size
        for token, i in vocab.items():
            token_bytes[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        for token, i in self.specials.items():
            token_bytes[i] = token.encode()
        self.bytes, self.byte_offsets = ragged(token_bytes)
        self.decimals, self.decimal_offsets = ragged([b"%d," % i for i in range(size)])
        self.of_byte = np.array([vocab.get(c, -1) for c in letters], dtype=np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in parts["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        keys = self.left << 32 | self.right
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, -1 where there is none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.by_key[at], -1)


def ragged(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(rows) + 1, dtype=np.int64)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return np.frombuffer(b"".join(rows), dtype=np.uint8), offsets


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merged(data: np.ndarray, offsets: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Encode rows of bytes: their ids, and offsets into these."""
    n = len(data)
    symbol = np.append(vocab.of_byte[data], np.int32(-1))  # symbol[n] stands before and after every row
    after = np.arange(1, n + 2, dtype=np.int32)
    before = np.arange(-1, n, dtype=np.int32)
    filled = offsets[:-1] < offsets[1:]
    after[offsets[1:][filled] - 1] = n
    before[offsets[:-1][filled]] = n

    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def note(positions: np.ndarray) -> None:
        """Add the pairs that begin at positions to the index."""
        rank = vocab.ranks(symbol[positions], symbol[after[positions]])
        known = rank >= 0
        rank, positions = rank[known], positions[known]
        if not len(rank):
            return
        order = np.argsort(rank, kind="stable")
        rank, positions = rank[order], positions[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        starts = [0, *cuts.tolist()]
        for r, a, b in zip(rank[starts].tolist(), starts, [*starts[1:], len(rank)], strict=True):
            held = index.get(r)
            if held is None:
                index[r] = [positions[a:b]]
                heapq.heappush(heap, r)
            else:
                held.append(positions[a:b])

    note(np.flatnonzero(after[:n] != n).astype(np.int32))
    while heap:
        rank = heapq.heappop(heap)
        lists = index.pop(rank)
        left, right = vocab.left[rank], vocab.right[rank]
        at = np.unique(np.concatenate(lists)) if len(lists) > 1 or left == right else lists[0]
        at = at[(symbol[at] == left) & (symbol[after[at]] == right)]
        if not len(at):
            continue
        if left == right:  # of overlapping pairs, the leftmost goes first
            begins = np.ones(len(at), dtype=bool)
            begins[1:] = after[at[:-1]] != at[1:]
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
        gone = after[at]
        symbol[at] = vocab.merged[rank]
        symbol[gone] = -2
        behind = after[gone]
        after[at] = behind
        before[behind] = at
        ahead = before[at]
        note(np.concatenate((ahead[ahead < n], at[behind < n])))
    alive = symbol[:n] >= 0
    counts = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(alive, out=counts[1:])
    return symbol[:n][alive], counts[offsets]


def string_bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without nulls, and its offsets."""
    strings = strings.cast(pa.large_string())
    offsets = np.frombuffer(strings.buffers()[1], dtype=np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


SPLITTER = regex.compile(PATTERN)
SPACE = regex.compile(r"\s")


def spaced(c: str) -> bool:
    return c.isspace() or SPACE.match(c) is not None


def encoded(texts: pa.Array, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Encode texts (null: empty): all ids, and the offsets of each text's ids.

    A single space between two other characters always begins a pre-token, so texts fall into words there and each
    distinct word is cut into pre-tokens once. Texts with other runs of white space are cut as a whole.
    """
    texts = pc.fill_null(texts, "")
    rows, ends = parts(texts, vocab.specials)
    words = pc.split_pattern(rows, " ")
    offsets = np.asarray(words.offsets).astype(np.int64)
    offsets -= offsets[0]
    coded = words.flatten().dictionary_encode()
    codes = np.asarray(coded.indices).astype(np.int64)
    distinct: list[str] = coded.dictionary.to_pylist()
    n = len(distinct)

    blank = {c: spaced(c) for c in {w[:1] for w in distinct} | {w[-1:] for w in distinct} if c} | {"": False}
    opens = np.array([not w or blank[w[0]] for w in distinct], dtype=bool)
    closes = np.array([blank[w[-1:]] for w in distinct], dtype=bool)
    first, last = offsets[:-1], offsets[1:] - 1
    bad = opens[codes]
    bad[first] = False
    ended = closes[codes]
    ended[last] = False
    odd = np.add.reduceat(bad | ended, first) > 0 if len(first) else np.zeros(0, dtype=bool)

    # chunks: each distinct word with its space, each distinct first word without, each odd row whole
    heads, head_of = np.unique(codes[first], return_inverse=True)
    codes[first] = n + head_of
    odd_rows = np.flatnonzero(odd)
    keep = np.repeat(~odd, np.diff(offsets))
    keep[first[odd_rows]] = True
    codes[first[odd_rows]] = n + len(heads) + np.arange(len(odd_rows))
    counts = np.add.reduceat(keep, first) if len(first) else np.zeros(0, dtype=np.int64)
    codes = codes[keep]
    offsets = np.concatenate(([0], np.cumsum(counts)))

    plain = ~(opens | closes)
    used = np.zeros(n, dtype=bool)
    used[codes[codes < n]] = True
    apart = [*(" " + distinct[i] for i in np.flatnonzero(used & ~plain)), *(distinct[i] for i in heads), *rows.take(pa.array(odd_rows)).to_pylist()]
    together = np.flatnonzero(used & plain)
    order = np.concatenate((together, np.flatnonzero(used & ~plain), n + np.arange(len(heads) + len(odd_rows))))
    tokens = SPLITTER.findall("".join(" " + distinct[i] for i in together))
    reach = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)))
    sizes = np.cumsum(np.fromiter((len(distinct[i]) + 1 for i in together), dtype=np.int64, count=len(together)))
    bounds = np.searchsorted(reach, sizes, side="left") + 1
    if len(sizes) and not np.array_equal(reach[bounds - 1], sizes):
        raise AssertionError("a pre-token crossed a word")
    tally = np.diff(bounds, prepend=0).tolist()
    for chunk in apart:
        found = SPLITTER.findall(chunk)
        tokens += found
        tally.append(len(found))

    coded = pa.array(tokens, pa.large_string()).dictionary_encode()
    ids, at = merged(*string_bytes(coded.dictionary), vocab)
    ids, at = gathered(ids, at, np.asarray(coded.indices).astype(np.int64))
    chunk_at = np.concatenate(([0], np.cumsum(tally))).astype(np.int64)
    chunk_at = at[chunk_at]
    place = np.full(n + len(heads) + len(odd_rows), -1, dtype=np.int64)
    place[order] = np.arange(len(order))
    ids, at = gathered(ids, chunk_at, place[codes])
    row_at = at[offsets]
    if ends is None:
        return ids, row_at
    return with_specials(ids, row_at, ends)


def parts(texts: pa.Array, specials: dict[str, int]) -> tuple[pa.Array, tuple[np.ndarray, np.ndarray] | None]:
    """Cut texts at special tokens: the rows between, and per row its text and the special id that follows (-1: none)."""
    hit = np.zeros(len(texts), dtype=bool)
    for s in specials:
        hit |= np.asarray(pc.match_substring(texts, s))
    if not hit.any():
        return texts, None
    cut = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")")
    rows: list[str] = []
    owner: list[int] = []
    follows: list[int] = []
    for i, text in enumerate(texts.to_pylist()):
        pieces = cut.split(text) if hit[i] else [text]
        for k in range(0, len(pieces), 2):
            rows.append(pieces[k])
            owner.append(i)
            follows.append(specials[pieces[k + 1]] if k + 1 < len(pieces) else -1)
    return pa.array(rows, texts.type), (np.array(owner), np.array(follows))


def with_specials(ids: np.ndarray, at: np.ndarray, ends: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    owner, follows = ends
    extra = follows >= 0
    ids = np.insert(ids, at[1:][extra], follows[extra].astype(ids.dtype))
    counts = np.diff(at) + extra
    total = np.bincount(owner, weights=counts, minlength=owner[-1] + 1).astype(np.int64)
    return ids, np.concatenate(([0], np.cumsum(total)))


def decoded(ids: np.ndarray, at: np.ndarray, vocab: Vocabulary) -> list[str]:
    """The text of each row of ids; bytes that are no UTF-8 become U+FFFD."""
    data, reach = gathered(vocab.bytes, vocab.byte_offsets, ids)
    bounds, whole = reach[at].tolist(), data.tobytes()
    return [whole[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def blocks(batch: pa.RecordBatch, column: str, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about ``most`` bytes of text, or a single row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    if not len(sizes):
        return
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of every text: ``id_col, ids array<int>``.

    A null text is empty and has no ids. Rows are never merged: repeated ids or texts give repeated rows. Other columns
    don't matter, whatever their names; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for whole in batches:
            for batch in blocks(whole, "text"):
                ids, at = encoded(batch.column("text"), vocab)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.record_batch([batch.column("id"), lists], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The text of every array of ids: ``id_col, text``; a null array is empty, a null id or one out of range has no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        size = len(vocab.byte_offsets) - 1
        for batch in batches:
            texts = []
            for ids in batch.column("ids").to_pylist():
                known = np.array([i for i in ids or [] if i is not None and 0 <= i < size], dtype=np.int64)
                texts += decoded(known, np.array([0, len(known)]), vocab)
            yield pa.record_batch([batch.column("id"), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    slim = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    return slim.mapInArrow(run, f"`{id_col}` {kind}, text string")


def roundtrip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``; rows as in ``encode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for whole in batches:
            for batch in blocks(whole, "text"):
                ids, at = encoded(batch.column("text"), vocab)
                digits, reach = gathered(vocab.decimals, vocab.decimal_offsets, ids)
                bounds, digits = reach[at].tolist(), memoryview(digits.tobytes())
                shas = [hashlib.sha256(digits[a : max(a, b - 1)]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                texts = [hashlib.sha256(t.encode()).hexdigest() for t in decoded(ids, at, vocab)]
                yield pa.record_batch([batch.column("id"), pa.array(np.diff(at), pa.int64()), pa.array(shas), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
