"""Unigram token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a run of characters other than ASCII white space, with the word-start mark before it. The distinct
pre-tokens of a batch form a trie. The forward score of a node is that of the best segmentation of its prefix: the most
of (forward score at an ancestor + score of the piece between), ties to fewer tokens. It is computed once for every
pre-token that shares the prefix, level by level; where a pre-token ends, its number of tokens is stored.

Pieces come from a file of the sentencepiece library, or with their scores from the caller. A file of merges tells ranks
and not probabilities, whose sums would mean nothing: its pieces get the logarithms of probabilities that fall with the
rank by Zipf's law. Nothing is learned from texts. A character that is no piece falls back to its UTF-8 bytes, a token
each, at a score below every piece's.

Pre-tokens are made distinct, and their trie is built, in each batch: the trie of a block of documents stays in its task,
so that no text and no word is shuffled, and how words are divided among batches changes nothing in their counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe

MARK = "▁"
#: How far the score of a fallback byte lies below the least piece's.
FALLBACK = 10.0
#: Probabilities of a file of merges are in proportion to 1 / (rank + SHIFT), ranks from 0.
SHIFT = 2.7


class Pieces:
    """A trie of the reversed pieces: from a place in a word it is walked backwards to all pieces that end there."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        self.floor = min(scores.values(), default=0.0) - FALLBACK
        nodes: dict[tuple[int, int], int] = {}
        values = {}
        for piece, score in scores.items():
            node = 0
            for c in reversed(piece):
                node = nodes.setdefault((node, ord(c)), len(nodes) + 1)
            values[node] = score
        keys = np.array([s << 21 | c for s, c in nodes], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.to = np.fromiter(nodes.values(), dtype=np.int64, count=len(nodes))[order]
        self.value = np.full(len(nodes) + 1, np.nan)
        self.value[list(values)] = list(values.values())

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states after one more character, -1 where there is none."""
        keys = state << 21 | code
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.to[at], -1)


def zipf(ranked: list[str]) -> dict[str, float]:
    """Log-probabilities of pieces in order of their ranks."""
    weight = 1.0 / (np.arange(len(ranked)) + SHIFT)
    return dict(zip(ranked, np.log(weight / weight.sum()).tolist(), strict=True))


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The pieces of a file: with its scores if they are log-probabilities (type unigram), else by their ranks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
    likely = np.exp(np.clip(list(scores.values()), -700.0, 700.0)).sum() if scores else 0.0
    if 0.5 < likely < 2.0 and not all(float(x).is_integer() for x in scores.values()):
        return Pieces(scores)
    return Pieces(zipf(sorted(scores, key=lambda x: (-scores[x], x))))


def counted(words: list[str], known: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and score of the best segmentation of each distinct word (without the mark, which is put before it)."""
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    back = sorted(range(n), key=words.__getitem__)  # words with a common prefix stand together
    joined = "".join(MARK + words[i] for i in back)
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    sizes = np.fromiter((len(words[i]) + 1 for i in back), dtype=np.int64, count=n)
    starts = np.cumsum(sizes) - sizes
    depth = np.arange(len(codes)) - np.repeat(starts, sizes)

    # the length of the prefix that a word shares with the one before it; what lies beyond are new nodes
    before = np.arange(len(codes)) - np.repeat(np.concatenate(([0], sizes[:-1])), sizes)
    same = (depth < np.repeat(np.concatenate(([0], sizes[:-1])), sizes)) & (codes[np.maximum(before, 0)] == codes)
    differs = np.where(same, np.iinfo(np.int64).max, depth)
    shared = np.minimum(np.minimum.reduceat(differs, starts), sizes)
    new = depth >= np.repeat(shared, sizes)
    owner = np.cumsum(new) - 1  # of new places: the node
    code = codes[new]
    level = depth[new]
    # the parent of a node is the one before it, but for a word's first: the node of the shared prefix's last character
    parent = np.arange(len(code)) - 1
    first = starts + shared
    fresh = shared < sizes
    path: list[int] = []
    ends = np.empty(n, dtype=np.int64)
    node_at = owner[np.minimum(first, len(owner) - 1)]
    for k in range(n):
        s, z = int(shared[k]), int(sizes[k])
        del path[s:]
        if fresh[k]:
            a = int(node_at[k])
            parent[a] = path[-1] if path else -1
            path.extend(range(a, a + z - s))
        ends[k] = path[-1]

    # every piece that ends at a node: an arc from the ancestor before the piece
    at = np.arange(len(code))
    place, state = at, np.zeros(len(code), dtype=np.int64)
    heads, tails, scores = [], [], []
    single = np.zeros(len(code), dtype=bool)
    steps = 0
    while len(at):
        state = known.step(state, code[place])
        alive = state >= 0
        at, place, state = at[alive], parent[place[alive]], state[alive]
        value = known.value[state]
        hit = ~np.isnan(value)
        heads.append(at[hit])
        tails.append(place[hit])
        scores.append(value[hit])
        if not steps:
            single[at[hit]] = True
        steps += 1
        going = place >= 0
        at, place, state = at[going], place[going], state[going]
    bare = np.flatnonzero(~single)
    width = 1 + (code[bare] > 0x7F) + (code[bare] > 0x7FF) + (code[bare] > 0xFFFF)
    head = np.concatenate((*heads, bare))
    tail = np.concatenate((*tails, parent[bare]))
    score = np.concatenate((*scores, known.floor * width))
    tokens = np.concatenate((np.ones(sum(map(len, heads)), dtype=np.int64), width))

    order = np.lexsort((head, level[head]))
    head, tail, score, tokens = head[order], tail[order], score[order], tokens[order]
    forward = np.zeros(len(code) + 1)  # the last stands for the empty prefix, at index -1
    count = np.zeros(len(code) + 1, dtype=np.int64)
    bounds = np.searchsorted(level[head], np.arange(level.max() + 2))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        cuts = np.flatnonzero(np.concatenate(([True], head[a + 1 : b] != head[a : b - 1])))
        total = forward[tail[a:b]] + score[a:b]
        best = np.maximum.reduceat(total, cuts)
        nodes = head[a:b][cuts]
        tie = total == np.repeat(best, np.diff(np.append(cuts, b - a)))
        least = np.where(tie, count[tail[a:b]] + tokens[a:b], np.iinfo(np.int64).max)
        forward[nodes] = best
        count[nodes] = np.minimum.reduceat(least, cuts)
    result, value = np.empty(n, dtype=np.int64), np.empty(n)
    result[back], value[back] = count[ends], forward[ends]
    return result, value


def count_tokens(docs: DataFrame, path: str | None, id_col: str = "doc_id", text_col: str = "text", scores: dict[str, float] | None = None) -> DataFrame:
    """One row a document: ``doc_id, n_pretokens, n_tokens, score``, with the pieces of a file or the ``scores`` of pieces.

    A text that is null, empty or white space has no pre-tokens, no tokens and score 0. Repeated rows are counted each;
    an empty table gives an empty one; other columns don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(path) if scores is None else Pieces(scores)
        for whole in batches:
            for batch in bpe.blocks(whole, "text"):
                words = pc.ascii_split_whitespace(pc.fill_null(batch.column("text"), ""))
                at = np.asarray(words.offsets).astype(np.int64)
                coded = words.flatten().dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                tokens, score = counted([w for w in distinct if w], known)
                filled = np.array([bool(w) for w in distinct], dtype=bool)
                totals = []
                for own in (np.ones(len(tokens)), tokens, score):
                    of_word = np.zeros(len(distinct))
                    of_word[filled] = own
                    running = np.concatenate(([0.0], np.cumsum(of_word[np.asarray(coded.indices)])))
                    totals.append(running[at[1:] - at[0]] - running[at[:-1] - at[0]])
                yield pa.record_batch([batch.column("id"), pa.array(totals[0].astype(np.int64)), pa.array(totals[1].astype(np.int64)), pa.array(totals[2])], names=["doc_id", "n_pretokens", "n_tokens", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long, score double")
