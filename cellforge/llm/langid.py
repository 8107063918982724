"""Language identification by hierarchical discrimination.

One-versus-one linear support vector machines first choose the language family, then separate the languages within it.
Features are hashed byte trigrams of the whole text (ASCII letters in lower case, digits alike), as shares of the
text's trigrams. The models are fitted on the driver from a bounded sample of labelled rows: at most
``per_language`` of each language, chosen by a hash; their trigram counts, not their texts, go to the driver.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import bpe

#: Families of closely related languages; a language that is not named here is a family of its own.
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
            "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
            "pl": "slavic", "cs": "slavic", "ru": "slavic", "uk": "slavic", "bg": "slavic"}
BINS = 1 << 12
PER_LANGUAGE = 300
UNDETERMINED = "und"

_RANDOM = np.random.default_rng(7)
_TABLES = _RANDOM.integers(0, BINS, size=(3, 256), dtype=np.uint16)


def _folded() -> np.ndarray:
    fold = np.arange(256)
    fold[65:91] += 32
    fold[48:58] = 48
    return fold


_TABLES = _TABLES[:, _folded()]


class Separator(NamedTuple):
    """A linear classifier: above zero for ``over``, else for ``under``."""

    over: str
    under: str
    weights: np.ndarray
    bias: float


class Model(NamedTuple):
    families: list[Separator]
    languages: list[Separator]
    family_of: dict[str, str]
    #: For each language, by bin: log of its share of trigrams against an even share, divided by the mean over its own.
    profiles: dict[str, np.ndarray] = {}


def bins(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each byte trigram of all texts; BINS stands for the places where none begins. And the texts' offsets."""
    data, at = bpe.string_bytes(texts)
    found = np.full(len(data), BINS, dtype=np.uint16)
    if len(data) > 2:
        found[:-2] = _TABLES[0][data[:-2]] ^ _TABLES[1][data[1:-1]] ^ _TABLES[2][data[2:]]
    ends, sizes = at[1:], np.diff(at)
    found[ends[sizes > 0] - 1] = BINS
    found[ends[sizes > 1] - 2] = BINS
    return found, at


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, np.ndarray]]:
    """Trigram shares of a bounded sample of labelled rows that are not held out."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    scale = 1 << 30
    below = F.lit(0)
    for lang, n in counts.items():
        below = F.when(F.col("lang") == lang, int(scale * min(1.0, 1.3 * per_language / n))).otherwise(below)
    order = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(scale))
    chosen = usable.where(order < below).select("lang", F.col("text").cast("string").alias("text"), order.alias("order")).limit(2 * per_language * max(1, len(counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, at = bins(batch.column("text"))
            shares = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                tally = np.bincount(found[a:b], minlength=BINS + 1)[:BINS]
                shares.append((tally / max(1, tally.sum())).astype(np.float32).tobytes())
            yield pa.record_batch([batch.column("lang"), batch.column("order"), pa.array(shares, pa.binary())], names=["lang", "order", "shares"])

    rows: dict[str, list[tuple[int, bytes]]] = {}
    for r in chosen.mapInArrow(run, "lang string, order long, shares binary").toLocalIterator():
        rows.setdefault(r["lang"], []).append((r["order"], bytes(r["shares"])))
    return [(lang, np.stack([np.frombuffer(x, dtype=np.float32) for _, x in sorted(rows.pop(lang))[:per_language]])) for lang in sorted(rows)]


def separator(over: str, x: np.ndarray, under: str, y: np.ndarray, rounds: int = 300, penalty: float = 1e-3) -> Separator:
    """A linear support vector machine by subgradient descent on the hinge loss, classes weighted alike."""
    rows = np.vstack((x, y))
    spread = np.sqrt(np.maximum(0, np.einsum("ij,ij->j", rows, rows, dtype=np.float64) / len(rows) - rows.mean(axis=0, dtype=np.float64) ** 2))
    scale = np.where(spread > 0, 1 / (spread + 1e-4), 0).astype(np.float32)
    middle = rows.mean(axis=0, dtype=np.float64).astype(np.float32)
    rows -= middle
    rows *= scale / np.float32(np.sqrt(BINS))
    sign = np.repeat(np.array([1.0, -1.0], dtype=np.float32), (len(x), len(y)))
    share = np.repeat(np.array([0.5 / len(x), 0.5 / len(y)], dtype=np.float32), (len(x), len(y)))
    w, b, mean_w, mean_b = np.zeros(BINS, dtype=np.float32), 0.0, np.zeros(BINS, dtype=np.float32), 0.0
    for k in range(rounds):
        rate = 1 / (penalty * (k + 20))
        wrong = sign * (rows @ w + b) < 1
        pull = np.where(wrong, sign * share, 0).astype(np.float32)
        w = (1 - rate * penalty) * w + rate * (pull @ rows)
        b += 0.1 * float(pull.sum())
        norm = np.linalg.norm(w) * np.sqrt(penalty)
        w = w / max(1.0, norm)
        if k >= rounds // 2:
            mean_w, mean_b = mean_w + w, mean_b + b
    count = rounds - rounds // 2
    w, b = mean_w / count * scale / np.sqrt(BINS), mean_b / count
    return Separator(over, under, np.append(w, 0).astype(np.float32), float(b - middle @ w))


def fit(labelled: list[tuple[str, np.ndarray]], families: dict[str, str] = FAMILIES) -> Model:
    """All one-versus-one separators between families, and between the languages of each family."""
    family_of = {lang: families.get(lang, lang) for lang, _ in labelled}
    profiles = {lang: profile(rows) for lang, rows in labelled}
    kin: dict[str, list[np.ndarray]] = {}
    for lang, rows in labelled:
        kin.setdefault(family_of[lang], []).append(rows)
    grouped = [(f, np.vstack(rows)) for f, rows in sorted(kin.items())]
    between = [separator(a, x, b, y) for (a, x), (b, y) in itertools.combinations(grouped, 2)]
    within = [separator(a, x, b, y) for (a, x), (b, y) in itertools.combinations(labelled, 2) if family_of[a] == family_of[b]]
    return Model(between, within, family_of, profiles)


def profile(rows: np.ndarray) -> np.ndarray:
    mean = rows.mean(axis=0, dtype=np.float64)
    log = np.log(0.99 * mean * BINS + 0.01)
    return np.append(log / max(1e-6, float(mean @ log)), 0).astype(np.float32)


def likeness(texts: pa.Array, model: Model) -> np.ndarray:
    """How much each text's trigrams are like those of the learned language they fit best: about 1 for that language,
    below 0 for one that was not learned. Short texts have the benefit of the doubt: 2 / sqrt(trigrams) is added."""
    found, at = bins(texts)
    best = np.full(len(texts), -np.inf)
    full = np.flatnonzero(np.diff(at) > 0)
    sizes = np.maximum(1, np.diff(at)[full] - 2)
    for p in model.profiles.values():
        best[full] = np.maximum(best[full], np.add.reduceat(p[found], at[:-1][full], dtype=np.float64) / sizes + 2 / np.sqrt(sizes))
    return best


def chosen(names: list[str], separators: list[Separator], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the name with most votes (then the greatest sum of margins), and how surely: 0 to 1."""
    votes = np.zeros((len(values), len(names)))
    margins = np.zeros((len(values), len(names)))
    worst = np.full((len(values), len(names)), np.inf)
    for k, s in enumerate(separators):
        for name, v in ((s.over, values[:, k]), (s.under, -values[:, k])):
            j = names.index(name)
            votes[:, j] += v > 0
            margins[:, j] += np.tanh(v)
            worst[:, j] = np.minimum(worst[:, j], v)
    best = (votes + margins / (2 * len(names) + 1)).argmax(axis=1)
    least = worst[np.arange(len(values)), best]
    return best, 1 / (1 + np.exp(-np.clip(4 * least, -50, 50)))


def scored(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """Predicted language and score of each text without nulls that has a letter."""
    found, at = bins(texts)
    separators = model.families + model.languages
    values = np.zeros((len(texts), len(separators)))
    full = np.flatnonzero(np.diff(at) > 0)
    sizes = np.maximum(1, np.diff(at)[full] - 2)
    for k, s in enumerate(separators):
        values[full, k] = np.add.reduceat(s.weights[found], at[:-1][full], dtype=np.float64) / sizes
        values[:, k] += s.bias
    names = sorted(set(model.family_of.values()))
    n = len(model.families)
    family, sure = chosen(names, model.families, values[:, :n])
    out = np.empty(len(texts), dtype=object)
    score = np.zeros(len(texts))
    for j, name in enumerate(names):
        rows = np.flatnonzero(family == j)
        own = sorted(lang for lang, f in model.family_of.items() if f == name)
        within = [k for k, s in enumerate(model.languages) if s.over in own]
        best, certain = chosen(own, [model.languages[k] for k in within], values[np.ix_(rows, [n + k for k in within])])
        out[rows] = np.array(own, dtype=object)[best]
        score[rows] = sure[rows] * certain
    return out.tolist(), score


def predict(docs: DataFrame, model: Model, text_col: str = "text", least: float | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``lang_score`` to every row. A text whose likeness is below ``least`` is ``und`` also.

    A text that is null or has no letter is ``und`` with score 0; so is every text if nothing was learned. Very short
    texts get whatever their few trigrams say. Repeated rows are scored alike; other columns stay as they are, but for those
    that have the names of the added ones, which are replaced.
    """
    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "lang_score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bpe.blocks(whole, text_col):
                texts = batch.column(text_col)
                usable = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))
                lang = np.full(len(texts), UNDETERMINED, dtype=object)
                score = np.zeros(len(texts))
                if model.family_of and usable.any():
                    chosen_texts = texts.filter(pa.array(usable))
                    lang[usable], score[usable] = scored(chosen_texts, model)
                    if least is not None:
                        strange = np.flatnonzero(usable)[likeness(chosen_texts, model) < least]
                        lang[strange], score[strange] = UNDETERMINED, 0
                columns = [batch.column(f.name) for f in fields]
                yield pa.record_batch([*columns, pa.array(lang.tolist(), pa.string()), pa.array(score)], names=[*(f.name for f in fields), "lang_pred", "lang_score"])

    kinds = StructType([*fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())])
    return docs.select(*(F.col(f"`{f.name}`") for f in fields)).mapInArrow(run, kinds)


def learned(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    return fit(sample(docs, per_language))


def identify(docs: DataFrame) -> DataFrame:
    """One row a document: ``doc_id, held_out, lang_pred, score``."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return predict(slim, learned(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
