"""Secret scanning with DataFrame functions only: patterns, and sliding-window entropy over candidate strings.

Nothing is shuffled: each text is scanned where it is read. Patterns give the base spans (kinds assign, access, hex).
The entropy scan adds spans of kind entropy: in every candidate string (a long run of token characters), a window of
fixed width slides by one character; the counts of its characters, their sum of c * log2(c) and the numbers of
characters of each class are updated incrementally. A window passes if its Shannon entropy reaches the threshold of its
character class. Candidates that an allow-list pattern matches whole are suppressed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: The base patterns, in the order in which kinds sort.
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
#: Characters that group 2 of an assignment needs; the lengths of the other kinds are part of their patterns.
ASSIGN_LEAST = 6

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Bits a character from which a window passes: all hexadecimal digits; digits mixed with letters of one case or both.
HEX_BITS = 3.0
MIXED_BITS = 3.6
#: Whole candidates that are no secrets: UUIDs, dates and numbers with separators, lower-case paths and slugs, placeholders.
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[0-9+/_=-]+",
    r"[a-z/_=-]+[0-9]{0,4}",
    r".*(?i:example|placeholder|xxxxxx|changeme|0123456789|abcdefgh).*",
)


def positions(text: Column, pattern: str, hits: Column) -> Column:
    """Start and end (code points, end exclusive) of each of the ``hits`` of ``pattern`` in ``text``."""
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(hits)), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("own")))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    walked = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + p["gap"] + p["own"]).alias("at"),
            F.concat(a["spans"], F.array(F.struct((a["at"] + p["gap"]).alias("start"), (a["at"] + p["gap"] + p["own"]).alias("end")))).alias("spans"),
        ),
    )
    return F.when(F.size(hits) > 0, walked["spans"]).otherwise(empty)


def labelled(rank: int, kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def plogp(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def passing(candidate: Column, window: int, hex_bits: float, mixed_bits: float) -> Column:
    """struct(first, last): the 0-based starts of the first and last window that pass, null if none does."""
    zero = F.array_repeat(F.lit(0), len(ALPHABET) + 1)
    code = lambda at: F.instr(F.lit(ALPHABET), candidate.substr(at, F.lit(1)))
    begin = F.struct(
        zero.alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("digits"), F.lit(0).alias("letters"), F.lit(0).alias("hexes"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
    )

    def add(n: Column, c: Column, low: int, high: int, by: int) -> Column:
        return n + F.when(c.between(low, high), by).otherwise(0)

    def step(a: Column, at: Column) -> Column:
        enters = code(at)
        leaves = F.when(at > window, code(at - window)).otherwise(0)
        n_in, n_out = F.get(a["counts"], enters), F.get(a["counts"], leaves)
        same = enters == leaves
        counts = F.when(same, a["counts"]).otherwise(F.transform(a["counts"], lambda n, i: n + F.when((i == enters) & (i > 0), 1).otherwise(0) - F.when((i == leaves) & (i > 0), 1).otherwise(0)))
        total = F.when(same, a["sum"]).otherwise(a["sum"] + plogp(n_in + 1) - plogp(n_in) + F.when(leaves > 0, plogp(n_out - 1) - plogp(n_out)).otherwise(0.0))
        digits = add(add(a["digits"], enters, 53, 62, 1), leaves, 53, 62, -1)
        letters = add(add(a["letters"], enters, 1, 52, 1), leaves, 1, 52, -1)
        is_hex = lambda c: c.between(53, 62) | c.between(1, 6) | c.between(27, 32)
        hexes = a["hexes"] + F.when(is_hex(enters), 1).otherwise(0) - F.when(is_hex(leaves), 1).otherwise(0)
        bits = F.log2(F.lit(float(window))) - total / window
        good = (at >= window) & (digits > 0) & (letters > 0) & F.when(hexes == window, bits >= hex_bits).otherwise(bits >= mixed_bits)
        return F.struct(
            counts.alias("counts"), total.alias("sum"), digits.alias("digits"), letters.alias("letters"), hexes.alias("hexes"),
            F.when(good & a["first"].isNull(), at - window).otherwise(a["first"]).alias("first"), F.when(good, at - window).otherwise(a["last"]).alias("last"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.length(candidate)), begin, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))


def scan(docs: DataFrame, text_col: str = "text", window: int = WINDOW, hex_bits: float = HEX_BITS, mixed_bits: float = MIXED_BITS, allowed: tuple[str, ...] = ALLOWED, spans_col: str = "_spans") -> DataFrame:
    """Add ``_spans``: array of (start, rank, end, kind) in order of start, then kind, to every row of ``docs``.

    rank numbers the kinds: assign 0, access 1, hex 2, entropy 3. A null or empty text has no spans. All other columns
    stay as they are, whatever their names; one that has the name of the added column is replaced by it. An empty table
    stays empty.
    """
    others = [c for c in docs.columns if c.lower() != spans_col.lower()]
    hits = dict(zip([*PATTERNS, "entropy"], fresh(docs, *(f"_{k}" for k in PATTERNS), "_entropy"), strict=True))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    run = f"[{ALPHABET[:-1]}-]{{{window},}}"
    found = docs.select("*", *(F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(hits[k]) for k, p in PATTERNS.items()), F.regexp_extract_all(text, F.lit(run), F.lit(0)).alias(hits["entropy"]))
    spans = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        own = positions(text, pattern, F.col(hits[kind]))
        if kind == "assign":
            values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
            kept = F.filter(F.arrays_zip(own.alias("at"), values.alias("value")), lambda x: F.length(x["value"]) >= ASSIGN_LEAST)
            own = F.when(F.size(hits[kind]) > 0, F.transform(kept, lambda x: x["at"])).otherwise(own)
        spans.append(F.transform(own, labelled(rank, kind)))

    def candidate(at: Column, value: Column) -> Column:
        quiet = F.lit(False)
        for p in allowed:
            quiet = quiet | value.rlike(f"^(?:{p})$")
        worth = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~quiet
        return F.struct(at.alias("at"), F.when(worth, passing(value, window, hex_bits, mixed_bits)).alias("hit"))

    checked = F.zip_with(positions(text, run, F.col(hits["entropy"])), F.col(hits["entropy"]), candidate)
    passed = F.filter(checked, lambda x: x["hit"]["first"].isNotNull())
    worth_any = F.size(hits["entropy"]) > 0
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    added = F.transform(
        passed,
        lambda x: F.struct((x["at"]["start"] + x["hit"]["first"]).alias("start"), F.lit(3).alias("rank"), (x["at"]["start"] + x["hit"]["last"] + window).alias("end"), F.lit("entropy").alias("kind")),
    )
    spans.append(F.when(worth_any, added).otherwise(empty))
    return found.select(*(F.col(f"`{c}`") for c in others), F.array_sort(F.concat(*spans)).alias(spans_col))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace each maximal run of overlapping secret spans by ``[SECRET]``; columns stay, a null text stays null."""
    (spans_col,) = fresh(docs, "_spans")
    scanned = scan(docs, text_col, spans_col=spans_col)
    text = F.col(f"`{text_col}`").cast("string")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.when(s["start"] > a["at"], F.concat(text.substr(a["at"] + 1, s["start"] - a["at"]), F.lit("[SECRET]")))
        first = F.when((s["start"] == 0) & (a["at"] == 0), F.lit("[SECRET]"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], F.coalesce(gap, first, F.when(s["start"] >= a["at"], F.lit("[SECRET]")), F.lit(""))).alias("out"))

    clean = F.aggregate(spans_col, begin, step, lambda a: F.concat(a["out"], text.substr(a["at"] + 1, F.length(text))))
    value = F.when(F.size(spans_col) > 0, clean).otherwise(text)
    return scanned.select(*(value.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """One row a document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``."""
    scanned = scan(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("_spans", lambda s: s["rank"] < 3)
    return scanned.select("doc_id", *map(count, PATTERNS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"))
