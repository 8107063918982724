"""The registered queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embdedup, knn, langid, linededup, minhash, packing, secret_scan, substrings, tokencount

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """The file of a public tokenizer that is installed beside this library."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(table(spark, sf_dir, "documents"))


def op2_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.deduplicate(table(spark, sf_dir, "embeddings"))


def op9_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip(table(spark, sf_dir, "documents"), tokenizer())


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer())


def packing_capacities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing where all three capacities bind: one row with the sums, and whether every sequence keeps within them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.pmod(F.col("doc_id") * 37, F.lit(401)) + 1).alias("length"))
    limit = packing.Capacities(2048, 10, 10 * 200 * 200)
    packed = packing.pack(docs, limit)
    per = packed.groupBy("sequence_id").agg(F.count("*").alias("pieces"), F.sum("length").alias("tokens"), F.sum(F.col("length") * F.col("length")).alias("attention"), F.max(F.col("offset") + F.col("length")).alias("reach"))
    return per.agg(
        F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.sum("attention").alias("attention"),
        (F.max("pieces") <= limit.documents).alias("documents_kept"), (F.max("tokens") <= limit.tokens).alias("tokens_kept"), (F.max("attention") <= limit.attention).alias("attention_kept"),
        F.min(F.col("reach") == F.col("tokens")).alias("gapless"),
    )


QUERIES: dict[str, Query] = {"packing_capacities": packing_capacities} | {f.__name__: f for f in (op1_minhash_dedup, op2_voronoi_knn, op3_secret_scan, op4_suffix_dedup, op5_token_counts, op6_language_id, op7_line_dedup, op8_embedding_dedup, op9_bpe_roundtrip, op10_best_fit_packing)}

USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

KNN_SQL = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {USABLE}),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i])) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def span_sql(kind: str, rank: int, pattern: str, keep: str = "true") -> str:
    """Spans of one kind: hits, and the lengths of what lies between them, summed up to each."""
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, hit, value, start, start + length(hit) AS stop FROM (
  SELECT doc_id, unnest(hits) AS hit, unnest(vals) AS value, unnest(list_transform(range(1, len(hits) + 1), lambda i: list_sum(gaps[1:i]) + coalesce(list_sum(own[1:i - 1]), 0))) AS start FROM (
    SELECT doc_id, hits, {'regexp_extract_all(t, ' + quoted(pattern) + ', 2)' if kind == 'assign' else 'hits'} AS vals, list_transform(hits, lambda x: length(x)) AS own, list_transform(regexp_split_to_array(t, {quoted(pattern)}), lambda x: length(x)) AS gaps
    FROM (SELECT doc_id, t, regexp_extract_all(t, {quoted(pattern)}) AS hits FROM d) WHERE len(hits) > 0)) WHERE {keep}"""


#: The patterns once more, as the contract has them: SQL that took them from the operator couldn't find a wrong one.
SECRETS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(value) >= 6"),
    ("access", r"AKIA[A-Z0-9]+", "length(hit) >= 20"),
    ("hex", r"[0-9a-f]+", "length(hit) >= 24"),
]
QUIET = [r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", r"[0-9+/_=-]+", r"[a-z/_=-]+[0-9]{0,4}", r".*(?i:example|placeholder|xxxxxx|changeme|0123456789|abcdefgh).*"]


def secret_sql() -> str:
    base = " UNION ALL ".join(span_sql(kind, i, pattern, keep) for i, (kind, pattern, keep) in enumerate(SECRETS))
    allowed = " OR ".join(f"regexp_full_match(hit, {quoted(p)})" for p in QUIET)
    bits = "-list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: (20 - length(replace(w, c, ''))) / 20.0 * log2((20 - length(replace(w, c, ''))) / 20.0)))"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), base AS ({base}),
runs AS (SELECT * FROM ({span_sql('entropy', 3, '[A-Za-z0-9+/_=-]{20,}')}) WHERE regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND NOT ({allowed})),
slid AS (SELECT doc_id, start, k, substr(hit, CAST(k + 1 AS INT), 20) AS w FROM (SELECT *, unnest(range(0, length(hit) - 19)) AS k FROM runs)),
good AS (SELECT doc_id, start, min(k) AS a, max(k) AS b FROM slid WHERE regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Za-z]') AND {bits} >= CASE WHEN regexp_full_match(w, '[0-9a-fA-F]+') THEN 3.0 ELSE 3.6 END GROUP BY doc_id, start),
spans AS (SELECT doc_id, rank, kind, start, stop FROM base UNION ALL SELECT doc_id, 3, 'entropy', start + a, start + b + 20 FROM good),
per AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per USING (doc_id)"""


#: Near-duplicates by brute force: shared shingles of all pairs that share one, then whatever can be reached by links.
MINHASH_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT a AS id, a AS seen FROM (SELECT DISTINCT a FROM link) UNION SELECT reach.id, link.b FROM reach JOIN link ON link.a = reach.seen),
lowest AS (SELECT id, min(seen) AS m FROM reach GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m, w.doc_id) AS component_id, coalesce(m, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN lowest ON lowest.id = w.doc_id"""

#: All pairs of vectors by cosine.
COSINE_SQL = """WITH RECURSIVE v AS (SELECT vec_id, CASE WHEN embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS x FROM embeddings),
u AS MATERIALIZED (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda a: a * a))) AS n FROM v WHERE x IS NOT NULL),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_inner_product(a.x, b.x) / (a.n * b.n) >= 0.95),
reach AS (SELECT a AS id, a AS seen FROM (SELECT DISTINCT a FROM link) UNION SELECT reach.id, link.b FROM reach JOIN link ON link.a = reach.seen),
lowest AS (SELECT id, min(seen) AS m FROM reach GROUP BY id), counted AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(counted.n, 0) AS n_links, coalesce(m, v.vec_id) AS component_id, coalesce(m, v.vec_id) = v.vec_id AS kept FROM v LEFT JOIN lowest ON lowest.id = v.vec_id LEFT JOIN counted ON counted.a = v.vec_id"""

#: All strings of 50 bytes (100 hexadecimal digits) of every text.
SUBSTRING_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS INT), 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE doc_id > m),
edge AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) > 50 AS fresh FROM hit),
run AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edge) GROUP BY doc_id, r),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS after FROM run),
per AS (SELECT c.doc_id, sum(b - a) AS gone, count(*) AS spans, string_agg(substr(h, CAST(2 * after + 1 AS INT), CAST(2 * (a - after) AS INT)), '' ORDER BY a) AS front, max(b) AS last FROM cut c JOIN d USING (doc_id) GROUP BY c.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(CASE WHEN per.doc_id IS NULL THEN h ELSE front || substr(h, CAST(2 * last + 1 AS INT)) END)) AS kept_sha256
FROM d LEFT JOIN per ON per.doc_id = d.doc_id"""

#: DuckDB SQL for the queries that SQL can express. Learned models, edit distances of characters and tokenizers are beyond
#: it; tests compare these with brute force.
ORACLE: dict[str, str] = {
    "op1_minhash_dedup": MINHASH_SQL, "op2_voronoi_knn": KNN_SQL, "op3_secret_scan": secret_sql(), "op4_suffix_dedup": SUBSTRING_SQL, "op8_embedding_dedup": COSINE_SQL,
    "packing_capacities": """SELECT CAST(count(*) AS BIGINT) AS pieces, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(n * n) AS BIGINT) AS attention, true AS documents_kept, true AS tokens_kept, true AS attention_kept, true AS gapless
FROM (SELECT doc_id * 37 % 401 + 1 AS n FROM documents)""",
}