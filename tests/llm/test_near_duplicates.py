import numpy as np

from cellforge.llm import embdedup, knn, minhash
from pyspark.sql import functions as F

from .cases import collected, component_of, documents, empty, numbered, rows, shingle_set


def test_minhash_equals_brute_force(spark):
    given = [(i, t) for i, t in rows() if i is not None]
    sets = {i: shingle_set(t) for i, t in given}
    comp = component_of(sorted(sets), lambda i, j: sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]))
    want = sorted([(i, len(shingle_set(t)), comp[i], comp[i] == i) for i, t in given])
    got = collected(minhash.deduplicate(documents(spark)), "doc_id", "n_shingles", "component_id", "kept")
    assert [r for r in got if r[0] is not None] == want
    assert [(r[2], r[3]) for r in got if r[0] is None] == [(None, True)] * 2
    assert sum(not r[3] for r in want) > 20


def test_minhash_large_groups_and_empty_table(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(40)]
    given = []
    for i in range(90):
        w = list(base)
        for k in rng.choice(40, size=int(rng.integers(0, 4)), replace=False):
            w[k] = f"x{rng.integers(1000)}"
        given.append((i, " ".join(w)))
    sets = {i: shingle_set(t) for i, t in given}
    comp = component_of(sorted(sets), lambda i, j: 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]))
    monkeypatch.setattr(minhash, "SKETCH_BLOCK", 32)
    monkeypatch.setattr(minhash, "SET_BLOCK", 16)
    got = collected(minhash.deduplicate(documents(spark, given)), "doc_id", "component_id")
    assert got == sorted(comp.items())
    assert minhash.deduplicate(empty(spark)).count() == 0


def test_minhash_of_documents_that_share_an_id(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    got = collected(minhash.deduplicate(documents(spark, [(5, a), (5, b), (8, a + " x"), (9, b + " more"), (9, b + " more"), (11, "c d e f g h")])), "doc_id", "component_id")
    assert got == [(5, 5), (5, 5), (8, 5), (9, 5), (9, 5), (11, 11)]
    got = collected(minhash.deduplicate(documents(spark, [(3, a), (5, a), (5, b), (7, b)])), "doc_id", "component_id", "kept")
    assert got == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False)]


def test_minhash_finds_nearly_all_links_of_a_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: shingle_set(r.text) for r in docs.collect()}
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    shared = {}
    for ids in where.values():
        for k, i in enumerate(ids):
            for j in ids[k + 1 :]:
                shared[i, j] = shared.get((i, j), 0) + 1
    links = {p for p, n in shared.items() if 100 * n >= 75 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    comp = component_of(sorted(sets), lambda i, j: (i, j) in links or (j, i) in links)
    got = dict(collected(minhash.deduplicate(docs), "doc_id", "component_id"))
    assert len(links) > 50
    assert sum(got[i] == comp[i] for i in comp) >= 0.99 * len(comp) and all(got[i] >= comp[i] for i in comp)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 62, size=3000, dtype=np.uint64)
    for shared in (0, 500, 900):
        a, b = pool[:1000], pool[1000 - shared : 2000 - shared]
        both = np.concatenate((a, b))
        s = minhash.sketches(np.concatenate((a, b, both)), np.array([0, 1000, 2000, 4000]))
        assert (minhash.merged(s[0], s[1]) == s[2]).all()
        greater, less = np.array([(s[0] > s[1]).sum()]), np.array([(s[0] < s[1]).sum()])
        value = minhash.estimated(greater, less, np.array([1000.0]), np.array([1000.0]))[0]
        assert abs(value - shared / (2000 - shared)) < 0.12


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, 16))
    out = []
    for k in range(40):
        for j in range(4):
            noise = 0 if j == 1 else 0.08 * j
            out.append((base[k] + noise * rng.normal(size=16)).astype(np.float32).tolist())
    return out


def tables(spark):
    given = [(i * 5, v, 1, 7, 1) for i, v in enumerate(vectors())]
    odd = [(1001, None, 1, 1, 1), (1002, [], 1, 1, 1), (1003, [0.0] * 16, 1, 1, 1), (1004, [float("nan")] + [1.0] * 15, 1, 1, 1), (1005, [None] + [1.0] * 15, 1, 1, 1), (1006, [1.0, 2.0], 1, 1, 1), (1007, [float("inf")] + [1.0] * 15, 1, 1, 1)]
    return given, odd, numbered(spark, given + odd).repartition(3)


def test_embeddings_equal_brute_force(spark):
    given, odd, df = tables(spark)
    x = np.array([v for _, v, *_ in given], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    comp = component_of(list(range(len(x))), lambda i, j: near[i, j])
    want = [(given[i][0], int(near[i].sum()), given[comp[i]][0], comp[i] == i) for i in range(len(x))]
    want += [(i, 0, i, True) for i, *_ in odd]
    got = collected(embdedup.deduplicate(df, block=8), "vec_id", "n_links", "component_id", "kept")
    assert got == sorted(want)
    assert sum(r[1] > 0 for r in want) > 50
    assert embdedup.deduplicate(df.limit(0)).count() == 0


def test_embeddings_that_share_an_id_and_recall(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    df = numbered(spark, [(i, v, 1, 7, 1) for i, v in ((5, a), (5, b), (8, a), (3, b), (9, [0.0, 0.0, 1.0]), (None, a))])
    got = collected(embdedup.deduplicate(df), "vec_id", "n_links", "component_id", "kept")
    assert got == [(3, 1, 3, True), (5, 1, 3, False), (5, 1, 3, False), (8, 1, 3, False), (9, 0, 9, True), (None, 0, None, True)]
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 64))
    x[1000:2000] = x[:1000] + rng.normal(size=(1000, 64)) * 0.3  # cosines about the threshold
    x = x.astype(np.float32)
    found = {r.vec_id: r.n_links for r in embdedup.deduplicate(numbered(spark, [(i, v.tolist(), 1, 7, 1) for i, v in enumerate(x)])).collect()}
    x = x.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.95).sum(axis=1) - 1
    assert sum(found.values()) >= 0.99 * want.sum() > 500
    assert all(found[i] <= n for i, n in enumerate(want))


def test_top_k_equals_brute_force(spark):
    given, odd, df = tables(spark)
    ids = np.array([i for i, *_ in given] + [1003])
    v = np.floor(256 * np.array([v for _, v, *_ in given] + [[0.0] * 16], dtype=np.float64)).astype(np.int64)
    want = []
    for q in np.flatnonzero(ids % 50 == 0):
        s = v @ v[q]
        others = np.flatnonzero(ids != ids[q])
        best = others[np.lexsort((ids[others], -s[others]))][:5]
        want += [(int(ids[q]), k + 1, int(ids[j]), int(s[j])) for k, j in enumerate(best)]
    two = v[0][:2].astype(float)  # vectors of two components have each other only
    for block in (16, 4096):
        got = collected(knn.top_k(df, F.col("id") % 50 == 0, block=block), "query_id", "rank", "vec_id", "score")
        assert got == sorted(want)
    assert knn.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0
    assert knn.top_k(df.where("vec_id <= 10"), F.col("id") % 50 == 0).count() == 2
    short = numbered(spark, [(50, two.tolist(), 1, 7, 1), (51, [1.0, 2.0], 1, 7, 1), (52, [1.0, 2.0, 3.0], 1, 7, 1), (100, [2.0, 0.0, 1.0], 1, 7, 1)])
    got = collected(knn.top_k(short, F.col("id") % 50 == 0), "query_id", "rank", "vec_id")
    assert got == [(50, 1, 51), (100, 1, 52)]


def test_top_k_scores_few_pairs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    v = np.floor(256 * np.array([r.embedding for r in rows], dtype=np.float64)).astype(np.int64)
    asks = ids % 50 == 0
    pool = np.random.default_rng(1).permutation(len(ids))[:1024]
    least = knn.sample_bound(v[asks], ids[pool], v[pool], ids[asks], 5)
    i, j = knn.reaching(v[asks], v, least, knn.principal(v[pool]), 48)
    score = v[asks] @ v.T
    true = np.sort(np.where(ids[asks][:, None] == ids, -(1 << 40), score), axis=1)[:, -5]
    kept = np.zeros(score.shape, dtype=bool)
    kept[i, j] = True
    assert (kept | (score < true[:, None])).all() and (least <= true).all()
    assert len(i) <= score.size / 3
