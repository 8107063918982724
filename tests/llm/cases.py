"""Documents with the awkward cases that every operator must stand, and plain brute-force versions to compare with."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, n int, size int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(rng, n):
    return " ".join("".join(rng.choice(("ta", "re", "on", "shi", "mu", "é", "ku")) for _ in range(rng.randint(1, 4))) for _ in range(n))


def texts(seed=1):
    rng = random.Random(seed)
    base = [words(rng, rng.randint(20, 60)) for _ in range(12)]
    out = [None, "", " ", "\n\n", "one", "one two three", "ONE two THREE", "x" * 3000, "\ta\x0bb\x0cc\rd e f"]
    for b in base:
        w = b.split(" ")
        out += [b, b, b.upper() if b.isascii() else b + " end"]
        for _ in range(3):
            v = list(w)
            for _ in range(rng.randint(1, 3)):
                v[rng.randrange(len(v))] = words(rng, 1)
            out.append(" ".join(v))
        out.append(" ".join(w[: len(w) // 2]) + "\n" + words(rng, 10) + "\n" + " ".join(w[len(w) // 2 :]))
    out.append("\n".join(base[k % 12] + "." for k in range(30)))
    return out


def rows(seed=1):
    """(doc_id, text) with some null ids; ids aren't in order of the rows."""
    found = [((i * 37) % 1009, t) for i, t in enumerate(texts(seed))]
    return [*found, (None, texts(seed)[12]), (None, None), found[12]]


def documents(spark, given=None):
    data = [(i, t, "en", "s", 0, 5, "k", 1, 2) for i, t in (rows() if given is None else given)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=lambda r: tuple((x is None, x) for x in r))


def shingle_set(text, k=5):
    w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))]
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def component_of(ids, linked):
    """Smallest id reachable for each id, from a predicate on pairs."""
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def numbered(spark, vectors):
    return spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, id long, cell int").withColumn("v", F.lit(1))
