import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from cellforge.llm import langid

from .cases import component_of, edit_distance, shingle_set
from .test_texts import plain_spans


def redacted(text):
    out, at = "", 0
    for a, _, b, _ in plain_spans(text):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1500")
    model = langid.learned(docs)
    extra = docs.limit(3).collect()
    odd = [(9001, None, "en", "s", 0), (9002, "12345 67890", "en", "s", 0), (9003, "", None, None, None), (None, "The words of this one are new ringtones", "en", "s", 0)]
    odd += [(9100 + k, r["text"] + (" more" if k else ""), r["lang"], r["source"], r["n_chars"]) for k, r in enumerate(extra)]
    single_line = "The " + " ".join(f"{a}{b}" for a in ("house", "river", "window", "garden", "winter", "morning") for b in ("s", "land", "ward", "side", "keeper", "like", "less", "ful"))
    odd += [(9200, single_line, "en", "s", 0), (9201, single_line.replace("gardenward", "quite different"), "en", "s", 0)]  # alike, but for more than an edit
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = []
    for i, t in rows:
        if t and re.search(r"[^\W\d_]", t):
            kept.append((i, t))
    lines = sorted((i, k, x) for i, t in kept if i is not None for k, x in enumerate(t.split("\n")) if x.strip())
    gone = set()
    by_length = {}
    for i, k, x in lines:
        near = (y for n in (len(x) - 1, len(x), len(x) + 1) for y in by_length.get(n, ()))
        if any(x == y or (min(len(x), len(y)) >= 20 and abs(len(x) - len(y)) <= 1 and sum(a != b for a, b in zip(x, y, strict=False)) < len(x) // 2 + 2 and edit_distance(x, y) <= 1) for y in near):
            gone.add((i, k))
        by_length.setdefault(len(x), []).append(x)
    cut = []
    for i, t in kept:
        left = [x for k, x in enumerate(t.split("\n")) if (i, k) not in gone]
        text = "\n".join(left)
        if len(left) == t.count("\n") + 1 or re.search(r"\S", text):
            cut.append((i, text))
    sets = {i: shingle_set(t) for i, t in cut if i is not None}
    comp = component_of(sorted(sets), lambda i, j: sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]))
    single = [(i, t) for i, t in cut if i is None or comp[i] == i]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for i, t in single:
        ids = np.array([*library.encode(redacted(t), add_special_tokens=False).ids, 0], dtype="<u4")
        count = -(-len(ids) // 2048)
        at = [0, *(len(ids) - 2048 * k for k in range(count - 1, -1, -1))]
        want |= {(i, k, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))}

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert model.family_of
    assert {(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    assert len(single) < len(cut) < len(kept) < len(rows)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "near-duplicates", "secret scan", "packing"]


def test_texts_of_no_learned_language_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    foreign = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "xqzj kvwq zzxk qjvx wkqz jxqv zkwj qxvz kjzq wxvk " * 4,
    ]
    odd = [(9001 + k, t, None, "s", 0) for k, t in enumerate(foreign)] + [(9100, "All human beings are born free and equal in dignity and rights.", None, "s", 0)]
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.union(spark.createDataFrame(odd, docs.schema)), "").collect()}
    with_letter = {r["doc_id"] for r in docs.collect() if re.search(r"[^\W\d_]", r["text"] or "")}
    assert kept == with_letter | {9100}
