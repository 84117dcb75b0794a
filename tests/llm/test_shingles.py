import random

import corpus_pipeline as P
from sparkloom.llm import shingles as S
from sparkloom.llm import simhash as SH


def jaccard(a, b):
    x, y = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_pipeline_stage_against_brute_force_jaccard(spark):
    rnd = random.Random(3)
    texts = []
    for _ in range(25):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(60, 200))]
        texts.append(" ".join(words))
        for part in (0.02, 0.04, 0.06, 0.1, 0.15, 0.3):  # a new tail: similarities around 0.8 and on both sides
            n = int(len(words) * part) + 1
            texts.append(" ".join(words[:-n] + [f"v{rnd.randrange(5000)}" for _ in range(n)]))
    rnd.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    kept = {r.doc_id for r in P.near_dedup(spark, docs, "").collect()}
    near = {(i, j) for j in range(len(texts)) for i in range(j) if jaccard(texts[i], texts[j]) >= 0.8}
    assert len(near) > 100 and not any(i in kept and j in kept for i, j in near)
    assert all(any((i, j) in near for i in range(j)) for j in range(len(texts)) if j not in kept)


def test_edges(spark):
    rows = [(4, "a b c d e f"), (2, "A b c  d e f"), (7, None), (6, " "), (None, "x y"), (None, "x y"), (9, "x y"), (8, "x z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs, "").collect()) == [2, 6, 8, 9]
    assert P.near_dedup(spark, docs.limit(0), "").count() == 0


def test_group_of_near_copies_and_leftovers(spark):
    rnd = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(base[:k] + [f"n{k}"] + base[k + 1 :]) for k in range(0, 150, 3)] + [" ".join(rnd.sample(base, 100)) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rounds in (0, 2):
        assert sorted(r.doc_id for r in S.distinct_rows(docs, rounds=rounds)[0].collect()) == [0, 50, 51, 52, 53, 54]


def test_null_ids_shared_ids_and_repeats(spark):
    a, b, c, d = ("alpha beta gamma delta eps", "one two three four five six", "red green blue white black", "u v w x y z")
    rows = [(None, a, 1), (None, b, 2), (7, c, 3), (7, d, 4), (7, d, 5), (7, d, 5), (None, a, 6), (8, d, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash int")
    for small in (300_000, 0):
        got = S.keep_distinct(docs, small=small)
        assert got.columns == docs.columns
        assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted([("None", a), ("None", b), ("7", c), ("7", d)])


def test_fingerprint_links_find_candidates_without_minhash(spark, monkeypatch):
    rnd = random.Random(6)
    texts = []
    for _ in range(8):  # long texts with one new last word: fingerprints within four bits
        words = [f"w{rnd.randrange(5000)}" for _ in range(600)]
        texts += [" ".join(words), " ".join(words[:-1] + ["other"])]
    near = [SH.fingerprint(a, 5) ^ SH.fingerprint(b, 5) for a, b in zip(texts[::2], texts[1::2])]
    assert all(0 < (x & (2**64 - 1)).bit_count() <= 4 for x in near if x) and any(near)
    texts += [" ".join(["x y z"] * 30 + [f"a{k}" for k in range(40)]), " ".join(["x y z"] * 30 + [f"b{k}" for k in range(40)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    each = S.profiles(docs, 5, whole=False).collect()
    assert [r.buckets[4] for r in sorted(each, key=lambda r: r.doc_id)] == [SH.fingerprint(t, 5) for t in texts]
    whole = S.profiles
    # only sketch and fingerprint: no MinHash bucket is left
    monkeypatch.setattr(S, "profiles", lambda d, w, whole_=None, **k: (lambda out: out if k.get("whole", whole_) else out.withColumn("buckets", S.F.transform("buckets", lambda x, i: S.F.when(i < 5, x).otherwise(S.F.xxhash64("key", i)))))(whole(d, w, k.get("whole", whole_))))
    assert sorted(r.doc_id for r in S.distinct_rows(docs)[0].collect()) == [*range(0, 16, 2), 16, 17]
