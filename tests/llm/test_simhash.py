import random

import numpy as np
import xxhash

from sparkloom.llm import simhash as S


def brute_fp(text, width=4):
    words = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    out = 0
    for bit in range(64):
        out |= (sum(h >> bit & 1 for h in hs) * 2 > len(hs)) << bit
    return out


def brute_components(fps, t):
    root = {i: i for i in range(len(fps))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= t:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("häß a b c",)], "s string").select(F.xxhash64("s")).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest("häß a b c".encode(), 42)


def test_against_brute_force(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(1, 120))]
        texts.append(" ".join(words))
        for _ in range(rnd.randint(0, 4)):
            other = list(words)
            other[rnd.randrange(len(other))] = "Edited"
            texts.append("  ".join(other))
    texts += [None, "", " \t\n", "A b\x0bC", "a B c", texts[0], texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("x", "x")
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in S.near_duplicates(df).collect()}
    fps = [brute_fp(t) for t in texts]
    assert {i: v[0] for i, v in got.items()} == dict(enumerate(fps))
    assert {i: v[1] for i, v in got.items()} == dict(enumerate(brute_components(fps, 4)))


def test_blocking_loses_no_link(spark):
    rnd = random.Random(1)
    for n in (10, 10**5, 10**7, 10**12):
        tables = S.blocking(n, 4)
        for _ in range(200):
            diff = sum(1 << b for b in rnd.sample(range(64), 4))
            assert any(m & diff == 0 for m in tables)


def test_links_with_all_block_schemes(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    fps = sorted({int(b) ^ (1 << int(k)) if k < 63 else int(b) for b in base for k in rng.integers(0, 64, 4)})
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 4}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for mean in (48, 0.0001):
        monkeypatch.setattr(S, "blocking", lambda n, t, m=mean: S_blocking(n, t, m))
        assert {tuple(r) for r in S.links(df).distinct().collect()} == want


S_blocking = S.blocking


def test_components_long_chain(spark):
    edges = [(i + 1, i) for i in range(200)] + [(500, 501), (7, 7)]
    got = dict(tuple(r) for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(201)) and got[501] == 500 and got[500] == 500


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, fp string, component_id int")
    assert S.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e", "x"), (3, "a b c d e", "y"), (3, "a b c d e", "z"), (None, None, "w")], "doc_id long, text string, fp string")
    rows = S.near_duplicates(df).collect()
    assert len(rows) == 4 and sorted(str(r.component_id) for r in rows) == ["3", "3", "3", "None"]


def test_components_of_a_very_long_chain(spark):
    n = 10_000
    edges = spark.range(n).selectExpr("id AS a", "id + 1 AS b")
    got = S.components(edges).groupBy("root").count().collect()
    assert [(r.root, r["count"]) for r in got] == [(0, n + 1)]
