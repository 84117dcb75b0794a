import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import ann as N

SF = "/root/testdata/sf0.1"


def brute(ids, x, q, k=20):
    out = {}
    for i in q:
        s = N.inner(x, x[ids == i][0])
        ok = ids != i
        out[int(i)] = list(zip(ids[ok][np.lexsort((ids[ok], -s[ok]))[:k]].tolist(), sorted(s[ok].tolist(), reverse=True)[:k]))
    return out


def test_recall_and_scores(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.filter("embedding IS NOT NULL").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    for shard_rows in (16_384, 700):
        got = N.search(df, F.expr("vec_id % 20 = 0"), shard_rows=shard_rows).collect()
        want = brute(ids, x, ids[ids % 20 == 0])
        mine = {}
        for r in got:
            mine.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert set(mine) == set(want)
        hits = 0
        for q, rs in mine.items():
            rs.sort()
            assert [r[0] for r in rs] == list(range(1, 21))
            assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(rs, rs[1:]))
            for _, v, s in rs:
                assert s == float(N.inner(x[ids == v], x[ids == q][0])[0])
            hits += len({v for _, v, _ in rs} & {v for v, _ in want[q]})
        assert hits / sum(map(len, want.values())) >= 0.9


def test_few_and_invalid(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (20, [-1.0, 0.0]), (None, [1.0, 1.0]), (8, [1.0]), (9, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = [tuple(r) for r in N.search(df, F.expr("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 0.5), (0, 3, 20, -1.0), (20, 1, 2, -0.5), (20, 2, 0, -1.0), (20, 3, 1, -1.0)]
    assert N.search(df.limit(0), F.expr("vec_id % 20 = 0")).count() == 0


def test_larger_norms_win(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 8)) * rng.uniform(0.2, 5, (400, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = N.search(df, F.expr("vec_id % 20 = 0"), k=5, block=7).collect()
    want = brute(np.arange(400), x, range(0, 400, 20), 5)
    hit = sum(r.vec_id in [v for v, _ in want[r.query_id]] for r in got)
    assert hit / sum(map(len, want.values())) >= 0.9


def test_repeated_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((120, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    extra = [(20, x[20].tolist()), (20, x[20].tolist()), (40, (2 * x[41]).tolist()), (7, x[7].tolist()), (7, (-x[7]).tolist()), (5, x[5].tolist())]
    df = spark.createDataFrame(rows + extra, "vec_id long, embedding array<double>")
    every = rows + extra
    for shard_rows in (16_384, 30):
        got = {}
        for r in N.search(df, F.expr("vec_id % 20 = 0"), shard_rows=shard_rows, recall=1.0).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert set(got) == set(range(0, 120, 20))
        for q, found in got.items():
            best = {}
            for i, v in every:
                if i != q:
                    for j, w in every:
                        if j == q:
                            best[i] = max(best.get(i, -np.inf), float(N.inner(np.array([v]), np.array(w))[0]))
            want = sorted(best.items(), key=lambda t: (-t[1], t[0]))[:20]
            found.sort()
            assert [f[0] for f in found] == list(range(1, 21)) and len({f[1] for f in found}) == 20
            assert len({f[1] for f in found} & {w[0] for w in want}) >= 19
            assert all(abs(s - best[v]) < 1e-12 for _, v, s in found)
