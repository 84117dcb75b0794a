import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import scalar as S
from sparkloom.operators import governance as G
from sparkloom.operators import graph as H
from sparkloom.operators import relational as R
from sparkloom.operators import search as X
from sparkloom.operators import series as T
from sparkloom.plans.queries import QUERIES
from sparkloom.sources import tables as IO


def vals(df, *order):
    return [tuple(r) for r in df.orderBy(*order or df.columns).collect()]


def test_join_kinds(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "b", 30)], "task int, wf string, cost int")
    right = spark.createDataFrame([("a", "P"), ("b", "D"), ("c", "I")], "wf_id string, team string")
    n = {k: R.join(left, right, [("wf", "wf_id")], k).count() for k in R.JOINS}
    assert n == {"INNER": 3, "LEFT_OUTER": 3, "RIGHT_OUTER": 4, "FULL_OUTER": 4, "LEFT_SEMI": 3, "LEFT_ANTI": 0, "CROSS": 3} or n["CROSS"] == 9
    assert R.join(left, right, [], "CROSS").count() == 9
    for algorithm in ("HASH", "SORT_MERGE", "BROADCAST"):
        assert R.join(left, right, [("wf", "wf_id")], "LEFT_ANTI", algorithm).count() == 0
        assert R.join(left, right, [("wf", "wf_id")], "RIGHT_OUTER", algorithm).count() == 4
    assert R.join(left, right.limit(0), [("wf", "wf_id")]).count() == 0


def test_null_keys_meet(spark):
    df = spark.createDataFrame([(None,), (2,)], "k int")
    assert R.join(df, df, [("k", "k")]).count() == 2
    assert R.join(df, df, [("k", "k")], "LEFT_ANTI").count() == 0


def test_windows(spark):
    df = spark.createDataFrame([(i,) for i in range(6)], "i int")
    assert [r.t for r in df.select("i", R.floor_ntile(4, [F.lit(0)], [F.col("i")]).alias("t")).orderBy("i").collect()] == [1, 1, 2, 3, 3, 4]
    df = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (2, 30, 3), (3, None, 4)], "k int, v int, i int")
    w = R.window([F.lit(0)], [F.col("k"), F.col("v").asc_nulls_last()])
    assert [r.s for r in df.select("i", F.sum("v").over(w).alias("s")).orderBy("i").collect()] == [10, 30, 60, 60]


def test_grouping_and_aggregates(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    assert R.grouping(df, ["a", "b"], [F.count(F.lit(1)).alias("n")], "rollup").count() == 4
    sd = spark.createDataFrame([(x,) for x in (2, 4, 4, 4, 5, 5, 7, 9)], "x int").agg(F.stddev_pop("x")).first()[0]
    assert sd == 2.0
    assert R.grouping(df.limit(0), [], [F.count(F.lit(1)).alias("n"), F.sum("a").alias("s")]).collect() == [(0, None)]
    assert spark.createDataFrame([(1,), (None,)], "x int").agg(R.array_agg("x").alias("l")).first().l == [1, None]
    with pytest.raises(ValueError):
        R.grouping(df, ["a"], [], "nope")


def test_latest_and_versions(spark):
    df = spark.createDataFrame([("a", 1, False, 500), ("a", 2, False, 750), ("b", 1, False, 1), ("b", 3, True, 0)], "k string, ts int, gone boolean, v int")
    assert vals(R.latest(df, ["k"], ["ts"], F.col("gone")).select("k", "v")) == [("a", 750)]
    assert vals(R.as_of(df, ["k"], "ts", 1, F.col("gone")).select("k", "v")) == [("a", 500), ("b", 1)]


def test_attributes(spark):
    df = spark.createDataFrame([("t1", "a", "hi"), ("t2", "a", "lo"), ("t3", "b", "hi")], "id string, tenant string, p string")
    assert vals(R.attributes_and(df, {"tenant": "a", "p": "hi"}).select("id")) == [("t1",)]
    assert R.attributes_and(df, {}).count() == 0
    assert R.attributes_or(df, {"tenant": "b", "p": "lo"}).count() == 2


def test_range_and_asof(spark):
    p = spark.createDataFrame([(float(x),) for x in range(20)], "x double")
    r = spark.createDataFrame([(1, 2.5, 7.0), (2, 19.0, 30.0)], "id int, lo double, hi double")
    got = vals(R.range_join(p, r, "x", "lo", "hi", 4.0).select("id", "x"))
    assert got == [(1, float(x)) for x in range(3, 8)] + [(2, 19.0)]
    a = spark.createDataFrame([("k", 5, 1), ("k", 1, 2)], "key string, ts int, id int")
    b = spark.createDataFrame([("k", 3, "x"), ("k", 5, "y")], "key string, ts int, v string")
    assert vals(R.asof_join(a, b, "key", "ts", ["v"]).select("id", "v")) == [(1, "y"), (2, None)]


def test_series(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("m", base + dt.timedelta(seconds=s), float(v)) for s, v in ((0, 10), (20, 20), (59, 30))], "m string, ts timestamp, v double")
    r = T.rollup(df, "ts", "v", "1 minute").first()
    assert (r.n, r.total, r["mean"]) == (3, 60.0, 20.0)
    nums = spark.createDataFrame([(x,) for x in range(1, 101)], "v int")
    assert [T.floor_percentile(nums, "v", p).first().value for p in (0.5, 0.9, 0.99)] == [51, 91, 100]
    assert nums.agg(T.nearest_rank(F.col("v"), 1.0)).first()[0] == 100
    e = T.ema(spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0)], "k string, t int, v double"), "k", ["t"], "v")
    assert [x.ema for x in e.orderBy("t").collect()] == [10.0, 12.0]
    base_rows = [("a", i, float(v)) for i, v in enumerate([10, 11, 9, 10, 12, 10, 50])]
    flags = T.baseline_anomalies(spark.createDataFrame(base_rows, "k string, t int, v double"), ["k"], [F.col("t")], "v").orderBy("t").collect()
    assert flags[-1].anomaly and not flags[-2].anomaly and not flags[0].anomaly
    p = [T.log_histogram_percentile(nums, "v", q).first()[0] for q in (0.5, 0.9, 0.99)]
    assert p[0] < p[1] < p[2]


def test_limits(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", base + dt.timedelta(milliseconds=m), m) for m in (0, 100, 200, 1100)], "k string, ts timestamp, id int")
    assert [r.allowed for r in T.sliding_log_limit(df, "k", "ts", ["id"], 2, 1.0).orderBy("id").collect()] == [True, True, False, True]
    assert [r.fresh for r in T.dedup_window(df, "k", "ts", ["id"], 0.15).orderBy("id").collect()] == [True, False, True, True]
    assert [r.allowed for r in T.token_bucket(df, "k", "ts", ["id"], 2.0, 1.0).orderBy("id").collect()] == [True, True, False, True]
    assert [r.n for r in T.sessions(df, "k", "ts", 0.5).orderBy("session_start").collect()] == [3, 1]


def test_scalars(spark):
    one = spark.range(1)

    def get(c):
        return one.select(c.alias("x")).first().x

    assert get(S.mask_email(F.lit("alice@x.com"))) == "a***e@x.com"
    assert get(S.mask_email(F.lit("al@x.com"))) == "*@x.com"
    assert get(S.mask_email(F.lit("nope"))) == "***@masked.com"
    assert get(S.bucket_label(F.lit(35), 10)) == "30-39"
    assert get(S.run_length_encode(F.lit("aaab"))) == "3xa;1xb;"
    assert get(S.run_length_decode(F.lit("3xa;1xb;2x;;"))) == "aaab;;"
    import hashlib
    import hmac

    assert get(S.pseudonym(F.lit("bob"), "key")) == "anon_" + hmac.new(b"key", b"bob", hashlib.sha256).hexdigest()[:16]
    h = 0
    for ch in "order-42":
        h = (h * 31 + ord(ch) + 2**31) % 2**32 - 2**31
    assert get(S.poly_hash(F.lit("order-42"), 8)) == abs(h) % 8
    assert get(S.template("a {{x}} b ${y}", {"x": F.lit(1)})) == "a 1 b "
    assert get(S.decrypt(S.encrypt(F.lit("secret"), "0123456789abcdef"), "0123456789abcdef")) == "secret"
    assert get(S.redact(F.create_map(F.lit("Password"), F.lit("p"), F.lit("u"), F.lit("v")), ["password"])) == {"Password": "[REDACTED]", "u": "v"}
    assert get(S.is_business_day(F.lit("2024-01-06").cast("date"))) is False
    assert get(S.in_daily_window(F.lit("2024-01-01 23:00:00").cast("timestamp"), 22, 6)) is True
    assert get(S.cron_matches("0 0 1 * *", F.lit("2024-02-01 00:00:00").cast("timestamp"))) is True
    assert len(get(S.recurrences(F.lit("2024-01-31").cast("timestamp"), "MONTHLY", 1, 3))) == 3
    a, b = F.create_map(F.lit("x"), F.lit(1)), F.create_map(F.lit("y"), F.lit(1))
    assert get(S.compare_versions(a, b)) == "CONCURRENT" and get(S.merge_versions(a, b)) == {"x": 1, "y": 1}
    assert get(S.snowflake_id(F.lit(1_704_067_200_001), F.lit(1), F.lit(2))) == (1 << 22) | (1 << 12) | 2
    assert get(S.age_priority(F.lit(5), F.lit(25), 10)) == 3
    assert get(S.backoff(F.lit(100.0), F.lit(3))) == 800.0
    with pytest.raises(ValueError):
        S.cron_matches("61 * * * *", F.current_timestamp())
    noise = spark.range(4000).select(S.laplace_noise(F.lit(5.0), 1.0, 1.0, 3).alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(noise[0] - 5) < 0.15 and abs(noise[1] - 2**0.5) < 0.2


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (7, 8)], "src int, dst int")
    assert dict(vals(H.tiers(e))) == {1: 0, 2: 1, 3: 2, 4: 3, 7: 0, 8: 1}
    assert vals(H.closure(e)) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (7, 8)]
    assert dict(vals(H.components(e))) == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7}
    ring = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src int, dst int")
    assert dict(vals(H.strong_components(ring))) == {1: 1, 2: 1}
    with pytest.raises(H.CycleError):
        H.tiers(ring)
    d = spark.createDataFrame([(1, 3), (2, 2), (3, 4), (4, 1), (7, 1), (8, 1)], "node int, duration int")
    cp = {r.node: (r.est, r.slack, r.critical) for r in H.critical_path(e, d).collect()}
    assert cp[4] == (9.0, 0.0, True) and cp[7][2] is False and cp[2] == (3.0, 0.0, True)
    n = spark.createDataFrame([(1, True), (2, False), (3, True), (4, True), (7, True), (8, True)], "node int, ok boolean")
    assert vals(H.prune(n, e, "ok").select("node")) == [(1,), (7,), (8,)]
    spans = spark.createDataFrame([("t", "r", None, 50000), ("t", "c", "r", 30000)], "trace string, span string, parent string, duration int")
    assert dict(vals(H.self_times(spans).select("span", "self_time"))) == {"r": 20000, "c": 30000}
    g = spark.createDataFrame([("base", "read"), ("admin", "*")], "role string, permission string")
    p = spark.createDataFrame([("editor", "base")], "role string, parent string")
    assert ("editor", "read") in vals(H.inherited(g, p))


def test_search(spark):
    d = spark.createDataFrame([(1, "red fox"), (2, "the quick red dog red"), (3, "blue")], "id int, text string")
    s = {r.id: r.score for r in X.bm25(d, "id", S.tokens_words(F.col("text")), ["red", "fox"]).collect()}
    assert set(s) == {1, 2} and s[1] > s[2]
    assert vals(X.phrase(d, "id", S.tokens_words(F.col("text")), ["quick", "red"])) == [(2,)]
    b = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (10.0, 10.0, 10.0, 10.0)], "min_x double, min_y double, max_x double, max_y double")
    assert X.boxes_touching(b, -1, -1, 1, 1).count() == 1


def test_governance(spark):
    one = spark.range(1)
    tier = lambda d, h=False: one.select(G.retention_tier(F.lit(d), F.lit(h)).alias("x")).first().x
    assert [tier(1), tier(8), tier(40), tier(100), tier(400), tier(400, True)] == ["HOT", "WARM", "COLD", "ARCHIVED", "PURGE", "ARCHIVED"]
    u = spark.createDataFrame([("A", 5000.0, 1024.0 * 3600000, 0.0)], "t string, c double, m double, s double")
    assert abs(G.invoice(u, "t", "c", "m", "s").first().total - 0.0041) < 1e-9
    req = spark.createDataFrame([(1, "u", "read", "doc/1"), (2, "u", "write", "doc/1"), (3, "x", "read", "z")], "request int, subject string, action string, resource string")
    rules = spark.createDataFrame([("u", "*", "doc/*", "ALLOW"), ("u", "write", "*", "DENY")], "subject string, action string, resource string, effect string")
    assert vals(G.decide(req, rules)) == [(1, "ALLOW"), (2, "DENY"), (3, "DENY")]
    a = spark.createDataFrame([(i, f"v{i}") for i in range(20)], "k int, v string")
    b = a.withColumn("v", F.when(F.col("k") == 13, "zz").otherwise(F.col("v")))
    assert vals(G.digest_diff(G.range_digests(a, "k", F.col("v"), 10), G.range_digests(b, "k", F.col("v"), 10))) == [(1, "DIFFERENT")]
    t = spark.createDataFrame([("r", "a", "FAILED", 1, []), ("r", "b", "FAILED", 1, ["a"]), ("r", "c", "SUCCESS", 100, []), ("r", "d", "SUCCESS", 1, [])], "run string, task string, status string, duration int, upstream array<string>")
    assert [r.state for r in G.root_cause(t).orderBy("task").collect()] == ["ROOT_FAILURE", "CASCADED", "BOTTLENECK", "OK"]
    good, bad = G.quarantine(spark.createDataFrame([(1,), (5,), (None,)], "n int"), "n", 3)
    assert (good.count(), bad.count()) == (2, 1)


def test_audit_chain(spark):
    import hashlib

    rows, prev = [], ""
    for i in range(3):
        h = hashlib.sha256(f"{prev}|e{i}".encode()).hexdigest()
        rows.append(("c", i, f"e{i}", prev, h))
        prev = h
    rows[2] = (*rows[2][:2], "forged", *rows[2][3:])
    df = spark.createDataFrame(rows, "chain string, seq int, event string, previous string, hash string")
    assert [r.ok for r in G.audit_chain_ok(df, "chain", "seq", ["event"]).orderBy("seq").collect()] == [True, True, False]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "CREATE"), ("b", 2, "CREATE"), ("a", 3, "DELETE")], "id string, seq int, op string")
    IO.write_log(df, f"{tmp_path}/log")
    with open(f"{tmp_path}/log/part-bad.txt", "w") as f:
        f.write('{"crc":1,"body":"{}"}\nnot json\n')
    back = IO.read_log(spark, f"{tmp_path}/log", "id string, seq int, op string")
    assert vals(back) == vals(df)
    assert vals(IO.replay(back, "id", "seq").select("id")) == [("b",)]
    IO.write_columnar(df, f"{tmp_path}/col", 2, ["op"])
    assert spark.read.parquet(f"{tmp_path}/col").count() == 3
    assert len(IO.export_ndjson(df, f"{tmp_path}/exp", F.col("seq") < 3)) == 64
    t = spark.createDataFrame([("1", "PENDING", "email", 1, 5), ("2", "RUNNING", "webhook", 2, 6), ("3", "PENDING", "email", 3, 7)], "id string, status string, type string, priority int, created_at int")
    assert [r.id for r in IO.query_tasks(t, ["PENDING"], ["email"], (1, 3)).collect()] == ["3", "1"]
    assert dict(vals(IO.count_by(t, "status", ["PENDING", "DONE"]))) == {"PENDING": 2, "DONE": 0}


def test_wide_and_narrow_ranges_meet_points_once(spark):
    import random

    rnd = random.Random(2)
    ranges = [(k, a := rnd.uniform(-50, 50), a + rnd.choice((0, 0.5, 3, 40, 1e6))) for k in range(60)] + [(99, 5.0, 4.0), (98, None, 3.0)]
    points = [(k, rnd.uniform(-60, 120)) for k in range(80)] + [(500, None)]
    p, r = spark.createDataFrame(points, "id long, x double"), spark.createDataFrame(ranges, "k long, lo double, hi double")
    got = sorted((row.id, row.k) for row in R.range_join(p, r, "x", "lo", "hi", 2.0).collect())
    assert got == sorted((i, k) for i, x in points if x is not None for k, a, b in ranges if a is not None and a <= x <= b)


def test_theta_join_kinds(spark):
    a, b = spark.createDataFrame([(1,), (5,), (None,)], "x int"), spark.createDataFrame([(3, "p"), (9, "q")], "y int, x string")
    rows = lambda how: sorted(map(str, (tuple(r) for r in R.theta_join(a, b, "l.x < r.y", how).collect())))
    assert rows("INNER") == ["(1, 3, 'p')", "(1, 9, 'q')", "(5, 9, 'q')"]
    assert rows("LEFT_OUTER") == ["(1, 3, 'p')", "(1, 9, 'q')", "(5, 9, 'q')", "(None, None, None)"]
    assert rows("LEFT_SEMI") == ["(1,)", "(5,)"] and rows("LEFT_ANTI") == ["(None,)"]


def test_attribute_conditions_on_nulls(spark):
    d = spark.createDataFrame([(1, "a", "r:1", None, None), (2, "b:read", "r:2", "x", "12"), (3, "c", "q", "x", "abc")], "request int, action string, resource string, who string, n string")
    allow = lambda *c: [{"id": "p", "effect": "ALLOW", "conditions": list(c)}]
    hit = lambda policies: [r.decision == "ALLOW" for r in G.decide_by_attributes(d, policies).orderBy("request").collect()]
    assert hit(allow(("who", "EQUALS", "x"))) == [False, True, True] and hit(allow(("who", "NOT_EQUALS", "x"))) == [True, False, False]
    assert hit(allow(("n", "GREATER_THAN", 5))) == [False, True, False] and hit(allow(("n", "LESS_THAN", 5))) == [False, False, False]
    assert hit([{"id": "p", "effect": "ALLOW", "actions": ["b:*"], "resources": ["r:*"]}]) == [False, True, False]
    assert hit([*allow(), {"id": "no", "effect": "DENY", "resources": ["q"]}]) == [True, True, False] and hit([]) == [False] * 3


def test_nested_redaction_and_permitted_times(spark):
    d = spark.createDataFrame([(("u", "t0", ("k", ["secret"])),), (None,)], "s struct<name:string,Token:string,in:struct<APIKEY:string,list:array<string>>>")
    got = d.select(S.redact_struct(F.col("s"), d.schema["s"].dataType, ["token", "apiKey"]).alias("s")).collect()
    assert got[0].s.asDict(True) == {"name": "u", "Token": "***REDACTED***", "in": {"APIKEY": "***REDACTED***", "list": ["secret"]}} and got[1].s is None
    t = spark.createDataFrame([("2024-01-05 09:00:00",), ("2024-01-05 17:00:00",), ("2024-01-06 10:00:00",), ("2024-01-08 10:00:00",), ("2024-01-09 10:00:00",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    ok = S.may_run(F.col("t"), ["2024-01-09"], blackouts=[("2024-01-08 09:30:00", "2024-01-08 10:00:00")])
    assert [r[0] for r in t.select(ok).collect()] == [True, False, False, False, False]


def test_many_users_are_counted_exactly(spark, tmp_path):
    e = spark.range(60_000).select(F.expr("nullif(id % 25013, 7)").alias("user_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), F.col("id") % 2)).alias("event_type"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for i in range(60_000):
        want.setdefault(f"t{i % 2}" if i % 3 else None, set()).add(i % 25013)
    assert {r.event_type: r.users for r in QUERIES["approx_users"](spark, str(tmp_path)).collect()} == {k: len(v - {7}) for k, v in want.items()}


def test_rounds_of_graphs_send_no_table_to_the_driver(spark, tmp_path):
    """Tables below the threshold for broadcasts, which are collected by the driver: no round's plan may hold one."""
    e = spark.createDataFrame([(i, j) for i in range(12) for j in (i + 1, i + 3)], "src long, dst long")
    d = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("duration", F.col("node") % 4 + 1)
    plans, cut = [], H.cut

    def seen(df):
        out = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    H.cut = seen
    try:
        cp = {r.node: r for r in H.critical_path(e, d).collect()}
        early = {r.node: (r.est, r.eft) for r in H.earliest_times(e, d).collect()}
        H.components(e), H.closure(e)
    finally:
        H.cut = cut
    assert len(plans) > 60 and not any("Broadcast" in x for x in plans)
    est, lft = {}, {}
    for n in range(15):
        est[n] = max((est[m] + m % 4 + 1 for m in (n - 1, n - 3) if 0 <= m < 12 and m in est), default=0)
    end = max(est[n] + n % 4 + 1 for n in est)
    for n in range(14, -1, -1):
        lft[n] = min((lft[m] - m % 4 - 1 for m in (n + 1, n + 3) if n < 12 and m in lft), default=end)
    assert early == {n: (est[n], est[n] + n % 4 + 1) for n in est}
    assert {n: (r.est, r.lft, r.critical) for n, r in cp.items()} == {n: (est[n], lft[n], lft[n] - n % 4 - 1 == est[n]) for n in est}


def test_range_join_deals_out_its_pairs(spark, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 2_000, raising=False)
    points = [(k, 1.0 if k % 2 else k % 97 + 0.25) for k in range(600)] + [(600, None)]
    ranges = [(k, a := float(k % 50), a + (3 if k % 5 else 40)) for k in range(150)]
    p, r = spark.createDataFrame(points, "id long, x double"), spark.createDataFrame(ranges, "k long, lo double, hi double")
    out = R.range_join(p, r, "x", "lo", "hi", 4.0)
    assert out.columns == ["id", "x", "k", "lo", "hi"]
    want = sorted((i, k) for i, x in points if x is not None for k, a, b in ranges if a <= x <= b)
    assert sorted((row.id, row.k) for row in out.collect()) == want
    each = [n for n in out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(each) >= 6 and max(each) < len(want) / 3
