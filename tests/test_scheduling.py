import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import calendar as C
from sparkloom.operators import governance as G
from sparkloom.operators import scheduling as K


def get(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def brute_next(expression, ts):
    fields = [C._values(f, *r) for f, r in zip(expression.split(), [(0, 59), (0, 23), (1, 31), (1, 12), (0, 6)])]
    t = ts.replace(second=0) + dt.timedelta(minutes=1)
    for _ in range(60 * 24 * 366):
        if t.minute in fields[0] and t.hour in fields[1] and t.day in fields[2] and t.month in fields[3] and t.isoweekday() % 7 in fields[4]:
            return t
        t += dt.timedelta(minutes=1)
    return None


@pytest.mark.parametrize("expression", ["*/15 9-17 * * 1-5", "0 0 29 2 *", "5,10 3 1 * *", "0 12 * * 0", "59 23 31 12 *"])
def test_next_cron(spark, expression):
    for ts in (dt.datetime(2024, 1, 1, 0, 0), dt.datetime(2024, 2, 28, 23, 59, 30), dt.datetime(2024, 12, 31, 23, 58), dt.datetime(2023, 6, 3, 17, 45)):
        assert get(spark, C.next_cron(expression, at(ts.isoformat(" ")))) == brute_next(expression, ts)


def test_cron_errors():
    for bad in ("* * * *", "60 * * * *", "a * * * *", "5-1 * * * *", "*/0 * * * *"):
        with pytest.raises(ValueError):
            C.next_cron(bad, F.current_timestamp())


def test_calendar(spark):
    assert get(spark, C.next_business_day(F.lit("2024-01-06").cast("date"), ["2024-01-08"])) == dt.date(2024, 1, 9)
    assert get(spark, C.utc_offset_hours(F.lit("2024-07-01 12:00:00").cast("timestamp"), "Asia/Tokyo")) == 9
    assert get(spark, C.utc_offset_hours(F.lit("2024-07-01 12:00:00").cast("timestamp"), "America/New_York")) == -4


def test_digits(spark):
    seen = set()
    for x in ("00", "12", "123", "4111111111111111", "9" * 36, "000000000000000000001"):
        e = get(spark, C.encrypt_digits(F.lit(x), "key"))
        assert len(e) == len(x) and e.isdigit() and get(spark, C.decrypt_digits(F.lit(e), "key")) == x
        seen.add(e)
    assert len(seen) == 6 and get(spark, C.encrypt_digits(F.lit("12ab"), "key")) == "12ab" and get(spark, C.encrypt_digits(F.lit(None).cast("string"), "key")) is None
    pairs = spark.range(100).select(C.encrypt_digits(F.lpad(F.col("id").cast("string"), 2, "0"), "k").alias("e"))
    assert pairs.distinct().count() == 100  # a permutation


def test_shares_and_misfires(spark):
    df = spark.createDataFrame([("a", 5.0, 1.0), ("b", 1.0, 90.0), ("c", None, None)], "u string, cpu double, mem double")
    s = K.dominant_share(df, "u", {"cpu": 10.0, "mem": 100.0})
    assert {r.u: r.share for r in s.collect()} == {"a": 0.5, "b": 0.9, "c": 0.0}
    assert K.neediest(s, "u").first().u == "c"
    assert [get(spark, K.misfire_runs(F.lit(n), F.lit(p))) for p, n in (("FIRE_ALL", 3), ("FIRE_ONCE", 3), ("FIRE_ONCE", 0), ("SKIP", 3))] == [3, 1, 0, 0]
    assert get(spark, K.drifted(at("2024-01-01 00:00:05"), at("2024-01-01 00:00:00"), 4)) is True


def test_growth(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [("a", base + dt.timedelta(minutes=i), 10.0 * i, i) for i in range(6)] + [("b", base, 1.0, 0)]
    got = {r.k: (r.per_minute, r.leaking) for r in K.growth(spark.createDataFrame(rows, "k string, ts timestamp, v double, id int"), ["k"], "ts", "v", "id", 5.0).collect()}
    assert got == {"a": (10.0, True), "b": (0.0, False)}


def test_append(spark):
    journal = spark.createDataFrame([("a", 1), ("a", 2), (None, 1)], "agg string, version int")
    new = spark.createDataFrame([("a", 2, 1), ("a", 2, 2), ("b", 0, 1), ("c", 3, 1), (None, 1, 1)], "agg string, expected int, seq int")
    ok, conflict = K.append(journal, new, "agg", ["seq"])
    assert sorted(((r.agg or ""), r.seq, r.version) for r in ok.collect()) == [("", 1, 2), ("a", 1, 3), ("a", 2, 4), ("b", 1, 1)]
    assert [r.agg for r in conflict.collect()] == ["c"]


def test_leases_and_delays(spark):
    now = at("2024-01-01 00:00:00")
    state = lambda n, until: get(spark, K.lease_state(F.lit(n), F.lit(until).cast("timestamp_ntz"), now, 3))
    assert [state(1, "2024-01-01 00:01:00"), state(0, None), state(1, "2023-01-01"), state(3, "2023-01-01")] == ["LEASED", "READY", "REDELIVER", "DEAD_LETTER"]
    df = spark.createDataFrame([(1, 5), (2, 9), (3, None)], "id int, t int")
    assert [r.id for r in K.due(df, "t", 5).collect()] == [1]
    assert [r.id for r in K.seek(df, "id", 2, 5).collect()] == [2, 3] and [r.id for r in K.seek(df, "id", 2, 1, True).collect()] == [2]
    assert K.size_by_class(df, "id", "t").first().id == 2


def test_audit_chain(spark):
    df = spark.createDataFrame([("c", i, f"e{i}") for i in range(4)] + [("d", 1, None)], "chain string, seq int, event string")
    made = K.audit_chain(df, "chain", "seq", ["event"])
    assert all(r.ok for r in G.audit_chain_ok(made, "chain", "seq", ["event"]).collect())
    forged = made.withColumn("event", F.when(F.col("seq") == 2, "x").otherwise(F.col("event")))
    assert [r.seq for r in G.audit_chain_ok(forged, "chain", "seq", ["event"]).filter("NOT ok").collect()] == [2]


def test_count_min(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("k"), F.concat(F.lit("u"), F.col("id") % 3).alias("s"))
    got = K.count_min(df, "k", list(range(7)))
    assert all(5000 // 7 <= n <= 5000 // 7 + 6 for n in got.values())
    assert all(1666 <= n <= 1672 for n in K.count_min(df, "s", ["u0", "u1", "u2"]).values())


def test_assignments(spark):
    members = spark.createDataFrame([("b", "t"), ("a", "t"), ("c", "t"), ("a", "u")], "member string, topic string")
    topics = spark.createDataFrame([("t", 8), ("u", 2), ("v", 3)], "topic string, partitions long")
    got = sorted(tuple(r) for r in K.range_assignment(members, topics).collect())
    assert got == [("t", 0, "a"), ("t", 1, "a"), ("t", 2, "a"), ("t", 3, "b"), ("t", 4, "b"), ("t", 5, "b"), ("t", 6, "c"), ("t", 7, "c"), ("u", 0, "a"), ("u", 1, "a")]
    held = spark.createDataFrame([("t", 0, "b"), ("t", 5, "b"), ("t", 9, "c"), ("t", 1, "gone"), ("u", 0, "b")], "topic string, partition long, member string")
    got = sorted(tuple(r) for r in K.sticky_assignment(members, topics, held).collect())
    assert got == [("t", 0, "b"), ("t", 1, "a"), ("t", 2, "c"), ("t", 3, "a"), ("t", 4, "c"), ("t", 5, "b"), ("t", 6, "a"), ("t", 7, "b"), ("u", 0, "a"), ("u", 1, "a")]


def test_bloom(spark):
    even = spark.range(0, 4000, 2).withColumnRenamed("id", "k")
    f = K.Bloom(2000, 0.01).add(even.limit(1000), "k").add(even, "k")
    hit = {r.k: r.maybe for r in f.may_hold(spark.range(4000).withColumnRenamed("id", "k"), "k").collect()}
    assert all(hit[k] for k in range(0, 4000, 2)) and sum(hit[k] for k in range(1, 4000, 2)) < 60
    assert not K.Bloom().may_hold(even, "k").filter("maybe").count()


def test_bloom_of_many_words_is_looked_up_by_place(spark):
    """A filter of 112,000 words: searching these for every value would take minutes; blocks are joined as well as broadcast."""
    import time

    n, begun = 150_000, time.time()
    some = spark.range(0, 2 * n, 2).select(F.when(F.col("id") > 0, F.col("id")).alias("k"))
    for expected in (n * 5, n * 6):
        f = K.Bloom(expected, 0.01).add(some.limit(10), "k").add(some, "k")
        asked = some.withColumn("own", F.lit(True)).union(spark.range(1, 2 * n, 2).select("id", F.lit(False)))
        got = {r.own: (r.rows, r.hits) for r in f.may_hold(asked, "k").groupBy("own").agg(F.count(F.lit(1)).alias("rows"), F.count_if("maybe").alias("hits")).collect()}
        assert got[True] == (n, n) and got[False][0] == n and got[False][1] < 0.001 * n
    full = K.Bloom(n, 0.01).add(some, "k").may_hold(spark.range(1, 2 * n, 2).withColumnRenamed("id", "k"), "k")
    assert full.filter("maybe").count() < 0.013 * n
    assert time.time() - begun < 60
