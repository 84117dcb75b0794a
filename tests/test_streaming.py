import datetime as dt

from pyspark.sql import functions as F

from sparkloom.streaming import operators as ST

BASE = dt.datetime(2024, 1, 1)


def source(spark, tmp_path, rows, schema):
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    return ST.read(spark, f"{tmp_path}/in", df.schema)


def drain(df, tmp_path, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


ROWS = [("a", BASE, 1.0), ("a", BASE + dt.timedelta(seconds=30), 2.0), ("b", BASE + dt.timedelta(seconds=90), 3.0)]


def test_tumbling_and_sessions(spark, tmp_path):
    s = source(spark, tmp_path, ROWS, "k string, ts timestamp, v double")
    got = drain(ST.tumbling(s, "ts", "1 minute", ["k"], "10 seconds", "v"), tmp_path, "tumbling", "complete")
    assert sorted((r.k, r.n, r.total) for r in got) == [("a", 2, 3.0), ("b", 1, 3.0)]
    got = drain(ST.sessions(s, "ts", "45 seconds", "k", "10 seconds"), tmp_path, "sess", "complete")
    assert sorted((r.k, r.n) for r in got) == [("a", 2), ("b", 1)]


def test_dedup_and_projection(spark, tmp_path):
    s = source(spark, tmp_path, ROWS, "k string, ts timestamp, v double")
    assert len(drain(ST.dedup(s, ["k"], "ts", "10 minutes"), tmp_path, "dedup")) == 2
    got = drain(ST.projection(s, "k", {"a": F.lit(1), "b": F.col("v")}, "k"), tmp_path, "proj", "complete")
    assert sorted((r.k, r.a, r.b) for r in got) == [("a", 2, 0.0), ("b", 0, 3.0)]


def test_rate_limit(spark, tmp_path):
    rows = [("a", BASE + dt.timedelta(milliseconds=m), float(m)) for m in (0, 100, 200, 1100)]
    s = source(spark, tmp_path, rows, "k string, ts timestamp, v double")
    got = drain(ST.rate_limit(s, "k", "ts", 2, 1.0), tmp_path, "limit")
    assert [r.allowed for r in sorted(got, key=lambda r: r.ts)] == [True, True, False, True]


def test_dead_letters(spark, tmp_path):
    s = source(spark, tmp_path, ROWS, "k string, ts timestamp, v double")
    run = ST.split_dead_letters(F.col("v") < 3, ST.once_per_batch(f"{tmp_path}/good"), ST.once_per_batch(f"{tmp_path}/dead"))
    s.writeStream.foreachBatch(run).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/good").count() == 2 and spark.read.parquet(f"{tmp_path}/dead").count() == 1


def test_silent_workers(spark):
    df = spark.createDataFrame([("w1", BASE), ("w2", BASE + dt.timedelta(seconds=50))], "w string, ts timestamp")
    got = {r.w: r.state for r in ST.silent_workers(df, "w", "ts", BASE + dt.timedelta(seconds=61), 10, 60).collect()}
    assert got == {"w1": "DEAD", "w2": "SUSPECT"}
