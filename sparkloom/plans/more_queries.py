"""Registered queries of limiters, forecasts, policies, sketches and assignments, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import scalar as S
from sparkloom.operators import governance as G
from sparkloom.operators import graph as H
from sparkloom.operators import relational as R
from sparkloom.operators import scheduling as K
from sparkloom.operators import series as T
from sparkloom.plans.queries import query, rnd
from sparkloom.lang import expression
from sparkloom.sources.tables import replay, resume, seal_statistics, snapshot, table

_USER = "SELECT user_id, event_id, ts, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events"
_TYPE = "SELECT event_id, event_type, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events WHERE value IS NOT NULL"


def _values(spark, d):
    return table(spark, d, "events").filter("value IS NOT NULL")


@query(f"""WITH RECURSIVE e AS ({_TYPE}), r AS (
SELECT event_type, ts, event_id, i, value AS mean, 0::DOUBLE AS var, 0::DOUBLE AS z FROM e WHERE i = 1 UNION ALL
SELECT e.event_type, e.ts, e.event_id, e.i, r.mean + 0.2::DOUBLE * (e.value - r.mean),
(1 - 0.2::DOUBLE) * (r.var + 0.2::DOUBLE * (e.value - r.mean) * (e.value - r.mean)), (e.value - r.mean) / sqrt(greatest(r.var, 1e-4::DOUBLE))
FROM r JOIN e ON e.event_type = r.event_type AND e.i = r.i + 1)
SELECT event_type, ts, event_id, round(z, 4) + 0 AS z, i > 5 AND abs(z) >= 3 AS anomaly FROM r""")
def ewma_anomaly(spark, d):
    return T.ewma_anomalies(_values(spark, d), "event_type", ["ts", "event_id"], "value").withColumn("z", rnd("z", 4) + 0.0)


@query(f"""WITH RECURSIVE e AS ({_TYPE}), r AS (
SELECT event_type, i, value AS level, 0::DOUBLE AS trend FROM e WHERE i = 1 UNION ALL
SELECT e.event_type, e.i, 0.5::DOUBLE * e.value + 0.5::DOUBLE * (r.level + r.trend),
0.3::DOUBLE * (0.5::DOUBLE * e.value + 0.5::DOUBLE * (r.level + r.trend) - r.level) + 0.7::DOUBLE * r.trend
FROM r JOIN e ON e.event_type = r.event_type AND e.i = r.i + 1),
n AS (SELECT event_type, max(i) AS n FROM e GROUP BY 1),
b AS (SELECT event_type, 1.96 * stddev_pop(value) AS band FROM e JOIN n USING (event_type) WHERE i > n - 500 GROUP BY 1)
SELECT r.event_type, round(level, 4) AS level, round(trend, 4) AS trend, round(level + trend, 4) AS forecast, round(level + trend - band, 4) AS low, round(level + trend + band, 4) AS high
FROM r JOIN n ON r.event_type = n.event_type AND r.i = n.n JOIN b ON b.event_type = r.event_type""")
def holt_forecast(spark, d):
    out = T.holt(_values(spark, d), "event_type", ["ts", "event_id"], "value")
    return out.select("event_type", *[rnd(c, 4).alias(c) for c in ("level", "trend", "forecast", "low", "high")])


@query(f"""WITH RECURSIVE e AS ({_USER}), r AS (
SELECT user_id, ts, event_id, i, [us] AS kept, TRUE AS allowed FROM e WHERE i = 1 UNION ALL
SELECT e.user_id, e.ts, e.event_id, e.i,
CASE WHEN len(list_filter(r.kept, lambda x: x > e.us - 3600000000)) < 2 THEN list_append(list_filter(r.kept, lambda x: x > e.us - 3600000000), e.us) ELSE list_filter(r.kept, lambda x: x > e.us - 3600000000) END,
len(list_filter(r.kept, lambda x: x > e.us - 3600000000)) < 2 FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, ts, event_id, allowed FROM r""")
def rate_limit_sliding_log(spark, d):
    return T.sliding_log_limit(table(spark, d, "events"), "user_id", "ts", ["event_id"], 2, 3600.0)


def _limiter(state0: str, state: str, allowed: str) -> str:
    """Recursive SQL of a limiter with a ``left``-like state; ``{dt}`` is the seconds since the row before."""
    dt = "((e.us - r.us) / 1e6::DOUBLE)"
    return f"""WITH RECURSIVE e AS ({_USER}), r AS (
SELECT user_id, ts, event_id, i, us, {state0} AS s, TRUE AS allowed FROM e WHERE i = 1 UNION ALL
SELECT user_id, ts, event_id, i, us, CASE WHEN ok THEN {state.split('|')[1]} ELSE s END, ok FROM (
SELECT *, {allowed} AS ok FROM (SELECT e.user_id, e.ts, e.event_id, e.i, e.us, {state.split('|')[0].format(dt=dt)} AS s FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)))
SELECT user_id, ts, event_id, allowed FROM r"""


@query(_limiter("2::DOUBLE", "least(3::DOUBLE, r.s + {dt} * (1 / 3600::DOUBLE))|s - 1", "s >= 1"))
def rate_limit_token_bucket(spark, d):
    return T.token_bucket(table(spark, d, "events"), "user_id", "ts", ["event_id"], 3.0, 1 / 3600)


@query(_limiter("1::DOUBLE", "greatest(0::DOUBLE, r.s - {dt} * (1 / 1800::DOUBLE))|s + 1", "s + 1 <= 4"))
def rate_limit_leaky_bucket(spark, d):
    return T.leaky_bucket(table(spark, d, "events"), "user_id", "ts", ["event_id"], 4.0, 1 / 1800)


@query(_limiter("us / 1e6::DOUBLE + 1200", "greatest(r.s, e.us / 1e6::DOUBLE)|s + 1200", "s <= us / 1e6::DOUBLE + 3600"))
def rate_limit_gcra(spark, d):
    return T.gcra(table(spark, d, "events"), "user_id", "ts", ["event_id"], 1200.0, 3600.0)


@query("""WITH s AS (SELECT 2000 / log10(3600000) AS k), b AS (SELECT least(1999, floor(log10(greatest(value, 1)) * k)) AS b, count(*) AS n FROM events, s WHERE value IS NOT NULL GROUP BY 1),
c AS (SELECT b, sum(n) OVER (ORDER BY b) AS c, sum(n) OVER () AS t FROM b) SELECT round(pow(10::DOUBLE, min(b) / (SELECT k FROM s)), 6) AS value FROM c WHERE c >= ceil(t * 0.99)""")
def hdr_percentile(spark, d):
    return T.log_histogram_percentile(table(spark, d, "events"), "value", 0.99).withColumn("value", rnd("value", 6))


@query("""WITH t AS (SELECT max(ts) AS z FROM events), w AS (SELECT event_type, value, ts, z FROM events, t WHERE value IS NOT NULL AND ts BETWEEN z - INTERVAL 10 HOUR AND z),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM w)
SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(count(*) / greatest(1, (epoch_us(max(z)) - epoch_us(min(ts))) / 1e6), 8) AS rate,
max(value) FILTER (i = least(n, floor(n * 0.5) + 1)) AS p50, max(value) FILTER (i = least(n, floor(n * 0.9) + 1)) AS p90, max(value) FILTER (i = least(n, floor(n * 0.99) + 1)) AS p99, max(value) FILTER (i = least(n, floor(n * 0.999) + 1)) AS p99_9 FROM r GROUP BY 1""")
def metric_summary(spark, d):
    e = table(spark, d, "events")
    out = T.summary(e, ["event_type"], "ts", "value", e.agg(F.max("ts")).first()[0], 36_000)
    return out.withColumn("mean", rnd("mean", 6)).withColumn("sd", rnd("sd", 6)).withColumn("rate", rnd("rate", 8))


@query("SELECT l.n_nationkey AS l_n_nationkey, r.r_regionkey AS r_r_regionkey FROM nation l JOIN region r ON l.n_regionkey < r.r_regionkey OR l.n_nationkey = r.r_regionkey * 5")
def join_nested_loop(spark, d):
    return R.theta_join(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), table(spark, d, "region").select("r_regionkey"), "l.n_regionkey < r.r_regionkey OR l.n_nationkey = r.r_regionkey * 5").drop("l_n_regionkey")


for _name, _algorithm in (("join_merge", "MERGE"), ("join_nested_loop_equal", "NESTED_LOOP"), ("join_hash", "HASH")):

    def _join(spark, d, algorithm=_algorithm):
        n, r = table(spark, d, "nation").select("n_nationkey", "n_regionkey"), table(spark, d, "region").select("r_regionkey", "r_name")
        return R.join(n, r, [("n_regionkey", "r_regionkey")], "INNER", algorithm)

    _join.__name__ = _name
    query("SELECT n_nationkey, n_regionkey, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")(_join)


@query("""SELECT c_custkey AS request, CASE WHEN c_acctbal < 0 AND c_mktsegment <> 'BUILDING' THEN 'DENY' WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 'ALLOW'
WHEN contains(c_name, '7') AND c_acctbal > 5000 THEN 'ALLOW' ELSE 'DENY' END AS decision,
CASE WHEN c_acctbal < 0 AND c_mktsegment <> 'BUILDING' THEN 'debt' WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 'segments' WHEN contains(c_name, '7') AND c_acctbal > 5000 THEN 'rich' END AS policy FROM customer""")
def attribute_policies(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("request"), F.lit("order:read").alias("action"), F.concat(F.lit("customer:"), F.col("c_name")).alias("resource"), "c_name", "c_mktsegment", "c_acctbal")
    policies = [
        {"id": "segments", "effect": "ALLOW", "actions": ["order:*"], "resources": ["customer:*"], "conditions": [("c_mktsegment", "IN", ["BUILDING", "AUTOMOBILE"])]},
        {"id": "rich", "effect": "ALLOW", "actions": ["*"], "conditions": [("c_name", "CONTAINS", "7"), ("c_acctbal", "GREATER_THAN", 5000)]},
        {"id": "debt", "effect": "DENY", "conditions": [("c_acctbal", "LESS_THAN", 0), ("c_mktsegment", "NOT_EQUALS", "BUILDING")]},
        {"id": "writes", "effect": "DENY", "actions": ["order:write"], "conditions": [("c_mktsegment", "EQUALS", "BUILDING")]},
    ]
    return G.decide_by_attributes(c, policies)


@query("""WITH t AS (SELECT n_name AS topic, n_nationkey + 1 AS partitions FROM nation), m AS (SELECT s_suppkey AS k, n_name AS topic FROM supplier, nation WHERE s_suppkey <= 6 AND (s_suppkey + n_nationkey) % 3 > 0),
o AS (SELECT topic, k, row_number() OVER (PARTITION BY topic ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY topic) AS n FROM m),
p AS (SELECT topic, partitions, unnest(range(partitions)) AS partition FROM t)
SELECT p.topic, p.partition, 'm' || k AS member FROM p JOIN o ON o.topic = p.topic AND p.partition >= i * (partitions // n) + least(i, partitions % n) AND p.partition < (i + 1) * (partitions // n) + least(i + 1, partitions % n)""")
def partition_ranges(spark, d):
    nation = table(spark, d, "nation")
    topics = nation.select(F.col("n_name").alias("topic"), (F.col("n_nationkey") + 1).cast("long").alias("partitions"))
    s = table(spark, d, "supplier").filter("s_suppkey <= 6")
    members = s.join(nation, (F.col("s_suppkey") + F.col("n_nationkey")) % 3 > 0).select(F.concat(F.lit("m"), F.col("s_suppkey")).alias("member"), F.col("n_name").alias("topic"))
    return K.range_assignment(members, topics)


@query("""SELECT c_custkey, (abs(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda x: ascii(x)::BIGINT)),
lambda h, x: ((h * 31 + x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)) % 8)::INT AS partition FROM customer""")
def keyed_partitions(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.poly_hash(F.col("c_name"), 8).alias("partition"))


@query("SELECT c_custkey, c_custkey % 2 = 0 AS member FROM customer WHERE c_custkey % 2 = 0")
def bloom_members(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    even = c.filter("c_custkey % 2 = 0")
    return K.Bloom(2_000, 0.01).add(even, "c_custkey").may_hold(c, "c_custkey", "member").filter("c_custkey % 2 = 0")


@query("SELECT TRUE AS rare")
def bloom_strangers(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    hit = K.Bloom(max(1_000, c.count()), 0.01).add(c.filter("c_custkey % 2 = 0"), "c_custkey").may_hold(c.filter("c_custkey % 2 = 1"), "c_custkey")
    return hit.agg((F.avg(F.col("maybe").cast("int")) < 0.03).alias("rare"))


@query("""SELECT o_orderkey, isodow(o_orderdate + to_hours((o_orderkey % 24)::INT)) <= 5 AND hour(o_orderdate + to_hours((o_orderkey % 24)::INT)) BETWEEN 9 AND 16
AND NOT (o_orderdate + to_hours((o_orderkey % 24)::INT)) BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-09-01' AND strftime(o_orderdate, '%Y-%m-%d') NOT IN ('1995-05-01', '1995-12-25') AS ok FROM orders""")
def execution_permitted(spark, d):
    at = F.expr("o_orderdate + make_dt_interval(0, CAST(o_orderkey % 24 AS INT))")
    o = table(spark, d, "orders").select("o_orderkey", at.alias("at"))
    return o.select("o_orderkey", S.may_run(F.col("at"), ["1995-05-01", "1995-12-25"], blackouts=[("1996-03-01 00:00:00", "1996-09-01 00:00:00")]).alias("ok"))


@query("""WITH t AS (SELECT event_id AS task, event_id // 10 AS run, CASE WHEN event_id % 7 = 0 OR (event_id % 7 = 1 AND event_id % 10 > 0) THEN 'FAILED' ELSE 'SUCCESS' END AS status, value AS duration, CASE WHEN event_id % 10 > 0 THEN event_id - 1 END AS up FROM events WHERE value IS NOT NULL),
m AS (SELECT *, avg(duration) OVER (PARTITION BY run) AS m FROM t)
SELECT a.run, a.task, CASE WHEN a.status = 'FAILED' AND b.status IS NOT NULL THEN 'CASCADED' WHEN a.status = 'FAILED' THEN 'ROOT_FAILURE' WHEN a.duration > 2.5 * a.m THEN 'BOTTLENECK' ELSE 'OK' END AS state
FROM m a LEFT JOIN t b ON a.run = b.run AND a.up = b.task AND b.status = 'FAILED'""")
def root_causes(spark, d):
    e = _values(spark, d)
    i = F.col("event_id")
    status = F.when((i % 7 == 0) | ((i % 7 == 1) & (i % 10 > 0)), "FAILED").otherwise("SUCCESS")
    upstream = F.when(i % 10 > 0, F.array(i - 1)).otherwise(F.array().cast("array<bigint>"))
    return G.root_cause(e.select(F.expr("event_id div 10").alias("run"), i.alias("task"), status.alias("status"), F.col("value").alias("duration"), upstream.alias("upstream"))).select("run", "task", "state")


@query("""WITH RECURSIVE p AS (SELECT n_nationkey AS role, n_nationkey // 2 AS parent FROM nation WHERE n_nationkey > 0), up AS (SELECT role, parent FROM p UNION SELECT up.role, p.parent FROM up JOIN p ON p.role = up.parent),
g AS (SELECT n_nationkey AS role, n_name AS permission FROM nation WHERE n_nationkey % 2 = 0)
SELECT role, permission FROM g UNION SELECT up.role, permission FROM up JOIN g ON g.role = up.parent""")
def inherited_permissions(spark, d):
    n = table(spark, d, "nation")
    grants = n.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("role"), F.col("n_name").alias("permission"))
    parents = n.filter("n_nationkey > 0").select(F.col("n_nationkey").cast("long").alias("role"), F.expr("n_nationkey div 2").alias("parent"))
    return H.inherited(grants, parents)


@query("SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-01'")
def delayed_due(spark, d):
    return K.due(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", F.expr("timestamp_ntz '1995-06-01'")).select("o_orderkey")


@query("SELECT p_partkey, p_name, '***REDACTED***' AS brand, '***REDACTED***' AS inner_type, p_size AS size FROM part")
def redact_nested(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.struct("p_name", F.col("p_brand").alias("Token"), F.struct(F.col("p_type").alias("APIKEY"), "p_size").alias("more")).alias("s"))
    p = p.withColumn("s", S.redact_struct(F.col("s"), p.schema["s"].dataType, ["token", "apiKey"]))
    return p.select("p_partkey", "s.p_name", F.col("s.Token").alias("brand"), F.col("s.more.APIKEY").alias("inner_type"), F.col("s.more.p_size").alias("size"))


@query("SELECT p_partkey AS node, floor(log2(p_partkey))::INT AS batch FROM part WHERE p_partkey BETWEEN 1 AND 1023")
def parallel_batches(spark, d):
    p = table(spark, d, "part").filter("p_partkey BETWEEN 1 AND 1023")
    edges = p.filter("p_partkey > 1").select(F.expr("p_partkey div 2").alias("src"), F.col("p_partkey").alias("dst"))
    return H.tiers(edges).select("node", F.col("tier").alias("batch"))


@query("SELECT event_type, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') AS segment, count(value) AS n, min(value) AS low, max(value) AS high, sum(value::DECIMAL(18, 6))::DOUBLE AS total, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1, 2")
def series_segments(spark, d):
    e = table(spark, d, "events").select("event_type", "ts", F.col("value").cast("decimal(18,6)").alias("value"))
    out = seal_statistics(e, "event_type", "ts", "value")
    return out.withColumns({c: F.col(c).cast("double") for c in ("low", "high", "total")})


@query("SELECT event_id, ts, value FROM events WHERE event_type = (SELECT max(event_type) FROM events) AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-05 12:00:00'")
def metric_range(spark, d):
    e = table(spark, d, "events")
    kind = e.agg(F.max("event_type")).first()[0]
    own = e.filter(F.col("event_type") == kind).select("event_id", "ts", "value")
    return T.in_range(own, "ts", F.expr("timestamp_ntz '2024-01-03'"), F.expr("timestamp_ntz '2024-01-05 12:00:00'"))


_STATE = "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"


@query(f"SELECT user_id, event_id, value FROM ({_STATE}) WHERE event_type <> (SELECT min(event_type) FROM events)")
def log_replay(spark, d):
    e = table(spark, d, "events")
    least = e.agg(F.min("event_type")).first()[0]
    log = e.select("user_id", "event_id", "value", F.when(F.col("event_type") == least, "DELETE").otherwise("UPDATE").alias("op"))
    return replay(log, "user_id", "event_id").drop("op")


@query(f"SELECT user_id, event_id, value FROM ({_STATE}) WHERE event_type <> (SELECT min(event_type) FROM events)")
def snapshot_replay(spark, d):
    e = table(spark, d, "events")
    least = e.agg(F.min("event_type")).first()[0]
    log = e.select("user_id", "event_id", "value", F.when(F.col("event_type") == least, "DELETE").otherwise("UPDATE").alias("op"))
    return resume(snapshot(log, "user_id", "event_id", 600), log, "user_id", "event_id", 600).drop("op")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, ts, i, ts AS last, TRUE AS committed FROM e WHERE i = 1 UNION ALL
SELECT e.user_id, e.event_id, e.ts, e.i, CASE WHEN r.last <= e.ts - to_hours((e.event_id % 9)::INT) THEN e.ts ELSE r.last END, r.last <= e.ts - to_hours((e.event_id % 9)::INT)
FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) SELECT user_id, event_id, committed FROM r""")
def commit_conflicts(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.expr("ts - make_dt_interval(0, CAST(event_id % 9 AS INT))").alias("began"))
    return T.first_committer_wins(e, "user_id", "began", "ts", ["event_id"]).select("user_id", "event_id", "committed")


@query("SELECT p_partkey, (p_size % 7 = 3 OR lower(p_name) LIKE '%a%') AND NOT p_brand IN ('Brand#11', 'Brand#12') AS ok, abs(p_retailprice - 1500) / 2 AS x FROM part")
def safe_expressions(spark, d):
    return table(spark, d, "part").select("p_partkey", expression("(p_size % 7 = 3 OR LOWER(p_name) LIKE '%a%') AND NOT p_brand IN ('Brand#11', 'Brand#12')").alias("ok"), expression("ABS(p_retailprice - 1500) / 2").alias("x"))


# RFC 2104 with the key "k1": SHA-256 over both padded keys, worked out by hand in SQL
_PAD = lambda x: "".join(f"\\x{(b ^ x):02X}" for b in b"k1".ljust(64, b"\0"))


@query(f"SELECT c_custkey, 'anon_' || left(sha256('{_PAD(0x5C)}'::BLOB || unhex(sha256('{_PAD(0x36)}'::BLOB || encode(c_name)))), 16) AS who FROM customer")
def pseudonyms(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.pseudonym(F.col("c_name"), "k1").alias("who"))
