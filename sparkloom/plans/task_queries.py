"""Registered queries of task, calendar and governance operators, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import calendar as C
from sparkloom.functions import scalar as S
from sparkloom.operators import governance as G
from sparkloom.operators import graph as H
from sparkloom.operators import relational as R
from sparkloom.operators import scheduling as K
from sparkloom.operators import series as T
from sparkloom.plans.queries import query, rnd
from sparkloom.sources.tables import table


@query("SELECT l_suppkey, round(greatest(0, sum(l_quantity) / 100000, sum(l_extendedprice) / 1e8), 8) AS share FROM lineitem GROUP BY 1")
def dominant_share(spark, d):
    li = table(spark, d, "lineitem")
    return K.dominant_share(li, "l_suppkey", {"l_quantity": 1e5, "l_extendedprice": 1e8}).withColumn("share", rnd("share", 8))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN o_orderkey % 5 WHEN 'O' THEN least(o_orderkey % 5, 1) ELSE 0 END AS runs FROM orders")
def misfire_policy(spark, d):
    policy = F.when(F.col("o_orderstatus") == "F", "FIRE_ALL").when(F.col("o_orderstatus") == "O", "FIRE_ONCE").otherwise("SKIP")
    return table(spark, d, "orders").select("o_orderkey", K.misfire_runs(F.col("o_orderkey") % 5, policy).alias("runs"))


@query("SELECT l_orderkey, l_linenumber, abs(epoch(l_shipdate) - epoch(o_orderdate)) > 5184000 AS late FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def schedule_drift(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", K.drifted(F.col("l_shipdate"), F.col("o_orderdate"), 5_184_000).alias("late"))


@query("""WITH g AS (SELECT user_id, count(*) AS n, arg_min(value, (ts, event_id)) AS a, arg_max(value, (ts, event_id)) AS z, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT user_id, n, round(CASE WHEN n < 5 OR us = 0 THEN 0 ELSE (z - a) / (us / 60e6) END, 8) AS per_minute, CASE WHEN n < 5 OR us = 0 THEN 0 ELSE (z - a) / (us / 60e6) END > 0.001 AS leaking FROM g""")
def growth_trend(spark, d):
    g = K.growth(table(spark, d, "events").filter("value IS NOT NULL"), ["user_id"], "ts", "value", "event_id", 0.001)
    return g.withColumn("per_minute", rnd("per_minute", 8))


@query("SELECT p_brand, count(*) AS n, sum(p_size)::BIGINT AS total FROM part GROUP BY 1")
def size_by_class(spark, d):
    return K.size_by_class(table(spark, d, "part"), "p_brand", "p_size")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey <= 500 ORDER BY o_orderkey DESC LIMIT 10")
def cursor_seek(spark, d):
    return K.seek(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 500, 10, backward=True)


_APPEND = """WITH j AS (SELECT user_id, count(*) AS v FROM events WHERE event_id % 3 = 0 GROUP BY 1),
k AS (SELECT user_id, event_id, CASE WHEN user_id % 2 = 0 THEN coalesce(v, 0) ELSE user_id % 4 END AS expected, coalesce(v, 0) AS v FROM events LEFT JOIN j USING (user_id) WHERE event_id % 3 = 1)
SELECT user_id, event_id, expected, v + row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM k WHERE expected = v"""


@query(_APPEND)
def optimistic_append(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id")
    journal = e.filter("event_id % 3 = 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("version"))
    new = e.filter("event_id % 3 = 1").join(journal, "user_id", "left").withColumn("expected", F.when(F.col("user_id") % 2 == 0, F.coalesce("version", F.lit(0))).otherwise(F.col("user_id") % 4)).drop("version")
    accepted, _ = K.append(journal, new, "user_id", ["event_id"])
    return accepted


@query("SELECT o_orderkey, CASE WHEN o_orderdate > TIMESTAMP '1997-01-01' THEN 'LEASED' WHEN o_orderkey % 6 = 0 THEN 'READY' WHEN o_orderkey % 6 >= 4 THEN 'DEAD_LETTER' ELSE 'REDELIVER' END AS state FROM orders")
def lease_states(spark, d):
    state = K.lease_state(F.col("o_orderkey") % 6, F.col("o_orderdate"), F.expr("timestamp_ntz '1997-01-01'"), 4)
    return table(spark, d, "orders").select("o_orderkey", state.alias("state"))


@query("""SELECT event_id, CASE WHEN isodow(ts) <= 5 AND hour(ts) * 60 + minute(ts) < 390 THEN date_trunc('day', ts)
ELSE date_trunc('day', ts) + to_days(CASE isodow(ts) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END) END + INTERVAL 390 MINUTE AS due FROM events""")
def cron_next(spark, d):
    return table(spark, d, "events").select("event_id", C.next_cron("30 6 * * 1-5", F.col("ts")).alias("due"))


@query("SELECT o_orderkey, (o_orderdate::DATE + (CASE isodow(o_orderdate) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END)::INT)::VARCHAR AS day FROM orders")
def business_day_next(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.next_business_day(F.col("o_orderdate")).cast("string").alias("day"))


@query("SELECT c_custkey, lpad(c_custkey::VARCHAR, 11, '4') AS back, TRUE AS same_shape FROM customer")
def digits_round_trip(spark, d):
    x = F.lpad(F.col("c_custkey").cast("string"), 11, "4")
    c = table(spark, d, "customer").select("c_custkey", x.alias("x")).withColumn("e", C.encrypt_digits(F.col("x"), "k1"))
    return c.select("c_custkey", C.decrypt_digits(F.col("e"), "k1").alias("back"), (F.col("e").rlike("^[0-9]{11}$") & (F.col("e") != F.col("x"))).alias("same_shape"))


@query("SELECT event_type, count(*) AS estimate FROM events GROUP BY 1")
def count_min_sketch(spark, d):
    """Never too low; equal to the exact counts as long as the items are few beside the sketch."""
    e = table(spark, d, "events").select("event_type")
    return K.count_min(e, "event_type", e.distinct())


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, coalesce(event_type, '') || '|' || coalesce((value * 100)::BIGINT::VARCHAR, '') AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, sha256('|' || t) AS hash FROM e WHERE i = 1 UNION ALL
SELECT e.user_id, e.event_id, e.i, sha256(r.hash || '|' || e.t) FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, event_id, hash, event_id % 10 <> 3 AS ok FROM r""")
def audit_chain(spark, d):
    e = table(spark, d, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    made = K.audit_chain(e, "user_id", "event_id", ["event_type", "cents"])
    forged = made.withColumn("event_type", F.when(F.col("event_id") % 10 == 3, F.lit("forged")).otherwise(F.col("event_type")))
    return G.audit_chain_ok(forged, "user_id", "event_id", ["event_type", "cents"]).select("user_id", "event_id", "hash", "ok")


@query("SELECT l_suppkey, sum(l_quantity) AS cpu_ms, round(sum(l_linenumber * l_quantity / 1000), 6) AS memory_mb_s, arg_max(l_partkey, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS storage FROM lineitem GROUP BY 1")
def usage_metering(spark, d):
    li = table(spark, d, "lineitem").withColumn("at", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"))
    return G.usage(li, "l_suppkey", "l_quantity", "l_linenumber", "l_partkey", "at").withColumn("memory_mb_s", rnd("memory_mb_s", 6))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 10 WHEN o_orderstatus = 'F' THEN 20 ELSE 90 END AS days FROM orders")
def policy_lookup(spark, d):
    policies = spark.createDataFrame([("F", "1-URGENT", 10), ("F", "*", 20)], "tenant string, kind string, days int")
    return G.policy_for(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), policies, "o_orderstatus", "o_orderpriority", "days", 90).select("o_orderkey", "days")


@query("SELECT c_custkey AS request, CASE WHEN c_mktsegment = 'BUILDING' THEN 'DENY' WHEN c_mktsegment LIKE 'AUTO%' OR c_nationkey % 2 = 0 THEN 'ALLOW' ELSE 'DENY' END AS decision FROM customer")
def access_decisions(spark, d):
    action = F.when(F.col("c_nationkey") % 2 == 0, "read").otherwise("write")
    requests = table(spark, d, "customer").select(F.col("c_custkey").alias("request"), F.lit("u").alias("subject"), action.alias("action"), F.col("c_mktsegment").alias("resource"))
    rules = spark.createDataFrame([("*", "read", "*", "ALLOW"), ("u", "*", "AUTO*", "ALLOW"), ("*", "*", "BUILDING", "DENY")], "subject string, action string, resource string, effect string")
    return G.decide(requests, rules)


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), (SELECT min(string_split(p_name, ' ')[1]) FROM part))")
def multi_value_attribute(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("tags"))
    tag = p.agg(F.min(F.get("tags", F.lit(0)))).first()[0]
    return p.filter(F.array_contains("tags", tag)).select("p_partkey")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '[REDACTED]' ELSE c_name END AS c_name FROM customer")
def purge_redact(spark, d):
    return G.purge_tenant(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_mktsegment", "BUILDING", ["c_name"]).drop("c_mktsegment")


_EDGES = "SELECT DISTINCT p_partkey AS dst, p_partkey // 3 AS src FROM part WHERE p_partkey // 3 > 0"


@query(f"WITH RECURSIVE e AS ({_EDGES}), gone AS (SELECT p_partkey AS node FROM part WHERE p_size > 40 UNION SELECT dst FROM gone JOIN e ON src = node) SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT node FROM gone)")
def dag_prune(spark, d):
    p = table(spark, d, "part")
    edges = p.select(F.expr("p_partkey div 3").alias("src"), F.col("p_partkey").alias("dst")).filter("src > 0")
    return H.prune(p.select(F.col("p_partkey").alias("node"), "p_size"), edges, "p_size <= 40").select("node")


@query("SELECT p_partkey AS node, p_partkey // 10 * 10 AS component FROM part")
def strong_components(spark, d):
    k = F.col("p_partkey")
    ring = table(spark, d, "part").select(k.alias("src"), (F.floor(k / 10) * 10 + (k + 1) % 10).alias("dst"))
    return H.strong_components(ring)


@query("SELECT floor(c_custkey / 100)::BIGINT AS chunk, 'DIFFERENT' AS state FROM customer GROUP BY 1 HAVING bool_or(c_custkey % 250 = 7)")
def replica_diff(spark, d):
    c = table(spark, d, "customer")
    other = c.withColumn("c_name", F.when(F.col("c_custkey") % 250 == 7, "changed").otherwise(F.col("c_name")))
    return G.digest_diff(G.range_digests(c, "c_custkey", F.col("c_name"), 100), G.range_digests(other, "c_custkey", F.col("c_name"), 100))


@query("""WITH v AS (SELECT s_suppkey, s_nationkey % 3 - 1 AS x, s_suppkey % 3 - 1 AS y FROM supplier)
SELECT s_suppkey, CASE WHEN greatest(x, y) > 0 AND least(x, y) < 0 THEN 'CONCURRENT' WHEN greatest(x, y) > 0 THEN 'AFTER' WHEN least(x, y) < 0 THEN 'BEFORE' ELSE 'EQUAL' END AS o FROM v""")
def version_vectors(spark, d):
    a = F.create_map(F.lit("x"), (F.col("s_nationkey") % 3).cast("long"), F.lit("y"), F.col("s_suppkey") % 3)
    b = F.create_map(F.lit("x"), F.lit(1).cast("long"), F.lit("y"), F.lit(1).cast("long"))
    return table(spark, d, "supplier").select("s_suppkey", S.compare_versions(a, b).alias("o"))


@query("SELECT event_id, ((epoch_us(ts) // 1000 - 1704067200000) * 4194304 + (user_id % 32) * 4096 + event_id % 4096)::BIGINT AS id FROM events")
def time_ordered_ids(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", S.snowflake_id(F.unix_millis(F.col("ts").cast("timestamp")), F.col("user_id") % 32, F.col("event_id") % 4096).alias("id"))


@query("SELECT p_partkey, least(100.0 * 2 ** (p_size % 20), 3600000.0) AS wait, greatest(0, 9 - p_size // 10)::INT AS priority FROM part")
def retry_and_ageing(spark, d):
    p = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", S.backoff(F.lit(100.0), p % 20).alias("wait"), S.age_priority(F.lit(9), p, 10).cast("int").alias("priority"))


@query("SELECT c_custkey, '[REDACTED]' AS secret, c_mktsegment AS segment FROM customer")
def redact_map(spark, d):
    m = S.redact(F.create_map(F.lit("Secret"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment")), ["secret"])
    return table(spark, d, "customer").select("c_custkey", m["Secret"].alias("secret"), m["segment"].alias("segment"))


@query("SELECT p_partkey, p_size < 5 AS retry FROM part")
def quarantine_split(spark, d):
    again, aside = G.quarantine(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", 5)
    return again.withColumn("retry", F.lit(True)).union(aside.withColumn("retry", F.lit(False))).drop("p_size")


@query("SELECT s_suppkey, CASE WHEN s_acctbal <> 0 AND 9000 / s_acctbal >= 2.5 OR s_suppkey % 3 * 5001 > 10000 THEN 'CRITICAL' WHEN s_acctbal <> 0 AND 9000 / s_acctbal >= 1.5 OR s_suppkey % 3 * 5001 > 5000 THEN 'WARNING' ELSE 'HEALTHY' END AS health FROM supplier")
def storage_health(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", G.storage_health(F.lit(9000.0), F.col("s_acctbal"), F.col("s_suppkey") % 3 * 5001).alias("health"))


_STOP = """'a','about','above','after','again','against','all','am','an','and','any','are','as','at','be','because','been','before','being','below','between','both','but','by',
'for','from','in','into','is','it','its','of','on','or','that','the','this','to','was','with'"""
_WORDS = "list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9_ \\t\\n\\r]', ' ', 'g'), '[ \\t\\n\\r]+'), lambda w: length(w) > 1 AND NOT list_contains([" + _STOP + "], w))"


@query(f"SELECT lang, count(*) AS n FROM (SELECT lang, unnest({_WORDS}) AS w FROM documents) GROUP BY 1")
def words_by_language(spark, d):
    t = table(spark, d, "documents").select("lang", F.explode(S.tokens_words(F.col("text"))).alias("w"))
    return t.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_shipdate::DATE::VARCHAR AS day, round(sum(l_quantity), 2) AS total FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-31' GROUP BY 1")
def series_range(spark, d):
    s = T.in_range(table(spark, d, "lineitem").select("l_shipdate", "l_quantity"), "l_shipdate", F.expr("timestamp_ntz '1995-01-01'"), F.expr("timestamp_ntz '1995-03-31'"))
    return s.groupBy(F.to_date("l_shipdate").cast("string").alias("day")).agg(rnd(F.sum("l_quantity"), 2).alias("total"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def topk_per_group(spark, d):
    w = R.window(["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("rn")).filter("rn <= 3").drop("rn")
