"""Data governance: retention, purge, metering, policies, audit chains, digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def retention_tier(age_days: Column, hold: Column, warm: int = 7, cold: int = 30, archive: int = 90, purge: int = 365) -> Column:
    """HOT, WARM, COLD, ARCHIVED or PURGE by age; a legal hold keeps from purging."""
    return F.when((age_days >= purge) & ~F.coalesce(hold, F.lit(False)), "PURGE").when(age_days >= archive, "ARCHIVED").when(age_days >= cold, "COLD").when(age_days >= warm, "WARM").otherwise("HOT")


def policy_for(rows: DataFrame, policies: DataFrame, tenant: str, kind: str, value: str, default) -> DataFrame:
    """``value`` of the policy for (tenant, kind), else (tenant, *), else the default."""
    exact = policies.filter("kind <> '*'").select(F.col("tenant").alias(tenant), F.col("kind").alias(kind), F.col(value).alias("__a"))
    wide = policies.filter("kind = '*'").select(F.col("tenant").alias(tenant), F.col(value).alias("__b"))
    return rows.join(exact, [tenant, kind], "left").join(wide, tenant, "left").withColumn(value, F.coalesce("__a", "__b", F.lit(default))).drop("__a", "__b")


def purge_tenant(rows: DataFrame, tenant: str, who: str, redact: Sequence[str] = ()) -> DataFrame:
    """Rows without a tenant's; with ``redact``, its rows stay with those columns blanked."""
    own = F.col(tenant).eqNullSafe(F.lit(who))
    if not redact:
        return rows.filter(~own)
    return rows.withColumns({c: F.when(own, F.lit("[REDACTED]")).otherwise(F.col(c)) for c in redact})


def usage(df: DataFrame, tenant: str, cpu_ms: str, memory_mb: str, storage: str, ts: str) -> DataFrame:
    """Metering per tenant: sums, memory-time, the last storage size."""
    return df.groupBy(tenant).agg(F.sum(cpu_ms).alias("cpu_ms"), F.sum(F.col(memory_mb) * F.col(cpu_ms) / 1000).alias("memory_mb_s"), F.max_by(storage, ts).alias("storage"))


def invoice(df: DataFrame, tenant: str, compute_ms: str, memory_mb_ms: str, storage: str, compute_price=0.00002, memory_price=0.004, storage_price=0.023) -> DataFrame:
    """Cost per tenant: compute by the second, memory by the GB-hour, the largest storage."""
    g = df.groupBy(tenant).agg(F.sum(compute_ms).alias("c"), F.sum(memory_mb_ms).alias("m"), F.max(storage).alias("s"))
    costs = g.select(tenant, (F.col("c") / 1000 * compute_price).alias("compute_cost"), (F.col("m") / (1024 * 1000 * 3600) * memory_price).alias("memory_cost"), (F.col("s") * storage_price).alias("storage_cost"))
    return costs.withColumn("total", F.col("compute_cost") + F.col("memory_cost") + F.col("storage_cost"))


def audit_chain_ok(df: DataFrame, chain: str, seq: str, fields: Sequence[str]) -> DataFrame:
    """``ok``: the row's hash is that of the hash before it and its fields, and it names that hash. Columns hash, previous."""
    w = W.partitionBy(chain).orderBy(seq)
    before = F.coalesce(F.lag("hash").over(w), F.lit(""))
    made = F.sha2(F.concat_ws("|", F.col("previous"), *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]), 256)
    return df.withColumn("ok", (F.col("previous") == before) & (F.col("hash") == made))


def decide(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """ALLOW or DENY per request: deny rules win, nothing matching denies.

    ``requests (request, subject, action, resource)``; ``rules (subject, action, resource, effect)`` with ``prefix*`` patterns.
    """
    fits = lambda a, p: (F.col(p) == "*") | (F.col(a) == F.col(p)) | (F.col(p).endswith("*") & F.col(a).startswith(F.expr(f"left({p}, length({p}) - 1)")))
    r = rules.select(*[F.col(c).alias(f"r_{c}") for c in ("subject", "action", "resource", "effect")])
    hit = requests.join(r, fits("subject", "r_subject") & fits("action", "r_action") & fits("resource", "r_resource"), "left")
    out = hit.groupBy("request").agg(F.coalesce(F.bool_or(F.col("r_effect") == "DENY"), F.lit(False)).alias("deny"), F.coalesce(F.bool_or(F.col("r_effect") == "ALLOW"), F.lit(False)).alias("allow"))
    return out.select("request", F.when(F.col("allow") & ~F.col("deny"), "ALLOW").otherwise("DENY").alias("decision"))


def decide_by_attributes(requests: DataFrame, policies: Sequence[dict]) -> DataFrame:
    """ALLOW or DENY per request, and the first policy that decided: deny wins, nothing matching denies.

    ``requests`` has ``request, action, resource`` and attribute columns. A policy is a dict
    of ``id``, ``effect``, ``actions`` (``*``, exact or ``prefix:*``), ``resources`` (``*``,
    exact or ``prefix*``) and ``conditions``: (column, operator, value) that all must hold.
    Policies are few and become one expression, so requests are neither joined nor shuffled.
    """

    def any_of(column: str, patterns: Sequence[str], tail: str) -> Column:
        out = F.lit(False)
        for p in patterns:
            if p == "*":
                return F.lit(True)
            out |= F.col(column).startswith(p.removesuffix(tail)) if p.endswith(tail) else F.col(column) == p
        return out

    def holds(field: str, operator: str, value) -> Column:
        if operator == "IN":
            return F.col(field).isin(list(value))
        if operator in ("LESS_THAN", "GREATER_THAN"):
            number = F.col(field).try_cast("double")
            return number < float(value) if operator == "LESS_THAN" else number > float(value)
        if operator == "CONTAINS":
            return F.contains(F.col(field).cast("string"), F.lit(str(value)))
        if operator in ("EQUALS", "NOT_EQUALS"):
            same = F.col(field).eqNullSafe(F.lit(value))
            return same if operator == "EQUALS" else ~same
        raise ValueError(f"unknown operator {operator}")

    fits = {"ALLOW": [], "DENY": []}
    for p in policies:
        ok = any_of("action", p.get("actions", ["*"]), ":*") & any_of("resource", p.get("resources", ["*"]), "*")
        for c in p.get("conditions", ()):
            ok &= holds(*c)
        fits[p["effect"]].append(F.when(F.coalesce(ok, F.lit(False)), F.lit(p["id"])))
    first = lambda xs: F.coalesce(*xs, F.lit(None).cast("string"))
    deny, allow = first(fits["DENY"]), first(fits["ALLOW"])
    decision = F.when(deny.isNotNull(), "DENY").when(allow.isNotNull(), "ALLOW").otherwise("DENY")
    return requests.select("request", decision.alias("decision"), F.coalesce(deny, allow).alias("policy"))


def range_digests(df: DataFrame, key: str, value: Column, chunk: int) -> DataFrame:
    """``chunk, digest, n`` of key ranges ``[chunk * size, ...)`` (integer keys), to compare replicas."""
    each = df.select(F.floor(F.col(key) / chunk).alias("chunk"), F.concat(F.col(key).cast("string"), F.lit("="), F.coalesce(value.cast("string"), F.lit(""))).alias("x"))
    return each.groupBy("chunk").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("x")), "\n"), 256).alias("digest"), F.count(F.lit(1)).alias("n"))


def digest_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Chunks that differ or are missing on a side."""
    j = a.select("chunk", F.col("digest").alias("a")).join(b.select("chunk", F.col("digest").alias("b")), "chunk", "full")
    return j.filter(~F.col("a").eqNullSafe(F.col("b"))).select("chunk", F.when(F.col("a").isNull(), "MISSING_LEFT").when(F.col("b").isNull(), "MISSING_RIGHT").otherwise("DIFFERENT").alias("state"))


def transitions_ok(df: DataFrame, key: str, order: Sequence[str], status: str, allowed: DataFrame) -> DataFrame:
    """``valid``: whether a status may follow the one before it (the first may be any); ``allowed (before, after)``."""
    before = F.lag(status).over(W.partitionBy(key).orderBy(*order))
    pairs = allowed.filter("before <> after").select(F.col("before").alias("__b"), F.col("after").alias(status), F.lit(True).alias("__ok")).distinct()
    return df.withColumn("__b", before).join(pairs, ["__b", status], "left").withColumn("valid", F.col("__b").isNull() | F.coalesce("__ok", F.lit(False))).drop("__b", "__ok")


def quarantine(df: DataFrame, retries: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows to retry and rows to set aside."""
    done = F.coalesce(F.col(retries) >= most, F.lit(False))
    return df.filter(~done), df.filter(done)


def storage_health(total: Column, live: Column, tombstones: Column) -> Column:
    """CRITICAL, WARNING or HEALTHY by space amplification and tombstones."""
    ratio = F.try_divide(total, live)
    return F.when((ratio >= 2.5) | (tombstones > 10_000), "CRITICAL").when((ratio >= 1.5) | (tombstones > 5_000), "WARNING").otherwise("HEALTHY")


def root_cause(tasks: DataFrame) -> DataFrame:
    """``state`` of each task of a run: BOTTLENECK (over 2.5 mean durations), ROOT_FAILURE, CASCADED or OK.

    Columns run, task, status, duration, upstream (array of tasks).
    """
    mean = F.avg("duration").over(W.partitionBy("run"))
    failed = tasks.filter("status = 'FAILED'").select("run", F.col("task").alias("up"))
    fed = tasks.select("run", "task", F.explode("upstream").alias("up")).join(failed, ["run", "up"], "left_semi").select("run", "task").distinct().withColumn("fed", F.lit(True))
    out = tasks.withColumn("__m", mean).join(fed, ["run", "task"], "left")
    state = F.when((F.col("status") == "FAILED") & F.col("fed"), "CASCADED").when(F.col("status") == "FAILED", "ROOT_FAILURE").when((F.col("status") == "SUCCESS") & (F.col("duration") > 2.5 * F.col("__m")), "BOTTLENECK").otherwise("OK")
    return out.withColumn("state", state).drop("__m", "fed")
