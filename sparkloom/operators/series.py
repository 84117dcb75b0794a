"""Time series: roll-ups, percentiles, histograms, sketches, recursive per-key folds."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rollup(df: DataFrame, ts: str, value: str, width: str, keys: Sequence[str] = ()) -> DataFrame:
    """Epoch-aligned tumbling buckets: n, total, low, high, mean."""
    v = F.col(value)
    out = df.groupBy(*keys, F.window(ts, width)["start"].alias("bucket"))
    return out.agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high")).withColumn("mean", F.col("total") / F.col("n"))


def downsample(buckets: DataFrame, width: str, keys: Sequence[str] = ()) -> DataFrame:
    """Coarser buckets from the partial aggregates of finer ones."""
    out = buckets.groupBy(*keys, F.window("bucket", width)["start"].alias("bucket"))
    return out.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).withColumn("mean", F.col("total") / F.col("n"))


def in_range(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Rows with low <= column <= high (an open end is None), in order."""
    out = df
    if low is not None:
        out = out.filter(F.col(column) >= low)
    if high is not None:
        out = out.filter(F.col(column) <= high)
    return out.orderBy(column)


def nearest_rank(value: str | Column, p: float) -> Column:
    """Exact percentile, nearest-rank convention (aggregate); at 0 and 1 the least and the largest value."""
    if p in (0.0, 1.0):
        return (F.max if p else F.min)(value)
    if isinstance(value, str):
        return F.expr(f"percentile_disc({float(p)}D) WITHIN GROUP (ORDER BY `{value}`)")
    return F.call_function("percentile_disc", value, F.lit(float(p)))


def summary(df: DataFrame, keys: Sequence[str], ts: str, value: str, now, window_s: float = 60.0, percentiles: Sequence[float] = (0.5, 0.9, 0.99, 0.999)) -> DataFrame:
    """Summary of the last ``window_s`` seconds before ``now`` (both ends in): n, low, high, mean, sd, percentiles, rate.

    Percentiles are those at index floor(n * p), from the counts of distinct values, so no
    group is gathered into an array; the rate divides by the age of the oldest, 1 s at least.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    end = F.unix_micros(F.lit(now).cast("timestamp"))
    rows = df.filter(F.col(value).isNotNull() & us.between(end - int(window_s * 1e6), end))
    v = F.col(value)
    out = rows.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(us).alias("__t"))
    out = out.withColumn("rate", F.col("n") / F.greatest(F.lit(1.0), (end - F.col("__t")) / 1e6)).drop("__t")
    per = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    w = W.partitionBy(*keys)
    per = per.withColumn("__to", F.sum("__c").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("__n", F.sum("__c").over(w))
    for p in percentiles:
        at = F.least(F.col("__n"), F.floor(F.col("__n") * p) + 1)
        per = per.withColumn(f"__p{p}", F.when((F.col("__to") >= at) & (F.col("__to") - F.col("__c") < at), v))
    got = per.groupBy(*keys).agg(*[F.max(f"`__p{p}`").alias(f"p{100 * p:g}".replace(".", "_")) for p in percentiles])
    return out.join(got, list(keys))


def floor_percentile(df: DataFrame, value: str, p: float, keys: Sequence[str] = ()) -> DataFrame:
    """Exact percentile at index floor(n * p), by ranks, not by arrays of whole groups."""
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    ranked = df.filter(F.col(value).isNotNull()).select(*keys, value, F.row_number().over(w.orderBy(value)).alias("__r"), F.count(F.lit(1)).over(w).alias("__n"))
    return ranked.filter(F.col("__r") == F.least(F.col("__n"), F.floor(F.col("__n") * p) + 1)).select(*keys, F.col(value).alias("value"))


def histogram(df: DataFrame, value: str, bounds: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Cumulative counts of values <= each bound and of all (+Inf): one pass."""
    counts = [F.sum((F.col(value) <= b).cast("long")).alias(f"le_{str(b).replace('.', '_')}") for b in bounds]
    return df.groupBy(*keys).agg(*counts, F.count(value).alias("le_inf"), F.sum(value).alias("total"))


def log_histogram_percentile(df: DataFrame, value: str, p: float, top: float = 3_600_000.0, buckets: int = 2000) -> DataFrame:
    """Lower bound of the logarithmic bucket that holds the percentile; the table of buckets is bounded."""
    scale = buckets / math.log10(top)
    b = F.least(F.lit(buckets - 1), F.floor(F.log10(F.greatest(F.col(value), F.lit(1.0))) * scale)).alias("b")
    per = df.filter(F.col(value).isNotNull()).groupBy(b).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(F.lit(0)).orderBy("b")
    per = per.select("b", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("c"), F.sum("n").over(W.partitionBy(F.lit(0))).alias("t"))
    return per.filter(F.col("c") >= F.ceil(F.col("t") * p)).agg(F.pow(F.lit(10.0), F.min("b") / scale).alias("value"))


def fold(df: DataFrame, key: str, order: Sequence[str], start: Callable[[], object], step: Callable[[object, pd.DataFrame], pd.DataFrame | None], schema: str, finish: Callable[[object], pd.DataFrame] | None = None) -> DataFrame:
    """A recurrence over each key's rows in order.

    Rows are dealt by key, sorted (on disk where need be), and streamed in batches:
    ``step(state, rows)`` sees some of a key's rows at a time and keeps what it needs in
    the key's ``state``, so no key is ever held in memory. ``finish(state)`` follows a
    key's last rows.
    """

    def run(batches):
        state, at = None, None
        for g in batches:
            if not len(g):
                continue
            k = g[key]
            same = (k == k.shift()) | (k.isna() & k.shift().isna())
            same.iloc[0] = False
            cuts = [*np.flatnonzero(~same.to_numpy()).tolist(), len(g)]
            for lo, hi in zip(cuts, cuts[1:]):
                part = g.iloc[lo:hi]
                now = part[key].iloc[0]
                if state is None or not (now == at or (pd.isna(now) and pd.isna(at))):
                    if state is not None and finish is not None:
                        yield finish(state)
                    state, at = start(), now
                out = step(state, part)
                if out is not None:
                    yield out
        if state is not None and finish is not None:
            yield finish(state)

    dealt = df.repartition(F.col(f"`{key}`")).sortWithinPartitions(key, *[o for o in order if o != key])
    return dealt.mapInPandas(run, schema)


def ema(df: DataFrame, key: str, order: Sequence[str], value: str, alpha: float = 0.2) -> DataFrame:
    """Exponential moving average; the first value starts it."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *order))

    def step(state, g):
        values = pd.Series(np.concatenate((state, g[value].to_numpy(float))))
        means = values.ewm(alpha=alpha, adjust=False).mean().to_numpy()[len(state) :]
        state[:] = [means[-1]]
        return g[[key, *order]].assign(ema=means)

    return fold(df.select(key, *order, value), key, order, list, step, f"{kinds}, ema double")


def ewma_anomalies(df: DataFrame, key: str, order: Sequence[str], value: str, alpha: float = 0.2, z_limit: float = 3.0, warm: int = 5) -> DataFrame:
    """z of each value against the running mean and variance before it."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *order))

    def step(state, g):
        z, flag = [], []
        n, mean, var = state or (0, 0.0, 0.0)
        for x in g[value].to_numpy(float):
            n += 1
            s = (x - mean) / math.sqrt(max(var, 1e-4)) if n > 1 else 0.0
            z.append(s)
            flag.append(n > warm and abs(s) >= z_limit)
            d = x - mean
            mean, var = (x, 0.0) if n == 1 else (mean + alpha * d, (1 - alpha) * (var + alpha * d * d))
        state[:] = [n, mean, var]
        return g[[key, *order]].assign(z=z, anomaly=flag)

    return fold(df.select(key, *order, value), key, order, list, step, f"{kinds}, z double, anomaly boolean")


def baseline_anomalies(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str) -> DataFrame:
    """value > mean + 2 population deviations of all rows before it; fewer than two before it: never."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    n, mean, sd = F.count(value).over(w), F.avg(value).over(w), F.stddev_pop(value).over(w)
    return df.withColumn("anomaly", F.when(n < 2, False).when(sd == 0, F.col(value) != mean).otherwise(F.col(value) > mean + 2 * sd))


def holt(df: DataFrame, key: str, order: Sequence[str], value: str, alpha: float = 0.5, beta: float = 0.3, ahead: int = 1) -> DataFrame:
    """Level, trend and forecast (with a 95 % band from the last 500 values' deviation) after each key's last row."""
    kind = df.schema[key].dataType.simpleString()

    def step(state, g):
        x = g[value].to_numpy(float)
        if not state:
            state.update(key=g[key].iloc[0], level=x[0], trend=0.0, last=x[:1])
            todo = x[1:]
        else:
            todo = x
        level, trend = state["level"], state["trend"]
        for v in todo:
            before = level
            level = alpha * v + (1 - alpha) * (level + trend)
            trend = beta * (level - before) + (1 - beta) * trend
        state.update(level=level, trend=trend, last=np.concatenate((state["last"], todo))[-500:])

    def finish(state):
        f, band = state["level"] + ahead * state["trend"], 1.96 * np.std(state["last"])
        return pd.DataFrame({key: [state["key"]], "level": [state["level"]], "trend": [state["trend"]], "forecast": [f], "low": [f - band], "high": [f + band]})

    return fold(df.select(key, *order, value), key, order, dict, step, f"`{key}` {kind}, level double, trend double, forecast double, low double, high double", finish)


def _stateful(df: DataFrame, key: str, ts: str, order: Sequence[str], start: Callable[[], object], allow: Callable[[object, float], bool], name: str) -> DataFrame:
    """``name``: what ``allow(state, seconds)`` says of each row in turn."""
    cols = list(dict.fromkeys((key, ts, *order)))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)

    def step(state, g):
        return g[cols].assign(**{name: [allow(state, t) for t in g["__s"].to_numpy(float)]})

    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("__s")
    return fold(df.select(*cols, seconds), key, [ts, *[o for o in order if o != ts]], start, step, f"{kinds}, `{name}` boolean")


def sliding_log_limit(df: DataFrame, key: str, ts: str, order: Sequence[str], most: int, window_s: float) -> DataFrame:
    """``allowed`` if fewer than ``most`` accepted rows lie in the window before; rejected rows don't count."""

    def allow(kept, t):
        while kept and kept[0] <= t - window_s:
            kept.popleft()
        if len(kept) < most:
            kept.append(t)
            return True
        return False

    return _stateful(df, key, ts, order, deque, allow, "allowed")


def token_bucket(df: DataFrame, key: str, ts: str, order: Sequence[str], capacity: float, per_second: float) -> DataFrame:
    """``allowed`` while the bucket, refilled at a constant rate, holds a token."""

    def allow(state, t):
        left = min(capacity, state.get("left", capacity) + (t - state.get("last", t)) * per_second)
        ok = left >= 1
        state.update(left=left - ok, last=t)
        return ok

    return _stateful(df, key, ts, order, dict, allow, "allowed")


def gcra(df: DataFrame, key: str, ts: str, order: Sequence[str], interval_s: float, burst_s: float) -> DataFrame:
    """``allowed`` by the generic cell rate algorithm: while the theoretical arrival time is at most ``burst_s`` ahead."""

    def allow(state, t):
        tat = max(state.get("tat", -math.inf), t)
        ok = tat <= t + burst_s
        state["tat"] = tat + interval_s * ok
        return ok

    return _stateful(df, key, ts, order, dict, allow, "allowed")


def leaky_bucket(df: DataFrame, key: str, ts: str, order: Sequence[str], capacity: float, per_second: float) -> DataFrame:
    """``allowed`` while the bucket, which leaks at a constant rate, has room for one more."""

    def allow(state, t):
        level = max(0.0, state.get("level", 0.0) - (t - state.get("last", t)) * per_second)
        ok = level + 1 <= capacity
        state.update(level=level + ok, last=t)
        return ok

    return _stateful(df, key, ts, order, dict, allow, "allowed")


def first_committer_wins(df: DataFrame, key: str, start: str, commit: str, order: Sequence[str]) -> DataFrame:
    """``committed`` of each transaction on a key: false if one that committed after its start came first."""
    cols = list(dict.fromkeys((key, start, commit, *order)))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)

    def step(state, g):
        out = []
        for began, ended in zip(g["__a"].tolist(), g["__z"].tolist()):
            out.append(not state or state[0] <= began)
            if out[-1]:
                state[:] = [ended]
        return g[cols].assign(committed=out)

    us = lambda c, n: F.unix_micros(F.col(c).cast("timestamp")).alias(n)
    return fold(df.select(*cols, us(start, "__a"), us(commit, "__z")), key, [commit, *[o for o in order if o != commit]], list, step, f"{kinds}, committed boolean")


def dedup_window(df: DataFrame, key: str, ts: str, order: Sequence[str], window_s: float) -> DataFrame:
    """``fresh`` if the last accepted row of the key is at least the window away."""

    def allow(state, t):
        ok = t - state.get("last", -math.inf) >= window_s
        if ok:
            state["last"] = t
        return ok

    return _stateful(df, key, ts, order, dict, allow, "fresh")


def sessions(df: DataFrame, key: str, ts: str, gap_s: float) -> DataFrame:
    """``key, session_start, session_end, n``: rows of a key less than the gap apart."""
    w = W.partitionBy(key).orderBy(ts)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.coalesce((micros - F.lag(micros).over(w) >= int(gap_s * 1e6)).cast("int"), F.lit(1))
    numbered = df.select(key, ts, new.alias("__n")).withColumn("__s", F.sum("__n").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "__s").agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count(F.lit(1)).alias("n")).drop("__s")
