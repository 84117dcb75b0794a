"""Joins, grouping, windows, subqueries and set operations with the engine's null rules."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

JOINS = {"INNER": "inner", "LEFT_OUTER": "left", "RIGHT_OUTER": "right", "FULL_OUTER": "full", "LEFT_SEMI": "left_semi", "LEFT_ANTI": "left_anti", "CROSS": "cross"}
#: Pairs that a task of a range join looks at, about.
PIECE = 4_000_000
HINTS = {"HASH": "shuffle_hash", "SORT_MERGE": "merge", "MERGE": "merge", "NESTED_LOOP": "shuffle_replicate_nl", "BROADCAST": "broadcast", None: None}


def join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str = "INNER", algorithm: str | None = None, left_alias: str | None = None, right_alias: str | None = None) -> DataFrame:
    """Joins on pairs of columns; null keys match null keys.

    With aliases, output columns are ``alias_column``. Without, a right column
    replaces a left one of the same name, except in outer joins on a kept key.
    """
    kind = JOINS[how]
    l = left.select(*[F.col(f"`{c}`").alias(f"{left_alias}_{c}" if left_alias else c) for c in left.columns])  # noqa: E741
    r = right.select(*[F.col(f"`{c}`").alias(f"__r_{c}") for c in right.columns])
    if HINTS[algorithm]:
        r = r.hint(HINTS[algorithm])
    name = (lambda c: f"{left_alias}_{c}") if left_alias else (lambda c: c)
    if kind == "cross" or not on:
        out = l.crossJoin(r)
    else:
        out = l.join(r, reduce(lambda a, b: a & b, (F.col(f"`{name(a)}`").eqNullSafe(F.col(f"`__r_{b}`")) for a, b in on)), kind)
    if kind in ("left_semi", "left_anti") and on:
        return out
    target = {c: f"{right_alias}_{c}" if right_alias else c for c in right.columns}
    kept = [c for c in l.columns if c not in target.values()]
    return out.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`__r_{c}`").alias(t) for c, t in target.items()])


def theta_join(left: DataFrame, right: DataFrame, condition: str, how: str = "INNER", left_alias: str = "l", right_alias: str = "r") -> DataFrame:
    """A nested-loop join on any condition over ``l.x`` and ``r.y``; output columns are ``alias_column``.

    Null conditions match nothing. Equalities in the condition still let Spark hash or merge.
    """
    kind = JOINS[how]
    out = left.alias(left_alias).join(right.alias(right_alias), F.expr(condition), kind)
    sides = [(left_alias, left)] if kind in ("left_semi", "left_anti") else [(left_alias, left), (right_alias, right)]
    return out.select(*[F.col(f"{a}.`{c}`").alias(f"{a}_{c}") for a, df in sides for c in df.columns])


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Rows whose ``value`` lies in [low, high]: equi-join on buckets, then the exact test.

    A range is filed at the level whose buckets (``width`` times a power of two) are as
    wide as itself, so it lies in two of them at most, however wide it is; a point
    looks its bucket up at every level that has ranges. Pairs can grow with the square
    of the input, so they are counted first: buckets of more than ``PIECE`` pairs are
    parted by points, and tasks are as many as the pairs need.
    """
    span = F.greatest(F.col(high) - F.col(low), F.lit(0.0)) / width
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(span, F.lit(1.0))))).cast("int")
    bucket = lambda c, k: F.floor(F.col(c) / (F.lit(float(width)) * F.pow(F.lit(2.0), k)))
    r = ranges.filter(F.col(low) <= F.col(high)).withColumn("__k", level)
    r = r.withColumn("__b", F.explode(F.array_distinct(F.array(bucket(low, F.col("__k")), bucket(high, F.col("__k"))))))
    levels = sorted(x[0] for x in r.select("__k").distinct().collect())  # fewer than 1,100: powers of two of a double
    if not levels:
        return points.join(ranges, F.lit(False))
    p = points.withColumn("__k", F.explode(F.array(*[F.lit(k) for k in levels]))).withColumn("__b", bucket(value, F.col("__k")))
    n = p.groupBy("__k", "__b").agg(F.count(F.lit(1)).alias("__p")).join(r.groupBy("__k", "__b").agg(F.count(F.lit(1)).alias("__r")), ["__k", "__b"])
    n = n.select("__k", "__b", F.ceil(F.col("__p").cast("double") * F.col("__r") / PIECE).alias("__n"), (F.col("__p").cast("double") * F.col("__r")).alias("__pairs"))
    tasks = math.ceil((n.agg(F.sum("__pairs")).first()[0] or 0) / PIECE)
    keys = ["__k", "__b"]
    if tasks > 1:
        # of these buckets there is one for 2 * sqrt(PIECE) rows at most
        large = F.broadcast(n.filter("__n > 1").select("__k", "__b", "__n"))
        p = p.withColumn("__i", F.xxhash64(F.monotonically_increasing_id())).join(large, keys, "left")
        p = p.withColumn("__s", F.coalesce(F.pmod("__i", "__n"), F.lit(0))).drop("__i", "__n")
        r = r.join(large, keys, "left").withColumn("__s", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("__n") - 1, F.lit(0))))).drop("__n")
        keys = [*keys, "__s"]
        # given numbers of partitions stay, unless below the session's: by their bytes, small inputs of many pairs would go to few tasks
        tasks = max(tasks, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        p, r = p.repartition(tasks, *keys), r.repartition(tasks, *keys).hint("merge")
    return p.join(r, keys).filter(F.col(value).between(F.col(low), F.col(high))).drop("__k", "__b", "__s")


def asof_join(left: DataFrame, right: DataFrame, key: str, ts: str, right_cols: Sequence[str]) -> DataFrame:
    """Each left row with the last right row of its key at or before its time: one sort of the union, no pairs."""
    cols = [c for c in left.columns if c not in (key, ts)]
    a = left.select(key, ts, F.struct(*cols).alias("__l"), F.lit(None).cast(right.select(F.struct(*right_cols)).schema[0].dataType).alias("__r"), F.lit(1).alias("__s"))
    b = right.select(key, ts, F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), F.struct(*right_cols).alias("__r"), F.lit(0).alias("__s"))
    w = W.partitionBy(key).orderBy(ts, "__s").rowsBetween(W.unboundedPreceding, 0)
    out = a.union(b).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).filter("__s = 1")
    return out.select(key, ts, *[F.col(f"__l.{c}") for c in cols], *[F.col(f"__r.{c}").alias(c) for c in right_cols])


def grouping(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], mode: str = "plain", sets: Sequence[Sequence[str]] = (), having: Column | None = None) -> DataFrame:
    """Plain, rollup, cube or grouping-sets aggregation, with ``grouping_id`` for the last three."""
    if mode == "plain":
        out = df.groupBy(*keys).agg(*aggs)
    else:
        if mode == "rollup":
            g = df.rollup(*keys)
        elif mode == "cube":
            g = df.cube(*keys)
        elif mode == "sets":
            g = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(k) for k in keys])
        else:
            raise ValueError(f"unknown grouping {mode}")
        out = g.agg(*aggs, F.grouping_id().cast("long").alias("grouping_id"))
    return out if having is None else out.filter(having)


def array_agg(c: str) -> Column:
    """All values of a group, nulls too."""
    return F.transform(F.collect_list(F.struct(F.col(c).alias("x"))), lambda s: s["x"])


def window(partition: Sequence[str], order: Sequence[Column] = (), frame: tuple[int | None, int | None] | None = None, by_range: bool = False):
    """A window; ordered windows end at the current *row* unless a frame is given (None is unbounded)."""
    w = W.partitionBy(*partition)
    if not order:
        return w
    w = w.orderBy(*order)
    lo, hi = frame if frame is not None else (None, 0)
    bounds = (W.unboundedPreceding if lo is None else lo, W.unboundedFollowing if hi is None else hi)
    return w.rangeBetween(*bounds) if by_range else w.rowsBetween(*bounds)


def floor_ntile(n: int, partition: Sequence[str], order: Sequence[Column]) -> Column:
    """floor((row - 1) * n / rows) + 1, which spreads the remainder evenly."""
    row = F.row_number().over(W.partitionBy(*partition).orderBy(*order)) - 1
    return (F.floor(row * n / F.count(F.lit(1)).over(W.partitionBy(*partition))) + 1).cast("int")


def scalar_subquery(outer: DataFrame, inner: DataFrame, key: str, pick: Column, name: str) -> DataFrame:
    """``name`` from the correlated rows of ``inner`` (an aggregate), null without any."""
    return outer.join(inner.groupBy(key).agg(pick.alias(name)), key, "left")


def exists(outer: DataFrame, inner: DataFrame, on: Sequence[tuple[str, str]], negated: bool = False) -> DataFrame:
    """Outer rows with (or without) a partner; null matches null."""
    return join(outer, inner, on, "LEFT_ANTI" if negated else "LEFT_SEMI")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], deleted: Column | None = None) -> DataFrame:
    """The last row of each key (log compaction, versions, merged runs), without those marked deleted."""
    w = W.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    out = df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
    return out if deleted is None else out.filter(~F.coalesce(deleted, F.lit(False)))


def as_of(df: DataFrame, keys: Sequence[str], commit: str, at, deleted: Column | None = None) -> DataFrame:
    """The state that a snapshot reader at ``at`` sees."""
    return latest(df.filter(F.col(commit) <= at), keys, [commit], deleted)


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> tuple[DataFrame, int, bool]:
    """One page by a total order, the number of all rows, and whether more follow."""
    total = df.count()
    return df.orderBy(*order).offset(offset).limit(limit), total, offset + limit < total


def round_robin(df: DataFrame, tenant: str, order: Sequence[Column]) -> DataFrame:
    """Rows interleaved by tenant: ``turn`` within the tenant, tenants by name."""
    return df.withColumn("turn", F.row_number().over(W.partitionBy(tenant).orderBy(*order)))


def attributes_and(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows that have all attributes; none wanted gives none."""
    if not wanted:
        return df.limit(0)
    return df.filter(reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.lit(v)) for k, v in wanted.items())))


def attributes_or(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows that have any of the attributes."""
    if not wanted:
        return df.limit(0)
    return df.filter(reduce(lambda a, b: a | b, (F.col(k).eqNullSafe(F.lit(v)) for k, v in wanted.items())))


def validate(df: DataFrame, rules: Sequence[tuple[str, Column]], name: str = "errors") -> DataFrame:
    """Adds the messages of the rules that a row breaks; null conditions break none."""
    return df.withColumn(name, F.array_compact(F.array(*[F.when(~ok, F.lit(message)) for message, ok in rules])))


def projection(rules: Sequence[tuple[str, Column]], default: Callable | None = None) -> list[Column]:
    """Payload projection: named columns."""
    return [c.alias(n) for n, c in rules]
