"""Task and scheduling analytics: shares, misfires, drift, trends, cursors, leases, journals."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators.relational import join
from sparkloom.operators.series import fold


def dominant_share(df: DataFrame, user: str, capacity: dict[str, float]) -> DataFrame:
    """``share`` of each user: the largest of its summed uses over the capacities."""
    g = df.groupBy(user).agg(*[(F.sum(c) / cap).alias(f"__{c}") for c, cap in capacity.items()])
    parts = [F.coalesce(F.col(f"__{c}"), F.lit(0.0)) for c in capacity]
    return g.select(user, F.greatest(F.lit(0.0), *parts).alias("share"))


def neediest(shares: DataFrame, user: str) -> DataFrame:
    """The user with the smallest dominant share (ties by name): one row, by aggregation."""
    return shares.agg(F.min_by(F.struct(user, "share"), F.struct("share", user)).alias("x")).select("x.*")


def misfire_runs(missed: Column, policy: Column) -> Column:
    """How many missed runs are made up: FIRE_ALL all, FIRE_ONCE one, others none."""
    return F.when(policy == "FIRE_ALL", missed).when(policy == "FIRE_ONCE", F.least(missed, F.lit(1))).otherwise(F.lit(0))


def drifted(actual: Column, scheduled: Column, threshold_s: float) -> Column:
    """Whether a start is further than the threshold from its schedule."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    return F.abs(seconds(actual) - seconds(scheduled)) > threshold_s


def growth(df: DataFrame, keys: Sequence[str], ts: str, value: str, tie: str, limit_per_minute: float, least: int = 5) -> DataFrame:
    """``per_minute`` between each key's first and last sample (0 below ``least`` samples) and ``leaking``."""
    order = F.struct(ts, tie)
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min_by(value, order).alias("a"), F.max_by(value, order).alias("z"), F.min(ts).alias("t0"), F.max(ts).alias("t1"))
    minutes = (F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / 60e6
    rate = F.when(F.col("n") < least, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("z") - F.col("a"), minutes), F.lit(0.0)))
    return g.select(*keys, "n", rate.alias("per_minute")).withColumn("leaking", F.col("per_minute") > limit_per_minute)


def size_by_class(df: DataFrame, kind: str, size: str) -> DataFrame:
    """``n`` and ``total`` of each class, largest total first."""
    return df.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("total")).orderBy(F.desc("total"), kind)


def seek(df: DataFrame, key: str, at, limit: int, backward: bool = False) -> DataFrame:
    """The next ``limit`` rows of a cursor from the first key >= ``at`` (or the last <= it, backward)."""
    hit = df.filter(F.col(key) <= at if backward else F.col(key) >= at)
    return hit.orderBy(F.desc(key) if backward else F.asc(key)).limit(limit)


def append(journal: DataFrame, new: DataFrame, aggregate: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Optimistic append: ``new`` rows (with ``expected``) accepted with their ``version``, and those in conflict.

    An aggregate's rows are accepted if all of them expect its last version in
    ``journal`` (0 without one); versions go on from there in order.
    """
    last = journal.groupBy(F.col(aggregate).alias("__a")).agg(F.max("version").alias("__v"))
    known = join(new, last, [(aggregate, "__a")], "LEFT_OUTER").withColumn("__v", F.coalesce("__v", F.lit(0)))
    w = W.partitionBy(aggregate)
    known = known.withColumn("__ok", F.bool_and(F.col("expected").eqNullSafe(F.col("__v"))).over(w))
    versioned = known.withColumn("version", F.col("__v") + F.row_number().over(w.orderBy(*order)))
    return versioned.filter("__ok").select(*new.columns, "version"), known.filter("NOT __ok").select(*new.columns)


def due(df: DataFrame, execute_at: str, now) -> DataFrame:
    """Delayed rows to release."""
    return df.filter(F.col(execute_at) <= now)


def lease_state(deliveries: Column, leased_until: Column, now: Column, most: int) -> Column:
    """LEASED while the lease runs; else READY if never delivered, DEAD_LETTER after ``most`` deliveries, else REDELIVER."""
    return F.when(F.coalesce(leased_until > now, F.lit(False)), "LEASED").when(F.coalesce(deliveries, F.lit(0)) == 0, "READY").when(deliveries >= most, "DEAD_LETTER").otherwise("REDELIVER")


def audit_chain(df: DataFrame, chain: str, seq: str, fields: Sequence[str]) -> DataFrame:
    """Adds ``previous`` and ``hash``: SHA-256 over the hash before and the row's fields, chain by chain."""
    cols = list(dict.fromkeys((chain, seq, *fields)))
    text = F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)

    def step(state: list, g: pd.DataFrame) -> pd.DataFrame:
        before, previous, hashes = state[0] if state else "", [], []
        for t in g["__t"]:
            previous.append(before)
            before = hashlib.sha256(f"{before}|{t}".encode()).hexdigest()
            hashes.append(before)
        state[:] = [before]
        return g[cols].assign(previous=previous, hash=hashes)

    return fold(df.select(*cols, text.alias("__t")), chain, [seq], list, step, f"{kinds}, previous string, hash string")


def range_assignment(members: DataFrame, topics: DataFrame) -> DataFrame:
    """``topic, partition, member``: contiguous ranges of each topic's partitions over its members by name; the first get one more.

    ``members (member, topic)``: subscriptions; ``topics (topic, partitions)``. Topics without members stay unassigned.
    """
    m = members.select("member", "topic").distinct()
    m = m.withColumn("i", F.row_number().over(W.partitionBy("topic").orderBy("member")) - 1).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("topic")))
    m = m.join(topics.select("topic", "partitions"), "topic")
    each, extra = F.floor(F.col("partitions") / F.col("n")), F.col("partitions") % F.col("n")
    first = F.col("i") * each + F.least(F.col("i"), extra)
    size = each + (F.col("i") < extra).cast("long")
    m = m.withColumn("first", first.cast("long")).withColumn("size", size.cast("long")).filter("size > 0")
    return m.select("topic", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("size") - 1)).alias("partition"), "member")


def sticky_assignment(members: DataFrame, topics: DataFrame, held: DataFrame) -> DataFrame:
    """``topic, partition, member``: what a member holds and still may hold stays; the rest goes, one by one, to the least loaded member that subscribes.

    ``held (topic, partition, member)``. Sequential by nature: one task over all partitions of a cluster's topics.
    """
    kept = held.join(topics, "topic").filter("partition < partitions").join(members.select("member", "topic").distinct(), ["member", "topic"], "left_semi")
    kept = kept.groupBy("topic", "partition").agg(F.min("member").alias("member"))
    every = topics.select("topic", F.explode(F.sequence(F.lit(0).cast("long"), F.col("partitions").cast("long") - 1)).alias("partition")).filter("partition >= 0")
    every = every.join(kept.select("topic", F.col("partition").cast("long").alias("partition"), "member"), ["topic", "partition"], "left")
    subscribers = members.groupBy("topic").agg(F.array_sort(F.collect_set("member")).alias("subscribers"))
    loads = kept.groupBy("member").agg(F.count(F.lit(1)).alias("n"))
    loads = loads.agg(F.map_from_entries(F.collect_list(F.struct("member", "n"))).alias("loads"))  # of a group's members
    rows = every.join(subscribers, "topic", "left").crossJoin(F.broadcast(loads)).withColumn("__one", F.lit(1))

    def step(load: dict, g: pd.DataFrame) -> pd.DataFrame:
        if not load:
            load.update(dict(g["loads"].iloc[0] or {}))
        out = []
        for who, able in zip(g["member"], g["subscribers"]):
            if pd.isna(who):
                who = min(able, key=lambda x: (load.get(x, 0), x)) if able is not None and len(able) else None
                if who is not None:
                    load[who] = load.get(who, 0) + 1
            out.append(who)
        return g[["topic", "partition"]].assign(member=out)

    return fold(rows, "__one", ["topic", "partition"], dict, step, "topic string, partition bigint, member string").filter("member IS NOT NULL")


def _cells(column: str, width: int, depth: int) -> Column:
    """The counter of a value in each row of a Count-Min table."""
    return F.array(*[F.struct(F.lit(i).alias("i"), F.pmod(F.xxhash64(F.lit(i), F.col(column)), F.lit(width)).alias("cell")) for i in range(depth)])


def count_min(df: DataFrame, column: str, items: DataFrame | Sequence, width: int = 2048, depth: int = 5) -> DataFrame | dict:
    """``items`` with ``estimate``: counts of their values from a Count-Min table of fixed size, never too low.

    Counters are summed map side first; at most ``width * depth`` rows meet. For a
    list of items, which is as short as its caller made it, estimates by item.
    """
    if not isinstance(items, DataFrame):
        asked = df.sparkSession.createDataFrame([(i,) for i in items], df.select(column).schema)
        return {r[0]: r[1] for r in count_min(df, column, asked, width, depth).collect()}
    table = df.select(F.explode(_cells(column, width, depth)).alias("c")).groupBy("c.i", "c.cell").agg(F.count(F.lit(1)).alias("n"))
    asked = items.select(column).distinct().select(column, F.explode(_cells(column, width, depth)).alias("c")).select(column, "c.i", "c.cell")
    found = asked.join(F.broadcast(table), ["i", "cell"], "left").groupBy(column).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))
    return join(items, found, [(column, column)], "LEFT_OUTER")


class Bloom:
    """A Bloom filter: bits set by ``k`` hashes, for about ``expected`` items at a false-positive rate of ``rate``.

    All bits of a value lie in one block of at most ``BLOCK`` words, so values meet their
    block by a join, and no task or driver holds more than a block at a time.
    """

    #: Words of 64 bits in a block: for some 1,700 values at 0.01, so blocks are filled alike.
    BLOCK = 256

    def __init__(self, expected: int = 10_000, rate: float = 0.01):
        self.size = math.ceil(-expected * math.log(rate) / math.log(2) ** 2)
        self.k = math.ceil(self.size / expected * math.log(2))
        self.blocks = math.ceil(self.size / 64 / self.BLOCK)
        self.width = math.ceil(self.size / 64 / self.blocks)
        self.words: DataFrame | None = None

    def _block(self, c: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(-1), c), F.lit(self.blocks))

    def _places(self, c: Column) -> Column:
        h = lambda i: F.pmod(F.xxhash64(F.lit(i), c), F.lit(self.width * 64))
        return F.array(*[F.struct(F.floor(h(i) / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h(i), F.lit(64)).cast("int")).alias("bit")) for i in range(self.k)])

    def add(self, df: DataFrame, column: str) -> Bloom:
        """Sets the bits of all values (nulls too): words of 64 bits are merged map side first."""
        new = df.select(self._block(F.col(column)).alias("block"), F.explode(self._places(F.col(column))).alias("p")).select("block", "p.word", "p.bit")
        new = new if self.words is None else new.union(self.words)
        self.words = new.groupBy("block", "word").agg(F.bit_or("bit").alias("bit"))
        return self

    def may_hold(self, df: DataFrame, column: str, name: str = "maybe") -> DataFrame:
        """Adds whether each value may have been added; never false for one that was.

        Blocks are arrays of words, looked up by place. Few are broadcast; more are joined, and rows are shuffled to them.
        """
        if self.words is None:
            return df.withColumn(name, F.lit(False))
        every = df.sparkSession.range(self.blocks * self.width).select(F.expr(f"id div {self.width}").alias("block"), (F.col("id") % self.width).cast("int").alias("word"), F.lit(0).cast("long").alias("bit"))
        held = self.words.union(every).groupBy("block", "word").agg(F.bit_or("bit").alias("bit"))  # all words, so that a place is an index
        held = held.groupBy(F.col("block").alias("__block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bit"))), lambda w: w["bit"]).alias("__held"))
        held = F.broadcast(held) if self.blocks * self.width <= 1 << 17 else held.hint("shuffle_hash")  # a megabyte
        hit = F.forall(self._places(F.col(column)), lambda p: F.get("__held", p["word"]).bitwiseAND(p["bit"]) != 0)
        return df.withColumn("__block", self._block(F.col(column))).join(held, "__block").withColumn(name, hit).drop("__block", "__held")
