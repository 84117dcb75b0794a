"""Sources and sinks: Parquet tables, NDJSON logs with checksums, task queries, text expositions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.relational import latest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder; columns and filters are pushed into its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Tables(dict):
    """Tables of a folder by name, opened when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self.spark, self.folder = spark, folder

    def __contains__(self, name: object) -> bool:
        return name in TABLES or super().__contains__(name)

    def __missing__(self, name: str) -> DataFrame:
        self[name] = table(self.spark, self.folder, name)
        return self[name]


def write_columnar(df: DataFrame, path: str, rows_per_file: int = 1_000_000, partition_by: Sequence[str] = ()) -> None:
    """Parquet with bounded files, partitioned for pruning."""
    w = df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_series(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Time series partitioned by metric and day, sorted inside files so that row groups can be skipped."""
    day = df.withColumn("day", F.to_date(ts))
    day.repartition("metric", "day").sortWithinPartitions("metric", ts).write.mode("overwrite").partitionBy("metric", "day").parquet(path)


def write_log(df: DataFrame, path: str) -> None:
    """NDJSON with the CRC-32 of every payload."""
    body = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    df.select(F.to_json(F.struct(F.crc32(body).alias("crc"), body.alias("body"))).alias("value")).write.mode("overwrite").text(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of such a log whose checksum holds; corrupt lines are skipped."""
    raw = spark.read.text(path).select(F.from_json("value", "crc bigint, body string").alias("r"))
    return raw.filter(F.crc32("r.body") == F.col("r.crc")).select(F.from_json("r.body", schema).alias("p")).select("p.*")


def replay(log: DataFrame, key: str, seq: str, op: str = "op") -> DataFrame:
    """The state after a log of CREATE, UPDATE and DELETE entries."""
    return latest(log, [key], [seq], F.col(op) == "DELETE")


def snapshot(log: DataFrame, key: str, seq: str, upto, op: str = "op") -> DataFrame:
    """What a log's entries up to a sequence number come to, deleted keys too (they may be older than what follows)."""
    return latest(log.filter(F.col(seq) <= upto), [key], [seq])


def resume(snapshot_rows: DataFrame, log: DataFrame, key: str, seq: str, after, op: str = "op") -> DataFrame:
    """The state from a snapshot and the entries after it: only those are read (the filter reaches the scan)."""
    return replay(snapshot_rows.unionByName(log.filter(F.col(seq) > after)), key, seq, op)


def seal_statistics(df: DataFrame, metric: str, ts: str, value: str, width: str = "2 hours") -> DataFrame:
    """``n, low, high, total, first, last`` of each metric's sealed segments (epoch-aligned)."""
    g = df.groupBy(metric, F.window(ts, width)["start"].alias("segment"))
    return g.agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.sum(value).alias("total"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def query_tasks(df: DataFrame, status: Sequence[str] = (), kind: Sequence[str] = (), priority: tuple | None = None, scheduled_before=None, scheduled_after=None, created_after=None, created_before=None, sort: str = "created_at", descending: bool = True, limit: int = 50, offset: int = 0, tie: str = "id") -> DataFrame:
    """The structured task query: every filter that is given, an order with a tiebreak, one page."""
    if status:
        df = df.filter(F.col("status").isin(list(status)))
    if kind:
        df = df.filter(F.col("type").isin(list(kind)))
    if priority:
        df = df.filter(F.col("priority").between(*priority))
    for c, v, after in (("scheduled_at", scheduled_before, False), ("scheduled_at", scheduled_after, True), ("created_at", created_before, False), ("created_at", created_after, True)):
        if v is not None:
            df = df.filter(F.col(c) >= v if after else F.col(c) <= v)
    key = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_first()
    return df.orderBy(key, tie).offset(offset).limit(limit)


def count_by(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows per listed value, zeros too."""
    all_values = df.sparkSession.createDataFrame([(v,) for v in values], f"`{column}` string")
    return all_values.join(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def export_ndjson(df: DataFrame, path: str, where: Column) -> str:
    """Writes matching rows as JSON lines; SHA-256 over the digests of all lines (independent of their order)."""
    lines = df.filter(where).select(F.to_json(F.struct(*df.columns)).alias("value"))
    lines.write.mode("overwrite").text(path)
    x = lines.select(F.xxhash64("value").cast("decimal(38,0)").alias("a"), F.xxhash64(F.concat(F.lit("#"), "value")).cast("decimal(38,0)").alias("b"))
    return x.agg(F.sha2(F.concat_ws(":", F.coalesce(F.sum("a"), F.lit(0)).cast("string"), F.coalesce(F.sum("b"), F.lit(0)).cast("string"), F.count(F.lit(1)).cast("string")), 256)).first()[0]


def prometheus_lines(df: DataFrame, name: str, labels: Sequence[str], value: str) -> DataFrame:
    """``line``: one exposition line per row."""
    parts = []
    for c in labels:
        parts += [F.lit(f'{c}="'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('",')]
    return df.select(F.concat(F.lit(name + "{"), F.rtrim(F.concat(*parts), F.lit(",")) if parts else F.lit(""), F.lit("} "), F.col(value).cast("string")).alias("line"))
