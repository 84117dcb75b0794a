"""Structured Streaming: windows, dedup, limits, projections, dead letters, sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """A file stream of Parquet."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(path)


def tumbling(df: DataFrame, ts: str, width: str, keys: Sequence[str], late: str, value: str, slide: str | None = None) -> DataFrame:
    """Windowed count and sum with a watermark."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    g = df.withWatermark(ts, late).groupBy(w.alias("w"), *keys)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("bucket"), *keys, "n", "total")


def sessions(df: DataFrame, ts: str, gap: str, key: str, late: str) -> DataFrame:
    """Session windows per key."""
    g = df.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key)
    return g.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def dedup(df: DataFrame, keys: Sequence[str], ts: str, within: str) -> DataFrame:
    """First row of each key, remembered as long as the watermark allows."""
    return df.withWatermark(ts, within).dropDuplicatesWithinWatermark(list(keys))


def rate_limit(df: DataFrame, key: str, ts: str, most: int, window_s: float) -> DataFrame:
    """Rows of each key with ``allowed`` by a sliding log of accepted rows, kept as state between batches."""
    kind = df.schema[key].dataType.simpleString()

    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts))
        rows = rows.sort_values(ts)
        out = []
        for t in rows["__s"]:
            kept = [x for x in kept if x > t - window_s]
            out.append(len(kept) < most)
            if out[-1]:
                kept.append(t)
        state.update((kept,))
        yield pd.DataFrame({key: rows[key].to_numpy(), ts: rows[ts].to_numpy(), "allowed": out})

    timed = df.select(key, ts, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("__s"))
    return timed.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, `{ts}` {df.schema[ts].dataType.simpleString()}, allowed boolean", "kept array<double>", "append", "NoTimeout")


def projection(df: DataFrame, key: str, handlers: dict[str, Column], kind: str) -> DataFrame:
    """A materialised view per aggregate: one sum per event type handled."""
    return df.groupBy(key).agg(*[F.sum(F.when(F.col(kind) == k, c).otherwise(0)).alias(k) for k, c in handlers.items()])


def split_dead_letters(good: Column, main: Callable[[DataFrame, int], None], dead: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that sends rows to the main or the dead-letter sink."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        main(batch.filter(F.coalesce(good, F.lit(False))), batch_id)
        dead(batch.filter(~F.coalesce(good, F.lit(False))), batch_id)
        batch.unpersist()

    return run


def once_per_batch(path: str) -> Callable[[DataFrame, int], None]:
    """An idempotent sink: a batch that is retried overwrites its own folder."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def silent_workers(df: DataFrame, worker: str, ts: str, now, suspect_s: float, dead_s: float) -> DataFrame:
    """``state`` of each worker by the age of its last heartbeat."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.max(ts).cast("timestamp"))) / 1e6
    out = df.groupBy(worker).agg(age.alias("age_s"))
    return out.withColumn("state", F.when(F.col("age_s") >= dead_s, "DEAD").when(F.col("age_s") >= suspect_s, "SUSPECT").otherwise("ALIVE"))
