"""Near-dedup of the pipeline by exact shingle similarity: of texts that share four fifths of their word shingles, the earliest stays.

A text's profile is the set of hashes of its lower-cased word shingles. Two
profiles are near duplicates if their Jaccard similarity is at least 0.8.

Candidates come from SimHash: fingerprints of the shingles that differ in at most
``LINK`` bits are linked through pivot distance tables (as in ``simhash``), and the
texts of a component share a bucket. Fingerprints of 64 bits cannot find all: at a
similarity of 0.8 two of them differ in about 10 bits, and in up to 18, where nearly
all pairs would be candidates. What links miss is found by MinHash: ``BANDS`` more
buckets, each the hash of ``ROWS`` MinHash values; a pair at 0.8 shares none with
probability (1 - 0.8^5)^20 = 0.0004, more similar pairs with less. Every candidate
pair that decides is verified on the whole profiles, so no dissimilar text is dropped.

Only distinct profiles take part. In each of ``rounds`` rounds, a bucket compares all
its profiles with its earliest one; those found similar are dropped, and
the earliest leaves the bucket, as it has met all others. A large group of near
copies so costs as many pairs as it has members. What is left then meets pair by
pair, but for pairs that cannot be similar: two bits of each of the 100 MinHash
values are compared inside the join condition (at 0.8, 85 agree in the mean; fewer
than ``AGREE`` in 1 of 30,000 pairs), so groups of texts that merely share a passage
make no rows. Hence no two candidates that stay are similar, and every one dropped
is similar to an earlier one (which may be dropped for a still earlier one).

A row is named by its id and the hash of its text, so rows with null ids, or with
different texts under one id, are judged each.

Edge cases: null and wordless texts have the empty profile and are copies of each
other only; fewer words than a shingle are one shingle; null ids rank last; of
rows that repeat id and text one stays; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, free_name, small_batches, thin, trim
from sparkloom.llm.simhash import components, fingerprint_of, links, shingle_hashes

BANDS, ROWS = 20, 5
#: Bits in which the fingerprints of linked texts may differ.
LINK = 4
#: MinHash values whose two bits must agree before a pair of the last round is looked at.
AGREE = 71
_RNG = np.random.default_rng(20240301)
FACTORS = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
MIX = _RNG.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
SALT = _RNG.integers(0, 2**64, BANDS, dtype=np.uint64)


def profile(text: str | None, width: int = 5) -> np.ndarray:
    """Distinct shingle hashes of one text, in order."""
    return np.unique(shingle_hashes(text, width))


def profile_key(p: np.ndarray) -> int:
    """A profile's name: the hash of all it holds, as a signed 64-bit integer."""
    return int(np.uint64(xxhash.xxh64_intdigest(p.tobytes(), 5)).astype(np.int64))


def minima(p: np.ndarray) -> np.ndarray:
    """The MinHash values of a profile."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(p), 1024):  # bounded memory for very long texts
        least = np.minimum(least, np.multiply.outer(FACTORS, p[i : i + 1024]).min(1))
    return least


def sketch(least: np.ndarray) -> np.ndarray:
    """Two bits of every MinHash value, in four longs: both halves of the first bits, then of the second."""
    bits = np.zeros((4, 64), np.uint8)
    for i in (0, 1):
        one = ((least >> np.uint64(20 + i)) & np.uint64(1)).astype(np.uint8).reshape(2, -1)
        bits[2 * i : 2 * i + 2, : one.shape[1]] = one
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()


def buckets(p: np.ndarray, least: np.ndarray | None = None) -> np.ndarray:
    """The bucket of every band; none for the empty profile."""
    if not len(p):
        return np.zeros(0, np.int64)
    least = minima(p) if least is None else least
    out = (least.reshape(BANDS, ROWS) * MIX).sum(1, dtype=np.uint64) ^ SALT
    return ((out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def profiles(docs: DataFrame, width: int, whole: bool) -> DataFrame:
    """``doc_id, text_hash, key`` of every row and its ``sketch``, fingerprint and ``buckets`` together, or with ``whole`` its ``profile``."""
    last = "profile" if whole else "buckets"

    def hashed(h, p):
        least = minima(p)
        return np.concatenate((sketch(least), np.array([fingerprint_of(h)], np.int64), buckets(p, least)))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                hashes = [shingle_hashes(t, width) for t in b.column(2).slice(lo, 64).to_pylist()]
                each = [np.unique(h) for h in hashes]
                parts = [p.view(np.int64) if whole else hashed(h, p) for h, p in zip(hashes, each)]
                ends = np.cumsum([0, *map(len, parts)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts)))
                keys = pa.array([profile_key(p) for p in each], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 64), b.column(1).slice(lo, 64), keys, lists], names=["doc_id", "text_hash", "key", last])
        trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return narrow.mapInArrow(run, f"doc_id {kind}, text_hash bigint, key bigint, {last} array<bigint>")


def similar_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` of keys whose profiles have a Jaccard similarity of at least 0.8."""
    x, y = sets.toDF("a", "x"), sets.toDF("b", "y")
    shared = F.size(F.array_intersect("x", "y"))
    # shared / (x + y - shared) >= 4 / 5, in whole numbers
    return pairs.join(y, "b").join(x, "a").filter(9 * shared >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def linked(each: DataFrame, few) -> DataFrame:
    """``key, bucket`` of the texts whose fingerprint is linked to another, a bucket for each component of links."""
    fp = each.filter(F.size("buckets") > 5).select("key", F.col("buckets")[4].alias("fp"))
    root = components(links(cut(fp.select("fp").distinct()), LINK)).withColumnRenamed("node", "fp")
    one = F.xxhash64(F.lit("simhash"), "root").alias("bucket")
    # texts that only share a fingerprint are a component of their own
    same = fp.distinct().groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fp", F.col("fp").alias("root"))
    root = cut(root.union(same.join(few(root), "fp", "left_anti")))
    return fp.join(few(root), "fp").select("key", one)


def distinct_rows(docs: DataFrame, width: int = 5, rounds: int = 2, small: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text_hash`` of the earliest row of every profile that stays; and ``doc_id, text_hash`` of all rows.

    What joins on has at most two longs a row, so ``small`` rows are 16 MB (below 100 MB as a hash table) where they are broadcast.
    """
    few = lambda df: F.broadcast(df) if df.count() <= small else df
    each = cut(profiles(docs, width, whole=False))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = cut(each.groupBy("key").agg(F.min(row).alias("first")))
    spread = each.select("key", F.explode(F.slice("buckets", 6, BANDS)).alias("bucket")).union(linked(each, few))
    shared = cut(spread.groupBy("bucket").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a <> b").select("bucket"))
    rank = F.struct("first", "key").alias("rank")
    live = cut(spread.join(few(shared), "bucket", "left_semi").distinct().join(first, "key").select("bucket", "key", rank))
    n = live.count()  # tables of candidates below have no more rows
    known = cut(thin(live.select("key", F.col("rank.first.doc_id").alias("id"), F.col("rank.first.text_hash").alias("hash")).distinct(), n))
    ids = known.select("id", "hash").distinct()
    own = docs.select("doc_id", "text").join(few(cut(thin(ids, n))), F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("hash")), "left_semi")
    whole = profiles(own, width, whole=True).select("key", "profile")
    sets = cut(whole.join(few(known.select("key")), "key", "left_semi").dropDuplicates(["key"]))
    gone = known.select("key").limit(0)
    for k in range(rounds + 1):
        if live.isEmpty():
            break
        if k < rounds:
            met = live.join(live.groupBy("bucket").agg(F.min("rank").alias("least")), "bucket").filter(F.col("rank") != F.col("least"))
            pairs = met.select(F.col("least.key").alias("a"), F.col("key").alias("b"))
        else:
            bits = each.select("key", F.slice("buckets", 1, 4).alias("sketch")).join(few(cut(thin(live.select("key").distinct(), n))), "key", "left_semi").dropDuplicates(["key"])
            live = live.join(few(cut(thin(bits, n))), "key").select("bucket", "key", "rank", "sketch")
            x, y = live.toDF("bucket", "a", "early", "p"), live.toDF("bucket", "b", "late", "q")
            differ = lambda h: F.bit_count((F.col("p")[h].bitwiseXOR(F.col("q")[h])).bitwiseOR(F.col("p")[h + 2].bitwiseXOR(F.col("q")[h + 2])))
            close = differ(0) + differ(1) <= BANDS * ROWS - AGREE
            pairs = x.alias("x").join(y.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("early") < F.col("late")) & close).select("a", "b")
        now = cut(thin(similar_pairs(pairs.distinct(), sets).select(F.col("b").alias("key")).distinct(), n))
        gone = gone.union(now)
        if k < rounds:
            left = cut(thin(met.select("bucket", "key", "rank").join(few(now), "key", "left_anti").select("bucket", "key", "rank"), n))
            more = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
            live = cut(left.join(few(cut(thin(more, n))), "bucket", "left_semi"))
    stay = first.join(few(cut(thin(gone.distinct(), n))), "key", "left_anti")
    return cut(stay.select("first.doc_id", "first.text_hash").distinct()), each.select("doc_id", "text_hash")


def keep_distinct(docs: DataFrame, width: int = 5, small: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` that stay, one of those that repeat id and text."""
    small_batches(docs.sparkSession)
    stay, each = distinct_rows(docs, width, small=small)
    again = cut(each.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "text_hash"))
    h = free_name(docs, "text_hash")
    keyed = docs.withColumn(h, F.xxhash64("text"))

    def among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        k = keys.toDF("__id", "__hash")
        return rows.join(F.broadcast(k) if keys.count() <= small else k, rows["doc_id"].eqNullSafe(k["__id"]) & (rows[h] == k["__hash"]), how)

    kept = among(keyed, stay, "left_semi")
    once, more = among(kept, again, "left_anti"), among(kept, again, "left_semi")
    return once.union(more.dropDuplicates(["doc_id", h])).drop(h)
