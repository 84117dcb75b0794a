"""SimHash near-dedup with pivot distance tables.

Each document gets a 64-bit SimHash over word shingles. Fingerprints that
differ in at most ``max_distance`` bits are linked; components of links are
duplicate groups.

Finding links: every *distinct* fingerprint carries a pivot table, its Hamming
distances to ``len(PIVOTS)`` reference fingerprints. By the triangle inequality
``|d(x, p) - d(y, p)| <= d(x, y)``, so a pair whose largest coordinate
difference exceeds the threshold is discarded unseen; survivors are verified
with the full Hamming distance. Both tests are part of the join condition, so a
discarded pair never becomes a row. The pivot table alone would still have to
look at all pairs, so pairs only meet inside pigeonhole blocks: of k bit
blocks, two fingerprints within t bits agree on at least k - t whole ones.
Hence joining on every choice of k - t blocks loses no link. k grows with the
number of distinct fingerprints (5 to 8), which keeps blocks small.

Copies share a fingerprint and are never expanded into pairs. Components are
found on distinct fingerprints by rounds of pointing to the smallest neighbour,
shortening pointers and contracting links, each cut by a checkpoint and built anew
from its rows (else estimates of size multiply from round to round); nothing is
collected to the driver.

Edge cases: null or wordless texts have fingerprint 0 (linked like any other);
fewer words than a shingle count as one shingle; null ids keep their row, a
component of null ids only has a null id; repeated rows stay repeated; an empty
table gives an empty result; extra input columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, narrow_text, rebuilt, small_batches, thin, trim

#: Reference fingerprints: fixed pseudo-random words, 16 coordinates of 7 bits in two longs.
PIVOTS = tuple(int(x) for x in np.random.default_rng(20240229).integers(-(2**63), 2**63 - 1, 16, dtype=np.int64))


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """Hash of every word shingle of one text, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, max(1, len(words) - width + 1))


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """SimHash of one text as a signed 64-bit integer (bit 63 is the sign)."""
    return fingerprint_of(shingle_hashes(text, width, seed))


def fingerprint_of(h: np.ndarray) -> int:
    """SimHash of the hashes of shingles, repeats included."""
    n = len(h)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):  # bounded memory for very long texts
        ones += np.unpackbits(h[i : i + (1 << 14)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">u8")[0].astype(np.uint64).astype(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``id_col`` and ``fp`` (long) for every row."""

    def run(batches):
        for b in batches:
            out = pa.array([fingerprint(t, width) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), out], names=[id_col, "fp"])
        trim()

    ids = docs.schema[id_col].dataType.simpleString()
    return narrow_text(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {ids}, fp bigint")


def pivot_table(fps: DataFrame) -> DataFrame:
    """Adds the distances to all pivots, packed eight to a long."""
    packed = []
    for half in (PIVOTS[:8], PIVOTS[8:]):
        c = F.lit(0).cast("long")
        for i, p in enumerate(half):
            c = c.bitwiseOR(F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long"), 7 * i))
        packed.append(c)
    return fps.select("*", packed[0].alias("pv0"), packed[1].alias("pv1"))


def blocking(n: int, max_distance: int, mean_block: int = 48) -> list[tuple[int, ...]]:
    """Bit masks to join on: all choices of k - t of k blocks, with the fewest tables that keep blocks small."""
    k = max_distance + 1
    while True:
        edges = [round(i * 64 / k) for i in range(k + 1)]
        masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(k)]
        tables = [sum(masks[i] for i in c) for c in combinations(range(k), k - max_distance)]
        if n <= mean_block * 2 ** min(m.bit_count() for m in tables) or k >= max_distance + 4:
            return tables
        k += 1


def links(fps: DataFrame, max_distance: int = 4) -> DataFrame:
    """Pairs ``a < b`` of distinct fingerprints within ``max_distance`` bits (a pair may repeat)."""
    n = fps.count()
    tables = blocking(n, max_distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in tables]
    keyed = pivot_table(fps).select(
        "fp", "pv0", "pv1",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("t", "key"),
    )
    a, b = (keyed.select(*[F.col(c).alias(f"{s}{c}") for c in keyed.columns]) for s in "xy")
    near = F.lit(True)
    for pv in ("pv0", "pv1"):
        for i in range(8):
            at = lambda c: F.shiftright(F.col(c), 7 * i).bitwiseAND(F.lit(127))  # noqa: E731, B023
            near &= F.abs(at(f"x{pv}") - at(f"y{pv}")) <= max_distance
    verified = F.bit_count(F.col("xfp").bitwiseXOR(F.col("yfp"))) <= max_distance
    same = (F.col("xt") == F.col("yt")) & (F.col("xkey") == F.col("ykey"))
    return a.join(b, same & (F.col("xfp") < F.col("yfp")) & near & verified).select(
        F.col("xfp").alias("a"), F.col("yfp").alias("b")
    )


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node that occurs in ``edges (a, b)``; root is the component's smallest node.

    Every round, each node points to its smallest neighbour (or itself), pointers
    double their reach until they lead to roots, and links are contracted to those
    between different roots. A round at least halves the nodes left of a component.
    """
    left = rebuilt(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    n = left.count()  # no table below has more than twice these rows
    left = thin(left, n)
    member = None
    while not left.isEmpty():
        low = left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        up = rebuilt(thin(low.union(left.select("a", "a")).groupBy("node").agg(F.min("up").alias("up")), n))
        while True:  # pointers double their reach until all lead to a root
            far = up.join(up.toDF("up", "far"), "up").select("node", F.col("far").alias("up"), (F.col("far") != F.col("up")).alias("moved"))
            far = rebuilt(thin(far, n))
            up = far.select("node", "up")
            if far.filter("moved").isEmpty():
                break
        if member is None:
            member = up.toDF("node", "root")
        else:
            member = rebuilt(thin(member.join(up.toDF("root", "now"), "root", "left").select("node", F.coalesce("now", "root").alias("root")), n))
        step = left.join(up.toDF("a", "x"), "a").join(up.toDF("b", "y"), "b").filter("x <> y")
        left = rebuilt(thin(step.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), n))
    return left.toDF("node", "root") if member is None else member


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_distance: int = 4) -> DataFrame:
    """One row per document: ``id_col``, ``fp`` (long) and ``component_id``, the smallest id reachable over links."""
    small_batches(docs.sparkSession)
    each = cut(fingerprints(docs, id_col, text_col, width))
    first = cut(each.groupBy("fp").agg(F.min(id_col).alias("first")))
    root = components(links(first.select("fp"), max_distance))
    joined = first.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    group = joined.join(least, "root").select("fp", "component_id")
    return each.join(group, "fp").select(id_col, "fp", "component_id")


def hex_digits(col: str = "fp"):
    """A long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Contract query: fingerprint and component of every document."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", hex_digits().alias("fingerprint"), "component_id")
