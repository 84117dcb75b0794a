"""Line dedup by distinct-site spread: boilerplate lines that many sites share.

A line (without outer blanks) is boilerplate if it stands on at least
``min_sites`` distinct sites *and* in at least ``min_sites`` distinct contents.
A document's content is named by its longest line other than the line in question,
so that copies of one document on many sites do not make its own lines boilerplate,
but a notice that is the longest line of its pages does not stand for all of them.
Two notices that are the two longest lines of the same pages still do.

Counting. First, exact row counts per line hash with the smallest and largest
site leave only lines that can qualify (a line has no more sites than rows).
For those, HyperLogLog sketches of sites and of contents are built per line
hash; sketches merge by aggregation, map side first, so a very common line is
never gathered. Lines whose estimates are within the sketch's error of the
threshold get exact distinct counts; the others are decided by the estimate.

Removing. Up to ``most`` hashes of boilerplate lines (16 bytes each; they are
counted) are broadcast, and texts are cleaned where they lie. More are joined with
the lines of distinct texts on hashes, and texts with the places found.

Edge cases: blank lines are never removed; a null site counts as one site of its
own; a null text stays null, an empty one empty; a text of which no line with
content would be left is kept whole; repeated rows count once per (site, content) by
nature; null ids and extra columns are passed through; a very long text is split in one
worker, in memory a few times its size; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, free_name, small_batches, table, trim

BLANKS = " \t\r\x0b\x0c"
LG_K = 12


def _lines(docs: DataFrame) -> DataFrame:
    """``h1, h2, site, content`` (hashes) of every line with content."""

    def run(batches):
        for b in batches:
            lines, sizes, sites = [], [], []
            for t, site in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = [x for x in (y.strip(BLANKS) for y in (t or "").split("\n")) if x]
                lines += own
                sizes.append(len(own))
                sites.append(xxhash.xxh64_intdigest(("\x00" if site is None else str(site)).encode("utf-8", "surrogatepass"), 42))
            h1, h2 = _hashes(lines)
            content, at = np.zeros(len(lines), np.int64), 0
            for n in sizes:
                if n:
                    own = h1[at : at + n]
                    longest = max(zip(map(len, lines[at : at + n]), own.tolist()))[1]
                    # none but the line itself: all such documents have one content
                    second = max(((len(x), h) for x, h in zip(lines[at : at + n], own.tolist()) if h != longest), default=(0, 0))[1]
                    content[at : at + n] = np.where(own == longest, second, longest)
                at += n
            site = np.repeat(np.array(sites, np.uint64).astype(np.int64), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1, h2, site, content)], names=["h1", "h2", "site", "content"])
        trim()

    return docs.select("text", "source").mapInArrow(run, "h1 bigint, h2 bigint, site bigint, content bigint")


def boilerplate(docs: DataFrame, min_sites: int = 5, small: int = 1_000_000) -> DataFrame:
    """``h1, h2`` of all boilerplate lines of ``docs`` (columns text, source)."""
    lines, key = cut(_lines(docs)), ["h1", "h2"]  # four longs for a line, read three times
    site = F.col("site")
    often = lines.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(site).alias("a"), F.max(site).alias("b"), F.min("content").alias("c"), F.max("content").alias("d"))
    spread = (F.col("n") >= min_sites) & (F.lit(min_sites < 2) | ((F.col("a") != F.col("b")) & (F.col("c") != F.col("d"))))
    often = cut(often.filter(spread).select(*key))

    def only(keys: DataFrame) -> DataFrame:
        return lines.join(F.broadcast(keys) if keys.count() <= small else keys, key, "left_semi")

    est = only(often).groupBy(*key).agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(c, LG_K)).alias(f"n_{c}") for c in ("site", "content")])
    band = max(1.0, 4 * 1.04 / 2 ** (LG_K / 2) * min_sites)
    est = cut(est.select(*key, F.least("n_site", "n_content").alias("n"), (F.least(F.abs(F.col("n_site") - min_sites), F.abs(F.col("n_content") - min_sites)) <= band).alias("near")))
    near = est.filter("near").select(*key)
    exact = only(near)
    counts = None
    for c in ("site", "content"):
        n = exact.select(*key, c).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias(f"x_{c}"))
        counts = n if counts is None else counts.join(n, key)
    sure = est.filter(~F.col("near") & (F.col("n") >= min_sites)).select(*key)
    return cut(sure.union(counts.filter((F.col("x_site") >= min_sites) & (F.col("x_content") >= min_sites)).select(*key)))


def _hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [x.strip(BLANKS).encode("utf-8", "surrogatepass") for x in lines]
    return (np.array([xxhash.xxh64_intdigest(x, 42) for x in raw], np.uint64).astype(np.int64), np.array([xxhash.xxh64_intdigest(b"#" + x, 42) for x in raw], np.uint64).astype(np.int64))


def _cleaned(text: str | None, is_gone) -> tuple[str | None, int, int]:
    """A text without the lines for which ``is_gone`` (by position), its number of lines, and how many went."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    content = [bool(x.strip(BLANKS)) for x in lines]
    flags = [c and is_gone(i) for i, c in enumerate(content)]
    if not any(flags) or not any(c and not g for c, g in zip(content, flags)):
        return text, len(lines), 0
    return "\n".join(x for x, g in zip(lines, flags) if not g), len(lines), sum(flags)


def _output(docs: DataFrame, counts: bool) -> tuple[str, list[str]]:
    names = [free_name(docs, "n_lines"), free_name(docs, "n_removed")] if counts else []
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *(f"`{n}` bigint" for n in names)]), names


def remove(docs: DataFrame, boiler: DataFrame, most: int = 1_000_000, counts: bool = False) -> DataFrame:
    """``docs`` with cleaned texts; with ``counts``, also ``n_lines`` and ``n_removed`` (with a number after it where ``docs`` has such a column)."""
    if boiler.count() > most:
        return _remove_joined(docs, boiler, counts)
    rows = boiler.toPandas()
    order = np.lexsort((rows["h2"].to_numpy(np.int64), rows["h1"].to_numpy(np.int64)))
    held = docs.sparkSession.sparkContext.broadcast(rows[["h1", "h2"]].to_numpy(np.int64)[order])  # at most ``most`` rows of 16 bytes
    at = docs.columns.index("text")
    kinds, names = _output(docs, counts)

    def run(batches):
        known = held.value
        for b in batches:
            texts = b.column(at).to_pylist()
            split = [[] if t is None else t.split("\n") for t in texts]
            h1, h2 = _hashes([x for s in split for x in s])
            gone = np.zeros(len(h1), bool)
            if len(known):
                i = np.searchsorted(known[:, 0], h1)
                while True:  # equal first hashes are next to each other
                    j = np.minimum(i, len(known) - 1)
                    same = (i < len(known)) & (known[j, 0] == h1)
                    gone |= same & (known[j, 1] == h2)
                    if not (same & ~gone).any():
                        break
                    i += 1
            out, k = [], 0
            for t, s in zip(texts, split):
                flags = gone[k : k + len(s)]
                k += len(s)
                out.append(_cleaned(t, flags.__getitem__))
            yield _with_texts(b, at, out, names)
        trim()

    return docs.mapInArrow(run, kinds)


def _with_texts(b: pa.RecordBatch, at: int, out: list, names: list[str]) -> pa.RecordBatch:
    cols = list(b.columns)
    cols[at] = pa.array([x[0] for x in out], pa.string())
    cols += [pa.array([x[i] for x in out], pa.int64()) for i in (1, 2)] if names else []
    return pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *names])


def _remove_joined(docs: DataFrame, boiler: DataFrame, counts: bool) -> DataFrame:
    """The same for any number of boilerplate lines: a distinct text's lines meet them in a join on hashes, then texts meet the places of their lines."""

    def places(batches):
        for b in batches:
            for i, t in enumerate(b.column(1).to_pylist()):
                lines = (t or "").split("\n")
                h1, h2 = _hashes(lines)
                key = b.column(0).take(pa.array(np.full(len(lines), i)))
                yield pa.RecordBatch.from_arrays([key, pa.array(h1), pa.array(h2), pa.array(np.arange(len(lines)))], names=["k", "h1", "h2", "at"])

    key = F.xxhash64("text")
    lines = docs.select(key.alias("k"), "text").mapInArrow(places, "k bigint, h1 bigint, h2 bigint, at bigint").dropDuplicates(["k", "at"])
    gone = lines.join(boiler, ["h1", "h2"], "left_semi").groupBy(F.col("k").alias("__k")).agg(F.collect_list("at").alias("__gone"))  # of one text's lines
    kinds, names = _output(docs, counts)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            out = []
            for t, g in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                out.append(_cleaned(t, set(g or ()).__contains__))
            yield _with_texts(b.select(list(range(b.num_columns - 1))), at, out, names)
        trim()

    return docs.join(gone, key == F.col("__k"), "left").select(*docs.columns, "__gone").mapInArrow(run, kinds)


def dedup_lines(docs: DataFrame, min_sites: int = 5, counts: bool = False) -> DataFrame:
    """``docs`` without cross-site boilerplate lines."""
    small_batches(docs.sparkSession)
    return remove(docs, boilerplate(docs.select("text", "source"), min_sites), counts=counts)


def op2_line_spread(spark, sf_dir: str) -> DataFrame:
    """Lines removed from every document, and the digest of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = dedup_lines(docs, counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


_T = "trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))"
#: Rows ``d(rid, doc_id, text, source, ...)`` are cleaned to ``cleaned(rid, n_lines, n_removed, text)``.
CLEAN_SQL = f"""
l0 AS (SELECT rid, coalesce(source, chr(0)) AS site, unnest(string_split(text, chr(10))) AS x,
       generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text IS NOT NULL),
l AS (SELECT rid, site, pos, x AS raw, {_T} AS x FROM l0),
c AS (SELECT rid, first(x ORDER BY length(x) DESC, x) AS content FROM l WHERE x <> '' GROUP BY rid),
b AS (SELECT x FROM l JOIN c USING (rid) WHERE x <> '' GROUP BY x
      HAVING count(DISTINCT site) >= 5 AND count(DISTINCT content) >= 5),
f AS (SELECT rid, pos, raw, x, x IN (SELECT x FROM b) AS gone FROM l),
g AS (SELECT rid, count(*) AS n_lines, sum(gone::INT) AS n_gone,
      string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept,
      count(*) FILTER (NOT gone AND x <> '') AS n_content FROM f GROUP BY rid),
cleaned AS (SELECT d.rid, coalesce(n_lines, 0) AS n_lines,
      CASE WHEN n_content > 0 THEN coalesce(n_gone, 0) ELSE 0 END AS n_removed,
      CASE WHEN n_content > 0 AND n_gone > 0 THEN kept ELSE d.text END AS text FROM d LEFT JOIN g USING (rid))
"""
OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, source FROM documents), {CLEAN_SQL}
SELECT d.doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, sha256(cleaned.text) AS text_sha256
FROM cleaned JOIN d USING (rid)
"""


def digest(text: str) -> str:
    """SHA-256 of a text in UTF-8."""
    return hashlib.sha256(text.encode()).hexdigest()
