"""Full-text, vector and spatial search."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.scalar import euclid
from sparkloom.operators.graph import cut


def bm25(docs: DataFrame, doc_id: str, tokens: Column, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``doc_id, score`` of every document with a query term; a term asked twice counts twice.

    Texts are read once; what shuffles is a row per document, without texts. Ids are unique.
    """
    wanted = Counter(query)
    terms = sorted(wanted)
    # one pass over the texts: a document's length and its counts of the wanted terms
    words = docs.select(F.col(doc_id), F.explode_outer(tokens).alias("t"))
    counts = [F.count(F.when(F.col("t") == w, 1)).alias(f"tf{i}") for i, w in enumerate(terms)]
    each = cut(words.groupBy(doc_id).agg(F.count("t").alias("len"), *counts))
    found = [F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))]
    stats = each.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"), *found)
    score = F.lit(0.0)
    for i, w in enumerate(terms):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n_docs") - df + 0.5) / (df + 0.5))
        score += wanted[w] * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    any_hit = F.greatest(*[F.col(f"tf{i}") for i in range(len(terms))], F.lit(0)) > 0 if terms else F.lit(False)
    return each.filter(any_hit).crossJoin(F.broadcast(stats)).select(doc_id, score.alias("score"))  # one row


def phrase(docs: DataFrame, doc_id: str, tokens: Column, words: list[str]) -> DataFrame:
    """Ids of documents that hold the words one after the other."""
    joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return docs.filter(F.contains(joined, F.lit(f" {' '.join(words)} "))).select(doc_id)


def nearest(points: DataFrame, coords: Column, query: list[float], k: int, tie: str) -> DataFrame:
    """The k nearest points to one query, by Euclid (take-ordered, no full sort)."""
    d = euclid(coords, F.array(*[F.lit(float(x)) for x in query]))
    return points.withColumn("distance", d).orderBy("distance", tie).limit(k)


def in_box(points: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Points inside an inclusive box."""
    out = points
    for c, (lo, hi) in bounds.items():
        out = out.filter(F.col(c).between(lo, hi))
    return out


def boxes_touching(boxes: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Boxes (min_x, min_y, max_x, max_y) that meet the query box, touching included."""
    return boxes.filter((F.col("min_x") <= x1) & (F.col("max_x") >= x0) & (F.col("min_y") <= y1) & (F.col("max_y") >= y0))
