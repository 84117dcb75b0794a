"""A corpus pipeline of five stages, from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and reread as the next stage's ``docs``. All but the last keep
the columns of ``documents``; each works on all that its predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import shared_dir, small_batches, table, written
from sparkloom.llm.decontaminate import contaminations
from sparkloom.llm.kneser_ney import keep_documents
from sparkloom.llm.lines import dedup_lines
from sparkloom.llm.packing import pack, pieces
from sparkloom.llm.shingles import keep_distinct


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the Kneser-Ney quality classifier rejects."""
    return keep_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes cross-site boilerplate lines; ``n_chars`` follows the text where it changed."""
    out = dedup_lines(docs, counts=True)
    removed = F.col(f"`{out.columns[-1]}`")
    return out.withColumn("n_chars", F.when(removed > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of those that share four fifths of their 5-word shingles.

    Candidates are linked by SimHash through pivot distance tables; MinHash adds those beyond
    its reach. Every document dropped has an exact Jaccard similarity of 0.8 or more to one
    with a smaller id (null ids last), or repeats its id and text.
    """
    return keep_distinct(docs, width=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold passages of the benchmark."""
    return contaminations(docs, table(spark, sf_dir, "benchmark"), flag_rows=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the pieces of all documents left into sequences of 2048 tokens."""
    return pack(pieces(docs))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", packing),
]

#: Model scores, 64-bit fingerprints over byte shingles and token ids are beyond SQL; stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{k}")
    return docs
