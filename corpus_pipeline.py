"""From raw documents to packed training sequences, in five stages.

Quality rules drop documents, line deduplication drops lines, SimHash keeps one document of each near-duplicate group,
decontamination drops documents that hold benchmark windows, packing cuts what is left into sequences. Each stage takes
all that its predecessor kept. Rows with equal id and text count as one document throughout, whatever their other
columns; null texts have no words, so the quality rules drop them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.llm.decontamination import contamination
from tarnweave.llm.line_dedup import dedup_lines
from tarnweave.llm.packing import pack
from tarnweave.llm.quality_rules import quality_rules
from tarnweave.llm.shared import free, saved
from tarnweave.llm.simhash import near_duplicates

#: Rows of ids to drop that may be broadcast (about 32 MB); more of them are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
KEY = "row key"


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, F.struct("doc_id", F.xxhash64("text").alias("body")))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs but for the rows whose key is in dropped."""
    keys = saved(dropped.select(F.col(KEY).alias("dropped")).distinct(), "dropped")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    own = keyed(docs)
    return own.join(keys, own[KEY].eqNullSafe(keys["dropped"]), "left_anti").select(*docs.columns)


def by_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return without(docs, quality_rules(keyed(docs), id_col=KEY).where(~F.col("kept")))


def by_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that occur elsewhere before; n_chars follows the text."""
    return dedup_lines(docs, exact_chars=1).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def by_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate group: by fingerprints of 5-word shingles, and by sets of them whose Jaccard similarity is 0.8 or more."""
    return without(docs, near_duplicates(keyed(docs), size=5, id_col=KEY, similarity=0.8).where(F.col(KEY) != F.col("component_id")))


def by_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark windows."""
    return without(docs, contamination(keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=KEY).where(F.size("items") > 0))


def by_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences, with their ids."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", by_quality_rules),
    ("line_dedup", by_line_dedup),
    ("simhash_near_dedup", by_simhash),
    ("decontamination", by_decontamination),
    ("packing", by_packing),
]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            free(before)
    return STAGES[-1][1](spark, docs, sf_dir)
