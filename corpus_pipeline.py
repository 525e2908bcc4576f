"""A training corpus from raw documents: quality rules, line dedup, near-dedup, a mix of sources by weight, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as Parquet and read
again as the next one's docs. All but the last return the columns of `documents`. After the mix a document may be there twice
(once for each pass that takes words of it), so the packed pieces of the two are told apart by their sequence_id and offset.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathomline.functions.staging import staged
from fathomline.llm import lines, mixing, packing, quality, similar

SIMILARITY, SHINGLE_WORDS = 0.8, 5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their failing lines."""
    return quality.filtered(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; lines that several hold stay in the first only."""
    return lines.without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: a similarity of 0.8 or more on shingles of five words, found by SimHash first."""
    return similar.representatives(docs, SIMILARITY, SHINGLE_WORDS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return packing.pack(packing.pieces_of(docs))


STAGES: list[tuple[str, Stage]] = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup),
                                   ("source_mix", source_mix), ("best_fit_packing", best_fit_packing)]
#: fingerprints, permutations, tokens and local search have no SQL; tests/llm holds every stage against brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
