"""The queries of this folder, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.staging import new_path

from . import lines, mixing, mtree, packing, phrases, quality, records, simhash, substring, suffixes, syncmers, trie, urls
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


@query("op3_token_records")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "records")
    return records.documents_of(records.write_records(table(spark, sf_dir, "documents"), path), path)


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces_of(table(spark, sf_dir, "documents")))


@query("op4_url_filter", urls.ORACLE)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"), urls.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


@query("op9_quality_rules", quality.ORACLE)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(docs).select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


@query("op5_line_dedup", lines.ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", lines.digest_of(F.col("text")).alias("kept_sha256"))


@query("op8_source_mix")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op1_substring_dedup", substring.ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_suffix_array_dedup", suffixes.ORACLE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_mtree_topk", mtree.ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op11_phrase_collocations", phrases.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("op12_prefix_trie", trie.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


@query("op13_document_fingerprints", syncmers.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))
