"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import ann, licenses, line_dedup, link_graph, manifest, mixing, near_dedup, packing, quality, runs, token_files, toxicity, warc
from vigil.session import ensure_checkpoint_dir


def prepare(spark: SparkSession) -> None:
    """The shared folder, and on one machine this package on the Python workers' path (a cluster gets it with --py-files)."""
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    root = str(Path(__file__).resolve().parents[2])
    if sc.master.startswith("local[") and root not in sc.environment.get("PYTHONPATH", ""):
        sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, sc.environment.get("PYTHONPATH")]))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_digest(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(licenses.scan_licenses(_table(spark, sf_dir, "documents")))


def op8_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.audit_pages(_table(spark, sf_dir, "pages"))


def op9_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_quality(_table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, sf_dir, "documents"))


def op11_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_graph.url_digest(link_graph.judge_urls(_table(spark, sf_dir, "pages"), link_graph.rule_table(spark, link_graph.RULES)))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digest(runs.find_runs(_table(spark, sf_dir, "documents"), planted=True))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audit_digest(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_rp_forest, op2_best_fit_packing, op3_line_dedup, op4_token_files, op5_toxicity, op6_minhash_near_dedup,
                                   op7_license_scan, op8_warc_audit, op9_repetition_quality, op10_source_mix,
                                   op11_link_graph, op12_word_runs, op13_merkle_manifest)}
# The others have no SQL form; tests/llm compares them with brute-force versions, exact round trips or held-out accuracy.
ORACLE_SQL = {"op3_line_dedup": line_dedup.ORACLE, "op8_warc_audit": warc.ORACLE, "op10_source_mix": mixing.ORACLE,
              "op11_link_graph": link_graph.ORACLE, "op13_merkle_manifest": manifest.ORACLE}
