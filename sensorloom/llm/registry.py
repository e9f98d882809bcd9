"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from sensorloom.llm import (
    bpe,
    id_planes,
    jaccard_join,
    licenses,
    line_dedup,
    maxscore,
    oracles,
    packing,
    periodic_runs,
    perspectives,
    quality_rules,
    surrogates,
    token_counts,
    turn_repair,
)
from sensorloom.llm.common import read_table
from sensorloom.sources.scratch import fresh_path, materialize

Query = Callable[[SparkSession, str], DataFrame]


def op1_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_repeated_chunks(read_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "text", "chunks_removed")


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = surrogates.replace_entities(read_table(spark, sf_dir, "documents"), corpus_pipeline.surrogate_key(spark))
    return replaced.select("doc_id", "text", F.size("entities").cast("bigint").alias("n_entities"))


def op5_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole renderings, part by part; the masks as text, so that SQL can compare them."""
    parts = perspectives.rotate(read_table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda m: F.concat_ws("-", m["begin"], m["end"]))
    return parts.withColumn("mask", F.array_join(spans, ","))


def op6_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    return maxscore.exact_search(table, F.col("vec_id") % 50 == 0)


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.round_trip(read_table(spark, sf_dir, "documents"))
    decimal_ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(decimal_ids, 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(read_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality_rules.rule_ledger(read_table(spark, sf_dir, "documents"))
    base = ~quality_rules.passes(quality_rules.BASE)
    return ledger.withColumns(
        {"base_failed": base, "kept": quality_rules.passes(quality_rules.DEFAULT)}
    )


def op11_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "id_planes")
    return id_planes.write_and_read(read_table(spark, sf_dir, "documents"), folder)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = periodic_runs.plant_loops(read_table(spark, sf_dir, "documents"))
    found = periodic_runs.find_runs(planted)
    best = periodic_runs.best_run(F.col("runs"))
    lines = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = read_table(spark, sf_dir, "conversations")
    broken = turn_repair.damaged(original)
    rated = turn_repair.structure(broken, materialize, every=original)
    return turn_repair.with_digests(broken, rated)


def queries() -> dict[str, Query]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_jaccard_components": op1_jaccard_components,
        "op2_license_scan": op2_license_scan,
        "op3_line_dedup": op3_line_dedup,
        "op4_pii_surrogates": op4_pii_surrogates,
        "op5_perspective_rotation": op5_perspective_rotation,
        "op6_maxscore_top_k": op6_maxscore_top_k,
        "op7_bpe_round_trip": op7_bpe_round_trip,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_token_counts": op9_token_counts,
        "op10_quality_rules": op10_quality_rules,
        "op11_bit_planes": op11_bit_planes,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_turn_repair": op13_turn_repair,
    }


def oracle_sql() -> dict[str, str]:
    found = dict(oracles.ORACLES)
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
