"""Driver queries over the corpus tables: one opN_<name> per operator, applied to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import asof, bpe, language, licenses, lines, packing, repair, secrets, surrogates, tiling, token_files
from .common import Scratch, table
from . import quality as rules
from . import token_groups
from .token_groups import jaccard_components


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "op2").path("files")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(spark, path)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "pages"), language.fit(table(spark, sf_dir, "documents")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.without_repeats(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda r: F.concat_ws("-", r["begin"], r["stop"])), ",")
    return out.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), spans.alias("removed"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.Repair(repair.damaged(rows)).report(rows)


def op13_tolerant_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.match_clicks(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sales"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_token_files, op3_language_id, op4_secret_scan, op5_benchmark_decontamination, op6_line_dedup, op7_pii_surrogates, op8_bpe_transducer, op9_quality_rules, op10_ngram_jaccard_join, op11_best_fit_packing, op12_conversation_repair, op13_tolerant_asof)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.ORACLE, "op6_line_dedup": lines.ORACLE, "op9_quality_rules": rules.ORACLE, "op10_ngram_jaccard_join": token_groups.ORACLE, "op13_tolerant_asof": asof.ORACLE}
