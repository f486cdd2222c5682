"""From raw documents to encoded ones in five stages; each works on all that the one before it kept.

Null and empty texts have no words and leave at the quality stage. Rows with a null doc_id pass it by their text, and leave
at the join stage, which cannot name them. Ties: of linked documents the smallest doc_id stays. Repeated rows of one doc_id
stay or go together. Very long texts are worked on whole. Empty tables give no rows. Other columns are carried through the
first four stages, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchgrid.llm import bpe, quality, surrogates, tiling
from dispatchgrid.llm.common import Scratch, table
from dispatchgrid.llm.token_groups import jaccard_components

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, in the same narrow pass that evaluates them."""
    return quality.kept_rows(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked over five-word shingles at 0.8 or more, the smallest doc_id stays."""
    groups = jaccard_components(docs, k=5, num=80, den=100)
    stay = groups.where(F.col("component_id") == F.col("doc_id")).select("doc_id")
    return docs.join(stay, "doc_id", "left_semi").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item to the threshold."""
    leaks = tiling.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return surrogates.replace_pii(docs, kinds=None)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every document left."""
    return bpe.encode(docs, TOKENIZER).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_surrogates", pii_surrogates),
    ("bpe_encoding", bpe_encoding),
]

#: SQL can't express byte-pair encoding; tests hold the stages against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written to the shared folder before the next reads them."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
