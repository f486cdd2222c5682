"""The pipeline's stages on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from dispatchgrid.llm import quality, tiling
from dispatchgrid.llm.common import Scratch
from tests.llm.test_corpus import brute_components

LIB = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ITEM = "seven wizards mix up strange blue potions under a pale moon while the quick brown fox sleeps in tall grass tonight"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{'the of and in'.split()[x % 4] if x % 3 == 0 else 'w' + str(x)}" for x in rng.integers(0, 400, n))


CASES = [
    (1, prose(1, 80)), (2, prose(1, 80)), (3, prose(1, 80).upper()), (4, prose(1, 80).replace(" w7 ", " other ", 1)), (5, None), (6, ""), (7, "too short"), (8, "again and again " * 40),
    (9, prose(9, 60) + " " + ITEM + " " + prose(10, 20)), (10, prose(11, 60) + " write to john.smith@mail.example.com or Mr John Smith"), (11, prose(12, 30000)), (None, prose(13, 50)),
    (12, prose(14, 70)), (12, prose(14, 70)), (13, prose(15, 60) + "\n\x00   <|endoftext|> é"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, pii_kinds string, component_id long, words int, kept boolean, token long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("cases")
    rows = [(i, t, "en", f"s{k}", len(t or ""), "own", 5, 6, True, 7) for k, (i, t) in enumerate(CASES)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{base}/empty.parquet")
    return str(base)


def test_stages_on_odd_documents(spark, folder):
    docs, scratch = spark.read.parquet(f"{folder}/documents.parquet"), Scratch(spark, "test-cases")
    for name, stage in P.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        columns = docs.columns
        docs = scratch.keep(stage(spark, docs, folder), name)
        rows = docs.collect()
        if name != "bpe_encoding":
            assert docs.columns == columns and all(r["pii_kinds"] == "own" and r["component_id"] == 5 and r["token"] == 7 for r in rows)
        if name == "quality_rules":
            judged = {r["source"] for r in rows}
            assert {CASES[int(s[1:])][0] for s in judged} == {1, 2, 4, 9, 10, 11, None, 12, 13} and len(rows) == 10  # 3 is in capitals, without a stop word
        elif name == "ngram_jaccard_join":
            groups = brute_components([(i, t) for i, t in before if i is not None], 5, 80, 100)
            assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in before if i is not None and groups[i][1] == i) and len(rows) == 7
        elif name == "benchmark_decontamination":
            assert sorted(r["doc_id"] for r in rows) == [1, 10, 11, 12, 12, 13]
        elif name == "pii_surrogates":
            new = {r["doc_id"]: r["text"] for r in rows}
            assert "Smith" not in new[10] and "john.smith" not in new[10] and re.search(r"\S+@\S+ or Mr \w+ \w+$", new[10])
            assert all(new[i] == t for i, t in before if i != 10)
        else:
            assert sorted((r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in rows) == sorted((i, len(x), tuple(x)) for i, t in before for x in [LIB.encode(t, add_special_tokens=False).ids])


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/empty.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_no_benchmark_removes_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert tiling.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert quality.kept_rows(docs.select("text", "doc_id")).columns == ["text", "doc_id"]
