"""The pipeline's stages against their brute-force versions, and the registered queries."""

import re

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tests.llm import test_decontaminate, test_paritysketch, test_suffixes


def test_stages(spark, docs, docs_rows, tmp_path):
    benchmark = [(1, docs_rows[3][1] if len(docs_rows[3][1].split()) > 12 else docs_rows[5][1]), (2, "never seen words here " * 4)]
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    steps, df = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        df = spark.read.parquet(f"{tmp_path}/{k}")
        steps.append(sorted(tuple(r) for r in df.collect()))
        if k < 4:
            assert df.columns == list(pipeline.COLUMNS)
    language, near, suffix, clean, tokens = steps
    assert {r[0] for r in language} <= {r[0] for r in docs_rows if re.search("[a-zé]", r[1] or "")}
    assert len(language) > 100
    first = {}
    for d, _, c in test_paritysketch.brute(language):
        first.setdefault(c, d)
    assert [r[0] for r in near] == sorted(first)
    assert [r[:2] for r in suffix] == test_suffixes.kept_characters(near, 400)
    told = {r[0] for r in test_decontaminate.brute([r[:2] for r in suffix], benchmark) if r[5]}
    assert told and [r[0] for r in clean] == [r[0] for r in suffix if r[0] not in told]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert [(r[0], r[1]) for r in tokens] == [(r[0], len(tokenizer.encode(r[1], add_special_tokens=False).ids)) for r in clean]
    whole = sorted(tuple(r) for r in pipeline.run(spark, str(tmp_path)).collect())
    assert whole == tokens


def test_odd_and_empty_tables(spark, docs, odd_docs, no_docs, tmp_path):
    """Nulls, repeated rows, clashing columns and empty tables go through every stage."""
    spark.createDataFrame([(1, None), (None, "x y z"), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = odd_docs.unionByName(docs.selectExpr("*", "'p' AS bucket", "3 AS k1"))
    for name, start in (("odd", odd), ("none", no_docs)):
        df = start
        for k, (_, stage) in enumerate(pipeline.STAGES):
            stage(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{name}{k}")
            df = spark.read.parquet(f"{tmp_path}/{name}{k}")
            if k < 4:
                assert df.columns == list(pipeline.COLUMNS)
            rows = df.collect()
            if name == "none":
                assert not rows
            elif k == 0:
                kept = len(rows)
                assert kept > 100
            elif k == 1:
                assert [r.doc_id for r in rows].count(7) <= 2 and 0 < len(rows) < kept
        assert df.columns[0] == "doc_id"


def test_names():
    names = list(entry.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 14)]
    assert "pipeline" in names
