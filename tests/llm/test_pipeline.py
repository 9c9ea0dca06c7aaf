"""The pipeline keeps clean documents, drops what its stages name, and hands on the columns of documents."""

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tablewarden.llm import bpe, decontaminate, line_rules, near_dup

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == columns and set(map(tuple, after.collect())) <= set(map(tuple, before.collect())), name
        ids, left = {r[0] for r in before.select("doc_id").collect()}, {r[0] for r in after.select("doc_id").collect()}
        if name == "quality_rules":
            assert left == {r["doc_id"] for r in line_rules.judge(before).where("kept").collect()}
        elif name == "quality_classifier":
            assert not any(labels.get(i) == 1 for i in ids - left) and not any(labels.get(i) == 0 for i in left)
        elif name == "near_dedup":
            assert left == {r["doc_id"] for r in near_dup.resolve(before, 80).where("kept").collect()}
        else:
            assert ids - left == {r["doc_id"] for r in decontaminate.leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
        before = spark.createDataFrame(after.collect(), docs.schema)
    ranks = bpe.Ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ids, special_tokens={})
    want = {r["doc_id"]: library.encode_ordinary(r["text"]) for r in before.collect()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {k: (len(v), v) for k, v in want.items()}


def test_stages_take_odd_and_empty_tables(spark, odd, none):
    for frame in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            assert (out.columns == frame.columns) == (name != "byte_bpe") and out.count() <= frame.count(), name
    assert odd.where(F.col("doc_id").isNull()).count() == 1
