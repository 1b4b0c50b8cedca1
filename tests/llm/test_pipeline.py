"""The five stages beside plain loops, each on its own input."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from barloom.llm.tables import saved
from tests.llm import brute
from tests.llm.test_similar import kept

ROOT = "/root/testdata/sf0.001"
STAGE = dict(cp.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{ROOT}/documents.parquet")


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_language_keeps_prose_and_rejects_noise(spark, docs):
    noise = spark.createDataFrame(
        [(9001, None), (9002, ""), (9003, "12 34 +++ ===\n"), (9004, "qxzj vvkq wwxq jjqz zxqv kkzx qqwj xvzk " * 20)], "doc_id long, text string"
    ).select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    got = {i for i, _ in rows(STAGE["language"](spark, docs.union(noise), ROOT))}
    assert got == {i for i, _ in rows(docs)}


def test_exact_stage(spark, docs):
    got = STAGE["exact dedup"](spark, docs, ROOT)
    assert got.columns == docs.columns
    assert sorted(i for i, _ in rows(got)) == sorted(r[0] for r in brute.exact(rows(docs)) if r[3])


def test_near_stage(spark, docs):
    got = {i for i, _ in rows(STAGE["near dedup"](spark, docs, ROOT))}
    assert got == kept(rows(docs))


def test_passage_stage(spark, docs):
    got = dict(rows(STAGE["substring dedup"](spark, docs, ROOT)))
    text = dict(rows(docs))
    for i, n, gone, kept in brute.without_repeats(rows(docs)):
        if n and gone == n:
            assert i not in got
        else:
            assert got[i] == (" ".join(kept) if gone else text[i])


def test_run(spark):
    out = cp.run(spark, ROOT).toPandas()
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = saved(stage(spark, docs, ROOT), "stage")
    assert set(out.doc_id) == {i for i, _ in rows(docs)}
    lengths = out.groupby("doc_id").agg(n=("length", "sum"), want=("doc_tokens", "first"))
    assert (lengths.n == lengths.want).all() and isinstance(out, pd.DataFrame)


def test_stages_take_empty_tables(spark, docs):
    empty = docs.where("doc_id < 0")
    for _, stage in cp.STAGES:
        assert stage(spark, empty, ROOT).count() == 0
