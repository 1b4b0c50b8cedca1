"""Importance resampling beside plain counting: longer runs, long lines, skew, odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import importance, tables, texts
from tests.llm import brute

TARGET = ["alpha beta\ngamma delta", "Alpha BETA gamma", None, "é漢 9x"]
SCHEMA = "doc_id long, text string"


def made(seed, n=60):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice(["alpha", "Beta", "gamma,", "é漢", "9x", "--", "o"]) for _ in range(rng.randrange(9))) for _ in range(12)]
    out = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 14)))) for i in range(n)]
    return out + [(n + 1, None), (n + 2, ""), (n + 3, "\n\n \n"), (n + 4, out[0][1]), (-5, "alpha\n\n\nbeta\n-\ngamma " * 9), (None, "alpha beta " * 15)]


@pytest.mark.parametrize("size", [1, 2, 4])
def test_meets_plain_counting(spark, size):
    rows = made(size)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for c in ("row", "line", "held", "features", "rank", "_hot", "weight"):
        docs = docs.withColumn(c, F.lit("x"))
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, doc_id int")
    got = importance.resample(docs, target, size=size, buckets=50, percent=30, least_words=6, seed=7).collect()
    want = brute.importance(rows, TARGET, size, 50, 30, 6, 7)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_frequent_lines_are_looked_up_alike(spark, monkeypatch):
    rows = made(9)
    docs, target = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(t,) for t in TARGET], "text string")
    want = sorted(map(str, importance.resample(docs, target, buckets=50).collect()))
    for limit in (1, 4):
        monkeypatch.setattr(tables, "FREQUENT", limit)
        assert sorted(map(str, importance.resample(docs, target, buckets=50).collect())) == want


def test_long_lines_are_worked_in_chunks(monkeypatch):
    rng = random.Random(3)
    words = [rng.choice(["a", "bb", "é" * 5, "x" * 90, "--", "c\n", "\n"]) for _ in range(400)]
    text = pa.array([" ".join(words)])
    for size, across in ((1, False), (3, False), (3, True)):
        whole = [(n.tolist(), m.tolist(), np.sort(b).tolist()) for n, m, b in importance.features(text, size, 97, across)]
        for limit in (1, 7, 64, 500):
            monkeypatch.setattr(importance, "SLICE_BYTES", limit)
            monkeypatch.setattr(importance, "chunks", lambda d, s, limit=limit: texts.chunks(d, s, limit))
            parts = [(n.tolist(), m.tolist(), np.sort(b).tolist()) for n, m, b in importance.features(text, size, 97, across)]
            assert parts == whole
        monkeypatch.undo()


def test_repeated_rows_empty_tables_and_bounds(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 4 + [(2, "a")], SCHEMA)
    none = docs.where("doc_id < 0")
    got = importance.resample(docs, none, percent=50, least_words=1).collect()
    assert sorted(r.rank for r in got if r.rank) == [1, 2] and [r.n_features for r in got if r.doc_id == 1] == [3] * 4
    assert importance.resample(none, docs).count() == 0
    with pytest.raises(ValueError):
        importance.resample(docs, docs, size=0)


def test_ranks_span_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("score"))
    got = importance.ranked(rows, 4000, F.desc("score"), F.asc("doc_id")).toPandas().sort_values(["score", "doc_id"], ascending=[False, True])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got["rank"].dropna().tolist() == list(range(1, 4001)) and got["rank"][4000:].isna().all()
