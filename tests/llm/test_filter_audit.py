"""The audit of filters beside every order applied to every row."""

import random
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from barloom.llm import filter_audit, texts
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string"


def made(seed, n=80):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(["Aa", "b", "cc", "é", "D#", "zz"]) + str(rng.randrange(rng.choice([3, 400]))) for _ in range(rng.choice([3, 49, 50, 90]))]
        text = " ".join(words)
        out.append((i, text if rng.random() < 0.5 else text.lower().replace("#", ""), rng.choice(["p", "q", "", None])))
    out += [(100 + k, rng.choice(out)[1], "p") for k in range(20)]
    return out + [(200, None, "q"), (201, "", None), (202, " \t", "q"), (None, None, "p"), (None, out[0][1], None), (5, out[5][1], out[5][2])]


def test_meets_every_order(spark):
    rows = made(1)
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (7, None, 1), (100, 1, 1), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for c in ("part", "mask", "digest", "n", "_q", "quality", "_first"):
        docs = docs.withColumn(c, F.lit("x"))
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    got = filter_audit.audit(docs, told).collect()
    assert len(got) == 600 * 3 and {tuple(r) for r in got} == brute.audit(rows, labels)
    assert filter_audit.audit(docs.where("false"), told).count() == 0
    assert filter_audit.audit(docs, told.where("false")).agg(F.sum("good_lost")).first()[0] == 0


def test_shapley_operator_is_the_mean_over_orders():
    rng = np.random.default_rng(2)
    for players in (2, 3, 5):
        game = rng.integers(0, 1000, 1 << players)
        game[0] = 0
        want = np.zeros(players, np.int64)
        for order in permutations(range(players)):
            seen = 0
            for i in order:
                want[i] += game[seen | 1 << i] - game[seen]
                seen |= 1 << i
        assert (filter_audit.shapley_operator(players) @ game == want).all()


def test_long_texts_are_counted_in_chunks(monkeypatch):
    text = " ".join(["Word#", "é" * 40, "x" * 900, "same", "same"] * 30 + [f"w{i}" for i in range(500)])
    whole = filter_audit._counts(pa.array([text])).tolist()
    for limit in (16, 100, 1000):
        monkeypatch.setattr(filter_audit, "SLICE_BYTES", limit)
        monkeypatch.setattr(filter_audit, "chunks", lambda d, s, limit=limit: texts.chunks(d, s, limit))
        assert filter_audit._counts(pa.array([text])).tolist() == whole
