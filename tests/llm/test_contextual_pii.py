"""Base patterns beside Python's own, contexts that vouch for unseen identifiers, odd rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from barloom.llm import contextual_pii, tables
from tests.llm import brute

SCHEMA = "doc_id long, text string"
PIECES = ["a", "b.c", "@", "@x", ".", "..", "-", "_", "%", "+", "1", "22", "255", "256", "0001", ".1", "4111111111111111", "4111 1111 1111 1111",
          " ", "  ", "(", ")", "\n", "é", "😀", "@mail.example.com", "10.0.0.1", "+49 30 1234567", "x@y.z", "::", "fe80:", "/"]


def spans(r):
    return [s for s in r.spans.split(",") if s]


def test_base_meets_the_plain_patterns(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 25)))) for i in range(1500)]
    rows += [(9000, None), (9001, ""), (9002, "4111 1111 1111 1111 and +1 (555) 123-4567, 1.2.3.4.5 a@b.c_d@e.f.@x.y")]
    got = {r.doc_id: r for r in contextual_pii.personal_data(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        base, r = brute.strict_spans(text), got[i]
        assert [s for s in spans(r) if s in set(brute.listed(base).split(","))] == [f"{k}:{a}:{b}" for k, a, b in base], text
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in contextual_pii.KINDS)
        assert len(spans(r)) == len(base) + r.n_found


def test_long_runs_take_no_square(spark):
    texts = ["x" * 3_000_000, "1" * 2_000_000, "1 " * 1_000_000, "a@" * 500_000, "1." * 1_000_000, "+1" * 500_000, "a@b" + ".c" * 1_000_000, "ab:" * 500_000]
    start = time.time()
    got = {r.doc_id: r for r in contextual_pii.personal_data(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert time.time() - start < 120
    assert got[6].n_email == 1 and got[4].n_ip == 250_000 and got[1].n_card == 0


def contexts(n=12):
    rows = [(i, f"Please call {'our' if i % 2 else 'the'} office at +1 (555) 010-{1000 + i} before noon, room {i}.") for i in range(n)]
    rows += [(100 + i, f"mail to user{i}@site{i}.example.com or leave it. page {i} of 9") for i in range(n)]
    rows += [(200, "Please call our office at 555-010-7777 before noon."), (201, "mail to jo@intranet or leave it. page 7 of 9")]
    return rows + [(202, "a number such as 555-010-7777 again"), (203, "page 5550108888 of nothing, 12 of 30")]


def test_contexts_discover_what_no_pattern_matches(spark):
    got = {r.doc_id: r for r in contextual_pii.personal_data(spark.createDataFrame(contexts(), SCHEMA)).collect()}
    assert spans(got[200]) == ["phone:26:38"] and got[200].n_found == 1 and got[200].n_phone == 0
    assert spans(got[201]) == ["email:8:19"]
    assert spans(got[202]) == ["phone:17:29"]  # known by then, in any context
    assert spans(got[203]) == [] and all(r.n_found == 0 for i, r in got.items() if i < 200)


def test_joins_of_hot_names_are_alike(spark, monkeypatch):
    docs = spark.createDataFrame(contexts() * 3, SCHEMA)
    want = sorted(map(str, contextual_pii.personal_data(docs).collect()))
    monkeypatch.setattr(tables, "FREQUENT", 1)
    assert sorted(map(str, contextual_pii.personal_data(docs).collect())) == want


def test_mixed_contexts_vouch_for_nothing(spark):
    rows = [(i, f"item {4000 + i} sold") for i in range(50)] + [(60 + i, f"item +1 (555) 010-{1000 + i} sold") for i in range(10)]
    rows.append((99, "item 555-010-7777 sold"))
    got = contextual_pii.personal_data(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.n_found for r in got) == 0 and sum(r.n_phone for r in got) == 10


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "x@y.zz"), (2, "x@y.zz"), (2, "x@y.zz")], SCHEMA)
    for c in ("row", "kind", "match", "start", "spans", "name", "_hot", "held"):
        docs = docs.withColumn(c, F.lit("x"))
    got = contextual_pii.personal_data(docs).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.spans) for r in got) == [(0, 1, "email:0:6"), (1, 0, ""), (1, 0, ""), (2, 1, "email:0:6"), (2, 1, "email:0:6")]
    assert contextual_pii.personal_data(docs.where("false")).count() == 0


@pytest.mark.parametrize("digits", ["4111111111111111", "4111111111111112", "6011000990139424", "0000000000000000000", "30569309025904"])
def test_luhn(spark, digits):
    assert spark.range(1).select(contextual_pii.luhn(F.lit(digits))).first()[0] == brute.luhn(digits)
