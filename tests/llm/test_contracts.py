"""Every opN query on the smallest tables, beside plain loops or the library itself."""

import hashlib
import zlib

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from barloom.llm.queries import tokenizer_file
from tests.llm import brute

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    t = pd.read_parquet(f"{ROOT}/documents.parquet")
    return list(zip(t.doc_id.tolist(), t.text.tolist()))


def result(spark, start):
    name = next(n for n in entry.queries() if n.startswith(start))
    return entry.queries()[name](spark, ROOT)


def test_one_query_per_operator():
    names = [n.split("_")[0] for n in entry.queries() if n.startswith("op")]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 14)) and "pipeline" in entry.queries()


def test_op1_decodes_and_varies(spark, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in result(spark, "op1_").collect()}
    assert len(got) == len(rows) and all(r.lossless for r in got.values())
    longer = 0
    for i, text in rows:
        assert sp.decode(list(got[i].ids)) == text and got[i].n_tokens == len(got[i].ids)
        longer += len(got[i].ids) > len(sp.encode(text))
    assert longer > 0.9 * len(rows)


def test_op2_key_law(spark, rows):
    got = result(spark, "op2_").toPandas()
    assert len(got) == len(rows) and set(got.law) == {"key"}
    assert got["shard"].between(0, 15).all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    moved = got[got["shard"] != got.grown_shard]
    assert set(moved.grown_shard) <= {16}
    text = dict(rows)
    for r in got.itertuples():
        assert (r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 1, brute.crc(text[r.doc_id]))


def test_op3(spark, rows):
    got = result(spark, "op3_").select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute.exact(rows))


def test_op4_counts(spark, rows):
    got = {r.doc_id: r for r in result(spark, "op4_").collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.stats(text)
        assert not (r.base_failed and r.kept)


def test_op5(spark, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    want = [(i, len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096) for i, t in rows]
    assert sorted(map(tuple, result(spark, "op5_").collect())) == want


def test_op6(spark, rows):
    want = brute.components(rows)
    got = result(spark, "op6_").collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, *v) for i, v in want.items())


def test_op7_held_out(spark):
    truth = pd.read_parquet(f"{ROOT}/documents.parquet").set_index("doc_id").lang
    got = result(spark, "op7_").toPandas()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in got.itertuples())
    test = got[got.held_out]
    assert (test.lang_pred.to_numpy() == truth[test.doc_id].to_numpy()).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_op8(spark, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    ids = {i: tok.encode(t, add_special_tokens=False).ids + [1] for i, t in rows}
    got = result(spark, "op8_").toPandas()
    for r in got.itertuples():
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert (zlib.crc32(piece.tobytes()), len(ids[r.doc_id])) == (r.ids_crc32, r.doc_tokens)
    for i, g in got.groupby("doc_id"):
        g = g.sort_values("start")
        assert g.start.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() == len(ids[i])
    assert set(got.doc_id) == set(ids)
    padding = 0
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 2048
        padding += 2048 - g.length.sum()
    assert padding < 0.05 * got.length.sum()


def test_op9(spark, rows):
    want = [(i, n, gone, hashlib.sha256(" ".join(kept).encode()).hexdigest()) for i, n, gone, kept in brute.without_repeats(rows)]
    assert sorted(map(tuple, result(spark, "op9_").collect())) == want
    assert sum(w[2] for w in want) > 0


def test_op10(spark):
    t = pd.read_parquet(f"{ROOT}/pages.parquet")
    got = result(spark, "op10_").collect()
    want = brute.archive(list(zip(t.page_id.tolist(), t.html.tolist())))
    assert sorted(map(tuple, got), key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])


def test_op11(spark, rows):
    target = pd.read_parquet(f"{ROOT}/benchmark.parquet").text.tolist()
    got = result(spark, "op11_").collect()
    assert sorted(map(tuple, got)) == sorted(brute.importance(rows, target))
    assert sum(r.rank is not None for r in got) == sum(r.n_words >= 20 for r in got) // 10


def test_op12(spark):
    docs, labels = (pd.read_parquet(f"{ROOT}/{t}.parquet") for t in ("documents", "labels"))
    got = result(spark, "op12_").collect()
    want = brute.audit(list(zip(docs.doc_id, docs.text, docs.source)), list(zip(labels.doc_id, labels.quality, labels.toxic)))
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_op13(spark, rows):
    got = {r.doc_id: r for r in result(spark, "op13_").collect()}
    assert len(got) == len(rows) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got.values()) > 0
    for i, text in rows:
        spans = brute.strict_spans(text)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(brute.listed(spans).encode()).hexdigest()
        assert set(brute.listed(spans).split(",")) - {""} <= set(r.spans.split(","))
