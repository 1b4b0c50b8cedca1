import math
import random
import time
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import barloom.catalog.text  # noqa: F401  (registers the loaders)
from barloom import plugins
from barloom.functions import text as tx
from barloom.operators import chunking, matching, retrieval, sentiment
from barloom.sources import chunk_store, documents, export, history


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?;,\n", max_size=1500), st.integers(50, 200), st.integers(0, 49))
def test_chunk_invariants(text, size, overlap):
    parts = chunking.pieces(text, size) if text.strip() else []
    assert all(0 < len(p) <= size for p in parts)
    chunks = chunking.split_text(text, size, overlap, 1)
    assert all(c == c.strip() and c for c in chunks)
    kept = set("".join(chunks).replace(" ", ""))
    assert kept <= set(text)


def test_chunk_overlap_and_ids(spark):
    body = "\n\n".join(f"Paragraph {i} " + "word " * 45 for i in range(12))
    df = spark.createDataFrame([("d1", body), ("d2", "short"), ("d3", "  ")], "doc_id string, content string")
    rows = chunking.chunk(df).orderBy("chunk_index").collect()
    assert [r["chunk_id"] for r in rows] == [f"d1_chunk_{i:04d}" for i in range(len(rows))]
    assert {r["total_chunks"] for r in rows} == {len(rows)}
    assert all(100 <= len(r["content"]) <= 1300 for r in rows)
    assert chunking.split_text("x" * 2500, 1000, 0, 1) == ["x" * 1000, "x" * 1000, "x" * 500]
    with pytest.raises(ValueError):
        chunking.chunk(df, size=40)
    with pytest.raises(ValueError):
        chunking.chunk(df, size=100, overlap=100)
    chunking.register_udtf(spark)
    df.createOrReplaceTempView("docs_for_chunks")
    n = spark.sql("SELECT c.* FROM docs_for_chunks, LATERAL chunk_text(content, 1000, 200, 100) c").count()
    assert n == len(rows)


@pytest.mark.parametrize(
    "text, want",
    [
        ("SIGNAL: SELL because", "SELL"),
        ("buy now, or sell", "BUY"),
        ("you may sell, sell or buy", "SELL"),
        ("buy sell", "BUY"),
        ("nothing", "HOLD"),
        ("we buy and sell", "HOLD"),
    ],
)
def test_parse_signal(spark, text, want):
    assert value(spark, tx.parse_signal, text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("Mon, 04 Nov 2024 10:00:00 +0000", "2024-11-04"),
        ("Mon, 4 Nov 2024 10:00:00 GMT", "2024-11-04"),
        ("2024-11-04T23:59:59+0100", "2024-11-04"),
        ("2024-11-04", "2024-11-04"),
        ("2024-13-04", "2030-01-01"),
        ("soon", "2030-01-01"),
        ("", "2030-01-01"),
    ],
)
def test_feed_dates(spark, text, want):
    as_of = F.lit("2030-01-01").cast("date")
    assert value(spark, lambda c: tx.feed_date(c, as_of), text) == want


def test_html(spark):
    page = "<!DOCTYPE html><style>x</style><p>First line of text</p>\n<b>12,345.00</b>\n<SCRIPT>a<b</SCRIPT>A &amp; B are companies\nshort"
    assert value(spark, tx.html_to_text, page) == "First line of text\nA & B are companies"
    assert value(spark, lambda c: tx.html_to_text(c, 5), page).endswith("[TRUNCATED]")
    assert value(spark, tx.clean_html, "<p>a&nbsp;b</p>\n c") == "a b c"


def test_jaccard_and_ids(spark):
    df = spark.createDataFrame([("a b c", "b c d"), ("", "x"), ("q", "q")], "a string, b string")
    got = [r[0] for r in df.select(tx.jaccard(tx.word_set(F.col("a")), tx.word_set(F.col("b")))).collect()]
    assert got == [0.5, 0.0, 1.0]
    assert len(value(spark, tx.content_id, "x")) == 16


def test_dedup_is_safe_for_hot_copies(spark):
    rows = [("same", f"u{i}", f"2024-01-{i % 28 + 1:02d}") for i in range(500)]
    rows += [("other", "u1", "2024-02-01"), ("third", "", "2024-02-02"), ("fourth", "", "2024-02-02")]
    df = spark.createDataFrame(rows, "content string, url string, date string")
    df = df.withColumn("doc_id", tx.content_id(F.col("content")))
    kept = documents.dedup(df, F.struct("date", "url")).orderBy("content").collect()
    assert [r["content"] for r in kept] == ["fourth", "other", "same", "third"]
    assert next(r for r in kept if r["content"] == "same")["date"] == "2024-01-01"


def test_metadata_round_trip(spark):
    df = spark.createDataFrame(
        [("T", "s", "news", "2024-01-01", "u", "t" * 600, "2024-01", 3, {"k": "v" * 300})],
        "ticker string, source string, doc_type string, date string, url string, title string, "
        "filing_period string, page_number int, extra map<string,string>",
    )
    row = documents.unflatten(documents.flatten(df).select("flat")).first()
    assert (row["ticker"], row["page_number"], len(row["title"])) == ("T", 3, 500)
    assert row["extra"] == {"k": "v" * 200}
    assert documents.metadata_filter(df).count() == 1
    assert documents.metadata_filter(df, "t", ["news"], "2024-01-01", "2024-01-01").count() == 1
    assert documents.metadata_filter(df, "x").count() == 0


def test_substring_join_equals_brute_force(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abé😀\n ") for _ in range(n))
    texts = [(i, word(rng.randint(0, 40))) for i in range(60)] + [(60, None)]
    needles = list({word(rng.randint(0, 6)) for _ in range(30)} | {word(50)})
    got = matching.contains_join(
        spark.createDataFrame(texts, "id int, t string"), "t",
        spark.createDataFrame([(n,) for n in needles], "n string"), "n",
    )
    assert {(r["id"], r["n"]) for r in got.collect()} == {
        (i, n) for i, t in texts for n in needles if t and n and n in t
    }


def test_substrings_are_found_in_parts_of_texts(spark, monkeypatch):
    needles = ["a", "é", "bé", "ab", "😀", "b a", "abab" * 5]
    marks = matching.Marks(spark.createDataFrame([(n,) for n in needles], "n string"), "n")
    rng = random.Random(5)
    texts = ["x"] + ["".join(rng.choice("abé😀 ") for _ in range(n)) for n in (0, 1, 2, 40, 300)] + [None, "abab" * 6]
    for part in (1, 7, 1 << 20):
        monkeypatch.setattr(matching, "SLICE", part)
        for got in (marks.within(pa.array(texts)), marks.within(pa.array(["abé", *texts])[1:])):
            assert len(got) == len(texts)
            for t, found in zip(texts, got.to_pylist()):
                assert {n for n in needles if n in (t or "")} <= set(found) and all(f in t for f in found)


def test_a_long_text_is_searched_in_seconds(spark):
    text = "the quick brown fox " * 100_000 + "fox jumps"
    names = spark.createDataFrame([("the", "brown fo"), ("x jum", "slow")], "ticker string, company string")
    entries = spark.createDataFrame([("f", 1, None, text)], "feed string, pos long, title string, summary string")
    start = time.perf_counter()
    got = documents.mentions(entries, names, per_feed=None).collect()
    assert {r["ticker"] for r in got} == {"the", "x jum"} and time.perf_counter() - start < 15


def test_topk_paths_agree_with_numpy(spark):
    rng = np.random.default_rng(0)
    corpus, asks = rng.normal(size=(200, 8)), rng.normal(size=(5, 8))
    corpus[7] = corpus[3]
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "vec_id long, vector array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asks)], "query_id long, query array<double>")
    cos = retrieval.unit(corpus) @ retrieval.unit(asks).T
    want = {
        (j, i, r + 1)
        for j in range(5)
        for r, i in enumerate(np.lexsort((np.arange(200), -cos[:, j].round(12)))[:10])
    }
    limits = retrieval.BLOCK_BYTES, retrieval.TILE
    try:
        for block, tile, bands in ((*limits, None), (8 * 8 * 7, 20, 3), (1, 1, 1)):
            retrieval.BLOCK_BYTES, retrieval.TILE = block, tile
            got = retrieval.vector_topk(c.repartition(3), q.repartition(2), 10, bands).collect()
            assert {(r["query_id"], r["vec_id"], r["rank"]) for r in got} == want
            assert all(abs(r["score"] - (1 - r["distance"] / 2)) < 1e-12 for r in got)
    finally:
        retrieval.BLOCK_BYTES, retrieval.TILE = limits
    assert retrieval.vector_topk(c, q.where("query_id < 0"), 10).count() == 0
    assert retrieval.vector_topk(c.where("vec_id < 0"), q, 10).count() == 0
    assert retrieval.vector_topk(c, q, 500).groupBy("query_id").count().first()["count"] == 200


def test_tfidf_shuffles_no_row_per_term_of_a_document(spark, monkeypatch):
    """Blocks of a few terms and slices of a row give the weights of one pass, and only a block's
    different terms meet by term."""
    rng = random.Random(8)
    docs = [(rng.randrange(40), " ".join(rng.choice(["The", "the", "of", "a\tb", "É", "x" * rng.randrange(1, 5)]) for _ in range(rng.randrange(30)))) for _ in range(60)]
    docs += [(100, None), (101, ""), (102, " \n "), (103, "the the once")]
    counts = {}
    for i, text in docs:
        for w in (text or "").lower().split():
            counts[i, w] = counts.get((i, w), 0) + 1
    n, df = len({i for i, _ in docs}), {}
    for _, w in counts:
        df[w] = df.get(w, 0) + 1
    raw = {(i, w): c * math.log((n + 1) / (df[w] + 1)) for (i, w), c in counts.items()}
    length = {i: math.sqrt(sum(v * v for (j, _), v in raw.items() if j == i)) for i, _ in docs}
    want = {k: v / length[k[0]] for k, v in raw.items() if v}
    frame = spark.createDataFrame(docs, "doc_id long, content string")
    for terms, rows in ((1 << 20, 512), (5, 1)):
        blocks = partial(retrieval._term_blocks, block_terms=terms, split_rows=rows)
        monkeypatch.setattr(retrieval, "_term_blocks", blocks)
        out = retrieval.tfidf(frame)
        got = {(r["doc_id"], r["term"]): r["weight"] for r in out.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
        monkeypatch.undo()
    plan = out._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "doc_id" not in plan.partition("Window")[2].split("\n")[0]


def recall_and_share(index, corpus, queries, k=10):
    """Recall of the index against the exact search and the share of all pairs that it meets."""
    pairs = lambda hits: {(r["query_id"], r["vec_id"]) for r in hits.collect()}
    true, found = pairs(retrieval.vector_topk(corpus, queries, k)), pairs(index.search(queries, k))
    cells, asked = (side.groupBy("cell").count().withColumnRenamed("count", n) for side, n in zip(index.met(queries), "ab"))
    met = cells.join(asked, "cell").agg(F.sum(F.col("a") * F.col("b"))).first()[0]
    return len(true & found) / len(true), met / corpus.count() / queries.count()


def test_cell_index_prunes_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(60, 24))
    points = [(i, (centers[i % 60] + 0.35 * rng.normal(size=24)).tolist()) for i in range(6000)]
    corpus = spark.createDataFrame(points, "vec_id long, vector array<double>").repartition(4)
    queries = corpus.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "vector as query")
    recall, share = recall_and_share(retrieval.CellIndex(corpus), corpus, queries)
    assert recall >= 0.9 and share < 0.2


def test_cell_index_keeps_its_recall_without_clusters(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id", "embedding as vector", "label")
    for queries in (retrieval.centroids(v, "label", "vector"), v.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "vector as query")):
        recall, share = recall_and_share(retrieval.CellIndex(v), v, queries)
        assert recall >= 0.9 and share < 1


def test_cell_index_answers_short_queries_exactly(spark):
    points = [(i, [math.cos(i / 50), math.sin(i / 50)]) for i in range(300)] + [(300, None), (301, [-1.0, 0.0])]
    corpus = spark.createDataFrame(points, "vec_id long, vector array<double>")
    queries = spark.createDataFrame([(1, [-1.0, -0.01]), (2, [1.0, 0.0]), (3, None)], "query_id int, query array<double>")
    index = retrieval.CellIndex(corpus, k=3)
    index.probes = 1
    got = {tuple(r) for r in index.search(queries, 40).select("query_id", "vec_id", "rank").collect()}
    assert got == {tuple(r) for r in retrieval.vector_topk(corpus, queries, 40).select("query_id", "vec_id", "rank").collect()}
    assert retrieval.CellIndex(corpus.where("false")).search(queries, 5).count() == 0


def test_mmr_prefers_new_words(spark):
    hits = [(0, 1, 10, 0.9, "a b c"), (0, 2, 11, 0.89, "a b c"), (0, 3, 12, 0.8, "x y z")]
    df = spark.createDataFrame(hits, "query_id long, rank int, vec_id long, score double, content string")
    rows = retrieval.mmr(df, k=2).orderBy("position").collect()
    assert [r["vec_id"] for r in rows] == [10, 12]
    assert retrieval.mmr(df, k=5).count() == 3


def test_context_budget(spark):
    hits = [(0, i + 1, "[s]", 0.5, "w" * 400) for i in range(4)]
    df = spark.createDataFrame(
        hits, "query_id long, position int, citation string, score double, content string"
    )
    row = retrieval.build_context(df, limit=1100).first()
    assert row["passages"] == 3 and row["context"].endswith("...[truncated]")
    row = retrieval.build_context(df, limit=900).first()
    assert row["passages"] == 2 and "truncated" not in row["context"]


def test_sentiment(spark):
    df = spark.createDataFrame(
        [("d", "[Source 1] x\nStrong growth and record profit. Shares fell on weak demand!\n12.5\n---\nNothing else here.")],
        "doc_id string, content string",
    )
    rows = sentiment.scored(sentiment.sentences(df, ["doc_id"])).orderBy("pos").collect()
    assert [r["score"] for r in rows] == [1.0, -1.0, 0.0]
    assert rows[0]["confidence"] == pytest.approx(0.45)
    a = sentiment.aggregate(sentiment.scored(sentiment.sentences(df, ["doc_id"])), ["doc_id"]).first()
    b = sentiment.evidence(df, F.col("doc_id"), "content", {"up": ["growth"], "down": ["miss"]}).first()
    assert a["sentiment_score"] == pytest.approx(b["sentiment_score"])
    assert (b["up"], b["down"], b["sentences"]) == (1, 0, 3)


def test_tables_on_disk(spark, tmp_path):
    path = str(tmp_path / "chunks")
    make = lambda rows: spark.createDataFrame(rows, "chunk_id string, content string, ticker string")
    chunk_store.write(make([("a", "1", "X"), ("b", "2", "Y")]), path)
    chunk_store.write(make([("c", "3", "X")]), path)
    assert {(r[0], r["ticker"]) for r in chunk_store.load(spark, path).collect()} == {("c", "X"), ("b", "Y")}

    log = str(tmp_path / "history")
    rows = [(i, "T", f"2024-01-{i + 1:02d} 10:00:00", "big") for i in range(5)]
    df = spark.createDataFrame(rows, "id long, ticker string, at string, equity_curve string")
    history.save(df.withColumn("created_at", F.col("at").cast("timestamp")).drop("at"), log)
    page = history.newest(history.load(spark, log), "t", 2).collect()
    assert [r["id"] for r in page] == [4, 3] and "equity_curve" not in page[0].asDict()

    out = str(tmp_path / "csv")
    text = [("a,b", 1.5), ('say "x"', 2.0), ("two\nlines", None)]
    export.csv(spark.createDataFrame(text, "note string, v double").coalesce(1), out)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(out)
    assert {(r[0], float(r[1]) if r[1] else None) for r in back.collect()} == set(text)


def test_parquet_sources_read_files_folders_and_stores(spark, tmp_path):
    rows = [(i, i % 3, "user" if i % 2 else None, f"text {i}" if i % 5 else None) for i in range(40)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    folder = tmp_path / "in" / "conversations.parquet"
    turns.repartition(4).write.parquet(str(folder))
    (folder / "_hidden.parquet").write_bytes(b"no Parquet")
    (folder / "more").mkdir()
    pq.write_table(turns.toArrow(), tmp_path / "one.parquet", row_group_size=7)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("fs.viewfs.mounttable.only.link./in", f"file://{tmp_path}/in")
    want = sorted((t or "", (r or "").upper(), f"https://example.com/c/{c}/{n}") for c, n, r, t in rows)
    for path in (tmp_path / "one.parquet", folder, f"file://{folder}", "viewfs://only/in/conversations.parquet"):
        got = plugins.load_all(spark, {"conversation_turns": {"path": str(path)}})
        assert sorted((r["content"] or "", r["ticker"] or "", r["url"]) for r in got.collect()) == want
