"""Nulls, empty and very long texts, repeated rows, empty tables, clashing column names."""

import pytest
from pyspark.sql import functions as F

from barloom.llm import boosting, exact_dedup, language, packing, pieces, quality, sharding, simhash, substrings, tables, token_counts, warc
from barloom.llm.components import components
from barloom.llm.queries import tokenizer_file
from barloom.llm.tables import Members, without
from tests.llm import brute

PIECE, WORD = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 7919} é{i % 31}" for i in range(120_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ROWS = [
    (1, None, None, "a", None),
    (2, "", "en", "a", 0),
    (3, " \t\n\x0b\x0c\r ", "en", "a", 7),
    (4, LONG, "en", "a", len(LONG)),
    (5, "the same row twice " * 9, "en", "a", 171),
    (5, "the same row twice " * 9, "en", "a", 171),
    (6, "the  same\nrow twice " * 9, "en", None, 180),
    (None, f"no id here {PASSAGE} left", "de", "a", 1),
    (None, f"another one {PASSAGE} right", "de", "a", 1),
    (7, f"with id {PASSAGE}", "de", "b", 1),
    (8, "<|endoftext|> <s> </s> \x00 ▁ 漢字 😀 ﬁ é", "fr", "b", 1),
    (9, "x" * 5000, None, "b", 5000),
]
CLASHING = ["row", "key", "id", "maybe", "spans", "kept", "h", "digest", "fp", "score", "_page", "_bits", "shard", "slot", "hashes", "seeds"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3, "source")
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id = -1")


def test_merge_dropout(docs, none):
    got = pieces.encode_dropout(docs, PIECE, share=0.3, seed=9).collect()
    assert len(got) == len(ROWS)
    assert all(r.lossless is True for r in got if r.ids is not None) and sum(r.ids is None for r in got) == 1
    back = {(r.doc_id, r.text) for r in pieces.decode_ids(pieces.encode_dropout(docs, PIECE, share=0.3), PIECE).collect()}
    assert back == {(r[0], r[1]) for r in ROWS}
    assert pieces.encode_dropout(none, PIECE).count() == 0
    with pytest.raises(ValueError):
        pieces.Dropout(1.5, 1)


def test_dropout_is_seeded_and_off_equals_the_library():
    import numpy as np
    import pyarrow as pa

    vocab = pieces.vocabulary(PIECE)
    texts = [r[1] for r in ROWS if r[1] and "▁" not in r[1] and len(r[1]) < 10_000] + ["  a  b ", "\n\n", "';\r"]
    keys = np.arange(len(texts))
    ids, _ = pieces.encode(vocab, pa.array(texts), keys, pieces.Dropout(0, 1))
    assert ids.tolist() == [i for x in vocab.model.encode(texts) for i in x]
    one, two, other = (pieces.encode(vocab, pa.array(texts), keys, pieces.Dropout(0.4, s))[0].tolist() for s in (1, 1, 2))
    assert one == two != other
    singles, _ = pieces.encode(vocab, pa.array(texts), keys, pieces.Dropout(1, 1))
    assert len(singles) > len(ids)


def test_long_pre_tokens_merge_alike():
    import numpy as np
    import pyarrow as pa

    vocab, text = pieces.vocabulary(PIECE), pa.array(["漢字かなword" * 40, "unbelievable" * 30])
    limit = pieces.LONG
    try:
        got = []
        for pieces.LONG in (4, 10**6):
            got.append([pieces.encode(vocab, text, np.arange(2), pieces.Dropout(p, 3))[0].tolist() for p in (0, 0.2)])
    finally:
        pieces.LONG = limit
    assert got[0] == got[1]


def test_shards(docs, none):
    got = sharding.shard_documents(docs, [1.0, 3.0]).collect()
    assert len(got) == len(ROWS)
    for s in (0, 1):
        mine = sorted(r.slot for r in got if r["shard"] == s)
        assert mine == list(range(len(mine)))
    assert len({r["shard"] for r in got if r.doc_id is None}) == 1 and {r.size for r in got if r.doc_id == 1} == {1}
    assert sharding.shard_documents(none, [1.0] * 16).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("doc_id"), [1.0, 0.0])


def test_weights_are_met_and_few_move(spark):
    ids = spark.range(40_000).select("id", sharding.rendezvous(F.col("id"), [1, 2, 5]).alias("a"), sharding.rendezvous(F.col("id"), [1, 2, 5, 2]).alias("b"))
    share = {r.a: r["count"] / 40_000 for r in ids.groupBy("a").count().collect()}
    assert all(abs(share[i] - w / 8) < 0.02 for i, w in enumerate([1, 2, 5]))
    moved = ids.where("a <> b")
    assert {r.b for r in moved.select("b").distinct().collect()} == {3} and abs(moved.count() / 40_000 - 0.2) < 0.02


def test_slots_of_many_equal_rows(spark):
    rows = spark.range(1000).select(F.lit(7).alias("doc_id"), F.lit("x").alias("text"))
    got = [r.slot for r in sharding.shard_documents(rows, [1.0] * 4).collect()]
    assert sorted(got) == list(range(1000))


def test_exact(docs, none):
    got = exact_dedup.keepers(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[1].keep_id == 3 and by[2].group_size == 3 and by[3].kept and not by[1].kept
    assert by[5].keep_id == 6 and not by[5].kept  # more code points stay
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 3, 4, 6, 7, 8, 9]
    assert exact_dedup.keepers(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_exact_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "q"), (None, "q"), (2, "z")], "doc_id long, text string")
    assert sorted(map(str, exact_dedup.drop_copies(df).collect())) == sorted(map(str, df.distinct().collect()))


def test_exact_chains_and_buckets(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 100).cast("string")).alias("text"))
    weak = lambda n: F.shiftleft(F.length(n).cast("long"), 60)
    _, index = exact_dedup.build(df, capacity=8, hashed=weak)
    assert index.agg(F.max("chain")).first()[0] == 89  # ninety texts of three characters
    assert {r.n for r in index.select("n").collect()} == {3}
    _, index = exact_dedup.build(df, capacity=8)
    assert index.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 8
    with pytest.raises(Exception, match="share hash and digest"):
        exact_dedup.build(df, hashed=weak, digested=lambda n: F.length(n).cast("string").cast("binary"))


def test_exact_goes_through_its_directory(spark, docs, monkeypatch):
    """Owners decide: rows whose slot is missing are lost, chains end where a bucket does."""
    whole = exact_dedup.directory

    def broken(entries, capacity):
        depth, slots = whole(entries, capacity)
        return depth, tables.saved(slots.where(F.col("bucket") > slots.agg(F.min("bucket")).first()[0]), "broken")

    df = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 100).cast("string")).alias("text"))
    right = exact_dedup.keepers(df, capacity=8).collect()
    assert len(right) == 300 and len({r.bucket for r in right}) > 10
    monkeypatch.setattr(exact_dedup, "directory", broken)
    got = exact_dedup.keepers(df, capacity=8).collect()
    lost = min(r.bucket for r in right)
    assert sorted(map(str, got)) == sorted(str(r) for r in right if r.bucket != lost) and len(got) < 300


def test_exact_directory_deepens_where_hashes_crowd(spark):
    df = spark.range(600).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    crowded = lambda n: F.shiftrightunsigned(F.xxhash64(n), 40)
    _, index = exact_dedup.build(df, capacity=8, hashed=crowded)
    assert index.count() == 600 and index.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 8


def test_quality(docs, none):
    got = quality.judge(docs, None).collect()
    assert len(got) == len(ROWS)
    want = sorted((r[0] or 0, *brute.stats(r[1])) for r in ROWS)
    assert sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(r.kept != r.base_failed and r.score is None for r in got)
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit("x").alias("text"))
    assert quality.learn(docs, labels) is None and quality.learn(none, labels) is None
    assert quality.judge(none, None).count() == 0


def test_boosting_is_monotone():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = (x[:, 0] + 0.5 * np.sin(9 * x[:, 1]) + 0.3 * rng.random(2000) > 0.9).astype(float)
    forest = boosting.fit(x, y, np.array([1, 0, -1]))
    assert ((forest.score(x) > 0.5) == y).mean() > 0.9
    for j, sign in ((0, 1), (2, -1)):
        grid = np.repeat(rng.random((50, 1, 3)), 40, axis=1)
        grid[:, :, j] = np.linspace(-0.5, 1.5, 40)
        steps = np.diff(forest.score(grid.reshape(-1, 3)).reshape(50, 40), axis=1)
        assert (sign * steps >= -1e-12).all()


def test_token_counts(docs, none):
    model = pieces.vocabulary(PIECE).model
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, PIECE).collect())
    want = [(r[0] or 0, len((r[1] or "").encode()), len(model.encode(r[1] or ""))) for r in ROWS]
    assert got == sorted((*w, w[2] > 4096) for w in want)
    assert token_counts.token_counts(none, PIECE).count() == 0


def test_near_copies(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    want = brute.components([(r[0], r[1]) for r in ROWS if r[0] is not None])
    assert all(want[r.doc_id][0] == r.fingerprint for r in got if r.doc_id is not None)
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {1}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 4, 5, None, 7, 8, 9}


def test_links_of_a_dense_cluster(spark):
    """A few thousand fingerprints in one ball: overfull postings split, no link is lost."""
    import numpy as np

    rng = np.random.default_rng(5)
    center = int(rng.integers(0, 2**63))
    fps = {center ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(1500)}
    fps |= {int(v) for v in rng.integers(0, 2**63, 300)} | {0, (1 << 64) - 1}
    all_ = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(v),) for v in all_.view(np.int64)], "fp long")
    got = {tuple(sorted((a & (1 << 64) - 1, b & (1 << 64) - 1))) for a, b in simhash.links(df).collect()}
    want = set()
    for k, v in enumerate(all_):
        for j in np.flatnonzero(np.bitwise_count(all_[k + 1 :] ^ v) <= 3):
            want.add((int(v), int(all_[k + 1 + j])))
    assert got == want and len(want) > 1000


def test_blocks_meet_every_five_positions():
    from itertools import combinations

    assert len(simhash.BLOCKS) == 14
    assert all(any(set(b) <= set(five) for b in simhash.BLOCKS) for five in combinations(range(8), 5))


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(200, 260)]
    got = dict(map(tuple, components(spark.createDataFrame(path + star + [(7, 7)], "a long, b long")).collect()))
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(200, 260)} == {5} and 7 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language(docs, none):
    profiles = language.learn(docs)
    assert profiles.langs == ("de", "en", "fr")
    got = language.identify(docs, profiles).collect()
    assert len(got) == len(ROWS) and {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    nothing = language.learn(none)
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(none, profiles).count() == 0
    kept = language.accepted(docs, profiles, 0.0)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 3


def test_distances_match_plain_counting(spark):
    import pyarrow as pa

    rows = [("Die Katze trinkt Milch, und der Hund schläft. ÄÖ ß", "de"), ("The cat drinks milk and the dog sleeps", "en")]
    profiles = language.learn(spark.createDataFrame(rows * 2, "text string, lang string"), profile=40)
    ranked = {k: [int(g) for g in profiles.grams[profiles.ranks[:-1, j].argsort()] if profiles.ranks[list(profiles.grams).index(g), j] >= 0] for j, k in enumerate(profiles.langs)}
    for text in ("der Hund und die Katze", "a dog", "xyz", "É1 2"):
        distance, n = brute.profile_distance(text, ranked, 40)
        lang, score = profiles.predict(pa.array([text]))
        best = min(sorted(distance), key=distance.get)
        assert lang == [best] and abs(score[0] - (1 - distance[best] / (40 * n))) < 1e-12


def test_packing(docs, none):
    got = packing.pack(docs, WORD, slots=2, fan=2).toPandas()
    assert got.groupby(["sequence_id"]).length.sum().max() <= 2048
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]]
    assert (got[got.doc_id == 1].doc_tokens == 1).all() and len(got[got.doc_id == 4]) > 100
    assert len(got[got.doc_id.isna()]) == 2 and len(got[got.doc_id == 5]) == 2
    assert packing.pack(none, WORD).count() == 0


def test_windows_stay_bounded():
    windows, sums = packing.Windows(10, 3), {}
    for need in [6, 7, 3, 8, 9, 4, 2, 10, 1, 5, 5]:
        number, offset = windows.place(need)
        assert offset == sums.get(number, 0)
        sums[number] = offset + need
        assert len(windows.open) <= 3
    assert max(sums.values()) <= 10


def test_substrings(docs, none):
    got = substrings.remove_repeats(docs).collect()
    want = brute.without_repeats([(r[0], r[1]) for r in ROWS])
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in got) == sorted((i or 0, n, g, " ".join(k)) for i, n, g, k in want)
    assert substrings.remove_repeats(none).count() == 0
    left = substrings.cleaned(docs)
    assert left.columns == docs.columns
    texts = {r.text for r in left.collect()}
    assert {"no id here left", "another one right", "with id"} <= texts and substrings.cleaned(none).count() == 0


def test_substring_ends_and_overlaps(spark):
    """Matches of every length around the threshold, runs of one word, hot passages."""
    import random

    rng = random.Random(3)
    pool = [f"u{i}" for i in range(400)]
    rows = []
    for i in range(150):
        text = [rng.choice(pool) for _ in range(rng.randrange(5, 60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(0, 300)
            text += [f"s{k}" for k in range(at, at + rng.randrange(30, 45))] + [rng.choice(pool)]
        if i % 10 == 0:
            text += ["same"] * rng.randrange(30, 80)
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(df).collect())
    assert got == [(i, n, g, " ".join(k)) for i, n, g, k in brute.without_repeats(rows)]
    assert 0 < sum(g[2] for g in got) < sum(g[1] for g in got)


def test_archive(spark, tmp_path):
    rows = [
        (3, "http://a", "same é"), (1, "http://b c\r\nX: y", "same é"), (2, None, None), (4, "u", ""), (5, "u", "\r\n\r\nWARC/1.1\r\n\r\n"),
        (6, "u", "long " * 100_000), (6, "u", "long " * 100_000), (None, "u", "same é"), (None, "u", "only null"), (None, "u", "only null"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder, index = warc.write_archive(pages.withColumn("sha", F.lit(1)).withColumn("refers_to", F.lit("x")), f"file://{tmp_path}/w", frame_bytes=1000)
    got = warc.read_archive(folder, index).toPandas()
    assert len(got) == len(rows) == index.count()
    kinds = {(None if x != x else int(x), t, None if r != r else int(r)) for x, t, r in zip(got.page_id, got.record_type, got.refers_to)}
    assert kinds == {(3, "revisit", 1), (1, "response", None), (2, "response", None), (4, "revisit", 2), (5, "response", None), (6, "response", None), (None, "revisit", 1), (None, "response", None)}
    one = index.where("page_id = 5").first()
    with open(f"{tmp_path}/w/{one.bundle}", "rb") as f:
        headers, block = warc.BundleReader(f).record(one.frame, one.offset, one.length)
    assert headers["WARC-Record-ID"] == one.record_id and block.endswith(b"\r\n\r\n\r\n\r\nWARC/1.1\r\n\r\n")
    folder, index = warc.write_archive(pages.where("page_id = -1"))
    assert warc.read_archive(folder, index).count() == 0


def test_bundle_is_plain_zstandard():
    import io

    import zstandard

    sink = io.BytesIO()
    writer = warc.BundleWriter(sink, 100)
    parts = [bytes([65 + i]) * (30 * i) for i in range(9)]
    for p in parts:
        writer.add(p)
    writer.close()
    sink.seek(0)
    assert zstandard.ZstdDecompressor().stream_reader(sink, read_across_frames=True).read() == b"".join(parts)
    reader = warc.BundleReader(sink)
    assert b"".join(reader.frame(i) for i in range(len(reader))) == b"".join(parts) and len(reader) > 3


def test_members_never_miss(spark):
    keys = spark.range(0, 5000, 7).select(F.xxhash64("id").alias("h"))
    marked = Members(keys, F.col("h")).mark(spark.range(5000), F.xxhash64("id"), "hit")
    hits = {r.id for r in marked.where("hit").collect()}
    assert set(range(0, 5000, 7)) <= hits and len(hits) < 1500
    nobody = Members(keys.where("h is null"), F.col("h"))
    assert nobody.mark(spark.range(10), F.xxhash64("id"), "hit").where("hit").count() == 0


def test_without(docs):
    gone = docs.where("doc_id in (4, 5)").select("doc_id", F.xxhash64("text").alias("key"))
    left = without(docs, gone)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 1, 2, 3, 6, 7, 8, 9]


@pytest.mark.parametrize("texts", [[""], ["", ""], [None], [" "], ["", None, " \n"], ["a"], ["\n"]])
def test_slices_with_hardly_any_text(texts):
    import numpy as np
    import pyarrow as pa

    from barloom.llm.texts import Words, lowered

    raw, plain = pa.array(texts, pa.string()), pa.array([t or "" for t in texts])
    vocab = pieces.vocabulary(PIECE)
    ids, counts = pieces.encode(vocab, plain, np.arange(len(texts)), pieces.Dropout(0.1, 1))
    assert pieces.decode(vocab, ids, counts).to_pylist() == [(t or "").encode() for t in texts]
    assert token_counts.counter(PIECE).counts(plain).tolist() == [len(vocab.model.encode(t or "")) for t in texts]
    stats = quality.statistics(raw)
    assert stats["features"].shape == (len(texts), len(quality.FEATURES)) and not np.isnan(stats["features"]).any()
    hashes, bounds = simhash.shingle_hashes(Words(raw, lowered), 3)
    assert [f == 0 for f in simhash.majority(hashes, bounds)] == [not (t or "").split() for t in texts]
    assert len(language.Profiles.of({"en": [97]}, 300).predict(plain)[0]) == len(texts)
    assert len(packing.encoder(WORD).encode(raw)[1]) == len(texts)
    assert len(substrings.Stretches(Words(raw), 35, 12).first) == 0


@pytest.mark.parametrize("seed", range(3))
def test_ids_by_parts_equal_the_library(seed):
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(WORD), random.Random(seed)
    alphabet = "abcXYZ 'sS\"tT.,!?-0123éÉßüçñØÿ÷×ǅİ́̊ﬁ漢字😀  \x85\x1c\n\t<|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["<|endoftext|> x", "A<|startoftext|>b", "don't I'LL we'Ve 'S", "<|ENDOFTEXT|>"]
    for some in (texts, texts[:-4]):
        want = tok.encode_batch(some, add_special_tokens=False)
        ids, counts = packing.Encoder(WORD).encode(pa.array(some))
        assert counts.tolist() == [len(w.ids) for w in want]
        assert ids.tolist() == [i for w in want for i in w.ids]


@pytest.mark.parametrize("seed", range(3))
def test_counts_of_odd_texts_equal_the_library(seed):
    import random

    import numpy as np
    import pyarrow as pa

    rng, vocab = random.Random(seed), pieces.vocabulary(PIECE)
    alphabet = "abc  the. \t\n\r'\";{}()0123éü漢😀▁ \x00<s>/"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)]
    want = vocab.model.encode(texts)
    assert token_counts.counter(PIECE).counts(pa.array(texts)).tolist() == [len(w) for w in want]
    plain = [t.replace("▁", "") for t in texts]
    ids, _ = pieces.encode(vocab, pa.array(plain), np.arange(len(plain)), pieces.Dropout(0, 1))
    assert ids.tolist() == [i for w in vocab.model.encode(plain) for i in w]
