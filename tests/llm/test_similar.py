"""Near copies of the pipeline beside brute-force Jaccard."""

import random
from itertools import combinations

from pyspark.sql import functions as F

import corpus_pipeline as cp
from barloom.llm import simhash, similar
from barloom.llm.tables import saved

STAGE = dict(cp.STAGES)
BLANK = " \t\n\x0b\x0c\r"


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.translate(dict.fromkeys(map(ord, BLANK), " ")).split(" ")
    words = [w for w in words if w]
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def kept(rows):
    """Smallest ids of the components of all pairs with a similarity of 0.8 or more."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    for i, j in combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        both = len(a & b)
        if 5 * both >= 4 * (len(a) + len(b) - both):
            x, y = root[i], root[j]
            if x != y:
                root = {k: min(x, y) if r in (x, y) else r for k, r in root.items()}
    return {i for i, r in root.items() if i == r}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


def made(seed):
    """Copies around a base, chains of edits, a passage in many texts, short texts."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts, base, line = [], fresh(150), fresh(30)
    texts += [edited(rng, base, rng.randrange(8)) for _ in range(60)]
    chain = fresh(120)
    for _ in range(15):
        chain = edited(rng, chain, 2)
        texts.append(chain)
    texts += [fresh(rng.randrange(5, 60)) + line for _ in range(40)]
    tail = fresh(60)
    texts += [tail[:n] for n in (*range(1, 12), 40, 44, 45, 46, 50, 54, 55, 56, 60)]
    rng.shuffle(texts)
    return [(i, rng.choice([" ", "\t"]).join(w).upper() if i % 7 == 0 else " ".join(w)) for i, w in enumerate(texts)] + [(9001, None), (9002, " ")]


def test_stage_meets_brute_force(spark):
    for seed in (1, 2):
        rows = made(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = [r.doc_id for r in STAGE["near dedup"](spark, df, "").collect()]
        want = kept(rows)
        assert sorted(got) == sorted(want) and 20 < len(want) < len(rows) - 40


def test_stage_on_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = STAGE["near dedup"](spark, docs, "")
    assert got.columns == docs.columns
    want = kept([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in got.collect()} == want and not want & {145, 177}


def test_links_of_a_large_group_stay_few(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(edited(rng, base, 2))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = spark.createDataFrame(
        [(i, len(s), s.view("int64").tolist(), similar.sketch(s).tolist()) for i, s in enumerate(_sets(rows))],
        "id long, n long, shingles array<long>, sketch array<long>",
    )
    assert similar.links(sets).count() < 20 * len(rows)
    assert [r.doc_id for r in similar.drop_similar(docs).collect()] == [0]


def _sets(rows):
    import pyarrow as pa

    return similar.shingle_sets(pa.array([t for _, t in rows]))


def test_stage_links_through_the_byte_index(spark, monkeypatch):
    """Without the prefix join the stage still folds similar texts with near fingerprints."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(1500)]
    rows = [(i, " ".join(base if i == 0 else edited(rng, base, 1))) for i in range(6)] + [(9, "some other words that stand alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fps = [r.fp for r in simhash.fingerprints(docs, 5).orderBy("doc_id").collect()]
    near = [i for i in range(1, 6) if ((fps[0] ^ fps[i]) & (2**64 - 1)).bit_count() <= simhash.RADIUS]
    assert near and kept(rows) == {0, 9}
    monkeypatch.setattr(similar, "_may_link", lambda *_: F.lit(False))
    got = {r.doc_id for r in STAGE["near dedup"](spark, docs, "").collect()}
    assert {0, 9} <= got and not got & set(near)


def test_stage_leaves_one_row_of_groups_that_share_or_lack_an_id(spark):
    rng = random.Random(8)
    base, lone, other = ([f"{c}{i}" for i in range(100)] for c in "abc")
    text = lambda words, n: " ".join(edited(rng, words, n))
    twice = text(other, 1)
    rows = [(5, text(base, k)) for k in (0, 1, 1)] + [(None, text(base, 1)), (8, text(base, 1)), (8, "some other words that stand alone")]
    rows += [(None, text(lone, k)) for k in (0, 1, 1)] + [(7, twice), (7, twice), (9, text(other, 0))]
    got = [(r.doc_id, r.text[0]) for r in STAGE["near dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert sorted(got, key=str) == sorted([(5, "a"), (8, "s"), (None, "b"), (7, "c")], key=str)


def spam(tails):
    """Texts whose fingerprint is that of one repeated shingle, whatever follows."""
    return [(i, " ".join(["spam"] * 400 + tail)) for i, tail in enumerate(tails)]


def test_index_takes_every_text_and_all_its_links(spark, monkeypatch):
    """With a prefix join that finds nothing, all similar texts with linked fingerprints are folded."""
    rng = random.Random(9)
    tails = [[f"w{rng.randrange(10**9)}" for _ in range(60)] for _ in range(9)]
    rows = spam([*tails, [*tails[0][:-1], "end"], [*tails[1][:-1], "end"], [*tails[1][:-2], "the", "end"]])
    names = [similar.digest(s) for s in _sets(rows)]
    assert {0, 9, 1, 10, 11}.isdisjoint({names.index(min(names))}) and kept(rows) == set(range(9))
    starts, postings = similar._starts, similar._postings

    def shut(size, least):
        run = starts(size, least)

        def emptied(batches):
            import pyarrow as pa

            for batch in run(batches):
                none = pa.array([[]] * batch.num_rows, pa.list_(pa.int64()))
                yield batch.set_column(batch.schema.get_field_index("start"), "start", none)

        return emptied

    monkeypatch.setattr(similar, "_starts", shut)
    monkeypatch.setattr(similar, "_postings", lambda *a: saved(postings(*a).where("false"), "posted"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in STAGE["near dedup"](spark, docs, "").collect()} == set(range(9))


def test_links_beyond_a_full_fingerprint_meet_in_the_prefix_join(spark, monkeypatch):
    monkeypatch.setattr(similar, "PAIRS", 4)
    rng = random.Random(10)
    tails = [[f"w{rng.randrange(10**9)}" for _ in range(60)] for _ in range(12)]
    rows = spam([*tails, *([*t[:-1], "end"] for t in tails)])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in STAGE["near dedup"](spark, docs, "").collect()} == kept(rows) == set(range(12))
