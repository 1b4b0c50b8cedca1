"""Slow twins of vectorised cores, and texts far longer than a slice."""

import math
import resource
import struct
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from barloom.llm import boosting, language, pieces, sharding, warc
from barloom.llm.queries import tokenizer_file

PIECE = tokenizer_file("piece_bpe_32k.model")
M64 = (1 << 64) - 1
TEXTS = ["unbelievable internationalisation", "  two  spaces and   three", "naïve façade 漢字かな 😀 x\ty", "a", "hello hello hello helloworld", "1234567890 10.5%"]


def mix(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & M64
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & M64
    return x ^ x >> 33


def slow_agenda(model, text, key, share, seed):
    """Merge the best pair of the whole text that is not skipped, until there is none."""
    chars = list(("▁" + text).replace(" ", "▁"))
    known = lambda s: model.piece_to_id(s) if model.id_to_piece(model.piece_to_id(s)) == s and not model.is_control(model.piece_to_id(s)) else -1
    own = mix(key ^ mix(seed))
    sym = [(i, c, known(c)) for i, c in enumerate(chars)]
    while True:
        best = None
        for k in range(len(sym) - 1):
            (place, a, left), (_, b, right) = sym[k], sym[k + 1]
            to = known(a + b)
            if left < 0 or right < 0 or to < 0:
                continue
            drawn = mix(own ^ mix((left << 32 | right) ^ (place * pieces.Rolling.BASE & M64)))
            if drawn < min(int(share * 2.0**64), M64):
                continue
            if best is None or model.get_score(to) > best[0]:
                best = model.get_score(to), k, a + b, to
        if best is None:
            break
        _, k, s, to = best
        sym[k : k + 2] = [(sym[k][0], s, to)]
    out = []
    for _, s, i in sym:
        out += [i] if i >= 0 else [model.piece_to_id(f"<0x{x:02X}>") for x in s.encode()]
    return out


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 0.9])
def test_dropout_equals_a_slow_agenda(share):
    vocab = pieces.vocabulary(PIECE)
    keys = np.arange(len(TEXTS)) * 977 + 3
    ids, counts = pieces.encode(vocab, pa.array(TEXTS), keys, pieces.Dropout(share, 11))
    at = np.concatenate([[0], np.cumsum(counts)])
    for k, text in enumerate(TEXTS):
        assert ids[at[k] : at[k + 1]].tolist() == slow_agenda(vocab.model, text, int(keys[k]), share, 11), (text, share)


def test_long_texts_are_encoded_in_parts(monkeypatch):
    vocab = pieces.vocabulary(PIECE)
    text = " ".join(TEXTS * 20) + "   " + "x" * 3000 + "    end  "
    for share in (0, 0.3):
        drop = pieces.Dropout(share, 5)
        whole = pieces.encode(vocab, pa.array([text]), np.array([9]), drop)
        for limit in (1, 13, 400):
            monkeypatch.setattr(pieces, "PART_CHARS", limit)
            got = pieces.encode(vocab, pa.array([text]), np.array([9]), drop)
            assert got[0].tolist() == whole[0].tolist() and got[1].tolist() == whole[1].tolist()
        monkeypatch.undo()
    assert pieces.spans("a" * 9, 2) == [(0, 9)] and pieces.spans("aa  bb cc", 2) == [(0, 2), (2, 6), (6, 9)]


def test_long_texts_are_profiled_in_parts(monkeypatch):
    text = pa.array(["Ein  kurzer Text, 12 mal — über ǅ Äpfel\n" * 50 + "x" * 700])
    whole = [a.tolist() for a in language.counted(text)]
    for limit in (1, 7, 300):
        monkeypatch.setattr(language, "SLICE", limit)
        assert [a.tolist() for a in language.counted(text)] == whole
    monkeypatch.undo()


CODE = {
    "op1": "from barloom.llm import pieces; d = pieces.dropout_batches({path!r}, 0.1, 1, True); sum(r.num_rows for r in d([batch]))",
    "op7": "from barloom.llm import language; p = language.Profiles.of({{'en': [101, 102]}}, 300); p.predict(batch.column('text'))",
}


@pytest.mark.parametrize("name", CODE)
def test_fifty_megabytes_stay_under_a_gigabyte(name):
    program = f"""
import resource, pyarrow as pa
words = " ".join(f"word{{i % 5003}} und{{i % 31}}" for i in range(100_000))
text = (words + " ") * (50_000_000 // (len(words) + 1))
batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([text])], ["doc_id", "text"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
{CODE[name].format(path=PIECE)}
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""
    out = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, timeout=300, check=True)
    assert int(out.stdout.split()[-1]) < 1000
    assert resource.RUSAGE_SELF == 0


def test_shards_equal_a_plain_draw(spark):
    keys = [0, 1, -5, 2**40, None, 77, 123456789]
    weights = [1.0, 2.5, 0.5, 3.0]

    def drawn(key, shard):
        seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", shard), seed)
        return ((h >> 11) + 0.5) / (1 << 53)

    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.rendezvous(F.col("k"), weights).alias("s"))
    for k, s in df.collect():
        assert s == min(range(4), key=lambda i: -math.log(drawn(k, i)) / weights[i])


def test_forest_equals_a_walk_of_its_trees():
    rng = np.random.default_rng(8)
    x = rng.random((1500, 4))
    forest = boosting.fit(x, (x[:, 0] + x[:, 2] * x[:, 3] > 0.8).astype(float), np.array([1, 0, 0, 1]))
    probe = np.vstack([rng.random((60, 4)) * 2 - 0.5, np.full((1, 4), np.nan)])

    def walk(row):
        raw = forest.base
        for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (1 if row[feature[node]] <= threshold[node] else 2)
            raw += value[node - len(feature)]
        return 1 / (1 + math.exp(-raw))

    assert np.allclose(forest.score(probe), [walk(r) for r in probe], rtol=1e-12)


def test_an_index_that_leads_elsewhere_fails(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://{i}", "x" * i) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    folder, index = warc.write_archive(pages, f"file://{tmp_path}/w")
    assert warc.read_archive(folder, index).count() == 20
    other = index.where("page_id = 3").first()
    swapped = index.withColumn("offset", F.when(F.col("page_id") == 4, other.offset).otherwise(F.col("offset"))).withColumn(
        "length", F.when(F.col("page_id") == 4, other.length).otherwise(F.col("length"))
    )
    with pytest.raises(Exception, match="does not lead to"):
        warc.read_archive(folder, swapped).collect()
