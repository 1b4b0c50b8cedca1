"""SimHash near-duplicates: fingerprints, an index of positional bytes, linked components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.components import components
from barloom.llm.tables import discard, in_batches, saved, text_key, without
from barloom.llm.texts import Words, lowered, slices

BYTES = 8
#: Largest Hamming distance of linked fingerprints, and hence the least number of the eight
#: bytes that linked fingerprints share in place.
RADIUS = 3
MIN_SHARED = BYTES - RADIUS
#: Postings: fours of byte positions whose numbers cancel under exclusive or. These 14 fours
#: hold every three positions once, and the complement of each is one of them, so any five
#: positions contain at least one: a pair with MIN_SHARED bytes in place meets in a posting.
BLOCKS = [c for c in combinations(range(BYTES), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
#: A posting with more fingerprints than this is split by one more byte, then by bits.
POSTING = 64


def majority(hashes: np.ndarray, bounds: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """Per text, the bits that more than half of its hashes set; zero without hashes."""
    n = len(bounds) - 1
    counts = np.diff(bounds)
    ones = np.zeros((n, 64), np.int64)
    text_of = np.repeat(np.arange(n), counts)
    for at in range(0, len(hashes), block):
        part, of = hashes[at : at + block], text_of[at : at + block]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        ones[of[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    set_ = 2 * ones > counts[:, None]
    return np.packbits(set_, axis=1).view(">u8").ravel().astype(np.uint64)


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 with seed 42 of the space-joined shingles of every text, repeats included. A
    text of fewer words gives its whole sequence, one without words nothing."""
    array = words.array
    at = np.frombuffer(array.buffers()[1], np.int64)[: len(array) + 1]
    raw = words.data[words.ink]
    joined = np.insert(raw, at[1:], 32).tobytes()
    starts = at[:-1] + np.arange(len(array))
    ends = at[1:] + np.arange(len(array))
    counts = words.counts
    n = np.where(counts > 0, np.maximum(1, counts - size + 1), 0)
    bounds = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(words.bounds[:-1] - bounds[:-1], n) + np.arange(bounds[-1])
    last = np.minimum(first + size, np.repeat(words.bounds[1:], n)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], 42) for a, b in zip(starts[first].tolist(), ends[last].tolist())), np.uint64, len(first)
    )
    return hashes, bounds


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, key, fp): 64-bit SimHash of every whole text over shingles of ``words`` words,
    ASCII letters lowered. A null text counts as empty; texts without words have 0.
    ``key`` is a hash of the text."""

    def run(batches):
        for whole in batches:
            for part in slices(whole):
                hashes, bounds = shingle_hashes(Words(part.column("text"), lowered), words)
                fp = majority(hashes, bounds).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(fp)], ["doc_id", "key", "fp"]
                )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return in_batches(rows.withColumn("key", text_key())).mapInArrow(run, "doc_id long, key long, fp long")


def _mask(positions) -> int:
    m = sum(0xFF << 8 * p for p in positions)
    return m - (1 << 64) if m >= 1 << 63 else m


def _signed(m: int) -> int:
    return m - (1 << 64) if m >= 1 << 63 else m


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the eight bytes two fingerprints share in place."""
    x = a.bitwiseXOR(b)
    return sum((x.bitwiseAND(F.lit(_mask([p]))) == 0).cast("int") for p in range(BYTES))


def _postings(fps: DataFrame, masks: list[int]) -> DataFrame:
    return fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask")).select(
        "fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key")
    )


def _finer(level: int) -> list[tuple[int, list[int]]]:
    """(mask, finer masks) of the postings of a level. A pair that shares the four bytes of
    a posting shares one more of the other four; one that shares five bytes differs in at
    most RADIUS bits of the 24 others, hence agrees in one of four groups of six."""
    fives = sorted({tuple(sorted((*b, p))) for b in BLOCKS for p in range(BYTES) if p not in b})
    full = lambda ps: sum(0xFF << 8 * p for p in ps)
    if level == 1:
        return [(full(b), [full((*b, p)) for p in range(BYTES) if p not in b]) for b in BLOCKS]
    out = []
    for five in fives:
        bits = [8 * p + i for p in range(BYTES) if p not in five for i in range(8)]
        out.append((full(five), [full(five) | sum(1 << i for i in bits[k : k + 6]) for k in range(0, 24, 6)]))
    return out


def _split(posted: DataFrame, level: int, spent: list) -> tuple[DataFrame, DataFrame]:
    """Postings as they are, and in finer ones what stands in overfull ones. What it writes is
    added to ``spent``."""
    sizes = saved(posted.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"), "postings")
    spent.append(sizes)
    met = posted.join(sizes, ["mask", "key"])
    small = met.where(F.col("n") <= POSTING).select("fp", "mask", "key")
    pairs = [F.struct(F.lit(_signed(m)).alias("m"), F.array(*[F.lit(_signed(f)) for f in fs]).alias("fs")) for m, fs in _finer(level)]
    finer = F.map_from_entries(F.array(*pairs))
    large = (
        met.where(F.col("n") > POSTING)
        .select("fp", F.explode(F.element_at(finer, F.col("mask"))).alias("mask"))
        .select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        .distinct()
    )
    return small, large


def links(fps: DataFrame, spent: list | None = None) -> DataFrame:
    """(a, b), a < b: all pairs of different fingerprints at RADIUS or fewer differing bits.

    Every fingerprint is posted under the 14 fours of positional bytes. Two that meet are
    tallied for shared positional bytes, kept from MIN_SHARED on, and verified on their
    bits. A posting of four bytes is one of 2**32, so the index stays sparse where single
    bytes (2048 postings) would let a share of all pairs meet. Overfull postings, as of large
    groups of near copies, are split twice by what a linked pair must also share, which
    loses no pair and leaves few fingerprints that agree in 46 bits. The table that the result
    is read from is added to ``spent``.
    """
    own: list = []
    posted = _postings(fps.select("fp"), [sum(0xFF << 8 * p for p in b) for b in BLOCKS])
    small, large = _split(posted, 1, own)
    finer = saved(large, "posted-finer")
    small2, finest = _split(finer, 2, own)
    index = small.union(small2).union(finest)
    index = saved(index, "index")
    for table in (*own, finer):
        discard(table)
    if spent is not None:
        spent.append(index)
    a, b = index.alias("a"), index.alias("b")
    x, y = F.col("a.fp"), F.col("b.fp")
    met = a.join(
        b,
        (F.col("a.mask") == F.col("b.mask")) & (F.col("a.key") == F.col("b.key")) & (x < y)
        & (shared_bytes(x, y) >= MIN_SHARED) & (F.bit_count(x.bitwiseXOR(y)) <= RADIUS),
    )
    return met.select(x.alias("a"), y.alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, key) of every row.

    Rows with the same fingerprint are folded before any pair is made; the component of a
    row is the smallest doc_id that links reach, its own included. A null text counts as
    empty and shares fingerprint zero with all texts without words. Null doc_ids never name a
    component unless it has no other. Repeated rows stay; an empty table gives no rows.
    """
    rows = saved(fingerprints(docs, words), "fingerprints")
    fps = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    spent = [fps]
    linked = components(links(fps, spent))
    rooted = fps.join(linked, fps["fp"] == linked["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("is_linked")
    )
    roots = rooted.where("is_linked").groupBy("root").agg(F.min("least").alias("component"))
    named = saved(
        rooted.join(roots, "root", "left").select(
            F.col("fp").alias("own"), F.coalesce("component", "least").alias("component_id")
        ),
        "named",
    )
    for table in spent:
        discard(table)
    return rows.join(named, rows["fp"] == named["own"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "key"
    )


def drop_near_copies(docs: DataFrame, words: int = 3) -> DataFrame:
    """``docs`` with the smallest doc_id of every component, all columns as they are. Rows
    that share that id stay; rows without an id stay if their whole component has none."""
    found = near_duplicates(docs, words)
    return without(docs, found.where("not doc_id <=> component_id"))
