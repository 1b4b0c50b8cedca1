"""Near copies by the Jaccard similarity of whole texts: the byte index of SimHash fingerprints, a
complete prefix join beside it, exact verification and components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm import simhash
from barloom.llm.components import components
from barloom.llm.tables import Members, discard, in_batches, saved, text_key, without
from barloom.llm.texts import Rolling, Words, lowered, slices

#: Words of a shingle.
SHINGLE = 5
#: Least similarity of linked texts, as a fraction of whole numbers.
LEAST = (4, 5)
#: Longs of a sketch: the parity of how many shingles fall on each of its bits. Two sketches
#: differ in no more bits than the sets in shingles.
SKETCH = 16
#: Two linked fingerprints with more pairs of sets than this leave those to the prefix join.
PAIRS = simhash.POSTING**2


def shared_at_least(n, least: tuple[int, int] = LEAST):
    """How many of its ``n`` shingles a text shares with any text that is similar to it."""
    return -(-n * least[0] // least[1])


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Hashes of the different shingles of each text, ascending, ASCII letters lowered. A
    text of fewer words gives its whole sequence, one without words nothing."""
    words = Words(texts, lowered)
    counts = words.counts
    rolling = Rolling(words.hashes)
    n = np.where(counts > 0, np.maximum(1, counts - size + 1), 0)
    bounds = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(words.bounds[:-1] - bounds[:-1], n) + np.arange(bounds[-1])
    hashes = rolling.of(first, np.minimum(size, np.repeat(counts, n)))
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def digest(shingles: np.ndarray) -> int:
    """Names a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64))


def sketch(shingles: np.ndarray) -> np.ndarray:
    odd = np.bincount((shingles >> np.uint64(54)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def _starts(size: int, least: tuple[int, int]):
    """For ``mapInArrow``: the set of every text and its least hashes, of which similar texts
    share ``need`` or more.

    Texts that share s of their shingles share k of them among the first n - s + k in any
    one order. Here k is a tenth of n; the shorter of two similar texts has the smaller k.
    """

    def run(batches):
        for whole in batches:
            for part in slices(whole):
                sets = shingle_sets(part.column("text"), size)
                n = np.array([len(s) for s in sets], np.int64)
                must = shared_at_least(n, least)
                start = [s[: len(s) - m + max(1, len(s) // 10)] for s, m in zip(sets, must.tolist())]
                columns = [
                    part.column("doc_id"), part.column("key"), pa.array([digest(s) for s in sets], pa.int64()),
                    pa.array(n), pa.array(np.maximum(1, must // 10)), _lists(start),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "id", "n", "need", "start"])

    return run


def _wholes(size: int):
    """For ``mapInArrow``: all shingles of every text, and their sketch."""

    def run(batches):
        for whole in batches:
            for part in slices(whole):
                sets = shingle_sets(part.column("text"), size)
                columns = [
                    pa.array([digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    _lists(sets), _lists([sketch(s).view(np.uint64) for s in sets]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "shingles", "sketch"])

    return run


def _may_link(a: str, b: str, least: tuple[int, int]) -> Column:
    """Neither the sizes nor the sketches of two sets rule similarity out."""
    p, q = least
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum(F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SKETCH))
    # of n + m shingles, similar sets have (q - p) / (q + p) on one side only, or fewer
    return (F.least(n, m) * q >= F.greatest(n, m) * p) & (apart * (q + p) <= (n + m) * (q - p))


def _verified(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) whose sets have the least similarity."""
    p, q = least
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(both * q >= (F.size("x") + F.size("y") - both) * p).select("a", "b")


def _candidates(docs: DataFrame, starts: DataFrame, size: int, met: DataFrame) -> DataFrame:
    """(id, n, shingles, sketch) of every set that may be similar to another, by its start or as
    one of the pairs ``met`` in the index of fingerprints."""
    heads = starts.select("id", "n", "need", F.explode("start").alias("t"), F.size("start").alias("size"))
    twice = saved(heads.groupBy("t").agg(F.count("*").alias("c")).where("c > 1").select("t"), "similar-twice")
    marked = Members(twice, F.xxhash64("t")).mark(heads, F.xxhash64("t"), "maybe")
    # rows of the same set count alike, so their mean is that of the set
    some = marked.groupBy("id").agg(
        F.sum(F.col("maybe").cast("long")).alias("hits"), F.count("*").alias("rows"), F.first("size").alias("size"), F.first("need").alias("need")
    ).where("hits * size >= need * rows")
    some = some.select("id").union(met.select("a")).union(met.select("b")).distinct()
    some = saved(some, "similar-some")
    discard(twice)
    keys = saved(starts.join(some, "id").groupBy("id").agg(F.min("key").alias("key")), "similar-keys")
    rows = docs.select(text_key().alias("key"), docs["text"].cast("string").alias("text"))
    rows = Members(keys, F.xxhash64("key")).mark(rows, F.xxhash64("key"), "maybe").where("maybe").select("text")
    wholes = in_batches(rows).mapInArrow(_wholes(size), "id long, n long, shingles array<long>, sketch array<long>")
    wholes = saved(wholes, "similar-wholes")
    once = wholes.join(some, "id").groupBy("id").agg(*(F.first(c).alias(c) for c in ("n", "shingles", "sketch")))
    out = saved(once, "similar-sets")
    discard(wholes)
    return out


def _postings(sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(t, id, n, usual, s0, ...): every set under the rarest of its shingles.

    In the order of their frequency, then of their hashes, sets that share s shingles of n
    share one of the first n - s + 1. Those that no other set has stand first and lead nowhere.
    ``usual`` is the mean frequency of the shingles of a set, largest in the midst of a group.
    """
    p, q = least
    each = sets.select("id", F.explode("shingles").alias("t"))
    often = saved(each.groupBy("t").agg(F.count("*").alias("c")).where("c > 1"), "similar-often")
    first = (
        each.join(often, "t").groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("seen"), F.sum("c").alias("sum"))
        .join(sets.select("id", "n", "sketch"), "id")
        .withColumn("room", F.col("n") - F.expr(f"(n * {p} + {q - 1}) div {q}") + 1 - (F.col("n") - F.size("seen")))
        .where("room > 0")
    )
    posted = first.select(
        F.explode(F.expr("slice(seen, 1, int(room)).t")).alias("t"), "id", "n", (F.col("sum") / F.col("n")).alias("usual"),
        *(F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)),
    )
    posted = saved(posted, "similar-posted")
    discard(often)
    return posted


def fingerprint_links(docs: DataFrame, rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(id, fp): the SimHash fingerprints of all sets, and (a, b): those that lie within the radius of
    operator 6, found in its index of positional bytes. ``rows`` (doc_id, key, id) names the set
    of each text; texts of one set may repeat its shingles otherwise and have several."""
    held = rows.select("key", "id").distinct()
    prints = simhash.fingerprints(docs, size).select("key", "fp").distinct().join(held, "key")
    prints = saved(prints.select("id", "fp").distinct(), "similar-prints")
    fps = saved(prints.select("fp").distinct(), "similar-fps")
    spent = [fps]
    near = saved(simhash.links(fps, spent), "similar-near")
    for table in spent:
        discard(table)
    return prints, near


def fingerprint_pairs(prints: DataFrame, near: DataFrame) -> DataFrame:
    """(a, b): sets with one fingerprint meet the least of them, which also meets those of linked
    fingerprints. Every set that shares a fingerprint or has a linked one is in a pair."""
    least = prints.groupBy("fp").agg(F.min("id").alias("first"))
    x, y = (least.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_id")) for c in "ab")
    across = near.join(x, "a").join(y, "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    same = prints.join(least, "fp").select(F.col("first").alias("a"), F.col("id").alias("b"))
    return saved(across.union(same).where("a <> b").distinct(), "similar-met")


def _apart(prints: DataFrame, near: DataFrame, placed: DataFrame, least: tuple[int, int], spent: list) -> DataFrame:
    """(a, b): sets with one fingerprint or linked ones that no known component connects.
    ``placed`` (id, n, s0, ..., root) are the sets and their components. Fingerprints with over PAIRS
    pairs leave them to the prefix join, which is complete. What it writes is added to ``spent``."""
    held = saved(prints.join(placed, "id"), "similar-held")
    spans = held.groupBy("fp").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    spans = saved(spans, "similar-spans")
    spent += [held, spans]
    x, y = (spans.select(*(F.col(c).alias(f"{c}_{side}") for c in spans.columns)) for side in "xy")
    ways = near.union(spans.where("lo < hi").select("fp", "fp")).toDF("fp_x", "fp_y").join(x, "fp_x").join(y, "fp_y")
    ways = ways.where(f"c_x * c_y <= {PAIRS} and least(lo_x, lo_y) < greatest(hi_x, hi_y)").select("fp_x", "fp_y")
    a, b = held.alias("a"), held.alias("b")
    met = ways.join(a, F.col("fp_x") == F.col("a.fp")).join(
        b, (F.col("fp_y") == F.col("b.fp")) & (F.col("a.root") != F.col("b.root")) & _may_link("a", "b", least)
    )
    return met.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))


def links(
    sets: DataFrame, least: tuple[int, int] = LEAST, met: DataFrame | None = None, index: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """(a, b): pairs of similar sets that connect all sets which similar pairs connect. Pairs ``met``
    before, as in the index of fingerprints, are verified with the first ones; the other pairs of that
    ``index`` (``fingerprint_links``) with the second ones.

    Under every shingle all sets are first compared with the most usual of them, which costs
    a row for each. Then those that are not connected yet are compared with each other; sizes
    and sketches rule most out as they meet, the rest is verified shingle by shingle. A pair within
    a component already known is never made, so a large group of near copies costs no square.
    """
    posted = _postings(sets, least)
    own = ["id", "n", *(f"s{i}" for i in range(SKETCH))]
    leaders = (
        posted.groupBy("t").agg(F.max_by(F.struct(*own), F.struct("usual", "id")).alias("m"), F.count("*").alias("c"))
        .where("c > 1").select("t", "m.*")
    )
    leaders = saved(leaders, "similar-leaders")
    a, b = posted.alias("a"), leaders.alias("b")
    near = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.id") != F.col("b.id")) & _may_link("a", "b", least))
    pairs = near.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    pairs = (pairs if met is None else pairs.union(met.select("a", "b"))).distinct()
    first = saved(_verified(pairs, sets, least), "similar-links")
    linked = components(first)
    root = F.coalesce("root", "id").alias("root")
    placed = saved(posted.join(linked, posted["id"] == linked["node"], "left").select("t", *own, root), "similar-placed")
    open_ = placed.groupBy("t").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("t")
    open_ = saved(placed.join(open_, "t"), "similar-open")
    spent = [posted, leaders, placed, open_]
    a, b = open_.alias("a"), open_.alias("b")
    across = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.root") < F.col("b.root")) & _may_link("a", "b", least))
    pairs = across.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    if index is not None:
        flat = sets.select("id", "n", *(F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)))
        flat = flat.join(linked, flat["id"] == linked["node"], "left").select(*own, root)
        pairs = pairs.union(_apart(*index, flat, least, spent))
    second = saved(_verified(pairs.distinct(), sets, least), "similar-links")
    for table in spent:
        discard(table)
    return first.union(second)


def similar(docs: DataFrame, size: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """(doc_id, component_id, key, kept) of every row.

    Texts are linked if the Jaccard similarity of their sets of shingles, as 64-bit hashes, is
    ``least`` or more; no such pair is missed. The fingerprints of all texts meet in the index of operator
    6; it finds the nearest texts only, so the prefix join finds the others. Rows with the same set are folded before any
    pair is made; texts without words share the empty one. The component of a row is the
    smallest doc_id that links reach; a null doc_id names none unless it has no other. ``kept`` is
    that row, of several with this id those of one wording; rows that are alike count as one.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    starts = in_batches(rows.withColumn("key", text_key())).mapInArrow(
        _starts(size, least), "doc_id long, key long, id long, n long, need long, start array<long>"
    )
    starts = saved(starts, "similar-starts")
    rows = saved(starts.select("doc_id", "key", "id"), "similar-rows")
    index = fingerprint_links(docs, rows, size)
    met = fingerprint_pairs(*index)
    sets = _candidates(docs, starts, size, met)
    discard(starts)
    stays = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("stays")
    ids = saved(rows.groupBy("id").agg(stays), "similar-ids")
    linked = components(links(sets, least, met, index))
    for table in (sets, met, *index):
        discard(table)
    rooted = ids.join(linked, ids["id"] == linked["node"], "left").select("id", "stays", F.coalesce("root", "id").alias("root"))
    rooted = saved(rooted, "similar-rooted")
    roots = rooted.groupBy("root").agg(F.min("stays").alias("stays"))
    named = saved(rooted.select("id", "root").join(roots, "root").select(F.col("id").alias("own"), "stays"), "similar-named")
    kept = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("key") == F.col("stays.key"))
    return rows.join(named, rows["id"] == named["own"]).select("doc_id", F.col("stays.doc_id").alias("component_id"), "key", kept.alias("kept"))


def drop_similar(docs: DataFrame, size: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """``docs`` with one row of every component, that of the smallest doc_id, all columns as they
    are. Of repeated rows one stays, likewise of rows that share that id or all lack one."""
    verdict = saved(similar(docs, size, least).select("doc_id", "key", "kept"), "similar-verdict")
    repeated = verdict.where("kept").groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1")
    return without(docs, verdict.where("not kept"), repeated)
