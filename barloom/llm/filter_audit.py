"""What each of five filters does to a corpus, alone and together with the others.

Every document gets a mask of the filters it fails. The counts of the 32 masks, per part of the
corpus, tell what any coalition of filters removes. Shapley values are the solution of
the least squares problem that weighs coalitions by the Shapley kernel, under the constraint that the
values add up to what all filters remove; it is solved once, in rationals. What a
filter removes at a step of an order is a difference of two coalitions.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.tables import discard, in_batches, saved
from barloom.llm.texts import _BLANK, SLICE_BYTES, Words, binary, chunks, flat, slices

#: Fixed values of the filters.
FILTERS = "ABCDE"
LEAST_WORDS = 50
DISTINCT_PERCENT = 65
UPPER_PERCENT = 5
MARKS = b"#$%&*|"

_MARK = np.zeros(256, bool)
_MARK[list(MARKS)] = True
#: Parts of a corpus whose reports are made in one go.
PARTS_AT_ONCE = 100


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[at])


def _counts(texts: pa.Array) -> np.ndarray:
    """Words, distinct words, capitals A to Z, code points and marks of each text, in rows."""
    data, at = flat(texts)
    n_texts = len(at) - 1
    if n_texts != 1 or len(data) <= SLICE_BYTES:
        words = Words(texts)
        codes, spelled = words.coded
        pairs = np.unique(words.text_of * (len(spelled) + 1) + codes)
        distinct = np.bincount(pairs // (len(spelled) + 1), minlength=n_texts)
        upper, points = (data >= 65) & (data <= 90), (data & 0xC0) != 0x80
        return np.stack([words.counts, distinct, _sums(upper, at), _sums(points, at), _sums(_MARK[data], at)])
    total, seen = np.zeros(5, np.int64), []
    for a, b in chunks(data, ~_BLANK):
        part = binary(np.array([0, b - a]), data[a:b])
        total += _counts(part)[:, 0] if b - a <= SLICE_BYTES else _long_word(data[a:b])
        seen.append(Words(part).coded[1])
    total[1] = len(pc.unique(pa.chunked_array(seen)))
    return total[:, None]


def _long_word(data: np.ndarray) -> np.ndarray:
    """The counts of a part that is a word longer than a slice, with blanks around it."""
    return np.array([1, 1, ((data >= 65) & (data <= 90)).sum(), ((data & 0xC0) != 0x80).sum(), _MARK[data].sum()])


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask) of every row: bits 0 to 3 of ``mask`` are filters A to D,
    ``digest`` is that of the whole text. Null texts count as empty, null sources as ''."""

    def run(batches):
        for whole in batches:
            for part in slices(whole):
                raw = pc.fill_null(part.column("text").cast(pa.large_binary()), b"")
                digests = [hashlib.sha256(t.as_buffer()).digest() for t in raw]
                words, distinct, upper, points, marks = _counts(part.column("text"))
                fails = [
                    words < LEAST_WORDS,
                    100 * distinct < DISTINCT_PERCENT * words,
                    100 * upper > UPPER_PERCENT * points,
                    marks > 0,
                ]
                mask = sum(f.astype(np.int32) << i for i, f in enumerate(fails))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("part"), pa.array(digests, pa.binary()), pa.array(mask, pa.int32())],
                    ["doc_id", "part", "digest", "mask"],
                )

    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"),
        docs["text"].cast("string").alias("text"),
    )
    return in_batches(rows).mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def with_copies(rows: DataFrame) -> DataFrame:
    """Rows of ``failures`` folded to (doc_id, part, mask, n), with bit 4 of the mask for filter E.

    A row fails E unless its doc_id is the smallest of its text. That row is found by an equi-join on
    (digest, doc_id), so a text that a third of all rows repeat still spreads over all tasks;
    the smallest ids come from a map-side minimum. A null doc_id is neither smaller nor larger, so it
    never fails E.
    """
    known, unknown = F.col("doc_id").isNotNull(), F.col("doc_id").isNull()
    folded = saved(rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")), "audit-rows")
    first = folded.where(known).groupBy("digest").agg(F.min("doc_id").alias("_first")).withColumnRenamed("digest", "_digest")
    joined = folded.where(known).join(first, (F.col("digest") == F.col("_digest")) & (F.col("doc_id") == F.col("_first")), "left")
    late = joined.select("doc_id", "part", (F.col("mask") + F.when(F.col("_first").isNull(), 16).otherwise(0)).alias("mask"), "n")
    return late.union(folded.where(unknown).select("doc_id", "part", "mask", "n"))


def tabulate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask of failed filters. A document
    with several labels is good or toxic if any of them says so; no label says neither."""
    rows = saved(failures(docs), "audit-failures")
    masked = saved(with_copies(rows), "audit-masks")
    told = labels.select(labels["doc_id"].cast("long").alias("_id"), labels["quality"].alias("_q"), labels["toxic"].alias("_t"))
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    told = told.where("_id is not null").groupBy("_id").agg(flag("_q").alias("_q"), flag("_t").alias("_t"))
    known = masked.where("doc_id is not null").join(told, F.col("doc_id") == F.col("_id"), "left")
    sums = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0)))
    columns = ["part", "mask", "n", "_q", "_t"]
    none = F.lit(None).cast("int")
    every = known.select(*columns).union(masked.where("doc_id is null").select("part", "mask", "n", none, none))
    table = every.groupBy("part", "mask").agg(F.sum("n").alias("n"), sums("_q").alias("good"), sums("_t").alias("toxic"))
    table = saved(table, "audit-table")
    for spent in (rows, masked):
        discard(spent)
    return table


def shapley_operator(players: int) -> np.ndarray:
    """Whole numbers X, players by coalitions, with X @ v = players! times the Shapley values of any game v
    that is nothing for the empty coalition.

    The values minimise the squares of v(S) less the sum over S, weighed by the Shapley kernel
    for every S but the empty and the full one, while adding up to v of all. The normal equations with
    the multiplier of that constraint have one matrix for all games; it is solved by elimination
    in rationals with a right-hand side for every coalition.
    """
    every = 1 << players
    weight = {s: Fraction(players - 1, comb(players, s) * s * (players - s)) for s in range(1, players)}
    has = [[s >> i & 1 for i in range(players)] for s in range(every)]
    size = players + 1
    system = [[Fraction(0)] * (size + every) for _ in range(size)]
    for s in range(1, every - 1):
        w = weight[sum(has[s])]
        for i in range(players):
            if has[s][i]:
                for j in range(players):
                    system[i][j] += w * has[s][j]
                system[i][size + s] += w
    for i in range(players):
        system[i][players] = system[players][i] = Fraction(1)
    system[players][size + every - 1] = Fraction(1)
    for c in range(size):
        pivot = next(r for r in range(c, size) if system[r][c])
        system[c], system[pivot] = system[pivot], system[c]
        system[c] = [x / system[c][c] for x in system[c]]
        for r in range(size):
            if r != c and system[r][c]:
                by = system[r][c]
                system[r] = [x - by * y for x, y in zip(system[r], system[c])]
    scaled = [[x * factorial(players) for x in row[size:]] for row in system[:players]]
    if any(x.denominator != 1 for row in scaled for x in row):
        raise ArithmeticError("the kernel does not give whole multiples")
    return np.array([[int(x) for x in row] for row in scaled], np.int64)


def _report(parts: list[str], counts: np.ndarray) -> pd.DataFrame:
    """The rows of all orders and steps for ``counts`` of (part, mask, kind)."""
    k = len(FILTERS)
    masks = np.arange(1 << k)
    meets = (masks[:, None] & masks[None, :]) != 0  # coalition, mask
    lost = np.einsum("cm,pmk->pck", meets.astype(np.int64), counts)
    total = counts[:, :, 0].sum(axis=1)
    shapley = lost[:, :, 0] @ shapley_operator(k).T
    orders = list(permutations(range(k)))
    own = np.array([i for o in orders for i in o])
    before = np.array([sum(1 << i for i in o[:s]) for o in orders for s in range(k)])
    after, alone, full = before | 1 << own, 1 << own, (1 << k) - 1
    gone = lost[:, after] - lost[:, before]
    n = len(parts)
    return pd.DataFrame(
        {
            "part": np.repeat(np.array(parts, object), len(own)),
            "filter_order": np.tile(np.repeat(["".join(FILTERS[i] for i in o) for o in orders], k), n),
            "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders) * n),
            "kept": (total[:, None] - lost[:, after, 0]).ravel(),
            "removed": gone[:, :, 0].ravel(),
            "redundant": (lost[:, alone, 0] - gone[:, :, 0]).ravel(),
            "unique_fails": (lost[:, full, 0][:, None] - lost[:, full ^ alone, 0]).ravel(),
            "good_lost": gone[:, :, 1].ravel(),
            "toxic_lost": gone[:, :, 2].ravel(),
            "shapley": shapley[:, own].ravel(),
        }
    )


def report(table: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step, from the counts of ``tabulate``.

    The masks of a part, 32 at most, become one row; parts are worked on wherever they lie.
    """
    size = 1 << len(FILTERS)

    def run(batches):
        for batch in batches:
            for first in range(0, len(batch), PARTS_AT_ONCE):
                some = batch.iloc[first : first + PARTS_AT_ONCE]
                counts = np.zeros((len(some), size, 3), np.int64)
                for i, cells in enumerate(some["cells"]):
                    for c in cells:
                        counts[i, c["mask"]] = c["n"], c["good"], c["toxic"]
                yield _report(some["part"].tolist(), counts)

    cells = F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")
    counts = "kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return table.groupBy("part").agg(cells).mapInPandas(run, f"part string, filter_order string, step int, {counts}")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley) for every source, all 120 orders of the five filters and their steps.

    Counts are of documents of the part: left after the step, removed by it, failing its filter but
    removed before, failing its filter alone, removed with a good or toxic label; ``shapley`` adds up
    what its filter removes over all orders. Repeated rows count each; null texts are empty,
    a null source is the part ''; a null doc_id has no label and is no copy; an empty table gives no rows.
    Other columns are left aside.
    """
    return report(tabulate(docs, labels))
