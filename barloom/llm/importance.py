"""Importance resampling towards a target text: hashed n-gram features, log ratios, Gumbel top-k.

Features are counted by segments. Line feeds cut texts into lines, the features of a line are
computed once however often it occurs in the corpus, and its counts are multiplied
by its occurrences. Runs of words that cross a line feed are added text by text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.tables import discard, in_batches, looked_up, saved
from barloom.llm.texts import SLICE_BYTES, Words, binary, chunks, flat, slices

#: A byte of a word stays, in lower case; any other becomes a space. Words are digits,
#: letters a to z and all that is not ASCII.
_KEPT = np.full(256, 32, np.uint8)
_KEPT[48:58] = range(48, 58)
_KEPT[65:91] = range(97, 123)
_KEPT[97:123] = range(97, 123)
_KEPT[128:] = range(128, 256)
_SOLID = _KEPT != 32


def _line_of(raw: np.ndarray, words: Words) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(raw == 10)])[words.starts]


def _runs(words: Words, size: int, buckets: int, after: int = 0, lines: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every run of 1 to ``size`` words of one text, in order of the texts.

    Only runs that end behind the first ``after`` words count, and with ``lines`` (of each word)
    only those that begin and end on different lines. The checksum of a run goes on
    from that of the run without its last word, once per different run.
    """
    codes, spelled = words.coded
    spelled = spelled.to_pylist()
    place = np.arange(len(codes))
    number, sums = codes.astype(np.int64), [zlib.crc32(w) for w in spelled]
    found = []
    for length in range(1, size + 1):
        if length > 1:
            place = place[: max(0, len(codes) - length + 1)]
            pair = number[: len(place)] * (len(spelled) + 1) + codes[length - 1 :]
            pair, number = np.unique(pair, return_inverse=True)
            before, last = np.divmod(pair, len(spelled) + 1)
            sums = [zlib.crc32(b" " + spelled[w], sums[b]) for b, w in zip(before.tolist(), last.tolist())]
        end = place + length - 1
        ok = (words.text_of[place] == words.text_of[end]) & (end >= after)
        if lines is not None:
            ok &= lines[place] != lines[end]
        hashed = np.array(sums, np.int64) % buckets if sums else np.zeros(0, np.int64)
        found.append((words.text_of[place[ok]], hashed[number[ok]]))
    text = np.concatenate([t for t, _ in found])
    bucket = np.concatenate([b for _, b in found])
    order = np.argsort(text, kind="stable")
    return text[order], bucket[order]


def features(texts: pa.Array, size: int, buckets: int, across: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, words per text, features per text, their buckets) for parts of a column.

    With ``across`` only the runs over several lines, else all runs. Long texts are
    worked in chunks that repeat the last ``size - 1`` words before them.
    """
    data, at = flat(texts)
    if len(at) != 2 or len(data) <= SLICE_BYTES:
        words = Words(texts, change=lambda b: _KEPT[b])
        text, bucket = _runs(words, size, buckets, lines=_line_of(data, words) if across else None)
        yield words.counts, np.bincount(text, minlength=len(texts)), bucket
        return
    n, found, back = 0, [], 0
    for a, b in chunks(data, _SOLID[:]):
        part = data[a - back : b]
        words = Words(binary(np.array([0, len(part)]), part), change=lambda b: _KEPT[b])
        again = int(np.searchsorted(words.starts, back))
        found.append(_runs(words, size, buckets, after=again, lines=_line_of(part, words) if across else None)[1])
        n += len(words) - again
        keep = words.starts[-(size - 1) :] if size > 1 else words.starts[:0]
        back = len(part) - int(keep[0]) if len(keep) else 0
    bucket = np.concatenate(found)
    yield np.array([n]), np.array([len(bucket)]), bucket


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(counts)])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text) with a number for every row and null texts as empty ones."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))


def cut(rows: DataFrame) -> DataFrame:
    """(row, doc_id, line) for every line of numbered texts that is not empty, and with a null
    line for an empty first one, so that each text has a row."""
    lines = rows.select("row", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.where("pos = 0 or line <> ''").select("row", "doc_id", F.when(F.col("line") != "", F.col("line")).alias("line"))


def line_table(texts: DataFrame, size: int, buckets: int) -> DataFrame:
    """(line_key, held, n_words, features): the features of every different line, once, and the
    number of its occurrences. Written to the shared folder."""

    def run(batches):
        for whole in batches:
            for part in slices(whole, "line"):
                keys = [hashlib.sha256(v).digest() for v in part.column("line").cast(pa.binary()).to_pylist()]
                for n_words, n, found in features(part.column("line"), size, buckets):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.binary()), part.column("held"), pa.array(n_words, pa.int64()), _lists(n, found)],
                        ["line_key", "held", "n_words", "features"],
                    )

    text = F.coalesce(texts["text"].cast("string"), F.lit(""))
    lines = texts.select(F.explode(F.split(text, "\n", -1)).alias("line")).where("line <> ''").groupBy("line").agg(F.count("*").alias("held"))
    return saved(in_batches(lines).mapInArrow(run, "line_key binary, held long, n_words long, features array<int>"), "importance-lines")


def crossing(texts: DataFrame, size: int, buckets: int) -> DataFrame:
    """(row, features) of the runs that cross a line feed, for a table (row, text)."""

    def run(batches):
        for whole in batches:
            for part in slices(whole):
                for _, n, found in features(part.column("text"), size, buckets, across=True):
                    yield pa.RecordBatch.from_arrays([part.column("row"), _lists(n, found)], ["row", "features"])

    return in_batches(texts.select("row", "text")).mapInArrow(run, "row long, features array<int>")


def bucket_counts(lines: DataFrame, joints: DataFrame | None) -> DataFrame:
    """(bucket, n): occurrences of the features of all lines, times those of the line, and of all crossing runs."""
    each = lines.select(F.explode("features").alias("bucket"), "held")
    if joints is not None:
        each = each.union(joints.select(F.explode("features"), F.lit(1).cast("long")))
    return each.groupBy("bucket").agg(F.sum("held").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of target to source) of every bucket. Only
    ``buckets`` counts of either side reach the driver."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, into in ((source, s), (target, t)):
        for bucket, n in counts.collect():
            into[bucket] = n
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weighed(table: DataFrame, kept: str, gain: np.ndarray) -> DataFrame:
    """``kept`` columns of a table with features, their number and the sum of their gains."""

    def run(batches):
        for batch in batches:
            lists = batch.column("features")
            at = lists.offsets.to_numpy()
            total = np.concatenate([[0], np.cumsum(gain[lists.values.to_numpy(zero_copy_only=False)])])
            own = [batch.column(c) for c in batch.schema.names if c != "features"]
            names = [c for c in batch.schema.names if c != "features"]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(np.diff(at), pa.int64()), pa.array(total[at[1:]] - total[at[:-1]], pa.int64())], [*names, "n_features", "weight"]
            )

    return in_batches(table).mapInArrow(run, f"{kept}, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel draw) that the seed and the doc_id decide; a null id counts as no characters."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, keep: int, *order: Column) -> DataFrame:
    """``rows`` with their ``rank`` from 1 in the given order, null beyond ``keep``.

    Rows are dealt by ranges of the order and numbered where they lie; one count per partition
    gives the numbers before it. No task sees all rows, and equal keys may share one only if
    they are equal in all of ``order``.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = saved(
        dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "importance-ranked"
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    rank = F.col("_s") + F.col("_at") + 1
    return placed.join(F.broadcast(starts), F.col("_part") == F.col("_p")).select(
        *rows.columns, F.when(rank <= keep, rank).cast("long").alias("rank")
    )


def resample(
    docs: DataFrame, target: DataFrame, size: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``.

    Features are all runs of 1 to ``size`` words, hashed into ``buckets``. The weight of a text is the sum
    of the gains of its features, its score adds a Gumbel draw, and the highest ``percent`` of the
    texts with ``least_words`` words are drawn without replacement: ``rank`` numbers them, ties go to
    the smaller doc_id, a null id comes last, and copies of one row are numbered one after the other.
    Null and empty texts have no features and weight 0. An empty target leaves all buckets
    smoothed; an empty table gives no rows. Other columns of either table are left aside.

    A line that a large part of the corpus shares is one row of the table of lines, and its
    weight is broadcast to where its occurrences are read.
    """
    if size < 1 or buckets < 1:
        raise ValueError("runs need a word and features a bucket")
    spread = None
    if size > 1:  # both passes over the texts must agree on the rows
        docs = saved(numbered(docs), "importance-texts")
        spread = saved(crossing(docs, size, buckets), "importance-joints")
    lines = line_table(docs, size, buckets)
    wanted = numbered(target.select(F.lit(None).alias("doc_id"), target["text"]))
    wanted_lines = line_table(wanted, size, buckets)
    gain = gains(
        bucket_counts(lines, spread), bucket_counts(wanted_lines, crossing(wanted, size, buckets) if size > 1 else None), buckets
    )
    discard(wanted_lines)
    weighed = saved(_weighed(lines, "line_key binary, held long, n_words long", gain), "importance-weights")
    discard(lines)
    whole = cut(numbered(docs) if spread is None else docs)
    places = saved(whole.select("row", "doc_id", F.unhex(F.sha2(F.col("line").cast("binary"), 256)).alias("line_key")), "importance-places")
    parts = looked_up(places, weighed, "line_key", "held").select("row", "doc_id", "n_words", "n_features", "weight")
    if spread is not None:
        joints = _weighed(spread, "row long", gain)
        none = F.lit(None).cast("long")
        parts = parts.union(joints.select("row", none, none, "n_features", "weight"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "n_features", "weight")]
    texts = parts.groupBy("row").agg(F.min("doc_id").alias("doc_id"), *sums)
    scored = saved(texts.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "importance-scored")
    for table in (weighed, places, *([spread, docs] if spread is not None else [])):
        discard(table)
    enough = scored.where(F.col("n_words") >= least_words)
    keep = percent * enough.count() // 100
    drawn = ranked(enough, keep, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.union(rest).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
