"""Repeated passages across documents: winnowed anchors, extension both ways, removal."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.tables import PAGE_BITS, Members, discard, in_batches, saved
from barloom.llm.texts import Rolling, Words, mix, slices

#: Words of a passage that must repeat.
WINDOW = 35
#: Words of an anchor. Every passage of WINDOW words holds an anchor of its own choice: the
#: least-hashed run of ANCHOR words in it, the leftmost of equals.
ANCHOR = 12


class Stretches:
    """Windows of a slice of texts by their anchors.

    A stretch is a run of consecutive windows that chose the same place as their anchor.
    Equal windows choose equal anchors at equal places in them, so a window can only repeat
    in another stretch with the same anchor, and every window lies in one stretch.
    """

    def __init__(self, words: Words, window: int, anchor: int):
        n, spread = len(words), window - anchor + 1
        self.window, self.rolling = window, None
        self.first = np.zeros(0, np.int64)
        if n < window:
            return
        self.rolling = rolling = Rolling(words.hashes)
        grams = rolling.of(np.arange(n - anchor + 1), anchor)
        # order by the hash, then by place: 38 bits of the one, 26 of the other
        place = np.arange(len(grams), dtype=np.uint64)
        low = np.uint64((1 << 26) - 1)
        least = (grams & ~low) | (place & low)
        size = 1
        while 2 * size <= spread:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < spread:
            least = np.minimum(least[: len(least) - (spread - size)], least[spread - size :])
        start = np.arange(n - window + 1)
        inside = words.bounds[1:][words.text_of[start]] >= start + window
        start, chosen = start[inside], (least[inside] & low).astype(np.int64)
        chosen += (start >> 26) << 26
        chosen[chosen < start] += 1 << 26  # the place was cut to 26 bits
        if not len(start):
            return
        head = np.concatenate([[True], chosen[1:] != chosen[:-1]])
        self.first = start[head]
        self.count = np.diff(np.flatnonzero(head), append=len(start))
        # least hashes crowd at one end; mixed again they are spread evenly
        self.anchor = mix(grams[chosen[head]])
        self.text = words.text_of[self.first]
        self.at = self.first - words.bounds[self.text]

    def digests(self) -> np.ndarray:
        """Hash of all words of a stretch, and of how many windows it has."""
        length = self.count + self.window - 1
        return mix(self.rolling.of(self.first, length) ^ mix(self.count.astype(np.uint64)))

    def windows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of some stretches, and where each begins."""
        n = self.count[rows]
        bounds = np.concatenate([[0], np.cumsum(n)])
        start = np.repeat(self.first[rows] - bounds[:-1], n) + np.arange(bounds[-1])
        return self.rolling.of(start, self.window), bounds


def _seeds(window: int, anchor: int):
    """For ``mapInArrow``: anchors of texts and how often each was chosen in a slice."""

    def run(batches):
        for whole in batches:
            for part in slices(whole):
                s = Stretches(Words(part.column("text")), window, anchor)
                if len(s.first):
                    different, n = np.unique(s.anchor.view(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(different), pa.array(n)], ["anchor", "n"])

    return run


def _bits_of(filter_: Members) -> np.ndarray:
    """The filter as bytes, at most 16 MB by its construction."""
    out = np.zeros((1 << filter_.bits >> PAGE_BITS, 1 << PAGE_BITS >> 3), np.uint8)
    for r in filter_.pages.collect():
        out[r["_page"]] = np.frombuffer(r["_bits"], np.uint8)
    return out.ravel()


def _stretches(window: int, anchor: int, bits, shift: int):
    """For ``mapInArrow``: stretches whose anchor may occur more than once."""

    def run(batches):
        member = bits.value
        for whole in batches:
            for part in slices(whole):
                s = Stretches(Words(part.column("text")), window, anchor)
                if not len(s.first):
                    continue
                at = (s.anchor >> np.uint64(shift)).astype(np.int64)
                rows = np.flatnonzero(member[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                hashes, bounds = s.windows(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(s.anchor[rows].view(np.int64)),
                        pa.array(s.digests()[rows].view(np.int64)),
                        part.column("doc_id").take(pa.array(s.text[rows])),
                        part.column("key").take(pa.array(s.text[rows])),
                        pa.array(s.at[rows].astype(np.int32)),
                        pa.array(s.count[rows].astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64))),
                    ],
                    ["anchor", "digest", "doc_id", "key", "at", "n", "hashes"],
                )

    return run


STRETCH = "anchor long, digest long, doc_id long, key long, at int, n int, hashes array<long>"


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, key, spans) of documents with repeated passages: ``spans`` are (at, length)
    in words, unmerged, and ``key`` is a hash of the text.

    Seed: anchors chosen more than once, in any documents, mark the stretches that can
    repeat. A filter of fixed size keeps all others out of the shuffle.
    Extend: stretches that agree as a whole, words on both sides of the anchor included, are
    met by one digest each; copies fold before the shuffle. Only stretches alone with their
    digest are compared window by window, with each other and with one stretch of every
    digest, which extends a match to its exact ends on both sides. No pairs of documents are
    made, so a passage in a third of all documents costs one row for each.
    """
    spark = docs.sparkSession
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    seeds = in_batches(base.select("text")).mapInArrow(_seeds(window, anchor), "anchor long, n long")
    seeds = saved(seeds.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "seeds")
    seen = Members(seeds, F.col("anchor"))
    bits = spark.sparkContext.broadcast(_bits_of(seen))
    stretches = saved(
        in_batches(base.withColumn("key", F.xxhash64("text"))).mapInArrow(
            _stretches(window, anchor, bits, 64 - seen.bits), STRETCH
        ),
        "stretches",
    )
    classes = saved(
        stretches.groupBy("anchor", "digest").agg(
            F.count("*").alias("times"), F.min(F.struct("doc_id", "key", "at", "n", "hashes")).alias("one")
        ),
        "classes",
    )
    windows = classes.select("anchor", "times", "one.doc_id", "one.key", "one.at", F.posexplode("one.hashes").alias("pos", "hash"))
    twice = saved(
        windows.groupBy("anchor", "hash").agg(F.sum("times").alias("times")).where("times > 1").select("anchor", "hash"),
        "windows",
    )
    edges = (
        windows.where("times = 1").join(twice, ["anchor", "hash"])
        .select("doc_id", "key", (F.col("at") + F.col("pos")).alias("at"), F.lit(window).alias("length"))
    )
    whole = (
        stretches.select("anchor", "digest", "doc_id", "key", "at", "n")
        .join(classes.where("times > 1").select("anchor", "digest"), ["anchor", "digest"])
        .select("doc_id", "key", "at", (F.col("n") + (window - 1)).alias("length"))
    )
    spans = edges.union(whole).groupBy("doc_id", "key").agg(F.collect_set(F.struct("at", "length")).alias("spans"))
    spans = saved(spans, "spans")
    for table in (seeds, stretches, classes, twice):
        discard(table)
    return spans


def with_repeats(docs: DataFrame, **options) -> DataFrame:
    """(row, spans): every document as a struct, with its repeated passages or null. Only
    documents that may have some are shuffled; a filter of fixed size tells."""
    found = repeats(docs, **options)
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("key")
    )
    hashed = F.xxhash64("id", "key")
    marked = Members(found, F.xxhash64("doc_id", "key")).mark(rows, hashed, "maybe")
    theirs = found.select(F.col("doc_id").alias("their_id"), F.col("key").alias("their_key"), "spans")
    none = F.lit(None).cast("array<struct<at:int,length:int>>")
    return (
        marked.where("maybe")
        .join(theirs, F.col("id").eqNullSafe(F.col("their_id")) & (F.col("key") == F.col("their_key")), "left")
        .select("row", "spans")
        .union(marked.where("not maybe").select("row", none.alias("spans")))
    )


def _kept(words: Words, spans: pa.Array) -> np.ndarray:
    """Which words no span covers."""
    cover = np.zeros(len(words) + 1, np.int64)
    size = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
    if size.any():
        values = spans.flatten()
        at = values.field("at").to_numpy() + np.repeat(words.bounds[:-1], size)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + values.field("length").to_numpy(), -1)
    return np.cumsum(cover[:-1]) == 0


def _left(words: Words, kept: np.ndarray) -> list[bytes]:
    """The words kept of each text, joined by one space."""
    raw = words.data.tobytes()
    out = []
    for a, b in zip(words.bounds[:-1], words.bounds[1:]):
        at = np.flatnonzero(kept[a:b]) + a
        out.append(b" ".join([raw[x:y] for x, y in zip(words.starts[at].tolist(), words.ends[at].tolist())]))
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row: words covered by a run of
    ``window`` words that starts anywhere else too are gone, whichever document comes first.

    A null text has no words. Repeated rows count as repeats of each other. Null doc_ids are
    told apart by their text. Texts shorter than ``window`` words stay whole. Other columns
    are left aside.
    """

    def run(batches):
        for whole in batches:
            for part in slices(whole):
                words = Words(part.column("text"))
                kept = _kept(words, part.column("spans"))
                sums = np.concatenate([[0], np.cumsum(~kept)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(words.counts),
                        pa.array(np.diff(sums[words.bounds])),
                        pa.array(_left(words, kept), pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept_text"],
                )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    found = with_repeats(rows, window=window, anchor=anchor).select("row.doc_id", "row.text", "spans")
    return in_batches(found).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def cleaned(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` without repeated passages, all columns as they are but ``text`` and, if
    there, ``n_chars``. A text that lost words has its other words joined by one space; one
    that lost none is untouched; one that lost all is dropped."""
    names, text = list(docs.columns), docs.columns.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for whole in batches:
            columns = [*whole.column("row").flatten(), whole.column("spans")]
            for part in slices(pa.RecordBatch.from_arrays(columns, [str(i) for i in range(len(columns))]), column=text):
                old = part.column(text).cast(pa.string())
                words = Words(old)
                kept = _kept(words, part.column(len(names)))
                lost = np.diff(np.concatenate([[0], np.cumsum(~kept)])[words.bounds])
                new = pc.if_else(pa.array(lost > 0), pa.array(_left(words, kept), pa.binary()).cast(pa.string()), old)
                out = part.columns[:-1]
                out[text] = new
                if chars is not None:
                    out[chars] = pc.if_else(pa.array(lost > 0), pc.utf8_length(new).cast(out[chars].type), out[chars])
                stays = (lost == 0) | (lost < words.counts)
                yield pa.RecordBatch.from_arrays(out, names).filter(pa.array(stays))

    return in_batches(with_repeats(docs, window=window, anchor=anchor)).mapInArrow(run, docs.schema)
