"""Substring joins and instrument search, without comparing every pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text that are looked at together; a longer text is looked at in parts.
SLICE = 1 << 20
#: Rows of needles that are sent to every task; more of them meet the found substrings in a shuffle.
FEW = 1 << 14
#: Bits of a set of hashes (16 MB) at most; a fuller one lets more through.
MAX_BITS = 27

# Instrument types left out, and display names of the others.
HIDDEN_TYPES = ["OPTION", "FUTURE", "CURRENCY", "CRYPTOCURRENCY"]
TYPE_NAMES = {"EQUITY": "Equity", "ETF": "ETF", "MUTUALFUND": "Fund", "INDEX": "Index"}

_START, _STEP, _MIX = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def _longer(hashes: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Hashes of texts that are one byte longer."""
    return (hashes ^ byte) * _STEP


def _place(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(32))) * _MIX) >> np.uint64(64 - bits)


def _parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, bounds) of the texts; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    held = texts.buffers()[2]
    return np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8), bounds


def _needle_places(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The places of all beginnings of the needles (set 0) and of whole needles (set 1)."""
    for batch in batches:
        data, bounds = _parts(batch.column(0))
        at, end = bounds[:-1], bounds[1:]
        hashes = np.full(len(at), _START)
        while len(at):
            hashes, at = _longer(hashes, data[at]), at + 1
            whole = at == end
            place = np.unique(np.concatenate([_place(hashes, bits), _place(hashes[whole], bits) + np.uint64(1 << bits)])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place >> 6), pa.array(place & 63, pa.int32())], ["w", "b"])
            hashes, at, end = hashes[~whole], at[~whole], end[~whole]


class Marks:
    """A set of needles as one bit per hash: of every beginning, so that a search ends where no
    needle goes on, and of every whole one. Never misses a member, and lets few others through.
    16 MB at most for each of the two."""

    def __init__(self, needles: DataFrame, needle: str):
        total = needles.agg(F.sum(F.octet_length(needle))).first()[0] or 0
        self.bits = bits = min(MAX_BITS, max(12, (32 * total).bit_length()))
        places = needles.select(needle).mapInArrow(lambda batches: _needle_places(batches, bits), "w long, b int")
        words = places.groupBy("w").agg(F.expr("bit_or(shiftleft(1L, b))").alias("v")).toArrow()
        held = np.zeros(1 << (bits - 5), np.int64)
        held[words.column("w").to_numpy()] = words.column("v").to_numpy()
        held = held.view(np.uint8)
        self.heads, self.wholes = held[: len(held) // 2], held[len(held) // 2 :]
        first = _longer(np.full(256, _START), np.arange(256, dtype=np.uint64))
        second = _longer(np.repeat(first, 256), np.tile(np.arange(256, dtype=np.uint64), 256))
        #: Which bytes may be a needle, and which two may begin one.
        self.single = self._has(self.wholes, first)
        self.double = np.repeat(self._has(self.heads, first), 256) & self._has(self.heads, second)

    def _has(self, bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = _place(hashes, self.bits)
        return bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1

    def _spots(self, data: np.ndarray, start: int, stop: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, length) of what begins from ``start`` on and before ``stop``, and may be a needle."""
        near = data[start : min(stop + 1, end)]
        found = [(np.flatnonzero(self.single[near[: stop - start]]) + start, 1)]
        at = np.flatnonzero(self.double[near[:-1].astype(np.uint16) << 8 | near[1:]]) + start
        hashes = _longer(np.full(len(at), _START), data[at])
        size = 1
        while len(at):
            hashes, size = _longer(hashes, data[at + size]), size + 1
            if size > 2:
                go = self._has(self.heads, hashes)
                at, hashes = at[go], hashes[go]
            found.append((at[self._has(self.wholes, hashes)], size))
            go = at + size < end
            at, hashes = at[go], hashes[go]
        return np.concatenate([f for f, _ in found]), np.repeat([n for _, n in found], [len(f) for f, _ in found])

    def within(self, texts: pa.Array) -> pa.Array:
        """For each text its different substrings that may be needles."""
        data, bounds = _parts(texts)
        rows, subs = [np.zeros(0, np.int64)], []
        end = int(bounds[-1])
        for start in range(int(bounds[0]), end, SLICE):
            at, size = self._spots(data, start, min(start + SLICE, end), end)
            row = np.searchsorted(bounds, at, "right") - 1
            inside = at + size <= bounds[row + 1]
            at, size, row = at[inside], size[inside], row[inside]
            to = np.concatenate([[0], np.cumsum(size)])
            held = data[np.repeat(at - to[:-1], size) + np.arange(to[-1])]
            named = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(to), pa.py_buffer(held)).dictionary_encode()
            # a substring of a row once; parts of one long text may still repeat it
            kinds = max(1, len(named.dictionary))
            once = np.unique(row * kinds + named.indices.to_numpy())
            rows.append(once // kinds)
            subs.append(named.dictionary.take(pa.array(once % kinds)))
        held = np.bincount(np.concatenate(rows), minlength=len(texts))
        values = pa.concat_arrays([pa.array([], pa.large_string()), *subs]).cast(pa.string())
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held)]), pa.int32()), values)


def contains_join(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Pairs where ``texts.text`` contains ``needles.needle``, each once for every row of either side.

    Every text is looked at once, byte by byte from all its places together: a place is followed as
    long as some needle may go on like this, and what may be a whole needle is kept, once for a
    row. These substrings meet the needles by equality, which is the check itself; the text is not
    needed again. The sets of the needles are bounded. Needles must not be empty.
    """
    known = needles.select(needle).filter(F.length(needle) > 0).distinct()
    marks = Marks(known, needle)

    @F.arrow_udf("array<string>")
    def within(column: pa.Array) -> pa.Array:
        return marks.within(column)

    found = texts.withColumn("_sub", F.explode(F.array_distinct(within(F.col(text)))))
    few = needles.limit(FEW + 1).count() <= FEW
    return found.join(F.broadcast(needles) if few else needles, F.col("_sub") == F.col(needle)).drop("_sub")


def listed(instruments: DataFrame) -> DataFrame:
    """Leave out derivative and currency instruments; add the display type."""
    names = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    return instruments.filter(~F.col("type").isin(HIDDEN_TYPES)).withColumn(
        "type_display", F.coalesce(names[F.col("type")], F.col("type"))
    )


def search(instruments: DataFrame, queries: DataFrame, limit: int = 8) -> DataFrame:
    """Best instruments per query: symbol prefix first, then any match, in list order.

    ``instruments(pos, symbol, name)``, ``queries(q)``. Hits are ranked with a bare
    ``row_number`` limit, which also cuts each query's hits before the shuffle.
    """
    hay = instruments.withColumn("_hay", F.lower(F.concat_ws(" ", "symbol", "name")))
    asks = queries.select("q", F.lower(F.trim("q")).alias("_q")).distinct()
    hits = contains_join(hay, "_hay", asks, "_q").drop("_hay")
    prefix = F.lower("symbol").startswith(F.col("_q"))
    best = Window.partitionBy("q").orderBy(F.col("_late"), F.col("pos"))
    return (
        hits.withColumn("_late", F.when(prefix, 0).otherwise(1))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= limit)
        .drop("_q", "_late")
    )
