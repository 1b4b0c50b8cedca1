"""Bounded-space packing of tokenised documents into sequences."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.tables import in_batches, saved
from barloom.llm.texts import Words, slices

WINDOW = 2048
#: Windows that a partition keeps open at a time.
OPEN = 64
#: Partitions whose leftover windows are merged by one task.
FAN = 64
#: Parts whose ids a task remembers before it starts anew.
MEMORY = 150_000
#: Names that the tokenizer takes as special tokens.


SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")

#: Small letters of ASCII and Latin-1: never joined with what follows by normalisation.
SMALL = "abcdefghijklmnopqrstuvwxyzß" + "".join(map(chr, [*range(0xE0, 0xF7), *range(0xF8, 0x100)]))

_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123))] = True
#: Second bytes, after 0xC3, of the letters from U+00C0 to U+00FF.
_SECOND = np.zeros(256, bool)
_SECOND[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True


def lowered_apart(data: np.ndarray) -> np.ndarray:
    """A to Z in lower case, but for a letter that a mark may follow: y and Y do not
    compose with the same marks, and the tokenizer composes before it lowers."""
    alone = np.ones(len(data), bool)
    alone[:-1] = data[1:] < 128
    return np.where((data >= 65) & (data <= 90) & alone, data + 32, data).astype(np.uint8)


def letter_edges(data: np.ndarray) -> np.ndarray:
    """Bytes before which the tokenizer certainly cuts: a letter up to U+00FF meets another
    ASCII character. After an apostrophe letters may belong to it, as in 's."""
    out = np.zeros(len(data), bool)
    letter = _LETTER[data]
    pair = (data[:-1] == 0xC3) & _SECOND[data[1:]]
    letter[:-1] |= pair
    letter[1:] |= pair
    plain = letter | (data > 32) & (data < 127)
    out[1:] = plain[1:] & plain[:-1] & (letter[1:] != letter[:-1]) & ~((data[:-1] == 39) & letter[1:])
    return out


class Encoder:
    """Ids of texts by the library, part by part.

    The tokenizer lowers letters, drops white space and never joins across it, nor across the
    edges of runs of Latin letters. So the ids of a text are those of its parts in a row, and
    each different part is encoded once and remembered. A run of SMALL letters goes straight
    to the library's merges, any other part through all its steps. Where the names
    of special tokens stand in a text, its parts are whole words as they are written.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.all = Tokenizer.from_file(path)
        self.merges = self.all.model
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = str.maketrans({c: as_bytes.pre_tokenize_str(c)[0][0] for c in SMALL})
        self.small = re.compile(f"[{SMALL}]+").fullmatch
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        parts = Words(texts, lowered_apart, letter_edges)
        raw = parts.data.tobytes()
        if any(name in raw for name in SPECIAL):
            parts = Words(texts)
        codes, different = parts.coded
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(parts.counts), np.int64)
        strings = different.to_pylist()
        if len(self.known) + len(strings) > MEMORY:
            self.clear()
        number = np.fromiter((self.known.get(s, -1) for s in strings), np.int64, len(strings))
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = np.arange(len(self.known), len(self.known) + len(new))
            fresh = [strings[i] for i in new.tolist()]
            self.known.update(zip(fresh, number[new].tolist()))
            ids = self._encoded([s.decode() for s in fresh])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, ids), np.int64, len(ids))])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.uint32)])
        first = np.cumsum(self.sizes) - self.sizes
        number = number[codes]
        n = self.sizes[number]
        at = np.concatenate([[0], np.cumsum(n)])
        take = np.repeat(first[number] - at[:-1], n) + np.arange(at[-1])
        return self.ids[take], np.diff(at[parts.bounds])

    def _encoded(self, parts: list[str]) -> list[list[int]]:
        merge, small, as_bytes = self.merges.tokenize, self.small, self.bytes
        out: list = [[t.id for t in merge(p.translate(as_bytes))] if small(p) else None for p in parts]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for i in some:
                out[i] = []
            got = self.all.encode([parts[i] for i in some], is_pretokenized=True, add_special_tokens=False)
            for w, i in zip(got.word_ids, got.ids):
                out[some[w]].append(i)
        return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Windows:
    """At most ``slots`` open windows; an item goes where the least room stays (best fit).
    When none fits, the fullest is closed to make room for a new one."""

    def __init__(self, size: int, slots: int):
        self.size, self.slots = size, slots
        self.open: list[tuple[int, int]] = []  # (room, number), ascending
        self.made = 0

    def place(self, need: int) -> tuple[int, int]:
        """(window, offset) of an item of ``need``, which is at most the size."""
        at = bisect_left(self.open, (need, -1))
        if at < len(self.open):
            room, number = self.open.pop(at)
        else:
            if len(self.open) == self.slots:
                self.open.pop(0)
            room, number = self.size, self.made
            self.made += 1
        if room > need:
            insort(self.open, (room - need, number))
        return number, self.size - room


#: Rows with ``used`` are no pieces: they name a window still open when its partition ended.
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, win long, offset long, used long"
NAMES = [f.split()[0] for f in PIECES.split(", ")]


def _pieces(path: str, end_id: int, size: int, slots: int):
    """For ``mapInArrow``: documents to pieces in the windows of their partition, then the
    windows that are still open, at most ``slots``."""

    def run(batches):
        from pyspark import TaskContext

        part_id = TaskContext.get().partitionId()
        enc, windows = encoder(path), Windows(size, slots)
        for whole in batches:
            for part in slices(whole):
                ids, counts = enc.encode(part.column("text"))
                rows: list[list] = [[] for _ in NAMES]
                at = 0
                for doc, n in zip(part.column("doc_id").to_pylist(), counts.tolist()):
                    own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    for start in range(0, n + 1, size):
                        piece = own[start : start + size]
                        win, offset = windows.place(len(piece))
                        values = (doc, start, len(piece), zlib.crc32(piece.tobytes()), n + 1, part_id, win, offset, None)
                        for column, v in zip(rows, values):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], NAMES)
        left = [(*[None] * 5, part_id, win, None, size - room) for room, win in windows.open]
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*left)], NAMES)

    return run


def _merge(size: int, slots: int):
    """For ``applyInArrow``: the open windows of a group of partitions (part, win, used), the
    fullest first, into windows of the group by best fit. Of these the ``slots`` with the most
    room stay open (``more``), the others are final."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("used", "descending"), ("part", "ascending"), ("win", "ascending")])
        windows = Windows(size, max(1, table.num_rows))
        placed = [windows.place(n) for n in table.column("used").to_pylist()]
        group = table.column("grp")
        open_ = {number for _, number in windows.open[-slots:]}
        return pa.table(
            {
                "part": table.column("part"), "win": table.column("win"), "grp": group,
                "into": pa.array([w for w, _ in placed], pa.int64()),
                "base": pa.array([o for _, o in placed], pa.int64()),
                "used": table.column("used"), "more": pa.array([w in open_ for w, _ in placed], pa.bool_()),
            }
        )

    return run


def pack(
    docs: DataFrame, path: str, end_id: int = 1, size: int = WINDOW, slots: int = OPEN, fan: int = FAN
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece.

    A document is its ids and ``end_id``; only one longer than a window is cut, at every
    ``size`` ids. Every partition packs its documents as they come, with at most ``slots``
    open windows; a window that it closed is final. Those still open at its end are merged:
    the ones of ``fan`` partitions by one task, which again leaves at most ``slots`` open,
    then those of ``fan`` such groups, until one group is left. So no task ever holds more
    than ``fan * slots`` windows. Texts never move, pieces move once.

    A null text counts as empty and is one piece with ``end_id`` alone. Rows are packed one
    by one, repeated or not, with null doc_ids too. Other columns are left aside.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    both = saved(in_batches(rows).mapInArrow(_pieces(path, end_id, size, slots), PIECES), "pieces")
    pieces = both.where(F.col("used").isNull())
    # where each open window of a partition ends up: (part, win) -> (level, grp, into, base)
    current = both.where(F.col("used").isNotNull()).select("part", "win", "used")
    groups = (current.agg(F.max("part")).first()[0] or 0) + 1
    moves, level = None, 0
    while True:
        level += 1
        groups = -(-groups // fan)
        placed = saved(
            current.withColumn("grp", F.floor(F.col("part") / fan))
            .groupBy("grp").applyInArrow(_merge(size, slots), "part long, win long, grp long, into long, base long, used long, more boolean"),
            "merged",
        )
        here = placed.select("part", "win", F.col("grp").alias("to_part"), F.col("into").alias("to_win"), F.col("base").alias("add"))
        if moves is None:
            moves = here.select("part", "win", F.lit(level).alias("level"), "to_part", "to_win", "add")
        else:
            nxt = here.select(
                F.col("part").alias("to_part"), F.col("win").alias("to_win"),
                F.col("to_part").alias("p"), F.col("to_win").alias("w"), F.col("add").alias("more"),
            )
            moves = saved(
                moves.join(nxt.withColumn("level", F.lit(level - 1)), ["level", "to_part", "to_win"], "left").select(
                    "part", "win",
                    F.when(F.col("p").isNull(), F.col("level")).otherwise(F.lit(level)).alias("level"),
                    F.coalesce("p", "to_part").alias("to_part"), F.coalesce("w", "to_win").alias("to_win"),
                    (F.col("add") + F.coalesce("more", F.lit(0))).alias("add"),
                ),
                "moves",
            )
        if groups == 1:
            break
        current = (
            placed.where("more").groupBy(F.col("grp").alias("part"), F.col("into").alias("win")).agg(F.sum("used").alias("used"))
        )
    # a sequence id names the level, the group and the window there
    name = lambda level, part, win: (level * (1 << 58) + part * (1 << 32) + win).cast("long")
    p = pieces.alias("p")
    m = moves.select(F.col("part").alias("mp"), F.col("win").alias("mw"), "level", "to_part", "to_win", "add")
    return p.join(m, (F.col("p.part") == F.col("mp")) & (F.col("p.win") == F.col("mw")), "left").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.when(F.col("mp").isNull(), name(F.lit(0).cast("long"), F.col("p.part"), F.col("p.win")))
        .otherwise(name(F.col("level").cast("long"), F.col("to_part"), F.col("to_win"))).alias("sequence_id"),
        (F.col("offset") + F.coalesce("add", F.lit(0))).alias("offset"),
    )
