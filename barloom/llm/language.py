"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.tables import in_batches
from barloom.llm.texts import slices

#: n-grams of 1 to 3 letters; the edge of a word counts as one letter in longer ones.
SIZES = (1, 2, 3)
#: A profile holds this many of the most frequent n-grams, of a language or of a document.
PROFILE = 300
#: Parts of a language's n-grams that are ranked apart before the driver merges them.
SHARES = 16
UNKNOWN = "und"
#: Bytes of text whose n-grams are held at a time, some 150 times as much.
SLICE = 1 << 19
_BITS = 21
_EDGE = 0x20


@cache
def _letters() -> np.ndarray:
    """Lower-case form of every letter, and the word edge for all other characters. A letter
    whose lower case is longer keeps the first character of it."""
    out = np.full(0x110000, _EDGE, np.int64)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            out[c] = ord(s.lower()[0])
    return out


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram) of every n-gram as two arrays, and whether a text has a letter. A gram is
    up to three code points of 21 bits, so the number is exact, not a hash."""
    strings = texts.to_pylist()
    size = np.fromiter(map(len, strings), np.int64, len(strings)) + 2
    chars = np.frombuffer(" ".join(["", *(s + " " for s in strings)]).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _letters()[chars]
    of = np.repeat(np.arange(len(strings)), size)
    of = np.concatenate([of, [len(strings)]])[: len(c)]
    letter = c != _EDGE
    has = np.zeros(len(strings) + 1, bool)
    has[of[letter]] = True
    texts_, codes = [of[letter]], [c[letter]]
    # two: a letter on at least one side; three: a letter in the middle or edge-free
    two = (letter[:-1] | letter[1:]) & (of[:-1] == of[1:])
    texts_.append(of[:-1][two])
    codes.append((c[:-1] << _BITS | c[1:])[two])
    three = letter[1:-1] & (of[:-2] == of[2:])
    texts_.append(of[:-2][three])
    codes.append((c[:-2] << 2 * _BITS | c[1:-1] << _BITS | c[2:])[three])
    return np.concatenate(texts_), np.concatenate(codes), has[: len(strings)]


def _counted(text: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (text, gram) in order and how often each occurs."""
    if not len(gram):
        return text, gram, gram
    different, number = _numbered(gram)
    key = text * len(different) + number
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(first, append=len(key))
    key = key[first]
    return key // len(different), different[key % len(different)], n


def _parts(text: str) -> Iterator[str]:
    """A text cut at characters that are no letters, which are left out: the edges that the parts get
    instead give the same n-grams."""
    first = 0
    while first < len(text):
        stop = first + SLICE
        while stop < len(text) and text[stop].isalpha():
            stop += 1
        yield text[first:stop]
        first = stop + 1


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different (text, gram) in order, how often each occurs, and whether a text has a letter. A long
    text is worked in parts, whose counts are added up."""
    if len(texts) != 1 or len(texts[0].as_buffer()) <= SLICE:
        text, gram, has = grams(texts)
        return (*_counted(text, gram), has)
    gram, n, has = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for part in _parts(texts[0].as_py()):
        text, more, letters = grams(pa.array([part]))
        _, more, times = _counted(text, more)
        gram, at = np.unique(np.concatenate([gram, more]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n, times]), len(gram)).astype(np.int64)
        has |= bool(letters[0])
    return np.zeros(len(gram), np.int64), gram, n, np.array([has])


def _numbered(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    coded = pa.array(gram).dictionary_encode()
    different = coded.dictionary.to_numpy()
    order = np.argsort(different)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return different[order], place[coded.indices.to_numpy()]


def _ranked(text: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by text, then count downwards, then gram (as the input stands); rank in the text."""
    order = np.lexsort((-n, text))
    first = np.flatnonzero(np.concatenate([[True], text[order][1:] != text[order][:-1]])) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
    return order, rank


def learn(docs: DataFrame, profile: int = PROFILE) -> "Profiles":
    """Profiles of every language of ``docs`` (text, lang), from all n-grams of all its texts.

    Tasks count n-grams per language; only (language, n-gram, count) is shuffled and the
    driver receives ``SHARES * profile`` rows per language. Rows without text or language teach
    nothing. Ties are ordered by the n-gram.
    """

    def run(batches):
        for whole in batches:
            for part in slices(whole, limit=SLICE):
                lang = part.column("lang").dictionary_encode()
                text, gram, n, _ = counted(part.column("text"))
                of = lang.indices.to_numpy()[text]
                yield pa.RecordBatch.from_arrays(
                    [lang.dictionary.take(pa.array(of)), pa.array(gram), pa.array(n)], ["lang", "gram", "n"]
                )

    rows = docs.select(docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text"))
    counts = (
        in_batches(rows.where("lang is not null and text is not null"))
        .mapInArrow(run, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    # the most frequent of every share of a language, then of those on the driver
    share = F.pmod(F.xxhash64("gram"), F.lit(SHARES)).alias("share")
    order = Window.partitionBy("lang", "share").orderBy(F.desc("n"), "gram")
    top = (
        counts.select("lang", "gram", "n", share).withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= profile).select("lang", "n", "gram").collect()
    )
    ranked: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r.lang, -r.n, r.gram)):
        ranked.setdefault(r.lang, []).append(r.gram)
    return Profiles.of({k: v[:profile] for k, v in ranked.items()}, profile)


@dataclass(frozen=True)
class Profiles:
    """Ranks of n-grams per language; ``ranks[i, j]`` of n-gram ``grams[i]``, -1 if absent."""

    langs: tuple[str, ...]
    grams: np.ndarray
    ranks: np.ndarray
    size: int

    @staticmethod
    def of(ranked: dict[str, list[int]], size: int) -> "Profiles":
        langs = tuple(sorted(ranked))
        all_ = np.unique(np.array([g for k in langs for g in ranked[k]], np.int64))
        ranks = np.full((len(all_) + 1, len(langs)), -1, np.int64)
        for j, k in enumerate(langs):
            ranks[np.searchsorted(all_, np.array(ranked[k], np.int64)), j] = np.arange(len(ranked[k]))
        return Profiles(langs, all_, ranks, size)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language of the least out-of-place distance and the score of each text.

        The distance sums, over the text's own ``size`` most frequent n-grams, how far the
        ranks lie apart; an n-gram absent from a profile counts ``size``. The score is one
        less the distance as a share of the largest possible one.
        """
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        text, gram, n, has = counted(texts)
        n_texts = len(has)
        order, rank = _ranked(text, n)
        top = order[rank < self.size]
        text, gram, rank = text[top], gram[top], rank[rank < self.size]
        at = np.searchsorted(self.grams, gram)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == gram, at, len(self.grams))
        theirs = self.ranks[at]
        apart = np.where(theirs < 0, self.size, np.abs(theirs - rank[:, None]))
        distance = np.stack([np.bincount(text, apart[:, j], n_texts) for j in range(len(self.langs))], axis=1)
        most = np.bincount(text, minlength=n_texts) * float(self.size)
        best = distance.argmin(axis=1)
        score = np.where(has, 1 - distance[np.arange(n_texts), best] / np.maximum(most, 1), 0.0)
        return [self.langs[b] if h else UNKNOWN for b, h in zip(best, has)], score


def held_out(doc_id):
    """One document in five, by its id, is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text, where it is read.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text if
    nothing was learnt. Equal distances go to the first language in alphabetical order.
    Repeated rows stay; other columns are left aside.
    """

    def run(batches):
        for whole in batches:
            for part in slices(whole, limit=SLICE):
                lang, score = profiles.predict(pc.fill_null(part.column("text"), ""))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
                )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return in_batches(rows).mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, profiles: Profiles, least: float) -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose text is in a known language with a
    score of ``least`` or more."""
    text = docs.columns.index("text")

    def run(batches):
        for whole in batches:
            for part in slices(whole, limit=SLICE):
                lang, score = profiles.predict(pc.fill_null(part.column(text).cast(pa.string()), ""))
                stays = (np.array(lang) != UNKNOWN) & (score >= least)
                yield part.filter(pa.array(stays))

    return in_batches(docs).mapInArrow(run, docs.schema)
