"""Quality rules: statistics of whole texts, base limits, boosted trees over the statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.boosting import Forest, fit
from barloom.llm.tables import in_batches
from barloom.llm.texts import Words, binary, slices

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30
#: Labelled rows that the trees are fitted on, at most; those of the smallest key hash.
SAMPLE_ROWS = 20_000
#: A document goes if the trees give it less than this chance of being good.
LEAST_SCORE = 0.15

#: Features of the trees, and whether the score may only rise (1) or fall (-1) with each.
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "distinct_share": 0,
    "upper_share": -1,
    "digit_share": -1,
    "mark_share": -1,
    "words_per_line": 0,
    "longest_word": 0,
    "line_end_share": 0,
}


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_SYMBOL, _LF = _table(SYMBOLS), _table(b"\n")
_UPPER, _DIGIT = _table(bytes(range(65, 91))), _table(b"0123456789")
_MARK, _END = _table(b"!?"), _table(b".!?:;\"'")


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def _numbers(keys: np.ndarray) -> np.ndarray:
    return pa.array(keys).dictionary_encode().indices.to_numpy()


def repeated_words(words: Words) -> np.ndarray:
    """Words of each text in windows of WINDOW words that occur at least twice in it. Windows
    get exact numbers by doubling: pairs of words, pairs of pairs, pairs of those."""
    codes, _ = words.coded
    codes, n = codes.astype(np.int64), len(words)
    size = 1
    while size < WINDOW and n > WINDOW:
        codes = _numbers(codes[:-size] * (codes.max() + 1) + codes[size:]).astype(np.int64)
        size *= 2
    if n <= WINDOW:
        return np.zeros(len(words.counts), np.int64)
    start = np.arange(len(codes))
    whole = words.bounds[1:][words.text_of[start]] >= start + WINDOW
    start = start[whole]
    if not len(start):
        return np.zeros(len(words.counts), np.int64)
    number = _numbers(words.text_of[start] * (codes.max() + 1) + codes[start])
    twice = start[np.bincount(number)[number] >= 2]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    return _per_text(np.cumsum(cover[:-1]) > 0, words.bounds)


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts per text and the features of the trees; null counts as empty."""
    words = Words(texts)
    data, at = words.data, words.offsets
    n_texts = len(at) - 1
    n = words.counts
    out = {
        "n_words": n,
        "word_chars": _per_text(words.ink & ((data & 0xC0) != 0x80), at),
        "n_symbols": _per_text(_SYMBOL[data], at),
    }
    # lines: cut at line feeds and at the ends of texts
    feed = _LF[data].astype(bool)
    heads = np.unique(np.concatenate([at[:-1], np.flatnonzero(feed) + 1]))
    heads = heads[heads < len(data)]
    line_of = np.searchsorted(at, heads, side="right") - 1
    ends = np.append(heads[1:], len(data))
    inked = np.concatenate([[0], np.cumsum(words.ink)])
    solid = np.flatnonzero(inked[ends] > inked[heads]) if len(heads) else np.zeros(0, np.int64)
    plain = np.concatenate([[0], np.cumsum(~feed)])
    lines = binary(np.append(plain[heads], plain[-1]), data[~feed]).dictionary_encode()
    number = lines.indices.to_numpy(zero_copy_only=False)[solid].astype(np.int64)
    key = line_of[solid] * (len(lines.dictionary) + 1) + number
    n_lines = np.bincount(line_of[solid], minlength=n_texts)
    different = np.unique(key)
    out["n_dup_lines"] = n_lines - np.bincount(different // (len(lines.dictionary) + 1), minlength=n_texts)
    out["n_repeat_words"] = repeated_words(words)

    codes, dictionary = words.coded
    pairs = np.unique(words.text_of * (len(dictionary) + 1) + codes)
    distinct = np.bincount(pairs // (len(dictionary) + 1), minlength=n_texts)
    some, chars = np.maximum(n, 1), np.maximum(out["word_chars"], 1)
    longest = np.zeros(n_texts)
    np.maximum.at(longest, words.text_of, words.ends - words.starts)
    closing = words.starts[np.searchsorted(words.starts, ends[solid]) - 1] if len(solid) else solid
    closing = words.ends[np.searchsorted(words.starts, closing)] - 1 if len(solid) else solid
    ended = np.bincount(line_of[solid], _END[data[closing]], n_texts)
    out["features"] = np.stack(
        [
            np.log1p(n),
            out["word_chars"] / some,
            out["n_symbols"] / some,
            out["n_dup_lines"] / np.maximum(n_lines, 1),
            out["n_repeat_words"] / some,
            distinct / some,
            _per_text(_UPPER[data], at) / chars,
            _per_text(_DIGIT[data], at) / chars,
            _per_text(_MARK[data], at) / some,
            n / np.maximum(n_lines, 1),
            np.log1p(longest),
            ended / np.maximum(n_lines, 1),
        ],
        axis=1,
    )
    return out


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    n = stats["n_words"]
    return (n < LEAST_WORDS) | (100 * stats["n_repeat_words"] > REPEAT_PERCENT * n)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> Forest | None:
    """Trees for ``labels.quality`` from at most ``sample`` labelled documents.

    The sample are the labels of the smallest id hash, so it does not depend on the order of
    rows; it alone is broadcast, and only its documents are read. None if fewer than two
    classes are labelled; labels that are null teach nothing.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("_id"), labels["quality"].cast("double").alias("_y"))
    known = known.where("_id is not null and _y is not null").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows = rows.join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_y")

    def run(batches):
        for whole in batches:
            for part in slices(whole):
                f = statistics(part.column("text"))["features"]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(f.ravel()), f.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_y"), lists], ["doc_id", "y", "x"])

    got = in_batches(rows).mapInArrow(run, "doc_id long, y double, x array<double>").toPandas().sort_values("doc_id")
    if got["y"].nunique() < 2:
        return None
    return fit(np.array(got["x"].tolist()), got["y"].to_numpy() > 0, np.array(list(FEATURES.values())))


def judge(docs: DataFrame, forest: Forest | None, least: float = LEAST_SCORE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    score, kept) of every whole text, where it is read.

    Null counts as empty: no words, base rules failed. Without trees the score is null and
    the base rules decide alone. Repeated rows stay; other columns are left aside.
    """

    def run(batches):
        for whole in batches:
            for part in slices(whole):
                s = statistics(part.column("text"))
                failed = base_failed(s)
                score = forest.score(s["features"]) if forest else np.full(len(failed), np.nan)
                kept = ~failed & (np.isnan(score) | (score >= least))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        *(pa.array(s[k].astype(np.int64)) for k in COUNTS),
                        pa.array(failed),
                        pc.if_else(pa.array(np.isnan(score)), pa.scalar(None, pa.float64()), pa.array(score)),
                        pa.array(kept),
                    ],
                    ["doc_id", *COUNTS, "base_failed", "score", "kept"],
                )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    counts = ", ".join(f"{k} long" for k in COUNTS)
    return in_batches(rows).mapInArrow(run, f"doc_id long, {counts}, base_failed boolean, score double, kept boolean")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
