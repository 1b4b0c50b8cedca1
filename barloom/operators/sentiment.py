"""Lexicon sentiment of sentences, documents and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.text import words

# The two word lists and the label limits.
POSITIVE = [
    "beat", "exceeded", "grew", "growth", "record", "strong", "bullish", "upgrade",
    "outperform", "buy", "positive", "profit", "revenue", "increase", "rose", "gained",
    "rally", "surge", "momentum", "recovery",
]
NEGATIVE = [
    "miss", "declined", "fell", "weak", "bearish", "downgrade", "sell", "negative", "loss",
    "decrease", "dropped", "slump", "concern", "risk", "headwind", "competition", "lawsuit",
    "investigation",
]
BULLISH_AT, BEARISH_AT = 0.15, -0.15
MAX_SENTENCES, MAX_SENTENCE = 25, 300


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


# The patterns of sources, rules, sentence ends and bare numbers.
def sentence_array(text: Column, limit: int | None, chars: int | None) -> Column:
    t = F.regexp_replace(text, r"\[Source \d+\][^\n]*\n?", "")
    t = F.regexp_replace(t, "---+", "")
    t = F.regexp_replace(t, r"([.!?])\s+", "$1\n")
    parts = F.transform(F.split(t, r"\n+"), strip)
    kept = F.filter(
        parts,
        lambda s: (F.length(s) >= 8)
        & ~s.startswith("[")
        & ~F.regexp(s, F.lit(r"^[\d\s\$\%\.\,]+$")),
    )
    if chars is not None:
        kept = F.transform(kept, lambda s: F.substring(s, 1, chars))
    return kept if limit is None else F.slice(kept, 1, limit)


def sentences(
    docs: DataFrame,
    keys: list[str],
    content: str = "content",
    limit: int | None = MAX_SENTENCES,
    chars: int | None = MAX_SENTENCE,
) -> DataFrame:
    """One row per sentence with its position; ``None`` limits keep whole texts."""
    found = F.posexplode(sentence_array(F.col(content), limit, chars)).alias("pos", "sentence")
    return docs.select(*keys, found)


def lexicon(values: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in values])


def rate(p: Column, n: Column) -> tuple[Column, Column]:
    """Score and confidence from the numbers of positive and negative words."""
    hits = p + n
    value = F.when(hits == 0, 0.0).otherwise((p - n) / hits)
    return value, F.when(hits == 0, 0.3).otherwise(F.least(F.lit(0.7), hits * 0.15))


def scored(sents: DataFrame, positive=POSITIVE, negative=NEGATIVE) -> DataFrame:
    """Score each sentence by the distinct lexicon words in it."""
    found = lambda values: F.size(F.array_intersect(F.col("_seen"), lexicon(values)))
    d = sents.withColumn("_seen", F.array_distinct(words(F.lower("sentence"))))
    d = d.withColumns({"_p": found(positive), "_n": found(negative)})
    value, confidence = rate(F.col("_p"), F.col("_n"))
    return d.withColumns({"score": value, "confidence": confidence}).drop("_seen", "_p", "_n")


def evidence(
    docs: DataFrame, key: Column, content: str, tone_words: dict[str, list[str]] | None = None,
    positive=POSITIVE, negative=NEGATIVE, limit: int | None = None, chars: int | None = None,
) -> DataFrame:
    """Sentiment per symbol in one pass over the documents, without a row per sentence.

    Each document folds its own sentences; the shuffle carries one partial row per symbol
    and task. ``tone_words`` adds columns counting which words occur anywhere.
    """

    # Stage by stage, so that a sentence is split into words only once.
    seen = F.transform(
        sentence_array(F.col(content), limit, chars),
        lambda s: F.array_distinct(words(F.lower(s))),
    )
    hits = F.transform(
        seen,
        lambda w: F.struct(
            F.size(F.array_intersect(w, lexicon(positive))).alias("p"),
            F.size(F.array_intersect(w, lexicon(negative))).alias("n"),
        ),
    )
    rates = F.transform(
        hits, lambda h: F.struct(*[r.alias(a) for a, r in zip("vc", rate(h["p"], h["n"]))])
    )

    def fold(acc: Column, r: Column) -> Column:
        return F.struct(
            (acc["w"] + r["v"] * r["c"]).alias("w"),
            (acc["c"] + r["c"]).alias("c"),
            (acc["n"] + 1).alias("n"),
        )

    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("c"), F.lit(0).cast("long").alias("n"))
    folded = F.aggregate(rates, zero, fold)
    text = F.lower(content)
    marks = {w: f"_t{i}" for i, w in enumerate(w for ws in (tone_words or {}).values() for w in ws)}
    rows = docs.select(
        key.alias("symbol"), folded.alias("_f"),
        *[text.contains(w).cast("int").alias(c) for w, c in marks.items()],
    )
    total = rows.groupBy("symbol").agg(
        F.sum("_f.w").alias("_w"), F.sum("_f.c").alias("_c"), F.sum("_f.n").alias("sentences"),
        *[
            sum(F.max(marks[w]) for w in ws).alias(name) for name, ws in (tone_words or {}).items()
        ],
    )
    mean = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_w") / F.col("_c")))
    return total.select(
        "symbol",
        F.when(F.col("_c") > 0, mean).otherwise(0.0).alias("sentiment_score"),
        F.when(F.col("_c") > 0, F.col("_c") / F.col("sentences")).otherwise(0.0).alias("confidence"),
        "sentences",
        *(tone_words or {}),
    ).withColumn("sentiment_label", label(F.col("sentiment_score")))


def label(value: Column) -> Column:
    return (
        F.when(value > BULLISH_AT, "BULLISH").when(value < BEARISH_AT, "BEARISH").otherwise("NEUTRAL")
    )


def aggregate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Confidence-weighted score within [-1, 1], mean confidence and label."""
    weight = F.sum("confidence")
    mean = F.sum(F.col("score") * F.col("confidence")) / weight
    value = F.when(weight > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), mean))).otherwise(0.0)
    out = rows.groupBy(*keys).agg(
        value.alias("sentiment_score"),
        F.when(weight > 0, F.avg("confidence")).otherwise(0.0).alias("confidence"),
        F.count(F.lit(1)).alias("sentences"),
    )
    return out.withColumn("sentiment_label", label(F.col("sentiment_score")))


def top_sentences(
    rows: DataFrame, keys: list[str], keep: int = 3, chars: int | None = 120
) -> DataFrame:
    """Best and worst sentences per key; equal scores keep text order."""
    side = F.when(F.col("score") > 0, "positive").when(F.col("score") < 0, "negative")
    d = rows.withColumn("side", side).filter(F.col("side").isNotNull())
    w = Window.partitionBy(*keys, "side").orderBy(F.abs("score").desc(), "pos")
    text = F.col("sentence") if chars is None else F.substring("sentence", 1, chars)
    return (
        d.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= keep)
        .select(*keys, "side", "rank", text.alias("text"), F.round("score", 3).alias("score"))
    )
