"""From raw documents to packed sequences: language, copies, near copies, passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.exact_dedup import drop_copies
from barloom.llm.language import accepted, held_out, learn
from barloom.llm.packing import pack
from barloom.llm.queries import tokenizer_file
from barloom.llm.similar import drop_similar
from barloom.llm.substrings import cleaned
from barloom.llm.tables import discard, saved

#: Documents nearer than this to no language go: text in a learnt language lies above
#: 0.4, letters at random below 0.2.
LEAST_LANGUAGE_SCORE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; others are rejected. If no
    document names its language, nothing can be told and none stays."""
    profiles = learn(docs.where(~held_out(F.col("doc_id"))))
    return accepted(docs, profiles, LEAST_LANGUAGE_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts equal but for white space."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more.
    All fingerprints meet in the byte index, a prefix join finds what lies further apart."""
    return drop_similar(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages that repeat; those with nothing else go."""
    return cleaned(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences."""
    return pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("exact dedup", exact),
    ("near dedup", near),
    ("substring dedup", passages),
    ("packing", packing),
]

#: SQL has neither the profiles nor the tokenizer; tests compare with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents that the stages keep. What a stage has written goes once the
    next one has read it."""
    docs, spent = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if spent is not None:
            discard(spent)
        spent = docs
    return STAGES[-1][1](spark, docs, sf_dir)
