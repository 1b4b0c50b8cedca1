"""Overlapping text chunks.

Documents are independent, so chunking is one narrow ``mapInPandas`` step, where the text
is read; nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default sizes, and separators from the most to the least preferred.
SIZE, OVERLAP, MINIMUM = 1000, 200, 100
SEPARATORS = ["\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " "]

CHUNK_SCHEMA = (
    "parent_doc_id string, chunk_id string, chunk_index int, total_chunks int, content string"
)


def check_sizes(size: int, overlap: int) -> None:
    if size < 50:
        raise ValueError(f"chunk size must be at least 50, got {size}")
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the chunk size")


def pieces(text: str, size: int) -> list[str]:
    """Parts of at most ``size`` characters: separators in order, applied to long parts
    only; what no separator can shorten is cut at ``size``."""
    parts = [text]
    for sep in SEPARATORS:
        parts = [
            q
            for p in parts
            for q in ([p] if len(p) <= size else [x for x in p.split(sep) if x.strip()])
        ]
    return [p[i : i + size] for p in parts for i in range(0, len(p), size)]


def cuts(lengths: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Ranges of parts that make up the chunks, from running lengths alone.

    A part weighs its length and a blank. A chunk takes as many parts as ``size`` holds, but
    always the part that the chunk before had no room for; the next starts at the first part
    from which no more than ``overlap`` is repeated. Both ends are found by bisection.
    """
    ends = [0, *accumulate(n + 1 for n in lengths)]
    first, stop = 0, 0
    while stop < len(lengths):
        stop = max(bisect_right(ends, ends[first] + size + 1) - 1, stop + 1)
        yield first, stop
        first = bisect_left(ends, ends[stop] - overlap, first, stop)


def join_pieces(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Chunks of joined parts."""
    for first, stop in cuts([len(p) for p in parts], size, overlap):
        yield " ".join(parts[first:stop]).strip()


def split_text(text: str, size=SIZE, overlap=OVERLAP, minimum=MINIMUM) -> list[str]:
    if not text or not text.strip():
        return []
    return [c for c in join_pieces(pieces(text, size), size, overlap) if c and len(c) >= minimum]


def chunk(
    docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, minimum: int = MINIMUM
) -> DataFrame:
    """``docs(doc_id, content)`` to chunks with ids ``<doc>_chunk_0000``."""
    check_sizes(size, overlap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["content"]):
                found = split_text(text, size, overlap, minimum)
                rows += [
                    (doc_id, f"{doc_id}_chunk_{i:04d}", i, len(found), c)
                    for i, c in enumerate(found)
                ]
            yield pd.DataFrame(
                rows, columns=["parent_doc_id", "chunk_id", "chunk_index", "total_chunks", "content"]
            )

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "content")
    return rows.mapInPandas(run, CHUNK_SCHEMA)


def fixed_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of equal length at a fixed stride, in column expressions only."""
    check_sizes(size, overlap)
    starts = F.sequence(F.lit(1), F.greatest(F.length("content"), F.lit(1)), F.lit(size - overlap))
    d = docs.select("doc_id", "content", F.posexplode(starts).alias("chunk_index", "_at"))
    return d.filter(F.length("content") > 0).select(
        "doc_id", "chunk_index", F.substring(F.col("content"), F.col("_at"), F.lit(size)).alias("content")
    )


def register_udtf(spark, name: str = "chunk_text") -> None:
    """``SELECT ... FROM docs, LATERAL chunk_text(content, 1000, 200, 100)``."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="chunk_index int, content string")
    class ChunkText:
        def eval(self, text: str, size: int, overlap: int, minimum: int):
            for i, c in enumerate(split_text(text, size, overlap, minimum)):
                yield i, c

    spark.udtf.register(name, ChunkText)
