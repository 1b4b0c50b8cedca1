"""Vector search, diversity re-ranking and context assembly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import materialize

#: Bytes of vectors in a block, and elements of a matrix product at a time.
BLOCK_BYTES = 4 << 20
TILE = 4 << 20
#: Vectors that the cells of an index are fitted on, at most; those of the smallest id hash.
SAMPLE_VECTORS = 20_000
#: Cells at most; more vectors make more blocks in a cell.
MAX_CELLS = 1024
#: Recall that the number of probed cells must reach on the sample.
RECALL = 0.97
#: Term counts in a block of documents, and documents that are split into words together.
BLOCK_TERMS = 1 << 22
SPLIT_ROWS = 512

# Retrieval defaults and the context budget.
N_RESULTS, FETCH_K, LAMBDA = 5, 20, 0.5
CONTEXT_CHARS, CONTEXT_TAIL = 8000, 200
NO_DOCUMENTS = "No relevant documents found."


def fetch_size(n_results: int) -> int:
    return max(max(FETCH_K, 2 * n_results), 3 * n_results)


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1.0)


def matrix(column: pa.Array) -> np.ndarray:
    """Equal-length lists as one matrix, without a Python object per row."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(column), -1)


def centroids(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector per group, added up map-side one position at a time."""
    parts = vectors.select(group, F.posexplode(vector).alias("_i", "_v"))
    means = parts.groupBy(group, "_i").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    packed = means.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_p"))
    return packed.select(
        F.col(group).cast("long").alias("query_id"), F.transform("_p", lambda x: x["_m"]).alias("query")
    )


def best_of(cos: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest values, ordered by value and then by id, so that a tie
    at the cut does not depend on how rows were batched."""
    take = min(k, len(cos))
    edge = np.partition(cos, len(cos) - take)[len(cos) - take]
    near = np.flatnonzero(cos >= edge)
    return near[np.lexsort((vec_id[near], -cos[near]))][:take]


HITS = "query_id long, vec_id long, cos double"
BLOCK = "cell string, ids binary, dim int, vectors binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, id, vector) as blocks of unit vectors: one row per run of equal cells, of
    BLOCK_BYTES at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column(0).cast(pa.string())
        codes = cell.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        ids = batch.column(1).to_numpy(zero_copy_only=False).astype("int64")
        vectors = unit(matrix(batch.column(2)))
        most = max(1, BLOCK_BYTES // (8 * max(1, vectors.shape[1])))
        edges = np.flatnonzero(np.diff(codes)) + 1
        cuts = sorted({0, *edges.tolist(), *range(0, len(ids), most)}) + [len(ids)]
        spans = list(zip(cuts, cuts[1:]))
        yield pa.RecordBatch.from_arrays(
            [
                cell.take(pa.array([i for i, _ in spans])),
                pa.array([ids[i:j].tobytes() for i, j in spans], pa.binary()),
                pa.array([vectors.shape[1]] * len(spans), pa.int32()),
                pa.array([vectors[i:j].tobytes() for i, j in spans], pa.binary()),
            ],
            ["cell", "ids", "dim", "vectors"],
        )


def _best_pairs(k: int):
    """Best ``k`` per query and pair of blocks, by matrix products of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                known, asks = np.frombuffer(row["ids"], "int64"), np.frombuffer(row["asks"], "int64")
                vectors = np.frombuffer(row["vectors"], "float64").reshape(len(known), -1)
                queries = np.frombuffer(row["queries"], "float64").reshape(len(asks), -1)
                step = max(1, TILE // len(known))
                for first in range(0, len(asks), step):
                    cos = vectors @ queries[first : first + step].T
                    picks = [best_of(cos[:, j], known, k) for j in range(cos.shape[1])]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "query_id": np.repeat(asks[first : first + step], [len(p) for p in picks]),
                            "vec_id": np.concatenate([known[p] for p in picks]),
                            "cos": np.concatenate([cos[p, j] for j, p in enumerate(picks)]),
                        }
                    )

    return run


def _met(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Hits of blocks of ``corpus(cell, vec_id, vector)`` and ``queries(cell, query_id, query)`` with the
    same cell. The join moves packed blocks; the side that turns out small at run time is sent to
    the other by adaptive execution, else both are shuffled by the cell."""
    left = corpus.mapInArrow(_pack, BLOCK)
    right = queries.mapInArrow(_pack, BLOCK).select("cell", F.col("ids").alias("asks"), F.col("vectors").alias("queries"))
    return left.join(right, "cell").select("ids", "vectors", "asks", "queries").mapInArrow(_best_pairs(k), HITS)


def ranked_hits(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query; ranks merge, so partial ones are cut before the shuffle."""
    best = Window.partitionBy("query_id").orderBy(F.col("cos").desc(), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select(
            "query_id",
            "vec_id",
            "rank",
            (1 - F.col("cos")).alias("distance"),
            (1 - (1 - F.col("cos")) / 2).alias("score"),
        )
    )


def _sides(corpus: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with long ids; rows without a vector find nothing and are found by nobody."""
    corpus = corpus.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").where("vector is not null")
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), "query").where("query is not null")
    return corpus, queries


def vector_topk(corpus: DataFrame, queries: DataFrame, k: int, bands: int | None = None) -> DataFrame:
    """Exact cosine top-k: ``corpus(vec_id, vector)``, ``queries(query_id, query)``.

    The corpus is dealt over ``bands`` (shuffle partitions, by default), the packed queries go to every
    band, and a task keeps ``k`` rows per query and pair of blocks before the final ranking, so it never
    holds more than two blocks and one product. ``score = 1 - distance / 2``.
    """
    corpus, queries = _sides(corpus, queries)
    bands = bands or int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a band for each run of ids, so that a batch of neighbours makes few blocks
    dealt = corpus.select(F.pmod(F.spark_partition_id() + F.floor(F.monotonically_increasing_id() / 4096), F.lit(bands)).cast("int").alias("cell"), "vec_id", "vector")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("cell"), "query_id", "query")
    return ranked_hits(_met(dealt, asked.sortWithinPartitions("cell"), k), k)


def filtered_topk(corpus: DataFrame, queries: DataFrame, key: str, k: int) -> DataFrame:
    """Exact top-k among the rows of ``corpus(vec_id, vector, key)`` that have the key of the query
    ``(query_id, query, key)``. Rows meet by the key before any product is taken; a key that
    holds much of the corpus is many blocks. Rows without a key are not found."""
    left = corpus.select(F.col(key).cast("string").alias("cell"), F.col("vec_id").cast("long").alias("vec_id"), "vector")
    right = queries.select(F.col(key).cast("string").alias("cell"), F.col("query_id").cast("long").alias("query_id"), "query")
    dealt = left.where("vector is not null and cell is not null").hint("rebalance", "cell").sortWithinPartitions("cell")
    asked = right.where("query is not null and cell is not null").sortWithinPartitions("cell")
    return ranked_hits(_met(dealt, asked, k), k)


class CellIndex:
    """Cells around centroids, for searches that look only at the cells nearest to a query.

    The centroids are spherical means of a bounded sample. On that sample the index also measures how many
    cells a search must probe for the wanted recall, so vectors without clusters cost more
    probes and not their neighbours. Every vector is indexed; a large cell is many blocks.
    """

    def __init__(self, corpus: DataFrame, k: int = 10, recall: float = RECALL, sample: int = SAMPLE_VECTORS, seed: int = 7):
        self.corpus = corpus.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").where("vector is not null")
        n = self.corpus.count()
        rows = self.corpus.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
        known = unit(np.array([r["vector"] for r in rows], "float64")) if rows else np.zeros((0, 1))
        self.centroids = self._fit(known, min(MAX_CELLS, max(1, math.isqrt(n))), seed)
        self.probes = self._probes(known, k, recall)

    @staticmethod
    def _fit(known: np.ndarray, cells: int, seed: int, rounds: int = 8) -> np.ndarray:
        cells = min(cells, len(known))
        centers = known[np.random.default_rng(seed).choice(len(known), cells, replace=False)] if cells else known
        for _ in range(rounds if cells else 0):
            sums = np.zeros_like(centers)
            np.add.at(sums, np.argmax(known @ centers.T, axis=1), known)
            full = np.linalg.norm(sums, axis=1) > 0
            centers = np.where(full[:, None], unit(sums), centers)
        return centers

    def _probes(self, known: np.ndarray, k: int, recall: float) -> int:
        """Cells within which the true neighbours of sampled vectors lie, nearest cells first."""
        if len(self.centroids) < 2:
            return len(self.centroids)
        asks = known[:: max(1, len(known) // 256)]
        best = np.argsort(-(asks @ known.T), axis=1)[:, 1 : k + 1]
        home = np.argmax(known @ self.centroids.T, axis=1)
        place = np.argsort(np.argsort(-(asks @ self.centroids.T), axis=1), axis=1)
        depth = np.sort(np.take_along_axis(place, home[best], axis=1).ravel())
        return int(depth[min(len(depth) - 1, math.ceil(recall * len(depth)) - 1)]) + 1

    def _cells(self, rows: DataFrame, name: str, vector: str, probes: int) -> DataFrame:
        """(cell, name, vector): a row for each of the ``probes`` nearest cells."""
        centroids = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = np.argsort(-(unit(matrix(batch.column(1))) @ centroids.T), axis=1, kind="stable")[:, :probes]
                    again = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(near.ravel(), pa.int32()), batch.column(0).take(again), batch.column(1).take(again)], ["cell", name, vector]
                    )

        kind = rows.schema[vector].dataType.simpleString()
        return rows.select(name, vector).mapInArrow(run, f"cell int, {name} long, {vector} {kind}")

    def met(self, queries: DataFrame, probes: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Corpus and queries by cell, placed so that a cell's rows lie together; a partition that
        one cell overfills is split, as blocks need not be whole cells."""
        _, queries = _sides(self.corpus, queries)
        homes = self._cells(self.corpus, "vec_id", "vector", 1).hint("rebalance", "cell").sortWithinPartitions("cell")
        return homes, self._cells(queries, "query_id", "query", probes or self.probes).sortWithinPartitions("cell")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """Top ``k`` of the probed cells. Queries that find fewer there are answered by the
        exact search."""
        if not len(self.centroids):
            return vector_topk(self.corpus, queries, k)
        near = materialize(ranked_hits(_met(*self.met(queries), k), k), "cell-hits")
        full = near.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query_id")
        short = queries.withColumn("query_id", F.col("query_id").cast("long")).join(full, "query_id", "left_anti")
        return near.join(full, "query_id", "left_semi").union(vector_topk(self.corpus, short, k))


def _lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(counts)])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)


def _counted(docs: pa.RecordBatch) -> pa.RecordBatch:
    """(doc_id, terms, n): the different words of each document and how often each is there."""
    named = docs.column("doc_id").dictionary_encode("encode")
    words = pc.ascii_split_whitespace(docs.column("content").cast(pa.string()))
    flat = pc.list_flatten(words).dictionary_encode()
    row = pc.list_parent_indices(words).to_numpy()
    kinds = max(1, len(flat.dictionary))
    keys = named.indices.to_numpy()[row] * np.int64(kinds) + flat.indices.to_numpy()
    keys, n = np.unique(keys[pc.not_equal(flat.dictionary, "").to_numpy(zero_copy_only=False)[keys % kinds]], return_counts=True)
    per = np.bincount(keys // kinds, minlength=len(named.dictionary))
    terms = flat.dictionary.take(pa.array(keys % kinds))
    return pa.RecordBatch.from_arrays([named.dictionary, _lists(terms, per), _lists(pa.array(n, pa.int64()), per)], ["doc_id", "terms", "n"])


def _merged(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Rows of one document as one: their different terms and the sums of their counts."""
    columns = [pa.concat_arrays([pc.list_flatten(r.column(c)) for r in rows]) for c in ("terms", "n")]
    sums = pa.table(columns, ["term", "n"]).group_by("term", use_threads=False).aggregate([("n", "sum")]).combine_chunks()
    terms, n = sums.column("term").combine_chunks(), sums.column("n_sum").combine_chunks()
    return pa.RecordBatch.from_arrays([rows[0].column("doc_id"), _lists(terms, [len(terms)]), _lists(n, [len(n)])], rows[0].schema.names)


def _block(block: int, rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of a block, and one row more for how many of them have each of its terms. The
    terms of a row are joined by spaces, which take less room than a list."""
    terms = pa.concat_arrays([pc.list_flatten(r.column("terms")) for r in rows]).value_counts()
    lists = (_lists(terms.field(k), [len(terms)]) for k in ("values", "counts"))
    whole = pa.RecordBatch.from_arrays([pa.nulls(1, rows[0].column("doc_id").type), *lists], rows[0].schema.names)
    for part, is_whole in [*((r, False) for r in rows), (whole, True)]:
        columns = [part.column("doc_id"), pc.binary_join(part.column("terms"), " "), part.column("n")]
        block_of, kind = pa.array(np.full(part.num_rows, block)), pa.array(np.full(part.num_rows, is_whole))
        yield pa.RecordBatch.from_arrays([block_of, *columns, kind], ["block", "doc_id", "terms", "n", "whole"])


def _term_blocks(
    batches: Iterator[pa.RecordBatch], block_terms: int = BLOCK_TERMS, split_rows: int = SPLIT_ROWS
) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over documents, rows of one id side by side: term counts in blocks of about
    ``block_terms``. A document lies in one block, also if it comes in several rows."""
    block = TaskContext.get().partitionId() << 32
    ready, size, last = [], 0, None
    for batch in batches:
        for at in range(0, batch.num_rows, split_rows):
            rows = _counted(batch.slice(at, split_rows))
            if last is not None and last.column("doc_id").equals(rows.column("doc_id").slice(0, 1)):
                # the last document goes on
                last, rows = _merged([last, rows.slice(0, 1)]), rows.slice(1)
            if not rows.num_rows:
                continue
            done = [rows.slice(0, rows.num_rows - 1)] if last is None else [last, rows.slice(0, rows.num_rows - 1)]
            last = rows.slice(rows.num_rows - 1)
            ready += done
            size += sum(len(pc.list_flatten(r.column("terms"))) for r in done)
            if size >= block_terms:
                yield from _block(block, ready)
                block, ready, size = block + 1, [], 0
    if last is not None:
        yield from _block(block, [*ready, last])


def _weights(docs: pa.Table, idf: pa.Table) -> pa.Table:
    """Weights of the documents of a block; terms that ``idf`` lacks have none."""
    terms, n = pc.list_flatten(pc.ascii_split_whitespace(docs.column("terms"))).combine_chunks(), pc.list_flatten(docs.column("n")).to_numpy()
    terms = terms.filter(pc.not_equal(terms, ""))
    row = np.repeat(np.arange(docs.num_rows), pc.list_value_length(docs.column("n")).to_numpy())
    at = pc.index_in(terms, value_set=idf.column("term").combine_chunks())
    known = pc.is_valid(at).to_numpy(zero_copy_only=False)
    at, row = at.drop_null().to_numpy(), row[known]
    w = n[known] * idf.column("idf").to_numpy()[at]
    length = np.sqrt(np.bincount(row, w * w, minlength=docs.num_rows))
    return pa.table([docs.column("doc_id").take(pa.array(row)), terms.filter(pa.array(known)), pa.array(w / length[row])], ["doc_id", "term", "weight"])


def tfidf(docs: DataFrame) -> DataFrame:
    """Unit-length TF-IDF vectors of ``docs(doc_id, content)`` as ``(doc_id, term, weight)``.

    Terms are words in lower case, every one of them kept apart. The weight is the count times
    ``ln((n + 1) / (df + 1))`` over the length of the vector; terms of weight 0 are left out. Rows of
    one ``doc_id`` are one document.

    Texts are split once, where they are read; only those whose id comes again are moved first. The
    counts are written, a row per document, in blocks of bounded size, with the different terms of
    each block. Only these meet by term; what they weigh goes back to their block, which then
    has all that its documents need.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.lower("content").alias("content"))
    again = rows.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1")
    again = materialize(again.select("_id"), "repeated-ids")
    repeated = F.col("doc_id").eqNullSafe(F.col("_id"))
    together = rows.join(again, repeated, "left_semi").repartition("doc_id").sortWithinPartitions("doc_id")
    rows = rows.join(again, repeated, "left_anti").union(together)
    counts = rows.mapInArrow(_term_blocks, f"block long, doc_id {kind}, terms string, n array<long>, whole boolean")
    counts = materialize(counts, "term-counts", "zstd")
    vectors = counts.where("not whole")
    total = vectors.agg(F.count("doc_id").alias("total"))
    parts = counts.where("whole").select("block", F.explode(F.arrays_zip(F.split("terms", " ").alias("term"), "n")).alias("part"))
    parts = parts.select("block", F.col("part.term").alias("term"), F.col("part.n").alias("df")).where("term <> ''")
    df = parts.withColumn("df", F.sum("df").over(Window.partitionBy("term"))).crossJoin(F.broadcast(total))
    idf = df.select(F.col("block").alias("home"), "term", F.log((F.col("total") + 1) / (F.col("df") + 1)).alias("idf")).where("idf <> 0")
    met = vectors.select("block", "doc_id", "terms", "n").groupBy("block").cogroup(idf.groupBy("home"))
    return met.applyInArrow(_weights, f"doc_id {kind}, term string, weight double")


def mmr(hits: DataFrame, k: int = N_RESULTS, weight: float = LAMBDA) -> DataFrame:
    """Pick ``k`` of each query's candidates, trading relevance against word overlap with
    those already picked; on equal scores the earlier candidate wins.

    ``hits(query_id, rank, vec_id, score, content)``. Groups hold one query's candidates,
    a few dozen rows by construction of the search that found them.
    """

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank").reset_index(drop=True)
        sets = [set(t.lower().split()) for t in group["content"]]
        value = group["score"].to_numpy()
        overlap = np.zeros(len(group))
        free = np.ones(len(group), dtype=bool)
        order = list(range(len(group)))
        if len(group) > k:
            order = []
            for _ in range(k):
                gain = np.where(free, weight * value - (1 - weight) * overlap, -np.inf)
                best = int(np.argmax(gain))
                order.append(best)
                free[best] = False
                for i in np.flatnonzero(free):
                    both = len(sets[i] | sets[best])
                    same = len(sets[i] & sets[best]) / both if sets[i] and sets[best] else 0.0
                    overlap[i] = max(overlap[i], same)
        out = group.loc[order, ["query_id", "vec_id", "score"]].copy()
        out["position"] = np.arange(1, len(order) + 1, dtype="int32")
        return out

    return hits.select("query_id", "rank", "vec_id", "score", "content").groupBy(
        "query_id"
    ).applyInPandas(pick, "query_id long, vec_id long, score double, position int")


def citation(source: Column, title: Column, date: Column, url: Column) -> Column:
    """``[source] title (date) — url`` without blank parts."""
    present = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(
        " ",
        F.concat(F.lit("["), source, F.lit("]")),
        present(title),
        F.concat(F.lit("("), present(date), F.lit(")")),
        F.concat(F.lit("— "), present(url)),
    )


def build_context(
    hits: DataFrame, limit: int = CONTEXT_CHARS, key: str = "query_id", order: str = "position"
) -> DataFrame:
    """Numbered passages per query up to ``limit`` characters; the first one over it is cut
    if more than 200 characters are left. ``hits`` carry ``citation, score, content``."""
    passage = F.concat(
        F.format_string("[%d] Source: %s | Score: %.3f\n", order, "citation", "score"), "content"
    )
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = hits.withColumn("_p", passage).withColumn("_sum", F.sum(F.length("_p")).over(w))
    left = limit - (F.col("_sum") - F.length("_p"))
    text = F.when(F.col("_sum") <= limit, F.col("_p")).when(
        left > CONTEXT_TAIL,
        F.concat(F.substring(F.col("_p"), F.lit(1), left.cast("int")), F.lit("...[truncated]")),
    )
    parts = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(F.col(order), text.alias("t")))))
    return d.groupBy(key).agg(parts.alias("_parts")).select(
        key,
        F.size("_parts").alias("passages"),
        F.when(F.size("_parts") == 0, NO_DOCUMENTS)
        .otherwise(F.array_join(F.transform("_parts", lambda p: p["t"]), "\n\n"))
        .alias("context"),
    )
