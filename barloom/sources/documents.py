"""Text sources brought to one document shape, dedup, and the ingestion report.

Length and count limits of the feeds are arguments; ``None`` keeps whole texts and all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import text as tx
from barloom.operators.matching import contains_join
from barloom.session import materialize

DOCS_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("doc_type", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("filing_period", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)

# Document types and the limits of each feed.
DOC_TYPES = ["10-K", "10-Q", "8-K", "news", "rss", "pdf", "earnings", "unknown"]
REMOVED = "[Removed]"
MIN_ARTICLE, MAX_ARTICLE, MAX_TITLE = 50, 5000, 200
FEED_ENTRIES, FEED_POSTS, POST_SUMMARY, MIN_POST = 50, 15, 200, 10
FLAT_TITLE, FLAT_VALUE = 500, 200
MAX_PAGES, MIN_PAGE = 50, 100


def cut(text: Column, limit: int | None) -> Column:
    return text if limit is None else F.substring(text, 1, limit)


def first_per(df: DataFrame, key: Column, order: Column) -> DataFrame:
    """First row per key by ``order``: a map-side fold, so a key with very many copies
    costs no task more than its share."""
    kept = df.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*df.columns), order).alias("_row"))
    return kept.select("_row.*")


def articles(
    df: DataFrame, limit: int | None = MAX_ARTICLE, title_chars: int | None = MAX_TITLE
) -> DataFrame:
    """News rows: titled, at least 50 clean characters, day taken from the timestamp.

    Input: ``ticker, source, title, description, content, url, published_at``.
    """
    parts = [F.coalesce(c, F.lit("")) for c in ("title", "description", "content")]
    content = tx.clean_html(F.concat_ws("\n\n", *parts))
    return (
        df.filter((F.col("title") != REMOVED) & (F.col("title") != ""))
        .withColumn("content", content)
        .filter(F.length("content") >= MIN_ARTICLE)
        .withColumns(
            {
                "content": cut(F.col("content"), limit),
                "title": cut(F.col("title"), title_chars),
                "date": F.substring("published_at", 1, 10),
                "ticker": F.upper("ticker"),
                "doc_type": F.lit("news"),
            }
        )
        .drop("description", "published_at")
    )


def mentions(
    entries: DataFrame, companies: DataFrame, per_feed: int | None = FEED_ENTRIES
) -> DataFrame:
    """``(feed, pos, ticker)`` of feed entries that name a ticker or its company, each once.

    ``entries(feed, pos, title, summary)``, ``companies(ticker, company)``.
    """
    if per_feed is not None:
        w = Window.partitionBy("feed").orderBy("pos")
        entries = entries.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_feed)
    hay = entries.select(
        "feed", "pos", F.lower(F.concat_ws(" ", "title", "summary")).alias("_hay")
    )
    names = companies.select(
        "ticker", F.explode(F.array(F.lower("ticker"), F.lower("company"))).alias("_needle")
    ).distinct()
    return contains_join(hay, "_hay", names, "_needle").select("feed", "pos", "ticker").distinct()


def posts(
    df: DataFrame,
    per_ticker: int | None = FEED_POSTS,
    summary_chars: int | None = POST_SUMMARY,
    key_chars: int | None = None,
) -> DataFrame:
    """Social posts: title plus summary when it differs, at least ten characters, one per
    url. Where there is no url the whole content tells posts apart, or its first
    ``key_chars`` characters if given.

    Input: ``ticker, pos, title, summary, url``; ``pos`` is unique and orders the feed.
    """
    if per_ticker is not None:
        w = Window.partitionBy("ticker").orderBy("pos")
        df = df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_ticker).drop("_n")
    summary = F.coalesce("summary", F.lit(""))
    content = F.when(
        (summary != "") & (summary != F.col("title")),
        F.concat("title", F.lit(" "), cut(summary, summary_chars)),
    ).otherwise(F.col("title"))
    d = df.withColumn("content", F.trim(content)).filter(F.length("content") >= MIN_POST)
    key = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.sha2(cut(F.col("content"), key_chars), 256))
    kept = first_per(d, F.struct(F.col("ticker"), key), F.col("pos"))
    return kept.drop("summary").withColumn("doc_type", F.lit("news"))


def paged(df: DataFrame, max_pages: int | None = MAX_PAGES) -> DataFrame:
    """Page texts to documents; pages under 100 characters are dropped.

    Input: ``ticker, doc, page_no, text, title, created`` with ``page_no`` from 1.
    """
    if max_pages is not None:
        df = df.filter(F.col("page_no") <= max_pages)
    return df.filter(F.length(F.trim("text")) >= MIN_PAGE).select(
        "ticker",
        "doc",
        F.col("page_no").alias("page_number"),
        F.trim("text").alias("content"),
        F.format_string("%s — Page %d", "title", "page_no").alias("title"),
        tx.pdf_date(F.col("created")).alias("date"),
        F.lit("pdf").alias("doc_type"),
    )


def to_docs(df: DataFrame) -> DataFrame:
    """Add the content id and the missing columns of the document shape."""
    d = df.withColumn("doc_id", tx.content_id(F.col("content")))
    for f in DOCS_SCHEMA:
        if f.name not in d.columns:
            d = d.withColumn(f.name, F.lit(None).cast(f.dataType))
    return d.select(*[F.col(f.name).cast(f.dataType) for f in DOCS_SCHEMA])


def union_sources(*sources: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(to_docs, sources))


def marked(docs: DataFrame) -> DataFrame:
    """Documents with the ``error`` that makes one unusable, or null; one bad source stops no other."""
    reason = (
        F.when(F.col("content").isNull() | (F.trim("content") == ""), "empty content")
        .when(F.col("date").try_cast("date").isNull(), "bad date")
        .when(~F.col("doc_type").isin(DOC_TYPES), "unknown document type")
    )
    return docs.withColumn("error", reason)


def land(docs: DataFrame) -> DataFrame:
    """``docs`` marked, numbered by ``row`` and written: every later step reads the columns it needs
    from there, and no source is read and cleaned again."""
    return materialize(marked(docs).withColumn("row", F.monotonically_increasing_id()), "landed")


def dedup(docs: DataFrame, order: Column, by_url: bool = True) -> DataFrame:
    """One document per content id, then one per url; the first by ``order`` wins."""
    d = first_per(docs, F.col("doc_id"), order)
    if not by_url:
        return d
    key = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.col("doc_id"))
    return first_per(d, key, order)


def newest(docs: DataFrame, limit: int) -> DataFrame:
    return docs.orderBy(F.col("date").desc(), "doc_id").limit(limit)


def ingest_report(landed: DataFrame, kept: DataFrame, chunks: DataFrame) -> DataFrame:
    """Counts per ticker across the stages, the sources seen and distinct error reasons.

    ``landed`` as ``land`` gives it; ``kept`` and ``chunks`` carry the ticker. The three are
    folded map-side and meet as a handful of rows per ticker.
    """
    none = lambda t: F.lit(None).cast(t)
    rows = [
        landed.select("ticker", F.lit(0).alias("stage"), "doc_type", "error"),
        kept.select("ticker", F.lit(1).alias("stage"), none("string"), none("string")),
        chunks.select("ticker", F.lit(2).alias("stage"), none("string"), none("string")),
    ]
    n = lambda i: F.count_if(F.col("stage") == i)
    return reduce(lambda a, b: a.union(b), rows).groupBy("ticker").agg(
        n(0).alias("documents_loaded"),
        F.sort_array(F.collect_set("doc_type")).alias("kinds"),
        n(1).alias("documents_kept"),
        n(2).alias("chunks"),
        F.when(F.count("error") > 0, F.sort_array(F.collect_set("error"))).alias("errors"),
    )


def flatten(
    docs: DataFrame, title_chars: int | None = FLAT_TITLE, value_chars: int | None = FLAT_VALUE
) -> DataFrame:
    """Document metadata as one string map; extra keys get a prefix. Titles and extra values
    are cut at the given lengths, or kept whole where a length is None."""
    plain = [c for c in ("ticker", "source", "doc_type", "date", "url") if c in docs.columns]
    base = [F.lit(x) if i % 2 == 0 else F.coalesce(F.col(x), F.lit("")) for c in plain for i, x in enumerate((c, c))]
    base += [F.lit("title"), cut(F.coalesce("title", F.lit("")), title_chars)]
    base += [F.lit("filing_period"), F.coalesce("filing_period", F.lit(""))]
    base += [F.lit("page_number"), F.coalesce(F.col("page_number").cast("string"), F.lit("0"))]
    extra = F.transform_keys(
        F.coalesce("extra", F.create_map().cast("map<string,string>")),
        lambda k, v: F.concat(F.lit("extra_"), k),
    )
    extra = F.transform_values(extra, lambda k, v: cut(v, value_chars))
    return docs.withColumn("flat", F.map_concat(F.create_map(*base), extra))


def unflatten(df: DataFrame) -> DataFrame:
    """Rebuild metadata columns from a ``flat`` map."""
    flat = F.col("flat")
    extra = F.transform_keys(
        F.map_filter(flat, lambda k, v: k.startswith("extra_")), lambda k, v: F.regexp_replace(k, "^extra_", "")
    )
    names = ("ticker", "source", "doc_type", "date", "url", "title", "filing_period")
    cols = {c: F.coalesce(flat[c], F.lit("unknown" if c == "doc_type" else "")) for c in names}
    cols["page_number"] = F.coalesce(flat["page_number"].try_cast("int"), F.lit(0))
    return df.withColumns(cols | {"extra": extra}).drop("flat")


def metadata_filter(
    df: DataFrame,
    ticker: str | None = None,
    doc_types: list[str] | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """Conjunction of the given conditions. Those on stored columns reach the scan."""
    conditions = []
    if ticker:
        conditions.append(F.col("ticker") == ticker.upper())
    if doc_types:
        conditions.append(F.col("doc_type").isin(doc_types))
    if date_from:
        conditions.append(F.col("date") >= date_from)
    if date_to:
        conditions.append(F.col("date") <= date_to)
    return df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df
