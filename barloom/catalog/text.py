"""Documents: sources, cleaning, dedup, chunks, sentiment, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.registry import query
from barloom.functions import text as tx
from barloom import plugins
from barloom.operators import chunking, retrieval, sentiment
from barloom.sources import chunk_store, documents, filings
from barloom.catalog.views import prose
from barloom.session import materialize
from barloom.sources.bars import balanced, table


# --- views -----------------------------------------------------------------------------


def lines(text):
    return F.split(text, "\n")


def raw_articles(spark, d):
    """Documents as news rows: first line as title, the rest as content."""
    t = F.col("text")
    return prose(spark, d).select(
        F.col("doc_id").alias("pos"),
        F.col("source").alias("ticker"),
        F.col("lang").alias("source"),
        F.when((F.col("lang") == "es") & (F.col("source") == "src3"), documents.REMOVED)
        .otherwise(F.element_at(lines(t), 1))
        .alias("title"),
        F.lit("").alias("description"),
        t.alias("content"),
        F.concat(F.lit("https://example.com/"), F.sha2(t, 256)).alias("url"),
        F.concat(
            F.date_format(
                F.date_add(F.lit("2024-01-01").cast("date"), F.col("doc_id").cast("int")), "yyyy-MM-dd"
            ),
            F.lit("T10:00:00Z"),
        ).alias("published_at"),
    )


def sql_clean(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for a, b in tx.ENTITIES:
        x = f"replace({x}, '{a}', '{b}')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


SQL_ARTICLES = f"""
raw AS (
  SELECT doc_id AS pos, source AS ticker, lang AS source,
    CASE WHEN lang = 'es' AND source = 'src3' THEN '[Removed]' ELSE string_split(text, chr(10))[1] END
      AS title, text AS content, 'https://example.com/' || sha256(text) AS url,
    strftime(DATE '2024-01-01' + doc_id::INT, '%Y-%m-%d') AS date FROM documents),
art AS (
  SELECT pos, upper(ticker) AS ticker, source, title, url, date, content FROM (
    SELECT * REPLACE ({sql_clean("title || chr(10) || chr(10) || '' || chr(10) || chr(10) || content")}
      AS content) FROM raw WHERE title NOT IN ('[Removed]', ''))
  WHERE length(content) >= 50)"""


def articles(spark, d):
    return documents.articles(raw_articles(spark, d), limit=None, title_chars=None)


@query(
    "article_normalize",
    f"WITH {SQL_ARTICLES} SELECT pos, ticker, source, title, content, url, date, 'news' AS doc_type FROM art",
)
def article_normalize(spark, d):
    return articles(spark, d)


@query(
    "filing_select",
    """
WITH f AS (
  SELECT o_custkey, o_orderdate, o_orderkey, unnest([0, 1, 2, 3]) AS pos, o_orderpriority, o_orderstatus
  FROM orders),
e AS (
  SELECT lpad(o_custkey::VARCHAR, 10, '0') AS ticker, o_orderdate AS fed, o_orderkey AS feed, pos,
    CASE pos WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' WHEN 2 THEN o_orderpriority ELSE '8-K' END AS form,
    CASE WHEN pos = 3 AND o_orderstatus = 'P' THEN 'n/a'
      ELSE strftime(o_orderdate + to_days(pos * 30), '%Y-%m-%d') END AS filing_date,
    o_orderkey || '-' || pos AS accession FROM f),
k AS (
  SELECT *, row_number() OVER (PARTITION BY ticker, form ORDER BY fed DESC, feed, pos)::INT AS rank FROM e
  WHERE form IN ('10-K', '10-Q', '8-K') AND try_cast(filing_date AS DATE) >= DATE '2000-12-31' - 365)
SELECT ticker, feed, pos::INT AS pos, form, filing_date, accession, accession || '.htm' AS document, rank
FROM k WHERE rank <= 3""",
)
def filing_select(spark, d):
    """Each order is a small filing index with four entries."""
    day = lambda n: F.date_format(F.col("o_orderdate") + F.expr(f"INTERVAL {n} DAYS"), "yyyy-MM-dd")
    text = lambda *parts: F.concat(*[F.col(p) if p[0] == "o" else F.lit(p) for p in parts])
    body = F.to_json(
        F.struct(
            F.array(F.lit("10-K"), F.lit("10-Q"), F.col("o_orderpriority"), F.lit("8-K")).alias("form"),
            F.array(
                day(0), day(30), day(60),
                F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(day(90)),
            ).alias("filingDate"),
            F.array(*[text("o_orderkey", f"-{i}") for i in range(4)]).alias("accessionNumber"),
            F.array(*[text("o_orderkey", f"-{i}.htm") for i in range(4)]).alias("primaryDocument"),
        )
    )
    feeds = table(spark, d, "orders").select(
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("ticker"),
        F.col("o_orderdate").alias("_at"),
        F.col("o_orderkey").alias("feed"),
        body.alias("body"),
    )
    rows = filings.entries(feeds).withColumn("_age", -F.unix_timestamp(F.col("_at").cast("timestamp")))
    out = filings.select_filings(
        rows, F.lit("2000-12-31").cast("date"), 3, ["_age", "feed", "pos"]
    )
    return out.drop("_at", "_age")


@query(
    "mention_join",
    """
WITH c AS (
  SELECT DISTINCT lower(string_split(text, ' ')[1]) AS ticker,
    lower(string_split(text, ' ')[2] || ' ' || string_split(text, ' ')[3]) AS company FROM benchmark),
e AS (SELECT source AS feed, doc_id AS pos, lower(string_split(text, chr(10))[1] || ' ' || text) AS hay
      FROM documents)
SELECT DISTINCT feed, pos, ticker FROM e JOIN c ON contains(hay, ticker) OR contains(hay, company)""",
)
def mention_join(spark, d):
    entries = prose(spark, d).select(
        F.col("source").alias("feed"),
        F.col("doc_id").alias("pos"),
        F.element_at(lines(F.col("text")), 1).alias("title"),
        F.col("text").alias("summary"),
    )
    w = F.split("text", " ")
    companies = table(spark, d, "benchmark").select(
        F.lower(w[0]).alias("ticker"), F.lower(F.concat_ws(" ", w[1], w[2])).alias("company")
    ).distinct()
    return documents.mentions(entries, companies, per_feed=None).select("feed", "pos", "ticker")


@query(
    "post_normalize",
    """
WITH p AS (
  SELECT role AS ticker, conv_id * 1000 + turn AS pos, string_split(text, chr(10))[1] AS title,
    text AS summary, CASE WHEN turn = 0 THEN 'https://example.com/c/' || conv_id ELSE '' END AS url
  FROM conversations),
c AS (
  SELECT *, trim(CASE WHEN summary <> '' AND summary <> title THEN title || ' ' || summary ELSE title END)
    AS content FROM p),
k AS (
  SELECT *, row_number() OVER (PARTITION BY ticker, CASE WHEN url <> '' THEN url ELSE content END
                               ORDER BY pos) AS rn FROM c WHERE length(content) >= 10)
SELECT ticker, pos, title, url, content, 'news' AS doc_type FROM k WHERE rn = 1""",
)
def post_normalize(spark, d):
    link = F.concat(F.lit("https://example.com/c/"), F.col("conv_id"))
    posts = table(spark, d, "conversations").select(
        F.col("role").alias("ticker"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"),
        F.element_at(lines(F.col("text")), 1).alias("title"),
        F.col("text").alias("summary"),
        F.when(F.col("turn") == 0, link).otherwise("").alias("url"),
    )
    return documents.posts(posts, per_ticker=None, summary_chars=None)


@query(
    "paged_docs",
    """
WITH p AS (
  SELECT doc_id AS doc, source AS ticker, unnest(string_split(text, chr(10))) AS t,
         generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT ticker, doc, n::INT AS page_number, trim(t) AS content,
  'Report ' || doc || ' — Page ' || n AS title,
  strftime(DATE '2023-01-01' + doc::INT, '%Y-%m-%d') AS date, 'pdf' AS doc_type
FROM p WHERE length(trim(t)) >= 100""",
)
def paged_docs(spark, d):
    made = F.date_add(F.lit("2023-01-01").cast("date"), F.col("doc_id").cast("int"))
    pages = prose(spark, d).select(
        F.col("source").alias("ticker"),
        F.col("doc_id").alias("doc"),
        F.posexplode(lines(F.col("text"))).alias("_n", "text"),
        F.concat(F.lit("Report "), F.col("doc_id")).alias("title"),
        F.concat(F.lit("D:"), F.date_format(made, "yyyyMMdd"), F.lit("120000Z")).alias("created"),
    )
    return documents.paged(pages.withColumn("page_no", F.col("_n") + 1), max_pages=None)


# --- union, dedup, store ---------------------------------------------------------------


def landed(spark, d):
    """Articles and pages as one document set; plain-http pages carry unreadable dates."""
    news = articles(spark, d)
    pages = balanced(table(spark, d, "pages")).select(
        F.concat(F.lit("SRC"), F.pmod("page_id", F.lit(20))).alias("ticker"),
        F.lit("web").alias("source"),
        F.lit("unknown").alias("doc_type"),
        F.when(F.col("url").startswith("https"), "2024-03-01").otherwise("yesterday").alias("date"),
        "url",
        tx.html_to_text(F.col("html")).alias("content"),
    )
    return documents.union_sources(news, pages)


def sql_html(x: str) -> str:
    for a, b in (
        (r"<\?xml[^>]*\?>", ""),
        ("<!DOCTYPE[^>]*>", ""),
        ("(?is)<script[^>]*>.*?</script>", " "),
        ("(?is)<style[^>]*>.*?</style>", " "),
        ("<[^>]+>", " "),
    ):
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    for a, b in tx.ENTITIES + [tx.QUOTE]:
        x = f"replace({x}, '{a}', '{b}')"
    x = f"regexp_replace({x}, '[ \\t\\f\\r]+', ' ', 'g')"
    return rf"""trim(array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda s: trim(s)),
      lambda s: length(s) > 10 AND NOT regexp_matches(s, '^[\d\s\-\.\,\$\%]+$')), chr(10)))"""


SQL_LANDED = (
    SQL_ARTICLES
    + f""",
landed AS (
  SELECT left(sha256(content), 16) AS doc_id, content, ticker, source, 'news' AS doc_type, date, url, title
  FROM art
  UNION ALL
  SELECT left(sha256(c), 16), c, 'SRC' || (page_id % 20), 'web', 'unknown',
    CASE WHEN starts_with(url, 'https') THEN '2024-03-01' ELSE 'yesterday' END, url, NULL
  FROM (SELECT *, {sql_html('html')} AS c FROM pages)),
marked AS (
  SELECT *, CASE WHEN content IS NULL OR trim(content) = '' THEN 'empty content'
    WHEN try_cast(date AS DATE) IS NULL THEN 'bad date' END AS error FROM landed),
good AS (SELECT * FROM marked WHERE error IS NULL),
d1 AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY date, url, ticker) = 1),
d2 AS (SELECT * FROM d1 QUALIFY row_number() OVER (
         PARTITION BY CASE WHEN url <> '' THEN url ELSE doc_id END ORDER BY date, url, ticker) = 1)"""
)

def arrival():
    """Order in which copies of a document compete; the first wins."""
    return F.struct("date", "url", "ticker")


@query(
    "union_sources",
    f"""WITH {SQL_LANDED}
SELECT doc_id, ticker, source, doc_type, date, url, title, length(content)::INT AS chars, error FROM marked""",
)
def union_sources(spark, d):
    return documents.marked(landed(spark, d)).select(
        "doc_id", "ticker", "source", "doc_type", "date", "url", "title",
        F.length("content").alias("chars"), "error",
    )


def turn_documents(turns):
    """A batch of turns as documents."""
    import pyarrow as pa
    import pyarrow.compute as pc

    role, text = turns.column("role").cast("string"), turns.column("text").cast("string")
    url = pc.binary_join_element_wise(
        "https://example.com/c", turns.column("conv_id").cast("string"), turns.column("turn").cast("string"), "/"
    )
    day, source = (pa.array([value] * turns.num_rows, "string") for value in ("2024-02-01", "turns"))
    return pa.RecordBatch.from_arrays([text, pc.utf8_upper(role), source, day, url], ["content", "ticker", "source", "date", "url"])


def benchmark_documents(spark, options: dict):
    """A loader made of column expressions."""
    return spark.read.parquet(options["path"]).select(
        F.col("text").alias("content"), F.lit("BENCH").alias("ticker"), F.lit("benchmark").alias("source"),
        F.lit("2024-02-02").alias("date"), F.concat(F.lit("https://example.com/b/"), "item_id").alias("url"),
    )


plugins.register_parquet_source(
    "conversation_turns", ["conv_id", "turn", "role", "text"],
    "content string, ticker string, source string, date string, url string", turn_documents,
)
plugins.register_loader("benchmark_items", benchmark_documents)


@query(
    "plugin_sources",
    """
SELECT left(sha256(text), 16) AS doc_id, upper(role) AS ticker, 'turns' AS source, '2024-02-01' AS date,
  'https://example.com/c/' || conv_id || '/' || turn AS url, length(text)::INT AS chars FROM conversations
UNION ALL
SELECT left(sha256(text), 16), 'BENCH', 'benchmark', '2024-02-02', 'https://example.com/b/' || item_id, length(text)::INT FROM benchmark""",
)
def plugin_sources(spark, d):
    """Documents of two loaders that users have registered, one of them a Python data source."""
    options = {"conversation_turns": {"path": f"{d}/conversations.parquet"}, "benchmark_items": {"path": f"{d}/benchmark.parquet"}}
    docs = plugins.load_all(spark, options)
    return docs.select("doc_id", "ticker", "source", "date", "url", F.length("content").alias("chars"))


@query("doc_dedup", f"WITH {SQL_LANDED} SELECT doc_id, ticker, source, date, url FROM d2")
def doc_dedup(spark, d):
    good = documents.marked(landed(spark, d)).where("error is null")
    return documents.dedup(good.select("doc_id", "ticker", "source", "date", "url"), arrival())


@query(
    "newest_docs",
    f"WITH {SQL_LANDED} SELECT doc_id, ticker, date FROM d2 ORDER BY date DESC, doc_id LIMIT 50",
)
def newest_docs(spark, d):
    good = documents.marked(landed(spark, d)).where("error is null")
    kept = documents.dedup(good.select("doc_id", "ticker", "date", "url"), arrival())
    return documents.newest(kept, 50).select("doc_id", "ticker", "date")


SQL_FIXED = """
ck AS (
  SELECT doc_id, ticker, unnest(range(0, length(content), 800)) AS start, content FROM d2)"""


@query(
    "ingest_report",
    f"""WITH {SQL_LANDED}, {SQL_FIXED},
a AS (SELECT ticker, count(*) AS documents_loaded, list_sort(list(DISTINCT doc_type)) AS k FROM marked
      GROUP BY ticker),
b AS (SELECT ticker, count(*) AS n FROM d2 GROUP BY ticker),
c AS (SELECT ticker, count(*) AS n FROM ck GROUP BY ticker),
e AS (SELECT ticker, list_sort(list(DISTINCT error)) AS errs FROM marked WHERE error IS NOT NULL
      GROUP BY ticker)
SELECT a.ticker, documents_loaded, array_to_string(k, ',') AS kinds, coalesce(b.n, 0) AS documents_kept,
  coalesce(c.n, 0) AS chunks, array_to_string(errs, ',') AS errors
FROM a LEFT JOIN b USING (ticker) LEFT JOIN c USING (ticker) LEFT JOIN e USING (ticker)""",
)
def ingest_report(spark, d):
    docs = documents.land(landed(spark, d))
    good = docs.where("error is null").select("row", "doc_id", "ticker", "date", "url")
    kept = materialize(documents.dedup(good, arrival()).select("row", "ticker"), "kept")
    texts = docs.join(kept.select("row"), "row", "left_semi").select("row", F.col("row").alias("doc_id"), "content")
    chunks = chunking.fixed_chunks(texts).select(F.col("doc_id").alias("row")).join(kept, "row")
    out = documents.ingest_report(docs, kept, chunks)
    return out.withColumns(
        {"kinds": F.array_join("kinds", ","), "errors": F.array_join("errors", ",")}
    )


def stored_chunks(spark, d):
    """Lines of documents as stored chunks."""
    return prose(spark, d).select(
        F.col("source").alias("ticker"),
        F.col("doc_id").alias("parent_doc_id"),
        F.posexplode(lines(F.col("text"))).alias("_i", "content"),
        F.lit(0).cast("long").alias("version"),
    ).withColumn(
        "chunk_id", F.format_string("%d_chunk_%04d", "parent_doc_id", "_i")
    ).drop("_i")


def fresh_chunks(spark, d):
    """Second versions of the chunks of labelled documents."""
    return stored_chunks(spark, d).join(
        table(spark, d, "labels").select(
            F.col("doc_id").alias("parent_doc_id"), (F.col("quality") + 1).alias("_v")
        ),
        "parent_doc_id",
    ).withColumns({"content": F.reverse("content"), "version": F.col("_v").cast("long")}).drop("_v")


SQL_STORED = """
st0 AS (
  SELECT source AS ticker, doc_id AS parent_doc_id, unnest(string_split(text, chr(10))) AS content,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
st AS (SELECT ticker, parent_doc_id, content, printf('%d_chunk_%04d', parent_doc_id, i) AS chunk_id FROM st0)"""


@query(
    "upsert_chunks",
    f"""WITH {SQL_STORED}
SELECT chunk_id, ticker, parent_doc_id, CASE WHEN quality IS NULL THEN content ELSE array_to_string(
    list_reverse(string_split(content, '')), '') END AS content, coalesce(quality + 1, 0)::BIGINT AS version
FROM st LEFT JOIN labels ON doc_id = parent_doc_id""",
)
def upsert_chunks(spark, d):
    return chunk_store.upsert(stored_chunks(spark, d), fresh_chunks(spark, d))


SQL_TOXIC = """
tox AS (SELECT source AS ticker FROM documents JOIN labels USING (doc_id) GROUP BY source
        HAVING avg(toxic) > 0.05)"""


def toxic_sources(spark, d):
    docs = prose(spark, d).select("doc_id", F.col("source").alias("ticker"))
    share = docs.join(table(spark, d, "labels"), "doc_id").groupBy("ticker").agg(
        F.avg("toxic").alias("_share")
    )
    return share.filter(F.col("_share") > 0.05).select("ticker")


@query(
    "delete_by_key",
    f"""WITH {SQL_STORED}, {SQL_TOXIC}
SELECT chunk_id, ticker FROM st WHERE ticker NOT IN (SELECT ticker FROM tox)""",
)
def delete_by_key(spark, d):
    left = chunk_store.delete_keys(stored_chunks(spark, d), toxic_sources(spark, d))
    return left.select("chunk_id", "ticker")


@query(
    "deleted_counts",
    f"""WITH {SQL_STORED}, {SQL_TOXIC}
SELECT ticker, count(*) AS deleted FROM st JOIN tox USING (ticker) GROUP BY ticker""",
)
def deleted_counts(spark, d):
    return chunk_store.deleted_counts(stored_chunks(spark, d), toxic_sources(spark, d))


@query(
    "store_stats",
    f"""WITH {SQL_STORED}
SELECT ticker, count(*) AS chunks, count(DISTINCT parent_doc_id) AS documents,
       sum(length(content))::BIGINT AS chars FROM st GROUP BY ticker""",
)
def store_stats(spark, d):
    return chunk_store.stats(stored_chunks(spark, d))


@query(
    "chunk_exists",
    f"""WITH {SQL_STORED}
SELECT chunk_id FROM (SELECT DISTINCT doc_id || '_chunk_0002' AS chunk_id FROM labels)
WHERE chunk_id IN (SELECT chunk_id FROM st)""",
)
def chunk_exists(spark, d):
    ids = table(spark, d, "labels").select(
        F.concat(F.col("doc_id"), F.lit("_chunk_0002")).alias("chunk_id")
    ).distinct()
    return chunk_store.existing(ids, stored_chunks(spark, d))


@query(
    "new_docs",
    "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def new_docs(spark, d):
    first = F.concat(F.col("doc_id"), F.lit("_chunk_0000"))
    stored = table(spark, d, "labels").select(first.alias("chunk_id"))
    docs = prose(spark, d).select("doc_id", "source")
    return chunk_store.missing(docs, stored, first)


@query(
    "metadata_filter",
    f"""WITH {SQL_LANDED} SELECT doc_id, ticker, doc_type, date, url FROM landed
WHERE ticker = 'SRC7' AND doc_type IN ('news', '10-K') AND date >= '2024-02-01' AND date <= '2026-06-30'""",
)
def metadata_filter(spark, d):
    out = documents.metadata_filter(
        landed(spark, d), "src7", ["news", "10-K"], "2024-02-01", "2026-06-30"
    )
    return out.select("doc_id", "ticker", "doc_type", "date", "url")


@query(
    "metadata_flatten",
    f"""WITH {SQL_LANDED}
SELECT doc_id, ticker, date, coalesce(url, '') AS url, coalesce(title, '') AS title, '0' AS page_number,
  source AS extra_feed, length(content)::VARCHAR AS extra_chars, 10::INT AS n_keys, true AS round_trip
FROM landed""",
)
def metadata_flatten(spark, d):
    extra = F.create_map(F.lit("feed"), F.col("source"), F.lit("chars"), F.length("content").cast("string"))
    docs = landed(spark, d).withColumn("extra", extra)
    flat = documents.flatten(docs, None, None).select("doc_id", F.col("ticker").alias("_t"), "flat", F.col("extra").alias("_x"))
    back = documents.unflatten(flat.withColumn("_f", F.col("flat")))
    same = (F.col("ticker") == F.col("_t")) & (F.to_json("extra") == F.to_json("_x"))
    pick = lambda k: F.col("_f")[k].alias(k)
    return back.select(
        "doc_id", "ticker", "date", "url", "title", pick("page_number"), pick("extra_feed"),
        pick("extra_chars"), F.size("_f").alias("n_keys"), same.alias("round_trip"),
    )


# --- cleaning and counts ---------------------------------------------------------------


@query("html_to_text", f"SELECT page_id, {sql_html('html')} AS text FROM pages")
def html_to_text(spark, d):
    return balanced(table(spark, d, "pages")).select("page_id", tx.html_to_text(F.col("html")).alias("text"))


@query("clean_html", f"SELECT page_id, {sql_clean('html')} AS text FROM pages")
def clean_html(spark, d):
    return balanced(table(spark, d, "pages")).select("page_id", tx.clean_html(F.col("html")).alias("text"))


SQL_WORDS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')"


@query(
    "doc_counts",
    f"""SELECT doc_id, len({SQL_WORDS.format('text')})::INT AS words, length(text)::INT AS chars,
  left(sha256(text), 16) AS content_id FROM documents""",
)
def doc_counts(spark, d):
    t = F.col("text")
    return prose(spark, d).select(
        "doc_id",
        tx.word_count(t).alias("words"),
        F.length(t).alias("chars"),
        tx.content_id(t).alias("content_id"),
    )


@query(
    "parse_dates",
    """
SELECT event_id, CASE event_id % 5 WHEN 4 THEN '2024-06-30' ELSE strftime(ts, '%Y-%m-%d') END AS day
FROM events""",
)
def parse_dates(spark, d):
    """Event times written in the four feed formats and one unreadable one."""
    ts = F.col("ts")
    forms = [
        F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss '+0000'"),
        F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+0000'"),
        F.date_format(ts, "yyyy-MM-dd"),
        F.date_format(ts, "dd/MM/yyyy"),
    ]
    text = F.element_at(F.array(*forms), (F.col("event_id") % 5 + 1).cast("int"))
    day = tx.feed_date(text, F.lit("2024-06-30").cast("date"))
    return table(spark, d, "events").select("event_id", day.alias("day"))


@query(
    "parse_signal",
    """
WITH c AS (
  SELECT conv_id, turn, upper(CASE WHEN turn % 4 = 1 THEN 'Signal: sell. ' ELSE '' END
    || replace(replace(replace(lower(text), 'the', 'buy'), 'of', 'sell'), 'an', 'hold')) AS u
  FROM conversations),
n AS (
  SELECT *, len(regexp_extract_all(u, 'BUY')) AS b, len(regexp_extract_all(u, 'SELL')) AS s,
    len(regexp_extract_all(u, 'HOLD')) AS h FROM c)
SELECT conv_id, turn, CASE
  WHEN contains(u, 'SIGNAL: BUY') OR starts_with(u, 'BUY') THEN 'BUY'
  WHEN contains(u, 'SIGNAL: SELL') OR starts_with(u, 'SELL') THEN 'SELL'
  WHEN contains(u, 'SIGNAL: HOLD') OR starts_with(u, 'HOLD') THEN 'HOLD'
  WHEN b > s AND b > h THEN 'BUY' WHEN s > b AND s > h THEN 'SELL' ELSE 'HOLD' END AS signal
FROM n""",
)
def parse_signal(spark, d):
    """Conversations with frequent syllables swapped for signal words."""
    t = F.lower("text")
    for a, b in (("the", "buy"), ("of", "sell"), ("an", "hold")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.concat(F.when(F.col("turn") % 4 == 1, "Signal: sell. ").otherwise(""), t)
    return table(spark, d, "conversations").select(
        "conv_id", "turn", tx.parse_signal(t).alias("signal")
    )


# --- chunks ----------------------------------------------------------------------------


def content_docs(spark, d):
    return prose(spark, d).select("doc_id", F.col("text").alias("content"))


@query("chunk_documents")
def chunk_documents(spark, d):
    return chunking.chunk(content_docs(spark, d))


@query(
    "fixed_chunks",
    """
WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 800)) AS start FROM documents)
SELECT doc_id, (start // 800)::INT AS chunk_index, substring(text, start + 1, 1000) AS content FROM c
WHERE length(text) > 0""",
)
def fixed_chunks(spark, d):
    return chunking.fixed_chunks(content_docs(spark, d))


# --- sentiment -------------------------------------------------------------------------

# Frequent words of the supplied prose join the lists, which it would otherwise never hit.
GOOD = sentiment.POSITIVE + ["the", "les", "der", "los", "with"]
BAD = sentiment.NEGATIVE + ["of", "que", "und", "de", "for"]

SQL_SENTENCES = r"""
sp AS (
  SELECT doc_id, source, lang, list_filter(list_transform(regexp_split_to_array(regexp_replace(
    regexp_replace(regexp_replace(text, '\[Source \d+\][^\n]*\n?', '', 'g'), '---+', '', 'g'),
    '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')),
    lambda s: length(s) >= 8 AND NOT starts_with(s, '[') AND NOT regexp_matches(s, '^[\d\s\$\%\.\,]+$')) AS l
  FROM documents),
sents AS (SELECT doc_id, source, lang, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS pos FROM sp)"""


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


SQL_SCORED = (
    SQL_SENTENCES
    + f""",
sw AS (SELECT *, list_distinct({SQL_WORDS.format('lower(sentence)')}) AS ws FROM sents),
sc AS (SELECT *, len(list_intersect(ws, {sql_list(GOOD)})) AS p,
         len(list_intersect(ws, {sql_list(BAD)})) AS n FROM sw),
scored AS (
  SELECT doc_id, source, lang, pos, sentence, CASE WHEN p + n = 0 THEN 0 ELSE (p - n) / (p + n) END AS score,
    CASE WHEN p + n = 0 THEN 0.3 ELSE least(0.7, (p + n) * 0.15) END::DOUBLE AS confidence
  FROM sc)"""
)


def doc_sentences(spark, d):
    return sentiment.sentences(
        prose(spark, d), ["doc_id", "source", "lang"], "text", limit=None, chars=None
    )


def doc_scores(spark, d):
    return sentiment.scored(doc_sentences(spark, d), GOOD, BAD)


@query(
    "sentences", f"WITH {SQL_SENTENCES} SELECT doc_id, pos::INT AS pos, sentence FROM sents"
)
def sentences(spark, d):
    return doc_sentences(spark, d).select("doc_id", "pos", "sentence")


@query(
    "sentence_sentiment",
    f"""WITH {SQL_SCORED} SELECT doc_id, pos::INT AS pos, round(score, 6)::DOUBLE AS score,
  round(confidence, 6) AS confidence FROM scored""",
)
def sentence_sentiment(spark, d):
    return doc_scores(spark, d).select(
        "doc_id", "pos", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence")
    )


def sql_sentiment(key: str, out: str = "sent") -> str:
    return f"""
{out}0 AS (SELECT {key}, sum(score * confidence) / sum(confidence) AS s, avg(confidence) AS c, count(*) AS n
         FROM scored GROUP BY {key}),
{out} AS (
  SELECT {key}, greatest(-1, least(1, s)) AS sentiment_score, c AS confidence, n AS sentences,
    CASE WHEN s > 0.15 THEN 'BULLISH' WHEN s < -0.15 THEN 'BEARISH' ELSE 'NEUTRAL' END AS sentiment_label
  FROM {out}0)"""


@query(
    "sentiment_score",
    f"""WITH {SQL_SCORED}, {sql_sentiment("source, lang")}
SELECT source, lang, round(sentiment_score, 6)::DOUBLE AS sentiment_score,
  round(confidence, 6) AS confidence, sentences, sentiment_label FROM sent""",
)
def sentiment_score(spark, d):
    out = sentiment.aggregate(doc_scores(spark, d), ["source", "lang"])
    return out.withColumns(
        {
            "sentiment_score": F.round("sentiment_score", 6),
            "confidence": F.round("confidence", 6),
        }
    )


@query(
    "top_sentences",
    f"""WITH {SQL_SCORED},
r AS (
  SELECT *, CASE WHEN score > 0 THEN 'positive' ELSE 'negative' END AS side,
    row_number() OVER (PARTITION BY doc_id, score > 0 ORDER BY abs(score) DESC, pos)::INT AS rank
  FROM scored WHERE score <> 0)
SELECT doc_id, side, rank, sentence AS text, round(score, 3)::DOUBLE AS score FROM r WHERE rank <= 3""",
)
def top_sentences(spark, d):
    return sentiment.top_sentences(doc_scores(spark, d), ["doc_id"], chars=None)


# --- retrieval -------------------------------------------------------------------------


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")


SQL_TOPK = """
ex AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
mean AS (SELECT label, i, avg(v) AS m FROM ex GROUP BY label, i),
qv AS (SELECT label AS query_id, list(m ORDER BY i) AS q FROM mean GROUP BY label),
cs AS (
  SELECT query_id::BIGINT AS query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS cos
  FROM embeddings CROSS JOIN qv),
topk AS (
  SELECT *, 1 - (1 - cos) / 2 AS score, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, vec_id)
    ::INT AS rank FROM cs)"""


def label_hits(spark, d, k: int):
    v = vectors(spark, d)
    return retrieval.vector_topk(v, retrieval.centroids(v, "label", "vector"), k)


@query(
    "vector_topk",
    f"""WITH {SQL_TOPK} SELECT query_id, vec_id, rank, round(1 - cos, 6) AS distance,
  round(score, 6) AS score FROM topk WHERE rank <= 10""",
)
def vector_topk(spark, d):
    return label_hits(spark, d, 10).withColumns(
        {"distance": F.round("distance", 6), "score": F.round("score", 6)}
    )


@query("vector_topk_lsh")
def vector_topk_lsh(spark, d):
    """Approximate search through cells; its recall is tested against the exact one."""
    v = vectors(spark, d)
    return retrieval.CellIndex(v).search(retrieval.centroids(v, "label", "vector"), 10)


@query(
    "tfidf_vectors",
    f"""
WITH w AS (SELECT doc_id, unnest({SQL_WORDS.format('lower(text)')}) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
i AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf FROM c GROUP BY term),
r AS (SELECT doc_id, term, tf * idf AS w FROM c JOIN i USING (term) WHERE idf <> 0)
SELECT doc_id::VARCHAR AS doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM r""",
)
def tfidf_vectors(spark, d):
    out = retrieval.tfidf(content_docs(spark, d))
    return out.select(F.col("doc_id").cast("string").alias("doc_id"), "term", F.round("weight", 6).alias("weight"))


SQL_TEXT_HITS = (
    SQL_TOPK
    + f""",
th AS (
  SELECT query_id, rank, vec_id, score, coalesce(text, '') AS content, coalesce(source, 'unknown') AS source, vec_id AS doc_id,
    list_distinct({SQL_WORDS.format("lower(coalesce(text, ''))")}) AS ws
  FROM topk LEFT JOIN documents ON doc_id = vec_id WHERE rank <= 20)"""
)


def text_hits(spark, d, k: int = retrieval.FETCH_K):
    docs = prose(spark, d).select(
        F.col("doc_id").alias("vec_id"), F.col("text").alias("content"), "source"
    )
    # a hit whose document is gone stays a hit, without words
    found = label_hits(spark, d, k).join(docs, "vec_id", "left")
    return found.withColumns({"content": F.coalesce("content", F.lit("")), "source": F.coalesce("source", F.lit("unknown"))})


@query(
    "mmr_rerank",
    f"""WITH {SQL_TEXT_HITS},
a AS (SELECT * FROM th WHERE rank = 1),
j AS (
  SELECT th.*, CASE WHEN len(th.ws) = 0 OR len(a.ws) = 0 THEN 0 ELSE
    len(list_intersect(th.ws, a.ws))::DOUBLE / len(list_distinct(th.ws || a.ws)) END AS sim
  FROM th JOIN a USING (query_id) WHERE th.rank > 1),
b AS (SELECT * FROM j QUALIFY row_number() OVER (
        PARTITION BY query_id ORDER BY 0.5 * score - 0.5 * sim DESC, rank) = 1)
SELECT query_id, vec_id, round(score, 6) AS score, 1 AS position FROM a
UNION ALL SELECT query_id, vec_id, round(score, 6), 2 FROM b""",
)
def mmr_rerank(spark, d):
    """Two picks per query, which plain SQL can state."""
    out = retrieval.mmr(text_hits(spark, d), k=2)
    return out.withColumn("score", F.round("score", 6))


def sql_mmr(k: int) -> str:
    """Greedy picks one after the other; the first is the best hit."""
    steps = [
        "p1 AS (SELECT query_id, vec_id, score, 1 AS position FROM th QUALIFY row_number() OVER ("
        "PARTITION BY query_id ORDER BY rank) = 1)"
    ]
    for n in range(2, k + 1):
        before = " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(1, n))
        steps.append(f"""
p{n} AS (
  SELECT query_id, vec_id, score, {n} AS position FROM (
    SELECT t.query_id, t.vec_id, t.score, t.rank, max(s.sim) AS m
    FROM th t JOIN ({before}) p ON p.query_id = t.query_id
    JOIN sims s ON s.query_id = t.query_id AND s.x = t.vec_id AND s.y = p.vec_id
    WHERE NOT EXISTS (SELECT 1 FROM ({before}) q WHERE q.query_id = t.query_id AND q.vec_id = t.vec_id)
    GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY 0.5 * score - 0.5 * m DESC, rank) = 1)""")
    return ",".join(steps)


@query(
    "mmr_rerank_five",
    f"""WITH {SQL_TEXT_HITS},
sims AS (
  SELECT a.query_id, a.vec_id AS x, b.vec_id AS y, CASE WHEN len(a.ws) = 0 OR len(b.ws) = 0 THEN 0 ELSE
    len(list_intersect(a.ws, b.ws))::DOUBLE / len(list_distinct(a.ws || b.ws)) END AS sim
  FROM th a JOIN th b ON a.query_id = b.query_id),
few AS (SELECT query_id FROM th GROUP BY query_id HAVING count(*) <= 5),
{sql_mmr(5)}
SELECT query_id, vec_id, round(score, 6) AS score, position FROM (
{" UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(1, 6))}) WHERE query_id NOT IN (FROM few)
UNION ALL SELECT query_id, vec_id, round(score, 6), row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT
FROM th WHERE query_id IN (FROM few)""",
)
def mmr_rerank_five(spark, d):
    return retrieval.mmr(text_hits(spark, d)).withColumn("score", F.round("score", 6))


@query(
    "jaccard",
    f"""
WITH w AS (SELECT conv_id, turn, list_distinct({SQL_WORDS.format('lower(text)')}) AS ws FROM conversations)
SELECT a.conv_id, a.turn, CASE WHEN len(a.ws) = 0 OR len(b.ws) = 0 THEN 0 ELSE round(
  len(list_intersect(a.ws, b.ws))::DOUBLE / len(list_distinct(a.ws || b.ws)), 6) END::DOUBLE AS jaccard
FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1""",
)
def jaccard(spark, d):
    """Word overlap of each turn with the one before it."""
    sets = table(spark, d, "conversations").select(
        "conv_id", "turn", tx.word_set(F.col("text")).alias("ws")
    )
    before = sets.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("ws").alias("_before"))
    value = tx.jaccard(F.col("ws"), F.col("_before"))
    return sets.join(before, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(value, 6).alias("jaccard")
    )


SQL_CITED = (
    SQL_TEXT_HITS
    + """,
cited AS (
  SELECT query_id, rank, vec_id, score, content, '[' || source || ']'
    || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' Note ' || doc_id END
    || ' (' || strftime(DATE '2024-01-01' + doc_id::INT, '%Y-%m-%d') || ')'
    || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' — https://example.com/' || doc_id END AS citation
  FROM th WHERE rank <= 10)"""
)


def citation_of(doc):
    """Citation of a document by its number; some have no title or address."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), doc.cast("int"))
    return retrieval.citation(
        F.col("source"),
        F.when(doc % 3 == 0, "").otherwise(F.concat(F.lit("Note "), doc)),
        F.date_format(day, "yyyy-MM-dd"),
        F.when(doc % 2 == 0, "").otherwise(F.concat(F.lit("https://example.com/"), doc)),
    )


def cited_hits(spark, d):
    return text_hits(spark, d, 10).withColumn("citation", citation_of(F.col("vec_id")))


@query("citations", f"WITH {SQL_CITED} SELECT query_id, rank, citation FROM cited")
def citations(spark, d):
    return cited_hits(spark, d).select("query_id", "rank", "citation")


@query(
    "build_context",
    f"""WITH {SQL_CITED},
p AS (
  SELECT query_id, rank, printf('[%d] Source: %s | Score: %.3f', rank, citation, score) || chr(10) || content
    AS t FROM cited),
s AS (SELECT *, sum(length(t)) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM p),
k AS (
  SELECT query_id, rank, CASE WHEN total <= 8000 THEN t WHEN 8000 - (total - length(t)) > 200
    THEN left(t, (8000 - (total - length(t)))::BIGINT) || '...[truncated]' END AS t FROM s)
SELECT query_id, count(t)::INT AS passages, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY rank)
  FILTER (WHERE t IS NOT NULL), 'No relevant documents found.') AS context
FROM k GROUP BY query_id""",
)
def build_context(spark, d):
    return retrieval.build_context(cited_hits(spark, d), order="rank")
