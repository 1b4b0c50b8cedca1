"""Registered queries of the text operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_merge_dropout")
def op1_merge_dropout(spark, d):
    from barloom.llm.pieces import encode_dropout

    return encode_dropout(documents(spark, d), tokenizer_file("piece_bpe_32k.model"), share=0.1, seed=1)


@query("op2_rendezvous_shards")
def op2_rendezvous_shards(spark, d):
    from barloom.llm.sharding import shard_documents

    return shard_documents(documents(spark, d), [1.0] * 16)


@query(
    "op3_exact_dedup",
    r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
""",
)
def op3_exact_dedup(spark, d):
    from barloom.llm.exact_dedup import keepers

    return keepers(documents(spark, d)).drop("bucket", "chain", "key")


@query("op5_token_counts")
def op5_token_counts(spark, d):
    from barloom.llm.token_counts import token_counts

    return token_counts(documents(spark, d), tokenizer_file("piece_bpe_32k.model"))


@query("op6_byte_index_simhash")
def op6_byte_index_simhash(spark, d):
    from barloom.llm.simhash import near_duplicates

    return near_duplicates(documents(spark, d), words=3).drop("key")


@query("op7_rank_order_language")
def op7_rank_order_language(spark, d):
    from barloom.llm.language import held_out, identify, learn

    docs = documents(spark, d)
    profiles = learn(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, profiles).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op4_boosted_quality")
def op4_boosted_quality(spark, d):
    from barloom.llm.quality import judge, learn

    docs = documents(spark, d)
    return judge(docs, learn(docs, table(spark, d, "labels")))


@query("op8_bounded_space_packing")
def op8_bounded_space_packing(spark, d):
    from barloom.llm.packing import pack

    return pack(documents(spark, d), tokenizer_file("word_bpe_49k.json"), end_id=1, size=2048)


@query(
    "op9_seed_extend_substrings",
    r"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM t),
runs AS (
  SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS run
  FROM w),
twice AS (SELECT doc_id, i FROM runs WHERE len(run) = 35 QUALIFY count(*) OVER (PARTITION BY run) > 1),
near AS (
  SELECT w.doc_id, w.word, w.i, max(r.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS last
  FROM w LEFT JOIN twice r ON r.doc_id = w.doc_id AND r.i = w.i),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words, count(*) AS n FROM near
  WHERE last IS NULL OR i > last + 34 GROUP BY doc_id)
SELECT t.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
""",
)
def op9_seed_extend_substrings(spark, d):
    from barloom.llm.substrings import remove_repeats

    return remove_repeats(documents(spark, d)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@query("op10_seekable_warc")
def op10_seekable_warc(spark, d):
    from barloom.llm.warc import read_archive, write_archive

    return read_archive(*write_archive(table(spark, d, "pages"))).drop("url")


@query(
    "op11_segment_importance",
    r"""
WITH RECURSIVE rounds(byte, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM rounds WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS step FROM rounds WHERE k = 8),
cleaned AS (
  SELECT doc_id, 0 AS target, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
  UNION ALL
  SELECT item_id, 1, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
runs AS (SELECT doc_id, target, unnest(regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM cleaned),
words AS (SELECT doc_id, target, word, count(*) AS n FROM runs GROUP BY ALL),
spelled AS (SELECT word, hex(word) AS h FROM (SELECT DISTINCT word FROM words)),
hashed AS (
  SELECT word, xor(list_reduce(
    list_transform(range(0, length(h) // 2), lambda i: ('0x' || substring(h, (2 * i + 1)::BIGINT, 2))::BIGINT),
    lambda a, b: xor(a >> 8, step[xor(a & 255, b) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM spelled, crc),
counts AS (
  SELECT bucket, sum(n) FILTER (target = 0) AS s, sum(n) FILTER (target = 1) AS t FROM words JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT coalesce(sum(n) FILTER (target = 0), 0) AS s_all, coalesce(sum(n) FILTER (target = 1), 0) AS t_all FROM words),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM counts, sums),
weighed AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
  FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE target = 0 GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substring(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weighed USING (doc_id)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS draws FROM scored)
SELECT doc_id, n_features AS n_words, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= draws THEN place END AS rank FROM placed
""",
)
def op11_segment_importance(spark, d):
    from barloom.llm.importance import resample

    return resample(documents(spark, d), table(spark, d, "benchmark"), size=1, buckets=10_000, percent=10, least_words=20, seed=2024)


@query(
    "op12_filter_interactions",
    r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
    len(ws) < 50,
    100 * len(list_distinct(ws)) < 65 * len(ws),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
    regexp_matches(text, '[#$%&*|]'),
    doc_id > min(doc_id) OVER (PARTITION BY text)] AS fails
  FROM t LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT o, s.i AS step, o[s.i] AS own, o[1:s.i - 1] AS before FROM orders, letters s),
cells AS (
  SELECT g.*, o, step, own, fails[own] AS bad,
    len(list_filter(before, lambda i: fails[i])) > 0 AS gone,
    len(list_filter([1, 2, 3, 4, 5], lambda i: fails[i])) = 1 AS alone
  FROM g, steps),
sums AS (
  SELECT part, o, step, own,
    coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0) AS kept,
    coalesce(sum(n) FILTER (bad AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (bad AND gone), 0) AS redundant,
    coalesce(sum(n) FILTER (bad AND alone), 0) AS unique_fails,
    coalesce(sum(good) FILTER (bad AND NOT gone), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (bad AND NOT gone), 0) AS toxic_lost
  FROM cells GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, step,
  kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM sums
""",
)
def op12_filter_interactions(spark, d):
    from barloom.llm.filter_audit import audit

    return audit(documents(spark, d), table(spark, d, "labels"))


@query("op13_contextual_pii")
def op13_contextual_pii(spark, d):
    from barloom.llm.contextual_pii import personal_data

    return personal_data(documents(spark, d))
