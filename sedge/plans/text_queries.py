"""Queries: text functions, counters, audits, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.functions import processors
from sedge.functions import scalars as sc
from sedge.functions import text as tx
from sedge.operators import payload, usage
from sedge.plans.registry import query, table
from sedge.plans.standins import chunks
from sedge.sources import files, portal
from sedge.streaming import ingest, timers

_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\n\s*\d+\s*(?:/\s*\d+)?\s*\n', chr(10), 'g'), '(\w+)-\s*\n\s*(\w+)', '\1\2', 'g'), '(\p{Ll})([A-ZŁŚĆŻŹÓĘĄŃ])([ąćęłńóśżź])', '\1 \2\3', 'g'), '\s+', ' ', 'g'))"""
_COUNT = lambda c, p: f"len(regexp_extract_all({c}, '{p}'))::BIGINT"
_STATUTE = r"(?i)(art\.|ust\.|§|dz\.?\s*u\.)"


@query(f"SELECT doc_id, {_CLEAN} AS clean FROM documents")
def cleanup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.cleanup(F.col("text")).alias("clean"))


@query(rf"SELECT doc_id, {_COUNT('text', r'\S+')} AS tokens, length(text)::BIGINT AS chars, {_COUNT('text', '[0-9]')} AS digits, {_COUNT('text', _STATUTE)} AS statutes FROM documents")
def text_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", tx.count_tokens(t).alias("tokens"), F.length(t).cast("long").alias("chars"), tx.count_digits(t).alias("digits"), tx.count_statutes(t).alias("statutes"))


@query(rf"""WITH j AS (SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS joined, count(*) AS chunks FROM conversations GROUP BY 1),
b AS (SELECT d.doc_id, d.text AS s, coalesce(j.joined, '') AS c, coalesce(j.chunks, 0) AS chunks FROM documents d LEFT JOIN j USING (doc_id)),
n AS (SELECT doc_id, chunks, {_COUNT('s', r'\S+')} AS source_tokens, {_COUNT('c', r'\S+')} AS chunk_tokens, length(s)::BIGINT AS source_chars, length(c)::BIGINT AS chunk_chars,
 {_COUNT('s', '[0-9]')} AS source_digits, {_COUNT('c', '[0-9]')} AS chunk_digits, {_COUNT('s', _STATUTE)} AS source_statutes, {_COUNT('c', _STATUTE)} AS chunk_statutes,
 contains(c, 'Sygn. akt') OR contains(c, 'WYROK') AS header_in_chunks FROM b)
SELECT *, CASE WHEN source_tokens = 0 THEN 0 ELSE round(((source_tokens - chunk_tokens)::FLOAT * 100::FLOAT / source_tokens::FLOAT)::DOUBLE, 3) END AS drift_pct FROM n""")
def audit_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = usage.audit(table(spark, sf_dir, "documents"), chunks(spark, sf_dir), "doc_id", "text", "content", "ord")
    return out.withColumn("chunks", F.col("chunks").cast("long"))


@query(rf"""WITH c AS (SELECT conv_id AS doc_id, sum({_COUNT('text', r'\S+')})::BIGINT AS n FROM conversations GROUP BY 1),
b AS (SELECT d.doc_id, {_COUNT('d.text', r'\S+')} AS source_tokens, coalesce(c.n, 0) AS chunk_tokens FROM documents d LEFT JOIN c USING (doc_id))
SELECT *, CASE WHEN source_tokens = 0 THEN true WHEN chunk_tokens = 0 THEN false ELSE abs(source_tokens - chunk_tokens)::FLOAT / source_tokens::FLOAT <= 0.15::FLOAT END AS covered FROM b""")
def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.coverage(table(spark, sf_dir, "documents"), chunks(spark, sf_dir), "doc_id", "text", "content")


@query(r"SELECT event_id, regexp_matches(v, '^[0-9\s.,\-_:;]+$') AND regexp_matches(v, '[0-9]') AS noise FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value || ' ; ' || user_id ELSE props END AS v FROM events)")
def numeric_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_id") % 2 == 0, F.concat(F.col("value").cast("string"), F.lit(" ; "), F.col("user_id").cast("string"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", tx.is_numeric_noise(v).alias("noise"))


@query("SELECT user_id, list_sort(list(value))[len(list(value)) // 2 + 1] AS median FROM events GROUP BY user_id")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("value").alias("v")).select("user_id", sc.upper_median(F.col("v")).alias("median"))


@query()
def segment_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.sentences(F.col("text"))).alias("s"))
    return docs.select("doc_id", F.col("s.ord").alias("ord"), F.col("s.text").alias("sentence"))


@query("""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(t, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM (SELECT doc_id, ' ' || lang || ', ,' || source || ' ,' AS t FROM documents)""")
def expand_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    csv = F.concat(F.lit(" "), F.col("lang"), F.lit(", ,"), F.col("source"), F.lit(" ,"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(sc.expand_csv(csv), "|").alias("parts"))


@query("SELECT event_id, nullif(trim(CASE WHEN event_id % 4 = 0 THEN '  ' ELSE ' ' || event_type || ' ' END), '') AS v FROM events")
def blank_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_id") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("event_type"), F.lit(" ")))
    return table(spark, sf_dir, "events").select("event_id", sc.blank_to_null(v).alias("v"))


@query("SELECT c_custkey, s AS slug, regexp_full_match(s, '[a-z0-9-]{1,32}') AS valid FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE lower(replace(c_name, '#', '-')) END AS s FROM customer)")
def slug_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))))
    return table(spark, sf_dir, "customer").select("c_custkey", slug.alias("slug")).withColumn("valid", sc.is_slug(F.col("slug")))


@query("""SELECT event_id, list_filter(list_transform(string_split(t, ','), lambda x: TRY_CAST(trim(x) AS BIGINT)), lambda x: x IS NOT NULL)[2] AS n
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'x, 1' WHEN event_id % 3 = 1 THEN '7, a, ' || user_id ELSE user_id || ',' || event_id END AS t FROM events)""")
def csv_nth_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    t = F.when(F.col("event_id") % 3 == 0, "x, 1").when(F.col("event_id") % 3 == 1, F.concat(F.lit("7, a, "), u)).otherwise(F.concat(u, F.lit(","), e))
    return table(spark, sf_dir, "events").select("event_id", sc.nth_int(t, 2).alias("n"))


@query("SELECT page_id, string_split(rtrim(url, '/'), '/')[-1] AS segment FROM pages")
def url_last_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", sc.last_segment(F.col("url")).alias("segment"))


@query("SELECT o_orderkey, 'saos/' || year(o_orderdate) || '/' || month(o_orderdate) || '/' || day(o_orderdate) || '/' || o_orderkey || '.pdf' AS path FROM orders")
def date_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", sc.date_path("saos", date, F.col("o_orderkey").cast("string"), "pdf").alias("path"))


@query("SELECT 'saos-' || event_id AS doc_id, CASE WHEN event_id % 2 = 0 THEN 'c-' || user_id END AS case_number, 9::BIGINT AS total FROM events")
def json_first_nonnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("c-"), F.col("user_id").cast("string")))
    courts = F.array(F.struct(F.lit(None).cast("string").alias("caseNumber")), F.struct(case.alias("caseNumber")))
    body = F.to_json(F.struct(F.array(F.struct(F.col("event_id").alias("id"), courts.alias("courtCases"))).alias("items"), F.struct(F.lit(9).alias("totalResults")).alias("info")))
    return portal.api_tasks(table(spark, sf_dir, "events").select(body.alias("body")), "body")


@query(r"""SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href="[^"]*"'))::BIGINT AS links FROM pages""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.size(portal.links(F.col("html"))).cast("long").alias("links"))


@query()
def file_scan_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.recent(files.scan(spark, sf_dir, "*.parquet", content=False, recursive=True), files.file_limit(100)).select("path", "length")


@query()
def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 25, seed=7)


@query("SELECT sha256(text) AS cid, any_value(octet_length(encode(text)))::BIGINT AS size_bytes FROM documents GROUP BY 1")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingest(spark, f"{sf_dir}/documents.parquet", "text").select("cid", "size_bytes")


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, epoch_us(ts) AS at_us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, at_us, n, true AS admitted, at_us + 8640000000.0::DOUBLE AS due FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.at_us, e.n, greatest(r.due, e.at_us) + 8640000000.0 - e.at_us <= 20 * 8640000000.0,
    greatest(r.due, e.at_us) + CASE WHEN greatest(r.due, e.at_us) + 8640000000.0 - e.at_us <= 20 * 8640000000.0 THEN 8640000000.0 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, at_us, admitted FROM r""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, each user's allowance as state."""
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    prepare = lambda df: df.select("user_id", "event_id", at.alias("at_us"))
    return timers.limited(spark, f"{sf_dir}/events.parquet", prepare, "user_id", "at_us", "event_id", per_window=10, window_us=86_400_000_000, burst=20)


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\f\r]+'), lambda x: x <> '') AS ws FROM documents),
o AS (SELECT *, unnest(range(0, CASE WHEN len(ws) = 0 THEN 0 ELSE 1 + greatest(0, ceil((len(ws) - 100) / 80.0)::BIGINT) END)) AS ord FROM w)
SELECT doc_id, ord::INTEGER AS ord, array_to_string(ws[ord * 80 + 1 : ord * 80 + 100], ' ') AS content FROM o""")
def process_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 100 words, 20 of them shared, by a processor called laterally."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return processors.process(docs, "text", processors.Windows(100, 20)).drop("section")
