"""Queries: content ids, blobs, records, validation, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.functions import ids
from sedge.operators import jobs as jb
from sedge.operators import payload, store
from sedge.plans.registry import query, table
from sedge.plans.standins import RECORDS_SQL, SILO, records


@query("SELECT doc_id, sha256(text) AS cid FROM documents")
def content_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ids.content_id(F.col("text")).alias("cid"))


@query("SELECT doc_id, regexp_full_match(c, '[0-9a-f]{2,}') AS valid FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(sha256(text)) WHEN doc_id % 3 = 1 THEN 'a' ELSE sha256(text) END AS c FROM documents)")
def cid_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cid = ids.content_id(F.col("text"))
    c = F.when(F.col("doc_id") % 3 == 0, F.upper(cid)).when(F.col("doc_id") % 3 == 1, "a").otherwise(cid)
    return table(spark, sf_dir, "documents").select("doc_id", ids.is_cid(c).alias("valid"))


@query("SELECT doc_id, sha256(text) || '|' || 'ab' AS cids FROM documents")
def normalize_cids(spark: SparkSession, sf_dir: str) -> DataFrame:
    cid = ids.content_id(F.col("text"))
    raw = F.array(F.concat(F.lit(" "), F.upper(cid)), F.lit("AB"), cid, F.lit("xyz"), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(ids.normalize_cids(raw), "|").alias("cids"))


@query("SELECT doc_id, sha256(text) || '|' || sha256(source) AS cids FROM documents")
def collect_cids(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.to_json(F.struct(F.struct(F.struct(ids.content_id(F.col("text")).alias("primary_blob")).alias("assets"), F.array(F.lit("no id"), ids.content_id(F.col("source"))).alias("files"), F.col("lang").alias("note")).alias("structured")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(store.collect_cids(record), "|").alias("cids"))


@query("SELECT sha256(text) AS cid, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(ids.content_id(F.col("text")).alias("cid")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))


@query("""SELECT doc_id::VARCHAR AS path, 'main' AS silo, sha256(text) AS cid, octet_length(encode(text))::BIGINT AS size_bytes,
 row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id::VARCHAR) > 1 OR sha256(text) IN (SELECT sha256(text) FROM documents WHERE source = 'src0') AS existed FROM documents""")
def blob_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = docs.where("source = 'src0'").select(F.lit(SILO).alias("silo"), ids.content_id(F.col("text")).alias("cid"))
    return store.put_blobs(held, docs.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")), SILO)


@query("SELECT DISTINCT sha256(text) AS cid, octet_length(encode(text))::BIGINT AS size_bytes FROM documents WHERE sha256(text) = (SELECT sha256(text) FROM documents WHERE doc_id = 3)")
def blob_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cid = store.get(docs, "doc_id", 3).select(ids.content_id(F.col("text"))).first()[0]
    blobs = docs.select(F.lit(SILO).alias("silo"), ids.content_id(F.col("text")).alias("cid"), F.octet_length("text").cast("long").alias("size_bytes"))
    return store.head(blobs, SILO, cid).distinct()


@query("SELECT doc_id, 'root/blobs/main/' || sha256(text)[1:2] || '/' || sha256(text) AS key FROM documents")
def blob_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ids.blob_key(F.lit(SILO), ids.content_id(F.col("text")), "/root/").alias("key"))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions whose chunks are a conversation's turns."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct((F.col("turn") + 1).alias("position"), F.col("role").alias("section"), F.col("text").alias("body")))).alias("chunks"))
    text = F.lit(None).cast("string")
    return c.select(
        F.col("conv_id").cast("string").alias("doc_id"), "chunks",
        F.struct(F.lit("2025-08-31").alias("date"), F.lit("upheld").alias("result")).alias("decision"),
        F.struct(F.array().cast("array<string>").alias("kio_docket"), text.alias("saos_id")).alias("identifiers"),
        F.struct(F.lit("authority").alias("contracting_authority"), F.lit("appellant").alias("appellant")).alias("parties"),
        F.struct(text.alias("subject"), F.array().cast("array<string>").alias("cpv_codes")).alias("procurement"),
        F.array().cast("array<struct<issue_key: string, confidence: int>>").alias("issues"),
    )


@query("SELECT 'main-' || conv_id || '-chunk-' || (turn + 1) AS id, conv_id::VARCHAR AS doc_id, turn + 1 AS ord, role AS section, text AS content, '2025-08-31' AS decision_date FROM conversations")
def explode_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.chunk_records(_decisions(spark, sf_dir), SILO).select("id", "doc_id", "ord", "section", "content", "decision_date")


@query(f"WITH {RECORDS_SQL} SELECT id, doc_type, doc_id FROM records")
def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("id", "doc_type", "doc_id")


@query("SELECT conv_id, CASE WHEN count(*) > 5 THEN 'error' ELSE 'indexed' END AS status, count(*) AS chunk_count, CASE WHEN count(*) > 5 THEN 'too many' END AS error FROM conversations GROUP BY 1")
def ingest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("e", F.when(F.col("n") > 5, "too many"))
    return per.withColumn("i", payload.ingest_status(F.col("e"), F.col("n"), "key")).select("conv_id", "i.status", "i.chunk_count", "i.error")


@query("""WITH n AS (SELECT user_id AS doc_id, arg_max(event_type, event_id) AS lang FROM events GROUP BY 1)
SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT doc_id, lang, NULL FROM n""")
def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("lang"), F.col("event_id").alias("seq"))
    return store.upsert(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), new, "doc_id", order="seq")


@query("""WITH n AS (SELECT 'job-' || user_id AS job_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
j AS (SELECT 'job-' || conv_id AS job_id FROM conversations) SELECT job_id, event_id AS created_at_ms FROM n WHERE k = 1 AND job_id NOT IN (SELECT job_id FROM j)""")
def enqueue_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "events").select(F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"), F.col("event_id").alias("created_at_ms"))
    known = table(spark, sf_dir, "conversations").select(F.concat(F.lit("job-"), F.col("conv_id").cast("string")).alias("job_id"))
    return jb.enqueue(known, new)[0].select("job_id", "created_at_ms")


@query("""WITH l AS (SELECT l_orderkey, count(*) AS items, count(*) FILTER (l_tax > 0.05 AND l_extendedprice <> 0) AS negative, count(*) FILTER (l_returnflag = 'R') AS odd FROM lineitem GROUP BY 1)
SELECT l_orderkey, items, negative + odd AS violations FROM l""")
def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.when(F.col("l_tax") > 0.05, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    currency = F.when(F.col("l_returnflag") == "R", "pln").otherwise("PLN")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(amount.alias("amount"), currency.alias("currency"))).alias("costs"))
    one = "named_struct"
    full = rows.select(
        "l_orderkey", "costs", F.expr(f"array({one}('name', 'N', 'role', 'chair'))").alias("panel"), F.expr(f"{one}('date', '2025-08-31', 'result', 'upheld')").alias("decision"),
        F.expr(f"{one}('contracting_authority', 'a', 'appellant', 'b')").alias("parties"), F.expr(f"{one}('cpv_codes', array('72222300', '39120000-3'))").alias("procurement"),
        F.expr(f"array({one}('article', '1'))").alias("statutes_cited"), F.expr(f"array({one}('confidence', 90))").alias("issues"),
        F.expr(f"array({one}('position', 1, 'section', cast(null as string), 'body', 'b'))").alias("chunks"), F.lit("s").alias("summary_short"),
    )
    return full.select("l_orderkey", F.size("costs").cast("long").alias("items"), F.size(payload.violations()).cast("long").alias("violations"))


@query("""WITH n AS (SELECT conv_id, turn + 1 AS p, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role <> 'system')
SELECT conv_id, count(*) AS chunks, count(*) FILTER (p <> k) AS broken FROM n GROUP BY 1""")
def chunk_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role <> 'system'").withColumn("position", F.col("turn") + 1)
    return payload.chunk_sequence(c, "conv_id", "position", "turn")


@query(f"""WITH {RECORDS_SQL}, g AS (SELECT doc_id, count(*) AS records, count(*) FILTER (doc_type = 'chunk') AS chunks, list_sort(list_distinct(flatten(list(blob_cids)))) AS c FROM records GROUP BY 1)
SELECT doc_id, records, chunks, array_to_string(c, '|') AS cids FROM g""")
def delete_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.delete_plan(records(spark, sf_dir), "doc_id", limit=None).select("doc_id", "records", "chunks", F.array_join("cids", "|").alias("cids"))


@query(f"WITH {RECORDS_SQL} SELECT id, doc_id FROM records WHERE doc_id NOT IN (SELECT doc_id::VARCHAR FROM labels WHERE toxic = 1)")
def delete_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("doc_id"))
    return store.delete(records(spark, sf_dir), "doc_id", gone).select("id", "doc_id")


@query(f"WITH {RECORDS_SQL} SELECT doc_type AS kind, count(*) AS records FROM records GROUP BY 1")
def record_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.breakdown(records(spark, sf_dir))


@query("SELECT count(*) AS records, count(embedding) AS vectors, count(DISTINCT CASE WHEN embedding IS NOT NULL THEN doc_id END) AS docs_with_vectors FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return store.index_stats(table(spark, sf_dir, "documents").select("doc_id").join(v, "doc_id", "left"), "doc_id", "embedding")


@query()
def index_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.index_sizes(spark, sf_dir)


@query("""WITH d AS (SELECT event_id, ts, date_trunc('day', ts) AS a, date_trunc('week', ts) AS b, date_trunc('month', ts) AS c FROM events),
k AS (SELECT event_id, ts FROM (SELECT *, dense_rank() OVER (ORDER BY a DESC) AS r, row_number() OVER (PARTITION BY a ORDER BY ts DESC, event_id DESC) AS n FROM d) WHERE r <= 7 AND n = 1
UNION SELECT event_id, ts FROM (SELECT *, dense_rank() OVER (ORDER BY b DESC) AS r, row_number() OVER (PARTITION BY b ORDER BY ts DESC, event_id DESC) AS n FROM d) WHERE r <= 4 AND n = 1
UNION SELECT event_id, ts FROM (SELECT *, dense_rank() OVER (ORDER BY c DESC) AS r, row_number() OVER (PARTITION BY c ORDER BY ts DESC, event_id DESC) AS n FROM d) WHERE r <= 6 AND n = 1)
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM k""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.retention(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))
