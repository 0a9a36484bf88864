"""Queries: what ingestion does around the records - attachments, answers, pages, replies, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.functions import glyphs, ids
from sedge.functions import scalars as sc
from sedge.operators import jobs as jb
from sedge.operators import payload, projection, store, usage
from sedge.plans.registry import query, table
from sedge.plans.standins import JOBS_SQL, jobs
from sedge.sources import portal


@query("SELECT doc_id, to_base64(encode(text)) AS data FROM documents")
def attachment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", sc.attachment(F.col("text")).alias("data"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '10.0.0.2' WHEN event_id % 5 = 0 THEN '10.0.0.1' ELSE '192.168.' || (user_id % 256) || '.7' END AS listed,
 CASE WHEN event_id % 3 = 0 THEN '10.0.0.2' WHEN event_id % 5 = 0 THEN '2001:db8::' || (user_id % 10) ELSE '10.0.0.1' END AS named FROM events""")
def client_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the peers are not trusted; a fifth of the first entries are no addresses."""
    peer = F.when(F.col("event_id") % 3 == 0, "10.0.0.2").otherwise("10.0.0.1")
    own = F.concat(F.lit("192.168."), (F.col("user_id") % 256).cast("string"), F.lit(".7"))
    xff = F.concat(F.when(F.col("event_id") % 5 == 0, "unknown").otherwise(own), F.lit(", 172.16.0.1"))
    six = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("2001:db8::"), (F.col("user_id") % 10).cast("string"))).otherwise("300.1.1.1")
    header = F.concat(F.lit("by=203.0.113.43; for=_hidden, for=\""), six, F.lit("\""))
    said = [sc.client_ip(peer, xff, header, ["10.0.0.1"], mode) for mode in ("x-forwarded-for", "forwarded")]
    return table(spark, sf_dir, "events").select("event_id", said[0].alias("listed"), said[1].alias("named"))


@query(f"""WITH {JOBS_SQL}, f AS (SELECT DISTINCT doc_id FROM jobs WHERE status = 'Failed' ORDER BY doc_id LIMIT 100)
SELECT count(*) AS total, count(*) FILTER (status = 'Generated') AS generated, count(*) FILTER (status = 'Generating') AS in_flight, count(*) FILTER (status = 'Pending') AS queued,
 count(*) FILTER (status = 'Failed') AS failed, (SELECT string_agg(doc_id, '|' ORDER BY doc_id) FROM f) AS failed_docs FROM jobs""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jb.run_summary(jobs(spark, sf_dir)).withColumn("failed_docs", F.array_join("failed_docs", "|"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 > 2 THEN regexp_replace(text, '\\s+$', '') WHEN doc_id % 7 > 0 THEN source END AS text,
 CASE WHEN doc_id % 5 > 2 THEN 1 WHEN doc_id % 7 > 0 THEN 2 END AS answer, CASE WHEN doc_id % 5 <= 2 AND doc_id % 7 = 0 THEN 'no usable answer' END AS error
 FROM documents WHERE regexp_matches(text, '[a-z]') AND trim(source) <> ''""")
def pick_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First answers are noise, blank or cut off in three of five cases; second ones are blank in one of seven."""
    k = F.col("doc_id") % 5
    first = F.when(k == 0, "12 34. 56").when(k == 1, " \n").otherwise(F.col("text"))
    used = F.when(k == 2, 512).when(k == 3, 511)
    second = F.when(F.col("doc_id") % 7 == 0, "  ").otherwise(F.col("source"))
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike("[a-z]") & (F.trim("source") != ""))
    return docs.select("doc_id", payload.pick_answer(first, used, F.lit(512), second).alias("a")).select("doc_id", "a.*")


@query("SELECT event_id, event_id % 2 = 0 AND event_id % 3 = 0 AND event_id % 5 = 0 AND event_id % 7 <> 1 AS empty FROM events")
def empty_procurement(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda n, name: F.when(F.col("event_id") % n != 0, F.col("event_type")).alias(name)
    codes = F.when(F.col("event_id") % 7 == 1, F.array(F.lit("39120000"))).when(F.col("event_id") % 7 == 2, F.array().cast("array<string>")).alias("cpv_codes")
    return table(spark, sf_dir, "events").select("event_id", payload.empty_procurement(F.struct(some(2, "subject"), some(3, "procedure_type"), some(5, "tender_id"), codes)).alias("empty"))


@query("""SELECT p_partkey, greatest(512, least(2048, p_size * 60)) AS budget, greatest(1, CASE WHEN p_size % 2 = 0 THEN 1000 ELSE 500 END) AS edge,
 CASE WHEN p_size % 3 = 0 THEN '<image> ' || p_brand ELSE '<image>' || chr(10) || p_brand END AS prompt, nullif(p_size % 4, 0) AS cached FROM part""")
def image_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    prompt = F.when(size % 3 == 0, F.concat(F.lit("<image> "), "p_brand")).otherwise(F.col("p_brand"))
    edge = F.when(size % 2 == 0, F.lit(4000)).otherwise(F.lit(2000))
    return table(spark, sf_dir, "part").select(
        "p_partkey", sc.fallback_budget(size * 60).alias("budget"), sc.resize_edge(edge, F.lit(4000), 1000).alias("edge"), sc.image_prompt(prompt).alias("prompt"), usage.zero_to_null(size % 4).alias("cached")
    )


@query("""SELECT CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey::VARCHAR END AS judgment_id, CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS judgment_date,
 CASE WHEN o_orderkey % 4 = 0 THEN 'no judgment id' WHEN o_orderkey % 3 = 0 THEN 'no judgment date' END AS error FROM orders""")
def api_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.struct(F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey").cast("string")).alias("judgmentId"))
    date = F.when(F.col("o_orderkey") % 3 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("judgmentDate")
    body = F.to_json(F.struct(F.struct(date, source.alias("source")).alias("data")))
    return portal.api_details(table(spark, sf_dir, "orders").select(body.alias("body")), "body")


@query("""SELECT doc_id, sha256('{"lang":"' || lang || '"' || CASE WHEN doc_id % 2 = 0 THEN ',"tags":["a","b"]' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN ',"inner":{"n":' || doc_id || '}' ELSE '' END || '}') AS hash FROM documents WHERE lang IS NOT NULL""")
def decision_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty arrays and structs without content leave no trace."""
    tags = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    inner = F.struct(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).alias("n"), F.array().cast("array<int>").alias("none"))
    docs = table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", F.struct("lang", tags.alias("tags"), inner.alias("inner")).alias("decision"))
    return docs.select("doc_id", ids.content_hash(F.col("decision"), docs.schema["decision"].dataType).alias("hash"))


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) > 4096 THEN 'blob of ' || octet_length(encode(text)) || ' bytes exceeds 4096' END AS problem FROM documents")
def blob_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ids.check_blob_size(F.col("text"), 4096).alias("problem"))


@query(r"""WITH c AS (SELECT n_nationkey, n_name, unnest(generate_series(1, length(n_name))) AS i FROM nation),
 p AS (SELECT n_nationkey, i, substr(n_name, i, 1) AS ch, substr(n_name, i + 1, 1) AS nx FROM c)
 SELECT n_nationkey, string_agg(ch || CASE WHEN nx = '' THEN '' WHEN i % 7 = 0 THEN CASE WHEN i % 14 = 0 THEN chr(10) || chr(10) ELSE chr(10) END WHEN i % 3 = 0 AND ch <> ' ' AND nx <> ' ' THEN ' ' ELSE '' END, '' ORDER BY i) AS text FROM p GROUP BY 1""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names drawn with a wide gap after every third letter, a new line after every seventh, a paragraph after two lines."""
    at = F.col("i") - 1
    lines, paragraphs = F.floor(at / 7), F.floor(at / 14)
    base = (-12 * lines - 18 * paragraphs).cast("float")
    left = (at * 5 + F.floor(at / 3) * 10).cast("float")
    flat = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.explode(F.sequence(F.lit(1), F.length("n_name"))).alias("i"))
    glyph = F.struct(F.substr("n_name", F.col("i"), F.lit(1)).alias("ch"), left.alias("left"), (left + 4).cast("float").alias("right"), (base + 10).cast("float").alias("top"), base.alias("bottom"), base.alias("baseline"))
    pages = flat.select("n_nationkey", F.struct("i", glyph.alias("g")).alias("x")).groupBy("n_nationkey").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["g"]).alias("glyphs"))
    return pages.select("n_nationkey", glyphs.page_text("glyphs").alias("text"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE trim(text) <> '' GROUP BY 1")
def join_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.join_pages(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("""SELECT event_id, '{"a.0":' || user_id || ',"a.l":["' || event_type || '",{"k":null}],"a.l.1":{"k":null}}' AS projected FROM events""")
def project_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested values stay JSON, a numeric segment reads a key or a position, missing paths are left out."""
    record = F.concat(F.lit('{"a":{"0":'), F.col("user_id").cast("string"), F.lit(',"l":["'), "event_type", F.lit('",{"k":null}]}}'))
    rows = table(spark, sf_dir, "events").select("event_id", record.alias("record"))
    return projection.project_json(rows, "record", ["a.0", " a.l", "a.l.1", "a.l.2", "a..b", "b"]).select("event_id", "projected")


@query("SELECT doc_id, sha256(text) || '|' || sha256(source) || '|' || sha256(lang) AS cids FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL AND text <> source AND text <> lang AND source <> lang")
def collect_nested_cids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in ``ingest.blobs``, in arrays that also hold objects, and in objects within arrays."""
    docs = table(spark, sf_dir, "documents").where("text is not null and source is not null and lang is not null and text <> source and text <> lang and source <> lang")
    t, s, l = (ids.content_id(F.col(c)) for c in ("text", "source", "lang"))  # noqa: E741
    parts = F.concat(F.lit('{"ingest":{"blobs":{"pdf":{"at":"'), t, F.lit('"}}},"structured":{"files":["'), s, F.lit('",{"k":1,"blob":"'), l, F.lit('","doc_id_blob":"'), t, F.lit('"}]}}'))
    return docs.select("doc_id", F.array_join(store.collect_cids(parts), "|").alias("cids"))


@query("SELECT conv_id, turn, text, CASE WHEN trim(text) = '' THEN 0.0::FLOAT ELSE (length(text) % 100)::FLOAT END AS first FROM conversations")
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 32 through a stand-in embedder that answers with a text's length."""
    docs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    got = payload.embed_texts(docs, "text", lambda texts: [[float(len(t) % 100), 1.0] for t in texts], 2)
    return got.select("conv_id", "turn", "text", F.col("embedding")[0].alias("first"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'blocked: SAFETY' WHEN event_id % 5 = 1 THEN 'the reply has no text' WHEN event_id % 5 = 2 THEN 'the reply is no such JSON' END AS error,
 CASE WHEN event_id % 5 > 2 THEN event_type END AS summary FROM events""")
def parse_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies come in parts; some prompts are blocked, some replies blank or broken."""
    from sedge.schema import decision_schema

    k = F.col("event_id") % 5
    parts = F.when(k == 1, F.array(F.lit(" "), F.lit(""))).when(k == 2, F.array(F.lit('{"summary_short":'))).otherwise(F.array(F.lit('{"summary_short":"'), F.col("event_type"), F.lit('"}')))
    reply = payload.parse_reply(F.when(k == 0, "SAFETY"), parts, decision_schema())
    return table(spark, sf_dir, "events").select("event_id", reply.alias("r")).select("event_id", "r.error", F.col("r.decision.summary_short").alias("summary"))
