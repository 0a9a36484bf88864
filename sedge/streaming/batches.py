"""Lifecycle of provider batches: submit ready jobs, fetch finished ones, with a pluggable provider."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import StructType

from sedge import storage
from sedge.errors import InvalidParameter
from sedge.functions.ids import content_hash
from sedge.functions.scalars import attachment
from sedge.operators import jobs as jb
from sedge.operators import payload, store

MOST_INPUTS = 32


class Answer(NamedTuple):
    """A provider's reply to one input: text, or what went wrong."""

    key: str
    text: str | None
    error: str | None


class Provider(Protocol):
    def submit(self, name: str, keys: Sequence[str]) -> str: ...

    def state(self, job: str) -> str: ...

    def fetch(self, job: str) -> Sequence[Answer]: ...


def check_inputs(inputs: DataFrame) -> None:
    """Raise InvalidParameter unless there are 1 to ``MOST_INPUTS`` inputs (doc_id, display_name, mime_type, content,
    text) and none of their fields is blank."""
    rows = inputs.limit(MOST_INPUTS + 1).select("doc_id", "display_name", "mime_type", F.octet_length("content").alias("content"), "text").collect()
    if not 1 <= len(rows) <= MOST_INPUTS:
        raise InvalidParameter("inputs", f"must be 1 to {MOST_INPUTS}")
    for r in rows:
        for field, value in r.asDict().items():
            if not (value if field == "content" else (value or "").strip()):
                raise InvalidParameter(field, "must not be empty")


def request(inputs: DataFrame, system: str) -> DataFrame:
    """(doc_id, body): the JSON request of each input - the attachment, its text and the instruction, one
    deterministic answer in JSON."""
    part = lambda kind, **fields: F.struct(F.lit(kind).alias("kind"), *[v.alias(k) for k, v in fields.items()])
    file = part("file", name=F.col("display_name"), mime_type=F.col("mime_type"), data=attachment(F.col("content")))
    body = F.struct(
        F.struct(file.alias("file"), part("text", text=F.col("text")).alias("text")).alias("user"), F.lit(system).alias("system"),
        F.struct(F.lit("application/json").alias("response_mime_type"), F.lit(1).alias("candidate_count"), F.lit(0.0).alias("temperature")).alias("generation"),
    )
    return inputs.select("doc_id", F.to_json(body).alias("body"))


def submit(jobs: DataFrame, provider: Provider, now_ms: int, limit: int = 4) -> DataFrame:
    """Ready batch jobs handed to the provider; their rows with the new state.

    ``limit`` bounds one submission, so the keys that reach the driver are few.
    """
    if not 1 <= limit <= MOST_INPUTS:
        raise InvalidParameter("limit", f"must be 1 to {MOST_INPUTS}")
    ready = jb.ready(jobs, "Pending", now_ms, limit, F.col("generation_mode") == "Batch")
    keys = [r.job_id for r in ready.select("job_id").collect()]
    if not keys:
        return jobs.limit(0)
    job = provider.submit(f"structured-{keys[0]}", keys)
    changed = {"status": F.lit("Generating"), "provider_job_id": F.lit(job), "submitted_batch_count": F.lit(len(keys)), "submitted_at_ms": F.lit(now_ms), "updated_at_ms": F.lit(now_ms)}
    return _changed(jobs, F.col("job_id").isin(*keys), changed)


def _changed(jobs: DataFrame, which, new: dict) -> DataFrame:
    return jobs.where(which).select(*[(new[f.name].cast(f.dataType) if f.name in new else F.col(f.name)).alias(f.name) for f in jobs.schema])


def fetch(jobs: DataFrame, provider: Provider, now_ms: int, limit: int = 4) -> DataFrame:
    """Rows of jobs whose batch ended, with their new state and ``reply``; running ones are left alone."""
    running = jobs.where("status = 'Generating' and provider_job_id is not null").select("provider_job_id").distinct().orderBy("provider_job_id").limit(limit).collect()
    replies = []
    for (job,) in running:
        state = provider.state(job)
        if state in ("Pending", "Running"):
            continue
        if state == "Succeeded":
            replies += [(a.key, a.text, a.error) for a in provider.fetch(job)]
        else:
            replies += [(r.job_id, None, f"provider job {state.lower()}") for r in jobs.where(F.col("provider_job_id") == job).select("job_id").collect()]
    answers = jobs.sparkSession.createDataFrame(replies, "job_id string, reply string, problem string")
    done = jobs.join(F.broadcast(answers), "job_id")  # MOST_INPUTS * limit rows at most
    ok = F.col("problem").isNull()
    new = {"status": F.when(ok, "Generated").otherwise("Failed"), "error": F.col("problem"), "last_error": F.coalesce("problem", "last_error"), "completed_at_ms": F.lit(now_ms), "updated_at_ms": F.lit(now_ms)}
    return done.select(*[(new[f.name].cast(f.dataType) if f.name in new else F.col(f.name)).alias(f.name) for f in jobs.schema], "reply")


def parse_replies(fetched: DataFrame, schema: str) -> DataFrame:
    """Adds ``decision`` (null where the reply is no such JSON)."""
    return fetched.withColumn("decision", F.from_json("reply", schema, {"mode": "PERMISSIVE"}))


def finalize(parsed: DataFrame, records: DataFrame, schema: StructType, silo: str, dim: int, embed, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(job rows with their new state, records with the decisions' own) of generated jobs with ``decision``.

    A decision must pass its rules, its hash must be that of the job where the job has one, and every chunk
    gets a vector of the index's length; jobs whose decision fails keep the records as they were.
    """
    parts = [F.col(f"decision.{f.name}").alias(f.name) for f in schema]
    rows = parsed.where("decision is not null").select("job_id", "doc_id", F.col("content_hash").alias("known"), F.col("decision").alias("whole"), *parts)
    rows = rows.withColumn("problems", payload.violations()).withColumn("hash", content_hash(F.col("whole"), schema))
    problem = F.when(F.size("problems") > 0, F.array_join("problems", "; ")).when(F.col("known") != F.col("hash"), "content hash mismatch after generation")
    rows = storage.stage(rows.withColumn("problem", problem), "finalize")
    good = rows.where("problem is null")
    chunks = payload.embed_texts(payload.chunk_records(good, silo), "content", embed, dim)
    new = payload.doc_records(good, silo).unionByName(chunks, allowMissingColumns=True)
    new = storage.stage(new.select(*[c for c in records.columns if c in new.columns]), "records")
    known = rows.select("job_id", "hash", "problem", F.size("chunks").alias("many"))
    done = parsed.join(known, "job_id", "left")
    told = F.when(F.col("decision").isNull(), F.coalesce("error", F.lit("the reply is no such JSON"))).otherwise(F.col("problem"))
    ok = told.isNull()
    state = {"status": F.when(ok, "Generated").otherwise("Failed"), "error": told, "last_error": F.coalesce(told, "last_error"), "content_hash": F.coalesce("content_hash", F.when(ok, F.col("hash"))), "chunk_count": F.when(ok, F.col("many")).otherwise(F.col("chunk_count")), "completed_at_ms": F.lit(now_ms), "updated_at_ms": F.lit(now_ms)}
    columns = [f for f in parsed.schema if f.name not in ("reply", "decision")]
    jobs = done.select(*[(state[f.name].cast(f.dataType) if f.name in state else F.col(f.name)).alias(f.name) for f in columns])
    return jobs, store.upsert(records, new, "id", replace_by="doc_id")
