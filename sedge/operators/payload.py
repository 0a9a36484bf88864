"""From structured decisions to records: validation, explosion into document and chunk rows, vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from sedge.errors import InvalidParameter
from sedge.functions.ids import chunk_record_id, doc_record_id, normalize_cids
from sedge.functions.text import count_tokens, is_numeric_noise

COVERAGE = 0.15


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"(?U)^\s*$")


def _each(items: str, check) -> Column:
    """Messages of ``check(item, index)`` over an array; a null array has none."""
    return F.flatten(F.coalesce(F.transform(items, lambda x, i: F.array_compact(F.array(*check(x, i)))), F.array()))


def _say(condition: Column, *parts) -> Column:
    message = F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.when(condition, message)


def is_date(c: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def is_currency(c: Column) -> Column:
    return F.coalesce(c.rlike("^[A-Z]{3}$"), F.lit(False))


def is_cpv(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[0-9]{8}(-[0-9])?$"), F.lit(False))


def violations() -> Column:
    """All rules that a decision row breaks, as messages with array positions; empty: valid."""
    at = lambda name, i, rest: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit(f"].{rest}"))
    single = F.array_compact(F.array(
        _say(F.coalesce(F.size("panel"), F.lit(0)) < 1, "panel needs a member"),
        _say(~is_date(F.col("decision.date")), "decision.date is no YYYY-MM-DD date"),
        _say(F.coalesce(F.col("decision.result"), F.lit("unknown")) == "unknown", "decision.result is unknown"),
        _say(_blank(F.col("parties.contracting_authority")), "parties.contracting_authority is empty"),
        _say(_blank(F.col("parties.appellant")), "parties.appellant is empty"),
        _say(F.coalesce(F.size("chunks"), F.lit(0)) < 1, "chunks needs an entry"),
        _say(_blank(F.col("summary_short")), "summary_short is empty"),
    ))
    return F.concat(
        single,
        _each("procurement.cpv_codes", lambda x, i: [_say(~is_cpv(x), F.concat(F.lit("procurement.cpv_codes["), i.cast("string"), F.lit("]")), " is no CPV code: ", F.coalesce(x, F.lit("null")))]),
        _each("costs", lambda x, i: [_say(x["amount"] < 0, at("costs", i, "amount"), " is negative"), _say(~is_currency(x["currency"]), at("costs", i, "currency"), " is no currency code: ", F.coalesce(x["currency"], F.lit("null")))]),
        _each("statutes_cited", lambda x, i: [_say(_blank(x["article"]), at("statutes_cited", i, "article"), " is empty")]),
        _each("issues", lambda x, i: [_say(x["confidence"] > 100, at("issues", i, "confidence"), " exceeds 100")]),
        _each("chunks", lambda x, i: [_say(x["position"] != i + 1, at("chunks", i, "position"), " must be ", (i + 1).cast("string")), _say(x["section"].isNotNull() & (F.trim(x["section"]) == ""), at("chunks", i, "section"), " is empty"), _say(_blank(x["body"]), at("chunks", i, "body"), " is empty")]),
    )


def chunk_sequence(chunks: DataFrame, doc: str, position: str, order: str) -> DataFrame:
    """(doc, chunks, broken): how many chunks are out of the sequence 1, 2, 3, ..."""
    n = F.row_number().over(Window.partitionBy(doc).orderBy(order))
    return chunks.withColumn("expected", n).groupBy(doc).agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col(position) != F.col("expected")).alias("broken"))


def coverage(docs: DataFrame, chunks: DataFrame, doc: str, text: str, body: str, most: float = COVERAGE) -> DataFrame:
    """(doc, source_tokens, chunk_tokens, covered): whether chunk tokens are near the source's, in single precision."""
    have = chunks.groupBy(doc).agg(F.sum(count_tokens(F.col(body))).alias("chunk_tokens"))
    both = docs.select(doc, count_tokens(F.col(text)).alias("source_tokens")).join(have, doc, "left").withColumn("chunk_tokens", F.coalesce("chunk_tokens", F.lit(0)))
    gap = F.abs(F.col("source_tokens") - F.col("chunk_tokens")).cast("float") / F.col("source_tokens").cast("float")
    return both.withColumn("covered", F.when(F.col("source_tokens") == 0, True).when(F.col("chunk_tokens") == 0, False).otherwise(gap <= F.lit(most).cast("float")))


def doc_records(decisions: DataFrame, silo: str, cids: Column | None = None) -> DataFrame:
    """One record per decision row (which carries ``doc_id``)."""
    return decisions.select(
        doc_record_id(F.lit(silo), F.col("doc_id")).alias("id"), F.lit(silo).alias("silo"), F.lit("doc").alias("doc_type"), "doc_id",
        F.col("decision.date").alias("decision_date"), F.col("decision.result").alias("decision_result"),
        F.col("identifiers.kio_docket").alias("identifiers_kio_docket"), F.col("identifiers.saos_id").alias("identifiers_saos_id"),
        F.col("parties.contracting_authority").alias("parties_contracting_authority"), F.col("parties.appellant").alias("parties_appellant"),
        F.col("parties.awardee").alias("parties_awardee"), F.col("parties.interested_bidders").alias("parties_interested_bidders"),
        F.col("procurement.subject").alias("procurement_subject"), F.col("procurement.procedure_type").alias("procurement_procedure_type"),
        F.col("procurement.tender_id").alias("procurement_tender_id"), F.col("procurement.cpv_codes").alias("procurement_cpv_codes"),
        F.col("panel.name").alias("panel_names"), F.col("panel.role").alias("panel_roles"), F.col("issues.issue_key").alias("issues_keys"),
        "summary_short", (normalize_cids(cids) if cids is not None else F.array(F.col("doc_id"))).alias("blob_cids"),
    )


def chunk_records(decisions: DataFrame, silo: str) -> DataFrame:
    """One record per chunk; the decision's fields come along as nested columns, with no join."""
    flat = decisions.select("doc_id", "decision", "identifiers", "parties", "procurement", "issues", F.col("decision.date").alias("decision_date"), F.col("decision.result").alias("decision_result"), F.explode("chunks").alias("chunk"))
    return flat.select(
        chunk_record_id(F.lit(silo), F.col("doc_id"), F.col("chunk.position")).alias("id"), F.lit(silo).alias("silo"), F.lit("chunk").alias("doc_type"), "doc_id",
        F.col("chunk.position").alias("ord"), F.col("chunk.section").alias("section"), F.col("chunk.body").alias("content"), "decision_date", "decision_result", "decision", "identifiers", "parties", "procurement", "issues",
    )


def zip_vectors(chunks: DataFrame, vectors: DataFrame, doc: str, position: str) -> DataFrame:
    """Chunks with their vectors by (document, position); both sides must agree in number (see ``check_vectors``)."""
    return chunks.join(vectors, [doc, position])


def check_vectors(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Adds ``problem``: null, ``missing``, ``dimension`` or ``not finite``."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.withColumn("problem", F.when(v.isNull(), "missing").when(F.size(v) != dim, "dimension").when(bad, "not finite"))


def zero_vector(text: Column, vector: Column, dim: int) -> Column:
    """The zero vector for blank text, else the vector."""
    return F.when(_blank(text), F.array_repeat(F.lit(0.0).cast("float"), dim)).otherwise(vector)


def ingest_status(error: Column, chunks: Column, embedder: str) -> Column:
    """The nested ``ingest`` object of a record."""
    return F.struct(F.when(error.isNull(), "indexed").otherwise("error").alias("status"), F.lit(embedder).alias("embedder_key"), chunks.alias("chunk_count"), error.alias("error"))


def empty_procurement(procurement: Column) -> Column:
    """Whether a decision says nothing of its procurement."""
    blank = [procurement[f].isNull() for f in ("subject", "procedure_type", "tender_id")]
    return procurement.isNull() | (blank[0] & blank[1] & blank[2] & (F.coalesce(F.size(procurement["cpv_codes"]), F.lit(0)) <= 0))


def sentence_records(docs: DataFrame, silo: str, doc: str, text: str) -> DataFrame:
    """One record per sentence of a document, with no vector; ids are made from silo, document and place."""
    from sedge.functions.text import sentences

    flat = docs.select(F.col(doc).cast("string").alias("doc_id"), F.explode(sentences(F.col(text))).alias("s"))
    position = (F.col("s.ord") + 1).cast("long")
    return flat.select(
        chunk_record_id(F.lit(silo), F.col("doc_id"), position).alias("id"), F.lit(silo).alias("silo"), F.lit("chunk").alias("doc_type"), "doc_id",
        F.lit(None).cast("string").alias("section"), position.alias("ord"), F.col("s.text").alias("content"), F.lit(None).cast("array<float>").alias("embedding"),
    )


def pick_answer(first: Column, used: Column, budget: Column, second: Column) -> Column:
    """struct(text, answer, error): the first answer of two, unless it was cut off (as many tokens used as it had),
    is numeric noise or blank; then the second, unless it is blank; else an error."""
    text = lambda c: F.when(~_blank(c), F.regexp_replace(c, r"\s+$", ""))
    one = F.when(~F.coalesce(used >= budget, F.lit(False)) & ~F.coalesce(is_numeric_noise(text(first)), F.lit(False)), text(first))
    two = text(second)
    error = F.when(one.isNull() & two.isNull(), "no usable answer")
    return F.struct(F.coalesce(one, two).alias("text"), F.when(one.isNotNull(), 1).when(two.isNotNull(), 2).alias("answer"), error.alias("error"))


MOST_DOCUMENTS, MOST_PAGES = 64, 1024


def check_ocr_budget(documents: int, pages: int, docs_at_once: int, pages_at_once: int, in_flight: int) -> None:
    """Raise InvalidParameter where a run of page reading is beyond its limits."""
    for field, value, most in (("documents", documents, MOST_DOCUMENTS), ("pages", pages, MOST_PAGES)):
        if value > most:
            raise InvalidParameter(field, f"{value} exceeds {most}")
    if min(docs_at_once, pages_at_once) < 1:
        raise InvalidParameter("concurrency", "must be 1 at least")
    if docs_at_once * pages_at_once > in_flight:
        raise InvalidParameter("concurrency", f"{docs_at_once} x {pages_at_once} exceeds {in_flight} in flight")


def join_pages(pages: DataFrame, doc: str, ordinal: str, text: str) -> DataFrame:
    """(doc, text): what was read of each page, in the pages' own order whatever order it came in, blank ones left out."""
    kept = pages.where(~_blank(F.col(text)))
    listed = F.sort_array(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(text).alias("t"))))
    return kept.groupBy(doc).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n\n").alias("text"))


def embed_texts(df: DataFrame, text: str, embed: Callable[[list[str]], list[Sequence[float]]], dim: int, batch: int = 32) -> DataFrame:
    """Adds ``embedding``: blank texts get the zero vector, all others go to ``embed`` in batches, in order.

    A batch that comes back with another number of vectors, or vectors of another length, is an error.
    """

    @pandas_udf(ArrayType(FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            full = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            out = [[0.0] * dim] * len(texts)
            for lo in range(0, len(full), batch):
                at = full[lo : lo + batch]
                got = embed([texts.iloc[i] for i in at])
                if len(got) != len(at) or any(len(v) != dim for v in got):
                    raise ValueError(f"{len(at)} vectors of {dim} dimensions are due, got {[len(v) for v in got]}")
                for i, v in zip(at, got, strict=True):
                    out[i] = list(v)
            yield pd.Series(out)

    return df.withColumn("embedding", vectors(F.col(text)))


def parse_reply(blocked: Column, parts: Column, schema: StructType) -> Column:
    """struct(decision, error) of a provider's reply: blocked prompts and blank replies are errors, text parts are
    joined and read as JSON.  Rules are checked by ``violations`` on the decision's fields."""
    text = F.trim(F.array_join(F.coalesce(parts, F.array().cast("array<string>")), ""))
    marked = StructType([*schema.fields, StructField("_bad", StringType())])
    read = F.from_json(text, marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    bad = read.isNull() | read["_bad"].isNotNull()
    error = F.when(blocked.isNotNull(), F.concat(F.lit("blocked: "), blocked)).when(text == "", "the reply has no text").when(bad, "the reply is no such JSON")
    return F.struct(F.when(error.isNull(), F.struct(*[read[f.name].alias(f.name) for f in schema])).alias("decision"), error.alias("error"))
