"""Schemas of records, decisions and jobs, and the declared roles of an index's fields."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql.types import StructType

# The structured decision and its allowed values.
DECISION_DDL = """
identifiers struct<kio_docket: array<string>, saos_id: string>,
decision struct<date: string, result: string, orders: array<string>>,
panel array<struct<name: string, role: string>>,
parties struct<contracting_authority: string, appellant: string, awardee: string, interested_bidders: array<string>>,
procurement struct<subject: string, procedure_type: string, tender_id: string, cpv_codes: array<string>>,
costs array<struct<payer: string, recipient: string, amount: double, currency: string, label: string>>,
statutes_cited array<struct<code: string, article: string, paragraph: string, point: string, quote: string>>,
issues array<struct<issue_key: string, confidence: int>>,
chunks array<struct<position: int, section: string, body: string>>,
summary_short string
"""
DECISION_RESULTS = ("dismissed", "upheld", "partially_upheld", "discontinued", "annulled", "unknown")
PANEL_ROLES = ("chair", "member", "rapporteur", "other")
PROCEDURE_TYPES = ("open", "restricted", "competitive_dialogue", "negotiated", "design_contest", "other")
STATUTE_CODES = ("pzp", "kc", "kpc", "other")
ISSUE_KEYS = ("low_price", "participation_requirements", "subject_matter", "formal_defect", "evaluation_criteria", "exclusion", "other")

# Roles of the fields.
SEARCHABLE = (
    "content", "summary_short", "doc_id", "decision.date", "decision.result", "identifiers.kio_docket", "identifiers.saos_id",
    "parties.contracting_authority", "parties.appellant", "parties.awardee", "parties.interested_bidders", "panel.names", "panel.roles",
    "procurement.subject", "procurement.procedure_type", "procurement.tender_id", "procurement.cpv_codes", "issues.issue_key", "section",
)
FILTERABLE = (
    "silo", "doc_type", "doc_id", "decision_date", "decision_result", "decision.date", "decision.result",
    "parties_contracting_authority", "parties_appellant", "parties_awardee", "parties_interested_bidders",
    "parties.contracting_authority", "parties.appellant", "parties.awardee", "parties.interested_bidders",
    "procurement_subject", "procurement_procedure_type", "procurement_tender_id", "procurement_cpv_codes",
    "procurement.subject", "procurement.procedure_type", "procurement.tender_id", "procurement.cpv_codes",
    "identifiers_kio_docket", "identifiers_saos_id", "identifiers.kio_docket", "identifiers.saos_id",
    "panel_names", "panel_roles", "panel.names", "panel.roles", "issues_keys", "issues.issue_key", "section",
)
SORTABLE = ("decision_date", "doc_id")
TYPEAHEAD_FIELDS = ("id", "doc_id", "decision_date", "summary_short", "section")

JOB_DDL = """
job_id string, doc_id string, silo string, embedder_key string, generator_key string, status string, generation_mode string,
provider_job_id string, provider_kind string, submitted_batch_count int, chunk_count int, content_hash string,
submitted_at_ms long, completed_at_ms long, error string, created_at_ms long, updated_at_ms long, stale boolean,
retry_count int, max_retries int, last_error string, next_retry_at_ms long
"""
JOB_STATES = ("Pending", "Generating", "Generated", "Failed")


def decision_schema() -> StructType:
    return StructType.fromDDL(DECISION_DDL)


def job_schema() -> StructType:
    return StructType.fromDDL(JOB_DDL)


def prompt_schema() -> dict:
    """JSON schema of a decision for prompting, derived from the Spark schema; optional fields are nullable."""
    allowed = {"result": DECISION_RESULTS, "role": PANEL_ROLES, "procedure_type": PROCEDURE_TYPES, "code": STATUTE_CODES, "issue_key": ISSUE_KEYS}
    simple = {"string": "string", "integer": "integer", "double": "number", "long": "integer"}

    def of(kind, name: str) -> dict:
        if isinstance(kind, dict) and kind["type"] == "struct":
            return {"type": "object", "properties": {f["name"]: of(f["type"], f["name"]) for f in kind["fields"]}}
        if isinstance(kind, dict):
            return {"type": "array", "items": of(kind["elementType"], name)}
        return {"type": simple[kind], "enum": list(allowed[name])} if name in allowed else {"type": simple[kind], "nullable": True}

    return of(json.loads(decision_schema().json()), "")


@dataclass(frozen=True)
class IndexSpec:
    """What an index declares about its fields; stored as JSON beside its table."""

    searchable: tuple[str, ...] = SEARCHABLE
    filterable: tuple[str, ...] = FILTERABLE
    sortable: tuple[str, ...] = SORTABLE
    embedder_key: str = "gemini-embedding-001"
    dim: int = 768
    primary_key: str = "id"
    #: What fields count in the ranking; 1 where nothing is said.
    weights: dict = field(default_factory=dict)
    extra: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> IndexSpec:
        got = json.loads(text)
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in got.items()})
