"""Tables of the document-knowledge model, and the values that their fields may have."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(ddl: str):
    return lambda: T.StructType.fromDDL(ddl)


META = "metadata map<string,string>"
TIMES = "created_at timestamp, updated_at timestamp"
#: Schemas by table; call one to get its StructType (a running session parses it).
TABLES = {
    "sources": _struct(f"source_key string, source_type string, title string, file_name string, sha256 string, verification_status string, {META}, {TIMES}, content_sha256 string, branch string, topic string, first_batch_id string"),
    "knowledge_objects": _struct(f"id string, object_type string, branch string, topic string, subtopic string, micro_issue string, title string, original_text string, normalized_text string, source_key string, verification_status string, temporal_scope string, {META}, {TIMES}, authority_status string, usable_as_citation boolean"),
    "relationships": _struct(f"from_id string, relation_type string, to_id string, confidence decimal(5,4), verification_status string, {META}, relation_origin string"),
    "verification_issues": _struct("id long, object_id string, status string, issue_type string, description string, evidence array<string>, resolution string, created_at timestamp, resolved_at timestamp"),
    "ingestion_batches": _struct("batch_id string, source_key string, status string, object_count int, relationship_count int, report map<string,string>, started_at timestamp, completed_at timestamp"),
    "legal_cases": _struct(f"case_key string, title string, branch string, topic string, subtopic string, parties string, court string, status string, facts string, requests string, notes string, {META}, {TIMES}"),
    "case_documents": _struct(f"id long, case_id string, document_type string, title string, file_name string, source_key string, {META}"),
    "case_authorities": _struct("case_id string, object_id string, authority_role string, relevance_note string, verification_status string"),
    "case_drafts": _struct("case_id string, draft_type string, version int, title string, body string, drafting_status string, authority_report map<string,string>"),
    "micro_issues": _struct("id long, branch string, topic string, classification_title string, normalized_key string, micro_issue_name string"),
    "knowledge_object_micro_issues": _struct("object_id string, micro_issue_id long, assignment_origin string, confidence decimal(5,4), is_primary boolean"),
    "legislation_mentions": _struct("object_id string, raw_mention_text string, mention_type string, mention_origin string, law_number string, law_year string, article_number string, target_object_id string, resolution_status string, usable_as_authority boolean"),
    "index_points": _struct("point_id long, object_id string, title string, object_type string, branch string, topic string, subtopic string, micro_issue string, source_key string, vector array<float>, embedding_model string, embedding_version string, content_hash string"),
}

# The statuses and kinds of the model.
STATUSES = ("source_verified", "operationally_accepted", "machine_pending_human", "historical_only", "requires_post_2026_reassessment", "superseded")
CITABLE = ("source_verified", "operationally_accepted")
AUTHORITIES = ("source_authority", "human_verified_authority", "non_authoritative")
BATCH_STATES = ("started", "completed", "failed", "duplicate")
TERMINAL_STATES = ("completed", "failed", "duplicate")
