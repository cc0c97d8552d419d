"""The tables of the ledgers as Spark types, with their keys.

Times are whole epoch seconds (`long`) unless a name says `_ms`; graph validity times are
ISO-8601 strings that compare as text. JSON arrays of tags are arrays, JSON objects strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType()), "array<double>": T.ArrayType(T.DoubleType())}


def _schema(fields: str) -> T.StructType:
    """A schema from `name type, ...`, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in map(str.split, fields.split(","))])


EVENTS = _schema("event_id string, ts long, channel string, content_types array<string>, content string, direction string, thread_id string, reply_to string, source_adapter string, source_id string, metadata_json string")
PARTICIPANTS = _schema("event_id string, contact_id string, role string")
CONTACTS = _schema("contact_id string, display_name string, source string, created_at long, updated_at long")
IDENTIFIERS = _schema("contact_id string, type string, value string, normalized string, last_seen_at long")
PERSONS = _schema("person_id string, canonical_name string, display_name string, is_me boolean, relationship_type string")
LINKS = _schema("person_id string, contact_id string, confidence double, source_type string, first_seen_at long, last_seen_at long")
THREADS = _schema("thread_id string, channel string, name string, source_adapter string, source_id string, parent_thread_id string")
ATTACHMENTS = _schema("attachment_id string, event_id string, filename string, mime_type string, media_type string, size_bytes long, created_at long")
EVENT_STATE = _schema("event_id string, read_state string, flagged boolean, archived boolean, status string")
TAGS = _schema("event_id string, tag_type string, value string, confidence double, source string, created_at long")
EPISODE_DEFINITIONS = _schema("definition_id string, name string, strategy string, channel string, config_json string")
EPISODES = _schema("episode_id string, definition_id string, channel string, thread_id string, start_time long, end_time long, event_count long, first_event_id string, last_event_id string")
EPISODE_EVENTS = _schema("episode_id string, event_id string, position int")
ANALYSIS_RUNS = _schema("run_id string, analysis_type string, episode_id string, status string, output_text string, started_at long, completed_at long")
FACETS = _schema("facet_id string, run_id string, episode_id string, facet_type string, value string, person_id string, confidence double, metadata_json string")
EMBEDDINGS = _schema("target_type string, target_id string, model string, embedding array<double>, dimension int, source_text_hash string")
DOCUMENT_HEADS = _schema("doc_key string, event_id string, channel string, title string, description string, content_hash string, retrieval_count long, last_retrieved_at long")
PERSON_FACTS = _schema("person_id string, category string, fact_type string, fact_value string, confidence double, source_type string, source_channel string, source_episode_id string, source_facet_id string, evidence string, is_sensitive boolean, is_identifier boolean, is_hard_identifier boolean, created_at long, updated_at long")
UNATTRIBUTED = _schema("fact_type string, fact_value string, source_episode_id string, context string, created_at long")
MERGE_EVENTS = _schema("merge_id string, source_person_id string, target_person_id string, merge_type string, similarity_score double, status string, auto_eligible boolean, created_at long, resolved_at long")
ENTITIES = _schema("entity_id string, canonical_name string, entity_type_id int, summary string, origin string, confidence double, merged_into string, created_at string, updated_at string")
ALIASES = _schema("entity_id string, alias string, alias_type string, normalized string, is_shared boolean, created_at string")
RELATIONSHIPS = _schema("relationship_id string, source_entity_id string, target_entity_id string, target_literal string, relation_type string, fact string, valid_at string, invalid_at string, created_at string, confidence double")
ENTITY_MENTIONS = _schema("episode_id string, entity_id string, mention_count long, created_at string")
RELATIONSHIP_MENTIONS = _schema("episode_id string, relationship_id string, extracted_fact string, asserted_by_entity_id string, source_type string, target_literal string, alias_id string, confidence double, created_at string")
MERGE_CANDIDATES = _schema("entity_a_id string, entity_b_id string, confidence double, auto_eligible boolean, reason string, matching_facts string, context string, conflicts string, status string")
SESSIONS = _schema("id string, source string, model string, project string, created_at long, message_count int, parent_session_id string, parent_message_id string, tool_call_id string, task_description string, task_status string, is_subagent int, workspace_path string, summary string")
MESSAGES = _schema("id string, session_id string, role string, content string, sequence int, timestamp long, metadata_json string")
TURNS = _schema("id string, session_id string, parent_turn_id string, query_message_ids string, response_message_id string, model string, token_count long, timestamp long, has_children int, tool_call_count int")
TOOL_CALLS = _schema("id string, message_id string, session_id string, tool_name string, tool_number int, params_json string, result_json string, status string, child_session_id string, started_at long, completed_at long")
BUS_EVENTS = _schema("seq long, type string, adapter string, event_id string, payload_json string, created_at long")

TABLES = {k.lower(): v for k, v in globals().items() if isinstance(v, T.StructType)}

#: Columns that identify a row of each table.
KEYS = {
    "events": ["source_adapter", "source_id"],
    "participants": ["event_id", "contact_id", "role"],
    "contacts": ["contact_id"],
    "identifiers": ["type", "normalized"],
    "persons": ["person_id"],
    "links": ["person_id", "contact_id"],
    "threads": ["thread_id"],
    "attachments": ["attachment_id"],
    "event_state": ["event_id"],
    "tags": ["event_id", "tag_type", "value"],
    "episode_definitions": ["name"],
    "episodes": ["episode_id"],
    "episode_events": ["episode_id", "event_id"],
    "analysis_runs": ["analysis_type", "episode_id"],
    "embeddings": ["target_type", "target_id", "model"],
    "document_heads": ["doc_key"],
    "person_facts": ["person_id", "category", "fact_type", "fact_value"],
    "entities": ["entity_id"],
    "entity_mentions": ["episode_id", "entity_id"],
    "merge_candidates": ["entity_a_id", "entity_b_id"],
    "sessions": ["id"],
    "messages": ["id"],
    "turns": ["id"],
    "tool_calls": ["id"],
}


def violations(df: DataFrame, table: str) -> DataFrame:
    """Keys of `table` that more than one row has."""
    return df.groupBy(*KEYS[table]).count().where("count > 1")


def target_violations(relationships: DataFrame) -> DataFrame:
    """Relationships with not exactly one of an entity target and a literal one."""
    return relationships.where(F.col("target_entity_id").isNull() == F.col("target_literal").isNull())


def conform(df: DataFrame, table: str) -> DataFrame:
    """`df` with the columns and types of `table`; missing columns are null, '' ids stay."""
    schema = TABLES[table]
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])
