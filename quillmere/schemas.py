"""Schemas of the engine's tables, as DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

CITATION = "struct<message_id:string,channel_id:string,guild_id:string,author_id:string,author_name:string,content_snippet:string,created_at:timestamp,message_url:string,role:string,revision:string,observation_id:string>"
ATTRIBUTION = "struct<type:string,speaker_id:string,speaker_name:string,actor_id:string>"

TABLES = {
    "messages": "guild_id string, message_id string, channel_id string, author_id string, subject_key string, content string, created_at timestamp, status string, mention_ids array<string>, author_is_bot boolean, edited boolean, edited_at timestamp, reply_to_message_id string, thread_parent_id string, governance map<string,bigint>, metadata map<string,string>",
    "facts": f"guild_id string, id string, subject_id string, text string, text_normalized string, category string, tier string, scope string, confidence double, strength double, occurrences bigint, attribution {ATTRIBUTION}, last_reinforced_at timestamp, created_at timestamp, updated_at timestamp, observed_at timestamp, valid_from timestamp, valid_until timestamp, expires_at timestamp, supersedes_id string, superseded_by_id string, related_user_ids array<string>, entity_slugs array<string>, tags array<string>, citations array<{CITATION}>, governance map<string,bigint>, version bigint",
    "vectors": "guild_id string, id string, subject_id string, embedding array<float>, version bigint",
    "aliases": "guild_id string, alias_norm string, user_id string, source string, weight double, updated_at timestamp",
    "links": "guild_id string, memory_id string, node_type string, node_id string, kind string, created_at timestamp",
    "relations": "guild_id string, src_type string, src_id string, dst_type string, dst_id string, verb string, polarity string, weight double, confidence double, occurrences bigint, evidence array<string>, valid_from timestamp, valid_until timestamp",
    "entities": "guild_id string, slug string, name string, kind string, linked_user_id string, summary string, aliases array<string>, fact_count bigint",
    "consent": "guild_id string, user_id string, opted_out boolean, generation bigint",
    "summaries": "guild_id string, subject_id string, text string, generated_at timestamp, source_fact_count bigint, schema_version bigint, sources array<struct<fact_id:string,version:bigint>>",
    "cursors": "guild_id string, key string, value string",
    "history": "guild_id string, fact_id string, kind string, detail string, at timestamp, fact_version bigint",
}

#: Columns that name a row.
KEYS = {
    "messages": ["guild_id", "message_id"],
    "facts": ["guild_id", "id"],
    "vectors": ["guild_id", "id"],
    "aliases": ["guild_id", "alias_norm", "user_id"],
    "links": ["guild_id", "memory_id", "node_type", "node_id", "kind"],
    "relations": ["guild_id", "src_type", "src_id", "dst_type", "dst_id", "verb"],
    "entities": ["guild_id", "slug"],
    "consent": ["guild_id", "user_id"],
    "summaries": ["guild_id", "subject_id"],
    "cursors": ["guild_id", "key"],
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def conformed(rows: DataFrame, name: str) -> DataFrame:
    """Rows with exactly a table's columns and types; missing ones are null, unknown ones are refused."""
    want = schema(name)
    unknown = set(rows.columns) - {f.name for f in want}
    if unknown:
        raise ValueError(f"{name} has no columns {sorted(unknown)}")
    from pyspark.sql import functions as F

    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want))
