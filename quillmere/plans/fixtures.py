"""Canonical tables as projections of the driver's tables, in SQL that Spark and DuckDB both run.

The rules that choose rows are ours and mean nothing beyond giving every operator
something to do. `now` is the moment that all queries ask at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = "timestamp '2000-06-01 00:00:00'"
GUILD = "concat('g', cast(o_custkey % 4 as string))"

SQL = {
    "facts": f"""
        select {GUILD} as guild_id, cast(o_orderkey as string) as id,
          case when o_orderkey % 25 = 7 then null else cast(o_custkey as string) end as subject_id,
          concat('order of ', lower(o_orderpriority), case when o_orderkey % 6 = 0 then ' due tomorrow' when o_orderkey % 10 = 3 then ' seen today' else ' kept' end) as text,
          lower(concat(o_orderpriority, o_orderstatus)) as text_normalized,
          case o_orderpriority when '1-URGENT' then 'personal' when '2-HIGH' then 'rules' when '3-MEDIUM' then 'experiences' when '4-NOT SPECIFIED' then 'culture' else 'general' end as category,
          case when o_orderkey % 50 = 0 then 'core' when o_orderstatus = 'F' then 'long_term' when o_orderstatus = 'O' then 'mid_term' else 'short_term' end as tier,
          (o_orderkey % 100) / 100.0e0 as confidence, 1 + o_orderkey % 5 as occurrences, (1 + o_orderkey % 9) * 1.0e0 as strength, o_orderkey % 40 = 1 as manual,
          cast(o_orderdate as timestamp) as last_reinforced_at, cast(o_orderdate as timestamp) as created_at, cast(o_orderdate as timestamp) as valid_from,
          case when o_orderkey % 3 = 0 then cast(o_orderdate as timestamp) + interval '400' day end as valid_until,
          case when o_orderkey % 11 = 5 then cast(o_orderkey + 1 as string) end as superseded_by_id,
          case when o_orderstatus = 'P' then cast(o_orderdate as timestamp) + interval '7' day when o_orderstatus = 'O' then cast(o_orderdate as timestamp) + interval '365' day end as expires_at,
          cast(o_orderkey % 3 as bigint) as stamped, cast((o_custkey * 7 + o_orderkey) % 97 as string) as other_id,
          concat('c', cast(o_orderkey % 6 as string)) as channel_id, cast(1 as bigint) as version
        from {{orders}}""",
    "observations": """
        select concat('g', cast(o_custkey % 4 as string)) as guild_id, 'user' as src_type, cast(o_custkey as string) as src_id, 'entity' as dst_type, replace(p_name, ' ', '-') as dst_id,
          case l_returnflag when 'R' then 'dislikes' when 'A' then 'knows' else 'likes' end as verb, 1 - l_discount as confidence, cast(o_orderkey as string) as evidence_id, cast(l_shipdate as timestamp) as seen_at
        from {orders} join {lineitem} on l_orderkey = o_orderkey join {part} on p_partkey = l_partkey""",
    "user_edges": """
        select concat('g', cast(o_custkey % 4 as string)) as guild_id, 'user' as src_type, cast(o_custkey as string) as src_id, 'user' as dst_type, cast((o_custkey * 7 + o_orderkey) % 97 as string) as dst_id,
          case o_orderpriority when '1-URGENT' then 'admires' when '2-HIGH' then 'argues_with' else 'knows' end as verb, max((o_orderkey % 100) / 100.0e0) as weight, count(*) as occurrences
        from {orders} group by 1, 2, 3, 4, 5, 6""",
    "aliases": """
        select 'g0' as guild_id, lower(c_name) as alias_norm, cast(c_custkey as string) as user_id, 'discord_username' as source, 1.0e0 as weight from {customer}
        union all select 'g0', lower(c_mktsegment), cast(c_custkey as string), 'display_name', 0.7e0 from {customer} where c_custkey % 50 = 0
        union all select 'g0', lower(s_name), concat('s', cast(s_suppkey as string)), 'mention', 0.6e0 from {supplier}
        union all select 'g0', lower(n_name), concat('n', cast(n_nationkey as string)), 'backfill', 0.5e0 from {nation}""",
    "messages": """
        select cast(event_id as string) as message_id, concat('g', cast(user_id % 4 as string)) as guild_id, event_type as channel_id, cast(user_id as string) as author_id, cast(user_id as string) as subject_key,
          cast(ts as timestamp) as created_at, concat(event_type, ' ', props) as content, user_id % 29 = 3 as author_is_bot,
          case event_id % 10 when 0 then 'processed' when 1 then 'claimed' when 2 then 'dead' else 'pending' end as status, cast((user_id * 3 + event_id) % 11 as string) as mentioned, cast(floor(value) as bigint) as prompt_tokens
        from {events}""",
    "consent": """
        select distinct concat('g', cast(user_id % 4 as string)) as guild_id, cast(user_id as string) as user_id, user_id % 17 = 0 as opted_out, cast(user_id % 3 as bigint) as generation from {events}""",
    "vectors": "select cast(vec_id as string) as id, 'g0' as guild_id, case when label = 0 then null else cast(label as string) end as subject_id, embedding, cast(1 as bigint) as version from {embeddings}",
    "texts": """
        select doc_id, source as guild_id, lang as subject_id, text, 0.5e0 + 0.25e0 * coalesce(quality, 0) + 0.25e0 * (1 - coalesce(toxic, 0)) as confidence
        from (select d.doc_id, d.source, d.lang, d.text, l.quality, l.toxic from {documents} d left join {labels} l on l.doc_id = d.doc_id) x""",
    "links": f"""
        select {GUILD} as guild_id, cast(o_orderkey as string) as memory_id, 'user' as node_type, cast(o_custkey as string) as node_id, 'subject_of' as kind from {{orders}} where o_orderkey % 25 <> 7
        union all select {GUILD}, cast(o_orderkey as string), 'user', cast((o_custkey * 7 + o_orderkey) % 97 as string), 'about_user' from {{orders}} where (o_custkey * 7 + o_orderkey) % 97 <> o_custkey
        union all select {GUILD}, cast(o_orderkey as string), 'entity', concat('e', cast(o_orderkey % 60 as string)), 'about_entity' from {{orders}}""",
    "things": f"""
        select distinct {GUILD} as guild_id, concat('e', cast(o_orderkey % 60 as string)) as slug, concat('Thing ', cast(o_orderkey % 60 as string)) as name,
          case when o_orderkey % 60 % 2 = 0 then 'person' else 'concept' end as kind, case when o_orderkey % 60 % 6 = 0 then cast(o_orderkey % 60 as string) end as linked_user_id from {{orders}}""",
    "notes": f"""
        select {GUILD} as guild_id, 'user' as src_type, cast(o_custkey as string) as src_id, 'entity' as dst_type, concat('e', cast(o_orderkey % 60 as string)) as dst_id,
          case o_orderstatus when 'F' then 'likes' when 'O' then 'dislikes' else 'knows' end as verb, (o_orderkey % 100) / 100.0e0 as confidence, cast(o_orderkey as string) as evidence_id, cast(o_orderdate as timestamp) as seen_at
        from {{orders}}""",
    "queue": """
        select cast(event_id as string) as message_id, concat('g', cast(user_id % 4 as string)) as guild_id, cast(user_id as string) as subject_key, cast(ts as timestamp) as created_at,
          case event_id % 5 when 0 then 'claimed' when 1 then 'processed' else 'pending' end as status, case when event_id % 5 = 0 then case when event_id % 2 = 0 then 'w1' else 'w2' end end as lease_owner,
          case when event_id % 5 = 0 then timestamp '2024-01-20 00:00:00' + (event_id % 3 - 1) * interval '60' second end as lease_until
        from {events}""",
    "persons": "select 'g0' as guild_id, cast(c_custkey as string) as user_id, c_name as username, c_mktsegment as display_name, c_custkey % 3 as k from {customer}",
    "says": "select conv_id, turn, role, text from {conversations}",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A canonical table over the driver's tables."""
    sql = SQL[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql})


def cte(*names: str) -> str:
    """The same tables as the beginning of a DuckDB query."""
    return "with " + ",\n".join(f"{n} as ({SQL[n].format(**{t: t for t in TABLES})})" for n in names)
