"""Further queries over the canonical tables, each with the same question in SQL; see the catalogue.

Edges come from `notes`, links from `links` and entities from `things`, so that the
graph, retrieval, governance and queue operators all meet rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.functions import embed, score, text
from quillmere.operators import attribution, compose, facts, governance, graph, identity, lifecycle, metering, names, retrieval
from quillmere.plans.catalogue import _AGE, ACTIVE, LIFE, ORACLE, QUERIES, full, now, query, table_query
from quillmere.plans.fixtures import NOW
from quillmere.streaming import ingest

#: Edges of notes, with their evidence, in DuckDB's words.
EDGES = """, c as (select guild_id, src_type, src_id, dst_type, dst_id, verb, count(*) as occurrences, max(confidence) as confidence from notes group by all),
  edges as (select *, case verb when 'likes' then 'positive' when 'dislikes' then 'negative' else 'neutral' end as polarity, round(ln(1 + occurrences) * confidence, 6) as weight from c),
  seen as (select guild_id, src_id, dst_id, verb, evidence_id, min(seen_at) as t0 from notes group by all),
  held as (select guild_id, src_id, dst_id, verb, evidence_id as id from (select *, row_number() over (partition by guild_id, src_id, dst_id, verb order by t0 desc, evidence_id desc) as n from seen) x where n <= 8)"""
OPEN = f"{ACTIVE} and valid_from <= {NOW} and (expires_at is null or {NOW} < expires_at)"
LATE = "timestamp '2024-01-20 00:00:00'"
late = lambda: F.expr(LATE)


def nodes_of(df: DataFrame, *users: str) -> DataFrame:
    ids = F.explode(F.array(*map(F.lit, users))).alias("node_id")
    return df.select("guild_id").distinct().select("guild_id", F.lit("user").alias("node_type"), ids)


def subject_queries(df: DataFrame) -> DataFrame:
    said = F.lit("tell me about thing 13 and Thing 31").alias("text")
    return df.select("guild_id").distinct().select("guild_id", F.lit("q").alias("query_id"), said, F.array(F.lit("6"), F.lit("12")).alias("subjects"), F.lit(None).cast("array<float>").alias("embedding"))


def aliases_of(things: DataFrame) -> DataFrame:
    return things.select("guild_id", text.normalize(F.col("name")).alias("alias_norm"), "slug")


# Joins and channels


@query("links", "facts", sql=f" select guild_id, node_id, id from (select l.guild_id, l.node_id, f.id, row_number() over (partition by l.guild_id, l.node_id order by f.created_at desc, f.id) as n from (select distinct guild_id, memory_id, node_id from links where node_type = 'user' and node_id in ('7', '12')) l join facts f on f.guild_id = l.guild_id and f.id = l.memory_id where {ACTIVE}) x where n <= 3")
def links_for_nodes(li, f):
    return retrieval.links_for_nodes(li, f, nodes_of(f, "7", "12"), per_node=3).select("guild_id", "node_id", "id")


_LINKED = f""", nodes as (select guild_id, 'user' as node_type, unnest(['6', '12']) as node_id from (select distinct guild_id from facts) g union all select guild_id, 'entity', slug from things where linked_user_id in ('6', '12')),
  near as (select * from (select n.guild_id, n.node_type, n.node_id, f.id, row_number() over (partition by n.guild_id, n.node_type, n.node_id order by f.created_at desc, f.id) as r from nodes n join (select distinct guild_id, node_type, node_id, memory_id from links) l on l.guild_id = n.guild_id and l.node_type = n.node_type and l.node_id = n.node_id
    join facts f on f.guild_id = l.guild_id and f.id = l.memory_id where {ACTIVE}) x where r <= 50)"""


@query("links", "facts", "things", sql=_LINKED + " select guild_id, id, score from (select guild_id, id, 1.0e0 as score, row_number() over (partition by guild_id order by id) as n from (select distinct guild_id, id from near) y) x where n <= 50")
def links_channel(li, f, t):
    return retrieval.links_channel(li, f, subject_queries(f), t).select("guild_id", "id", "score")


_NAMED = f""", near as (select * from (select l.guild_id, l.node_id, f.id, row_number() over (partition by l.guild_id, l.node_id order by f.created_at desc, f.id) as r from (select distinct guild_id, node_type, node_id, memory_id from links where node_type = 'entity' and node_id in ('e13', 'e31')) l
    join facts f on f.guild_id = l.guild_id and f.id = l.memory_id where {ACTIVE}) x where r <= 50)"""


@query("links", "facts", "things", sql=_NAMED + " select guild_id, id, score from (select guild_id, id, 1.0e0 as score, row_number() over (partition by guild_id order by id) as n from (select distinct guild_id, id from near) y) x where n <= 50")
def entity_channel(li, f, t):
    return retrieval.entity_channel(subject_queries(f), aliases_of(t), li, f).select("guild_id", "id", "score")


@query("things", sql=" select distinct guild_id, slug from things where slug in ('e13', 'e31')")
def entity_hint(t):
    return retrieval.entity_mentions(subject_queries(t), aliases_of(t)).select("guild_id", "slug")


@query("facts", "consent", sql=f" select f.id from facts f where {OPEN} and not exists (select 1 from consent c where c.guild_id = f.guild_id and c.opted_out and (c.user_id = f.other_id or c.user_id = f.subject_id))")
def recall_eligible(f, c):
    return retrieval.eligible(full(f), c.where("opted_out"), now=now()).select("id")


_RECALL = f""", e as (select *, {_AGE} as age, f.text as said from facts f where {OPEN} and not exists (select 1 from consent c where c.guild_id = f.guild_id and c.opted_out and (c.user_id = f.other_id or c.user_id = f.subject_id))),
  ev as (select id, guild_id, subject_id, cast(embedding as double[]) as v from vectors), qv as (select cast(embedding as double[]) as q from vectors where id = '0'),
  sc as (select e.*, ev.v from e left join (select * from ev) ev on ev.guild_id = e.guild_id and ev.id = e.id),
  scoped as (select *, subject_id is null or subject_id in ('6', '12') as mine from sc),
  vs as (select s.guild_id, s.id, round(greatest(0, least(1, list_dot_product(s.v, qv.q) / sqrt(list_dot_product(s.v, s.v) * list_dot_product(qv.q, qv.q)))), 6) as score from scoped s cross join qv where s.v is not null and (select vv.subject_id is null or vv.subject_id in ('6', '12') from vectors vv where vv.id = s.id and vv.guild_id = s.guild_id)),
  vr as (select guild_id, id, score, row_number() over (partition by guild_id order by score desc, id) as rank from vs where score > 0),
  ks as (select guild_id, id, round(len(list_filter(['tell', 'order', 'kept', 'thing', '13'], lambda t: contains(concat(lower(said), ' '), t))) / 5, 6) as score from scoped where mine),
  kr as (select guild_id, id, score, row_number() over (partition by guild_id order by score desc, id) as rank from ks where score > 0),
  br as (select guild_id, id, row_number() over (partition by guild_id order by strength desc, confidence desc, id) as rank from scoped where mine),
  un as (select distinct guild_id, 'user' as node_type, unnest(['6', '12']) as node_id from facts union all select guild_id, 'entity', slug from things where linked_user_id in ('6', '12')),
  ln as (select * from (select n.guild_id, n.node_type, n.node_id, e.id, row_number() over (partition by n.guild_id, n.node_type, n.node_id order by e.created_at desc, e.id) as r from un n join (select distinct guild_id, node_type, node_id, memory_id from links) l on l.guild_id = n.guild_id and l.node_type = n.node_type and l.node_id = n.node_id join e on e.guild_id = l.guild_id and e.id = l.memory_id) x where r <= 50),
  lr as (select guild_id, id, row_number() over (partition by guild_id order by id) as rank from (select distinct guild_id, id from ln) y),
  en as (select * from (select l.guild_id, l.node_id, e.id, row_number() over (partition by l.guild_id, l.node_id order by e.created_at desc, e.id) as r from (select distinct guild_id, node_type, node_id, memory_id from links where node_type = 'entity' and node_id = 'e13') l join e on e.guild_id = l.guild_id and e.id = l.memory_id) x where r <= 50),
  er as (select guild_id, id, row_number() over (partition by guild_id order by id) as rank from (select distinct guild_id, id from en) y),
  st as (select * from (select *, row_number() over (partition by guild_id, src_id order by weight desc, dst_type, dst_id, verb) as pick from user_edges) x where pick <= 24),
  h1 as (select distinct guild_id, src_id as seed, dst_id from st where src_id in ('6', '12') and dst_id <> src_id),
  h2 as (select distinct h1.guild_id, h1.seed, s.dst_id from h1 join st s on s.guild_id = h1.guild_id and s.src_id = h1.dst_id where s.dst_id <> h1.seed),
  hn as (select distinct guild_id, dst_id as node_id from (select guild_id, dst_id from h1 union select guild_id, dst_id from h2) z),
  hl as (select * from (select n.guild_id, n.node_id, e.id, row_number() over (partition by n.guild_id, n.node_id order by e.created_at desc, e.id) as r from hn n join (select distinct guild_id, node_id, memory_id from links where node_type = 'user') l on l.guild_id = n.guild_id and l.node_id = n.node_id join e on e.guild_id = l.guild_id and e.id = l.memory_id) x where r <= 50),
  hr as (select guild_id, id, row_number() over (partition by guild_id order by id) as rank from (select distinct guild_id, id from hl) y),
  u as (select guild_id, id, rank from vr where rank <= 50 union all select guild_id, id, rank from kr where rank <= 50 union all select guild_id, id, rank from br where rank <= 8 union all select guild_id, id, rank from lr where rank <= 50 union all select guild_id, id, rank from er where rank <= 50 union all select guild_id, id, rank from hr where rank <= 50),
  fu as (select *, row_number() over (partition by guild_id order by fs desc, id) as n from (select guild_id, id, round(sum(1.0e0 / (60 + rank)), 9) as fs from u group by 1, 2) y),
  h as (select s.guild_id, s.id, s.subject_id, round(0.55e0 * coalesce(v.score, 0) + 0.25e0 * coalesce(k.score, 0) + 0.1e0 * case when er.id is null then 0 else 1 end + 0.1e0 * round(least(1.0, ln(1 + strength) / ln(11.0)) * exp(-age / greatest(1.0, strength)), 6), 6) as score
    from fu join scoped s on s.guild_id = fu.guild_id and s.id = fu.id left join (select * from vr where rank <= 50) v on v.guild_id = s.guild_id and v.id = s.id left join (select * from kr where rank <= 50) k on k.guild_id = s.guild_id and k.id = s.id left join (select * from er where rank <= 50) er on er.guild_id = s.guild_id and er.id = s.id where n <= 100),
  o as (select *, row_number() over (partition by guild_id, coalesce(subject_id, '__server__') order by score desc, id) as own from h),
  x as (select *, row_number() over (partition by guild_id order by score desc, id) as rank from o where own <= 4) select guild_id, rank, id, score from x where rank <= 8"""


@query("facts", "vectors", "links", "user_edges", "things", "consent", sql=_RECALL)
def recall_all_channels(f, v, li, e, t, c):
    vectors = v.join(f.select("guild_id", "id").where("guild_id = 'g0'"), ["guild_id", "id"], "left_semi")
    asked = subject_queries(f).drop("embedding", "text").withColumn("text", F.lit("tell order kept thing 13"))
    asked = asked.crossJoin(F.broadcast(v.where("id = '0'").select("embedding")))
    own = t.where("slug = 'e13'").select("guild_id", F.lit("thing 13").alias("alias_norm"), "slug")
    found = retrieval.recall(full(f), vectors, li, e, t, own, c.where("opted_out"), asked, now(), channels=retrieval.CHANNELS)
    return found.select("guild_id", "rank", "id", "score")


@query("facts", "vectors", sql=f", f as (select * from facts where {ACTIVE}) select f.id from f left join (select id, guild_id, cast(id as bigint) % 2 as have from vectors) v on v.id = f.id and v.guild_id = f.guild_id where have is null or have < version")
def pending_projections(f, v):
    return facts.pending_projections(f, v.withColumn("version", F.col("id").cast("long") % 2)).select("id")


@query("vectors", sql=" select id, case when cast(id as bigint) % 2 = 0 then 2 else 1 end as version from vectors")
def vectors_upserted(v):
    return facts.upserted_vectors(v.select("guild_id", "id", "embedding", "version"), v.where(F.col("id").cast("long") % 2 == 0).select("guild_id", "id", "embedding", F.lit(2).cast("long").alias("version"))).select("id", "version")


@query("facts", sql=f" select id, id as message_id from facts where {ACTIVE} and cast(id as bigint) % 97 = 3")
def facts_for_source(f):
    asked = f.where(F.col("id").cast("long") % 97 == 3).select("guild_id", F.col("id").alias("message_id"))
    return facts.for_sources(full(f), asked).select("id", "message_id")


@query("facts", sql=f" select id from facts where {ACTIVE} and cast(id as bigint) % 2 = 0")
def citations_revalidated(f):
    return facts.revalidated(f.select("guild_id", "id", (1 + F.col("id").cast("long") % 2).alias("version")), f).select("id")


@query("facts", sql=" select id, case when cast(id as bigint) % 7 = 0 then '2000-06-01' else cast(cast(last_reinforced_at as date) as string) end as day from facts")
def facts_touched(f):
    out = facts.touched(f, f.where(F.col("id").cast("long") % 7 == 0), now())
    return out.select("id", F.col("last_reinforced_at").cast("date").cast("string").alias("day"))


@query("facts", sql=" select id, strength + 1 as strength from facts")
def strength_reinforced(f):
    return f.select("id", score.reinforced(F.col("strength")).alias("strength"))


_SHOWN = f" select f.id from facts f where {OPEN} and channel_id in ('c1', 'c4') and not exists (select 1 from consent c where c.guild_id = f.guild_id and c.opted_out and (c.user_id = f.other_id or c.user_id = f.subject_id))"


@query("facts", "consent", sql=_SHOWN)
def visible_facts(f, c):
    return compose.visible_facts(full(f), c.where("opted_out"), F.array(F.lit("c1"), F.lit("c4")), now()).select("id")


@query("facts", "messages", sql=" select guild_id from facts union select guild_id from messages")
def guild_ids(f, m):
    return compose.guild_ids(f, m)


@query("facts", "messages", "vectors", sql=f""", w as (select f.guild_id, count(*) as unprojected from facts f left join vectors v on v.guild_id = f.guild_id and v.id = f.id where {ACTIVE.replace('valid_until', 'f.valid_until').replace('superseded_by_id', 'f.superseded_by_id')} and v.id is null group by 1),
  q as (select guild_id, count(*) filter (where status = 'pending') as pending, count(*) filter (where status = 'dead') as dead from messages group by 1), g as (select guild_id from facts union select guild_id from messages)
  select g.guild_id, coalesce(pending, 0) as pending, coalesce(unprojected, 0) as unprojected, case when coalesce(dead, 0) > 0 then 'degraded' else 'ok' end as status from g left join q using (guild_id) left join w using (guild_id)""")
def health(f, m, v):
    return compose.health(f, m, v).select("guild_id", "pending", "unprojected", "status")


@query("facts", sql=f""", a as (select guild_id, subject_id, count(*) as n from facts where {ACTIVE} and subject_id is not null group by 1, 2) select guild_id, subject_id, n from a where n >= 5 and n - case when subject_id like '%1' then 3 else 0 end >= 5""")
def profile_due(f):
    known = f.where("subject_id like '%1'").select("guild_id", "subject_id").distinct().withColumn("source_fact_count", F.lit(3))
    return metering.profile_due(f, known).select("guild_id", "subject_id", "n")


@query("facts", sql=f""", s as (select guild_id, subject_id, bool_and({ACTIVE} and cast(id as bigint) % 4 <> 1) as fine from facts where subject_id is not null group by 1, 2) select guild_id, subject_id from s where fine""")
def summaries_valid(f):
    used = F.struct(F.col("id").alias("fact_id"), F.when(F.col("id").cast("long") % 4 == 1, 2).otherwise(1).cast("long").alias("version"))
    summaries = f.where("subject_id is not null").groupBy("guild_id", "subject_id").agg(F.collect_list(used).alias("sources"))
    return metering.valid_summaries(summaries, f).select("guild_id", "subject_id")


# Graph


@query("notes", sql=EDGES + """, e as (select guild_id, src_id, dst_id, verb, array_to_string(list(h.id order by t0, h.id), ',') as evidence from held h join seen s using (guild_id, src_id, dst_id, verb) where s.evidence_id = h.id group by all)
  select guild_id, src_id, dst_id, verb, occurrences, weight, evidence from edges join e using (guild_id, src_id, dst_id, verb)""")
def relations_upserted(n):
    none = graph.merged_relations(n).limit(0)
    return graph.upserted_relations(none, n).select("guild_id", "src_id", "dst_id", "verb", "occurrences", "weight", F.array_join("evidence", ",").alias("evidence"))


@query("user_edges", sql=""", p as (select src_id as l, dst_id as r from user_edges where src_id <> dst_id order by src_id, dst_id limit 1)
  select guild_id, src_id, dst_id, verb, weight from user_edges, p where (src_id = l and dst_id = r) or (src_id = r and dst_id = l)""")
def edges_between(e):
    one = e.where("src_id <> dst_id").agg(F.min(F.struct("src_id", "dst_id")).alias("p")).first()["p"]
    return graph.between(e, one.src_id, one.dst_id).select("guild_id", "src_id", "dst_id", "verb", "weight")


@query("notes", sql=EDGES + ", p as (select src_id as l, dst_id as r from edges order by src_id, dst_id limit 1) select guild_id, verb, weight from edges, p where src_id = l and dst_id = r")
def edges_directed(n):
    e = graph.merged_relations(n, evidence=False)
    one = e.agg(F.min(F.struct("src_id", "dst_id")).alias("p")).first()["p"]
    return graph.edges_between(e, ("user", one.src_id), ("entity", one.dst_id)).select("guild_id", "verb", "weight")


@query("notes", "things", sql=EDGES + """, t as (select e.guild_id, e.src_id, coalesce(th.linked_user_id, e.dst_id) as dst_id, case when th.linked_user_id is null then 'entity' else 'user' end as dst_type, e.verb, e.weight from edges e left join things th on th.guild_id = e.guild_id and th.slug = e.dst_id where e.src_id = '6' or e.dst_id = 'e6'),
  m as (select guild_id, src_id, dst_type, dst_id, verb, max(weight) as weight from t where not (dst_type = 'user' and dst_id = src_id) group by all) select * from m order by weight desc, guild_id, src_id, dst_type, dst_id, verb limit 50""")
def relations_of(n, t):
    users = n.select("guild_id", F.lit("6").alias("user_id")).distinct()
    return graph.relations_of(graph.merged_relations(n, evidence=False), t, users).select("guild_id", "src_id", "dst_type", "dst_id", "verb", "weight")


@query("notes", "links", "facts", sql=EDGES + f""" select distinct guild_id, kind, user_id from (select guild_id, case polarity when 'neutral' then 'other' else polarity end as kind, src_id as user_id from edges where dst_id = 'e7'
  union all select f.guild_id, 'mentioned', f.subject_id from facts f join links l on l.guild_id = f.guild_id and l.memory_id = f.id where l.node_type = 'entity' and l.node_id = 'e7' and {ACTIVE}) x where user_id is not null""")
def users_for_entity(n, li, f):
    return graph.users_for_entity(graph.merged_relations(n, evidence=False), li, full(f), "e7").select("guild_id", "kind", "user_id")


@query("links", sql=" select guild_id, node_id as slug, count(distinct memory_id) as fact_count from links where kind = 'about_entity' group by 1, 2")
def entity_counts(li):
    return graph.entity_counts(li)


@query("things", sql=""", m as (select guild_id, case when slug in ('e1', 'e3') then 'e2' else slug end as slug, slug as alias from things) select guild_id, slug, count(*) as fact_count, string_agg(alias, ',' order by alias) as aliases from (select guild_id, slug, alias from m union select guild_id, slug, alias from m) x group by 1, 2""")
def entities_merged(t):
    rows = t.select("guild_id", "slug", F.array("slug").alias("aliases"), F.lit(1).cast("long").alias("fact_count"))
    moves = t.where("slug in ('e1', 'e3')").select("guild_id", F.col("slug").alias("from_slug"), F.lit("e2").alias("to_slug"))
    return graph.merged_entities(rows, moves).select("guild_id", "slug", "fact_count", F.array_join("aliases", ",").alias("aliases"))


@query("facts", "notes", "consent", sql=EDGES + ", v as (" + _SHOWN[1:].replace("select f.id", "select f.guild_id, f.id") + """), s as (select h.guild_id, h.src_id, h.dst_id, h.verb, count(v.id) as seen, count(*) as n from held h left join v on v.guild_id = h.guild_id and v.id = h.id group by all)
  select guild_id, src_id, dst_id, verb, seen = n as whole from s where seen > 0""")
def edges_for_audience(f, n, c):
    seen = compose.visible_facts(full(f), c.where("opted_out"), F.array(F.lit("c1"), F.lit("c4")), now())
    edges = graph.merged_relations(n)
    some = graph.eligible_edges(edges, seen).where(F.size("evidence") > 0).select("guild_id", "src_id", "dst_id", "verb")
    every = graph.eligible_edges(edges, seen, every=True).select("guild_id", "src_id", "dst_id", "verb", F.lit(True).alias("whole"))
    return some.join(every, ["guild_id", "src_id", "dst_id", "verb"], "left").na.fill(False, ["whole"])


_GRAPH = EDGES + """, un as (select guild_id, subject_id as node_id from facts where subject_id is not null union select guild_id, other_id from facts union select guild_id, node_id from links where node_type = 'user' union select guild_id, src_id from edges union select guild_id, linked_user_id from things where linked_user_id is not null),
  nodes as (select guild_id, 'user' as node_type, node_id from un union all select distinct guild_id, 'entity', slug from things),
  drawn as (select guild_id, src_type, src_id, dst_type, dst_id, verb, polarity, weight from edges union all select guild_id, 'entity', slug, 'user', linked_user_id, 'is', 'neutral', 1.0 from things where linked_user_id is not null)"""


@query("facts", "links", "notes", "things", sql=_GRAPH + " select guild_id, concat('edge ', verb) as what, count(*) as n from drawn group by 1, 2 union all select guild_id, concat('node ', node_type), count(*) from nodes group by 1, 2")
def graph_snapshot(f, li, n, t):
    nodes, drawn = graph.snapshot(full(f), li, graph.merged_relations(n, evidence=False), t)
    ends = drawn.groupBy("guild_id", F.concat(F.lit("edge "), "verb").alias("what")).agg(F.count("*").alias("n"))
    return ends.unionByName(nodes.groupBy("guild_id", F.concat(F.lit("node "), "node_type").alias("what")).agg(F.count("*").alias("n")))


@query("facts", "links", "notes", "things", sql=_GRAPH + ", sn as (select * from nodes where contains(node_id, '1')) select d.guild_id, d.src_id, d.dst_id, d.verb, d.weight from drawn d join sn a on a.guild_id = d.guild_id and a.node_type = d.src_type and a.node_id = d.src_id join sn b on b.guild_id = d.guild_id and b.node_type = d.dst_type and b.node_id = d.dst_id where d.weight >= 0.5 and d.polarity in ('positive', 'neutral')")
def graph_explorer(f, li, n, t):
    nodes, drawn = graph.snapshot(full(f), li, graph.merged_relations(n, evidence=False), t)
    return graph.explorer(nodes, drawn, ["user", "entity"], "1", ["positive", "neutral"], 0.5)[1].select("guild_id", "src_id", "dst_id", "verb", "weight")


@query("things", sql=" select distinct guild_id, slug from things where slug in ('e4', 'e9')")
def entities_matched(t):
    asked = t.select("guild_id").distinct().select("guild_id", F.explode(F.array(F.lit("Thing 4"), F.lit("e9"), F.lit("nothing"))).alias("name"))
    return compose.matched_entities(asked, t, aliases_of(t)).select("guild_id", "slug")


_PROMPT = f""", held as (select * from facts where {ACTIVE}), asked as (select distinct guild_id, subject_id as asker_id from held where subject_id is not null),
  near as (select a.guild_id, a.asker_id, f.id, f.subject_id, f.text, row_number() over (partition by a.guild_id, a.asker_id order by f.strength desc, f.id) as rank from asked a join held f on f.guild_id = a.guild_id and (f.subject_id = a.asker_id or (f.other_id = a.asker_id and f.subject_id <> a.asker_id))),
  own as (select *, case when subject_id = asker_id then 0 else min(rank) over (partition by guild_id, asker_id, subject_id) end as section from near where rank <= 8),
  shared as (select guild_id, id, text, row_number() over (partition by guild_id order by strength desc, id) as rank from held where subject_id is null),
  called as (select user_id, list(distinct alias_norm order by alias_norm) as names, arg_max(alias_norm, {{'r': case source when 'discord_username' then 100 when 'display_name' then 70 when 'mention' then 60 else 50 end, 'w': weight, 'n': alias_norm}}) as best from aliases where guild_id = 'g0' group by 1),
  lines as (select guild_id, asker_id, section, rank, id, text, case when section = 0 then 'WHAT I KNOW ABOUT THE CURRENT ASKER' else concat('REFERENCED USER: ', coalesce(c.best, subject_id)) end as heading, section > 0 and coalesce(len(c.names), 0) > 1 as noted from own o left join called c on c.user_id = o.subject_id and o.guild_id = 'g0'
    union all select a.guild_id, a.asker_id, 2147483647, s.rank, s.id, s.text, 'SERVER COMMUNITY FACTS', false from asked a join shared s on s.guild_id = a.guild_id and s.rank <= 3)
  select guild_id, asker_id, heading, noted, id, concat('- ', text) as line, cast(row_number() over (partition by guild_id, asker_id order by section, rank, id) as bigint) as ref from lines"""


@query("facts", "aliases", sql=_PROMPT)
def prompt_lines(f, a):
    """Each subject asks, within a budget that holds all; budgets that don't are tested against prompts written out."""
    held = full(f.where(ACTIVE))
    who = F.concat_ws(" ", "guild_id", "asker_id").alias("query_id")
    asked = held.where("subject_id is not null").select("guild_id", F.col("subject_id").alias("asker_id")).distinct().select("*", who)
    cols = ["guild_id", "query_id", "id", "strength"]
    own = asked.join(held.withColumn("asker_id", F.col("subject_id")), ["guild_id", "asker_id"]).select(*cols)
    told = asked.join(held.where("other_id <> subject_id").withColumn("asker_id", F.col("other_id")), ["guild_id", "asker_id"]).select(*cols)
    recalled = retrieval.top(own.unionByName(told).withColumnRenamed("strength", "score"), retrieval.TOP_K)
    shared = retrieval.top(held.where("subject_id is null").select("guild_id", F.lit("").alias("query_id"), "id", F.col("strength").alias("score")), compose.SERVER_FACTS)
    server = asked.select("guild_id", "query_id").join(shared.drop("query_id"), "guild_id")
    chosen = a.select("guild_id", "user_id", F.lit("").alias("name")).limit(0)
    lines = compose.prompt_lines(recalled, server, held, asked.select("query_id", "asker_id"), a, chosen, 4000).join(asked, "query_id")
    noted = F.contains(F.coalesce("head", F.lit("")), F.lit("\nCoreference: "))
    return lines.select("guild_id", "asker_id", F.split("head", "\n")[0].alias("heading"), noted.alias("noted"), "id", "line", F.col("ref").cast("long").alias("ref"))


# Governance


_PURGE = EDGES + """, u as (select guild_id, author_id as user_id from messages group by 1, 2), o as (select distinct f.guild_id, f.id, u.user_id from facts f join u on u.guild_id = f.guild_id and (u.user_id = f.subject_id or u.user_id = f.other_id)),
  ms as (select x.guild_id, u.user_id, count(*) as messages from messages x join u on u.guild_id = x.guild_id and (u.user_id = x.author_id or u.user_id = x.mentioned) group by 1, 2), cf as (select guild_id, user_id, count(*) as facts from o group by 1, 2),
  cl as (select guild_id, user_id, count(*) as links from (select o.user_id, l.* from links l join o on o.guild_id = l.guild_id and o.id = l.memory_id union select u.user_id, l.* from links l join u on u.guild_id = l.guild_id and l.node_type = 'user' and l.node_id = u.user_id) x group by 1, 2),
  ce as (select guild_id, user_id, count(*) as relations from (select e.guild_id, u.user_id, e.src_id, e.dst_id, e.verb from edges e join u on u.guild_id = e.guild_id and u.user_id = e.src_id union select h.guild_id, o.user_id, h.src_id, h.dst_id, h.verb from held h join o on o.guild_id = h.guild_id and o.id = h.id) x group by 1, 2),
  ca as (select u.guild_id, u.user_id, count(*) as aliases from aliases a join u on u.guild_id = a.guild_id and u.user_id = a.user_id group by 1, 2)
  select u.guild_id, u.user_id, coalesce(facts, 0) as facts, coalesce(links, 0) as links, coalesce(relations, 0) as relations, coalesce(aliases, 0) as aliases, coalesce(messages, 0) as messages from u left join cf using (guild_id, user_id) left join cl using (guild_id, user_id) left join ce using (guild_id, user_id) left join ca using (guild_id, user_id) left join ms using (guild_id, user_id)"""


@query("facts", "messages", "links", "notes", "aliases", sql=_PURGE)
def purge_counts(f, m, li, n, a):
    users = m.select("guild_id", F.col("author_id").alias("user_id")).distinct()
    return governance.purge_counts(full(f), li, graph.merged_relations(n), a, m.withColumn("mention_ids", F.array("mentioned")), users)


@query("facts", "links", "notes", sql=EDGES + """, g as (select id, guild_id from facts where subject_id = '3' or other_id = '3'), l as (select count(*) as n from links l where not exists (select 1 from g where g.guild_id = l.guild_id and g.id = l.memory_id) and not (node_type = 'user' and node_id = '3')),
  e as (select count(*) as n from edges x where src_id <> '3' and not exists (select 1 from held h join g on g.guild_id = h.guild_id and g.id = h.id where h.guild_id = x.guild_id and h.src_id = x.src_id and h.dst_id = x.dst_id and h.verb = x.verb))
  select 'facts' as what, count(*) as n from facts f where not exists (select 1 from g where g.guild_id = f.guild_id and g.id = f.id) union all select 'links', n from l union all select 'relations', n from e""")
def purged(f, li, n):
    users = f.select("guild_id", F.lit("3").alias("user_id")).distinct()
    parts = zip(("facts", "links", "relations"), governance.purged(full(f), li, graph.merged_relations(n), users), strict=True)
    made = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, rows in parts]
    return made[0].unionByName(made[1]).unionByName(made[2])


_KEPT = " select f.guild_id, f.id from facts f where not exists (select 1 from consent c where c.guild_id = f.guild_id and ((c.user_id = f.other_id and (c.opted_out or c.generation > f.stamped)) or (c.user_id = f.subject_id and (c.opted_out or (c.user_id <> f.other_id and c.generation > 0)))))"


@query("facts", "things", "notes", "consent", sql=EDGES + ", k as (" + _KEPT + """), s as (select h.guild_id, h.src_id, h.dst_id, h.verb, count(k.id) as seen, count(*) as n from held h left join k on k.guild_id = h.guild_id and k.id = h.id group by all)
  select guild_id, 'fact' as what, id as name from k union all select guild_id, 'edge', concat(src_id, ' ', verb, ' ', dst_id) from s where seen = n""")
def export_visible(f, t, n, c):
    kept, _, drawn = governance.exported(full(f), t, graph.merged_relations(n), c)
    edges = drawn.select("guild_id", F.lit("edge").alias("what"), F.concat_ws(" ", "src_id", "verb", "dst_id").alias("name"))
    return kept.select("guild_id", F.lit("fact").alias("what"), F.col("id").alias("name")).unionByName(edges)


@query("messages", sql=" select guild_id, subject_key, author_id as user_id, min(cast(message_id as bigint) % 3) as generation from messages group by 1, 2, 3")
def batch_snapshot(m):
    rows = m.withColumn("governance", F.create_map("author_id", F.col("message_id").cast("long") % 3))
    return governance.batch_snapshot(rows)


@query("messages", "consent", sql=", s as (select guild_id, subject_key, author_id as user_id, min(cast(message_id as bigint) % 3) as generation from messages group by 1, 2, 3) select distinct s.guild_id, s.subject_key from s join consent c on c.guild_id = s.guild_id and c.user_id = s.user_id where c.opted_out or c.generation > s.generation")
def batches_revoked(m, c):
    rows = m.withColumn("governance", F.create_map("author_id", F.col("message_id").cast("long") % 3))
    return governance.revoked(governance.batch_snapshot(rows), c)


@query("messages", sql=" select message_id from messages where author_id not in ('5', '9') and mentioned not in ('5', '9')")
def governance_dropped(m):
    users = m.select("guild_id").distinct().select("guild_id", F.explode(F.array(F.lit("5"), F.lit("9"))).alias("user_id"))
    return governance.without_author(m.withColumn("mention_ids", F.array("mentioned")), users).select("message_id")


@query("consent", "messages", sql=", l as (select guild_id, author_id as user_id, arg_max(cast(message_id as bigint) % 2 = 0, cast(message_id as bigint)) as choice from messages where cast(message_id as bigint) % 3 = 0 group by 1, 2) select guild_id, user_id, coalesce(l.choice, c.opted_out, false) as opted_out, coalesce(generation, 0) as generation from consent c full join l using (guild_id, user_id)")
def consent_merged(c, m):
    some = m.where(F.col("message_id").cast("long") % 3 == 0)
    changes = some.select("guild_id", F.col("author_id").alias("user_id"), (F.col("message_id").cast("long") % 2 == 0).alias("opted_out"), F.col("message_id").cast("long").alias("at"))
    return governance.merged_consent(c, changes)


@query("consent", sql=" select guild_id, user_id, opted_out, generation + case when user_id like '%7' then 1 else 0 end as generation from consent")
def generations_bumped(c):
    return governance.bumped(c, c.where("user_id like '%7'"))


@query("messages", sql=" select guild_id, channel_id from (select guild_id, channel_id, bool_or(channel_id = 'click') or bool_and(cast(author_id as bigint) % 2 = cast(substr(guild_id, 2) as bigint) % 2) as allowed from messages group by 1, 2) x where allowed")
def channels_allowed(m):
    reads = F.col("author_id").cast("long") % 2 == F.substring("guild_id", 2, 9).cast("long") % 2
    return governance.allowed_channels(m.select("guild_id", "channel_id", F.col("author_id").alias("reader"), reads.alias("may_read"), (F.col("channel_id") == "click").alias("public")))


@query("facts", sql=" select guild_id, n, shown, case when shown < n then 'restricted' else 'ready' end as status from (select guild_id, count(*) as n, count(*) filter (where channel_id in ('c1', 'c4')) as shown from facts group by 1) x")
def audience_status(f):
    return governance.audience_status(full(f), F.array(F.lit("c1"), F.lit("c4")))


# Identity and names


@query("persons", sql=""", r as (select guild_id, user_id, 'discord_username' as source, lower(username) as alias_norm, 0.95e0 as base, regexp_full_match(lower(username), '[a-z0-9._-]{2,32}') as formed from persons union all select guild_id, user_id, 'display_name', lower(display_name), 0.7e0, false from persons)
  select guild_id, user_id, alias_norm, source, case when source = 'discord_username' then 1.0e0 else base end as weight from r where not regexp_full_match(alias_norm, '[0-9]+')""")
def aliases_of_members(p):
    return identity.from_members(p).select("guild_id", "user_id", "alias_norm", "source", "weight")


@query("persons", sql=", a as (select guild_id, user_id, lower(display_name) as alias_norm from persons) select guild_id, user_id, alias_norm from a where not user_id like '%3'")
def aliases_without_user(p):
    rows = p.select("guild_id", "user_id", text.normalize(F.col("display_name")).alias("alias_norm"))
    return identity.without_user(rows, p.where("user_id like '%3'").select("guild_id", "user_id"))


@query("things", "persons", sql=", a as (select guild_id, concat('e', cast(cast(user_id as bigint) % 120 as string)) as slug, user_id from persons), s as (select guild_id, slug, min(user_id) as member from (select distinct * from a) x group by 1, 2 having count(*) = 1) select t.guild_id, t.slug, case when kind = 'person' then member end as linked_user_id from things t left join s using (guild_id, slug)")
def entities_bridged(t, p):
    named = p.select("guild_id", F.concat(F.lit("E"), (F.col("user_id").cast("long") % 120).cast("string")).alias("alias_norm"), "user_id")
    return identity.bridged(t.drop("linked_user_id"), named).select("guild_id", "slug", "linked_user_id")


@query("things", sql=" select guild_id, name, case when slug in ('e1', 'e2') then concat('known-', slug) else replace(lower(name), ' ', '-') end as slug from things")
def entity_slugs(t):
    known = t.where("slug in ('e1', 'e2')").select("guild_id", text.normalize(F.col("name")).alias("alias_norm"), F.concat(F.lit("known-"), "slug").alias("slug"))
    return identity.entity_slugs(t.select("guild_id", "name"), known)


def introduced(p: DataFrame) -> DataFrame:
    """What persons say of their names, in prose."""
    said = F.when(F.col("k") == 0, F.concat(F.lit("hey, call me "), "display_name")).when(F.col("k") == 1, F.concat(F.lit("my name is "), "display_name")).otherwise(F.concat(F.lit("I met "), "display_name"))
    return p.select("guild_id", "user_id", said.alias("text"), "k", "display_name")


@query("persons", sql=" select user_id, case k when 0 then 'preferred' else 'stated' end as kind, display_name as name from persons where k < 2")
def name_statement_rows(p):
    return names.name_statements(introduced(p)).select("user_id", "kind", "name")


@query("persons", sql=" select user_id, case k when 0 then 'preferred' else 'stated' end as kind, case k when 0 then display_name else concat('N', cast(3 + k as string)) end as name from persons where k < 2")
def conversational_names(p):
    """Two statements of each: an older one, and a newer one of the same kind for some; a preference that is newer wins."""
    at = lambda d: F.expr(f"timestamp '2024-01-0{d} 00:00:00'").alias("at")
    rows = p.where("k < 2").select("guild_id", "user_id", F.lit("m1").alias("message_id"), at(1), F.lit("stated").alias("kind"), F.lit("N0").alias("name"))
    newer = p.where("k < 2").select("guild_id", "user_id", F.lit("m2").alias("message_id"), at(2), F.when(F.col("k") == 0, "preferred").otherwise("stated").alias("kind"), F.when(F.col("k") == 0, F.col("display_name")).otherwise(F.concat(F.lit("N"), (F.col("k") + 3).cast("string"))).alias("name"))
    return names.conversational_names(rows.unionByName(newer)).select("user_id", "kind", "name")


@query("persons", sql=" select user_id, lower(display_name) as alias_norm, case k when 0 then 0.86e0 else 0.88e0 end as weight from persons where k < 2")
def aliases_mined(p):
    said = introduced(p).select("guild_id", F.col("user_id").alias("author_id"), F.col("text").alias("content"))
    return identity.mined(said).select("user_id", "alias_norm", "weight")


@query("persons", sql=" select user_id, display_name as name, 0.85e0 as weight from persons where k = 1")
def names_stated(p):
    return introduced(p).select("user_id", F.explode(text.stated_names(F.col("text"))).alias("n")).select("user_id", "n.name", "n.weight")


@query("persons", sql=", s as (select lower(display_name) as identifier, count(distinct user_id) as users, min(user_id) as one from persons where k < 2 group by 1) select identifier, case when users = 1 then one end as user_id, users > 1 as ambiguous from s")
def members_by_name_facts(p):
    said = introduced(p).select("guild_id", F.col("user_id").alias("id"), F.col("user_id").alias("subject_id"), "text")
    asked = p.select("guild_id", F.lower("display_name").alias("identifier")).distinct()
    return identity.by_name_facts(said, asked).select("identifier", "user_id", "ambiguous")


@query("aliases", sql=" select user_id, alias_norm, case source when 'discord_username' then 1.0e0 when 'display_name' then 0.7e0 when 'mention' then 0.6e0 else 0.5e0 end as base from aliases")
def alias_weights(a):
    return a.select("user_id", "alias_norm", text.weight_for_source(F.col("source")).alias("base"))


# Metering, queue and stream


@query("messages", sql=" select message_id, cast(coalesce(sum(prompt_tokens) over (partition by guild_id order by created_at, message_id rows between unbounded preceding and 1 preceding), 0) as bigint) as used, coalesce(sum(prompt_tokens) over (partition by guild_id order by created_at, message_id rows between unbounded preceding and 1 preceding), 0) + length(content) + 512 <= 5000 as granted from messages")
def budget_reserved(m):
    calls = m.select("guild_id", F.col("message_id").alias("call_id"), F.col("created_at").alias("at"), "prompt_tokens", F.length("content").alias("prompt_bytes"))
    return metering.reserved(calls, 5000).select(F.col("call_id").alias("message_id"), "used", "granted")


@query("says", sql=" select conv_id as case_id, count(*) as probes, cast(sum(turn % 3) as bigint) as expected, cast(sum(turn % 2) as bigint) as matched, cast(sum(turn % 4) as bigint) as returned, count(*) filter (where turn % 4 = 0 and role = 'user') as abstained from says group by 1")
def probe_metrics(s):
    rows = s.select(F.col("conv_id").alias("case_id"), (F.col("turn") % 3).alias("expected"), (F.col("turn") % 2).alias("matched"), (F.col("turn") % 4).alias("returned"), F.lit(0).alias("forbidden"), (F.col("role") == "user").alias("must_abstain"))
    return metering.probe_metrics(rows).drop("forbidden")


@query("facts", sql=" select guild_id, subject_id as subject_key, count(*) filter (where cast(id as bigint) % 4 = 0) as add, count(*) filter (where cast(id as bigint) % 4 = 1) as reinforce, count(*) filter (where cast(id as bigint) % 4 = 2) as update, count(*) filter (where cast(id as bigint) % 4 = 3) as invalidate from facts group by 1, 2")
def commit_summary(f):
    kind = F.element_at(F.array(*map(F.lit, ("add", "reinforce", "update", "invalidate"))), (F.col("id").cast("int") % 4) + 1)
    return metering.commit_summary(f.select("guild_id", F.col("subject_id").alias("subject_key"), kind.alias("kind")))


@query("messages", sql=""", w as (select *, row_number() over (partition by guild_id order by created_at, message_id) as r from messages where guild_id <> 'g1' or created_at > timestamp '2024-01-12 00:00:00' or (created_at = timestamp '2024-01-12 00:00:00' and message_id > '0'))
  select guild_id, count(*) as n, arg_max(message_id, {'a': created_at, 'b': message_id}) as message_id from w where r <= 100 group by 1 having count(*) >= 10""")
def window_after(m):
    cursors = m.where("guild_id = 'g1'").select("guild_id").distinct().select("guild_id", F.expr("timestamp '2024-01-12 00:00:00'").alias("at"), F.lit("0").alias("message_id"))
    return metering.window_after(m, cursors).select("guild_id", "n", "message_id")


@query("messages", sql=" select message_id, coalesce(count(*) filter (where status = 'pending') over (partition by guild_id order by created_at, message_id rows between unbounded preceding and 1 preceding), 0) >= 50 as over from messages")
def ingest_within_depth(m):
    return ingest.within_depth(m, 50).select("message_id", "over")


@query("messages", sql=" select message_id, case when status = 'dead' and guild_id = 'g2' then 'pending' else status end as status from messages")
def ingest_requeued(m):
    return ingest.requeued(m, "g2").select("message_id", "status")


@query("messages", sql=" select message_id, concat('ingest:user:', sha256(message_id)) as receipt from messages where cast(message_id as bigint) % 6 <> 2")
def ingest_unreceipted(m):
    done = m.where(F.col("message_id").cast("long") % 6 == 2).select(F.concat(F.lit("ingest:user:"), F.sha2("message_id", 256)).alias("key"))
    return ingest.without_receipts(m, done).select("message_id", "receipt")


@query("messages", sql=" select guild_id, subject_key, a + 1 as attempts, case when a + 1 >= 3 then 'dead' else 'pending' end as status from (select distinct guild_id, subject_key, cast(subject_key as bigint) % 4 as a from messages) x")
def ingest_after_failure(m):
    rows = m.select("guild_id", "subject_key", (F.col("subject_key").cast("long") % 4).alias("attempts")).distinct()
    return ingest.after_failure(rows, late()).select("guild_id", "subject_key", "attempts", "status")


@query("messages", sql=" select message_id, substr(sha256(content), 1, 16) as content from messages")
def ingest_private(m):
    return ingest.private(m).select("message_id", "content")


@query("queue", sql=" select message_id, case when n = 1 then 'accepted' else 'duplicate' end as outcome from (select message_id, unnest([1, 2, 3]) as n from queue) x")
def ingest_redelivered(q):
    """Every message three times: as it is, again the same, and once more at an earlier time with other words; the earliest counts."""
    rows = q.select("guild_id", "message_id", F.lit("u").alias("author_id"), F.lit(False).alias("author_is_bot"), F.lit(False).alias("edited"), F.lit(None).cast("timestamp").alias("edited_at"), "created_at", F.lit("some words").alias("content"))
    twice = rows.unionByName(rows).unionByName(rows.withColumn("created_at", F.col("created_at") - F.expr("interval 1 hour")).withColumn("content", F.lit("other words")))
    nobody = q.limit(0).select("guild_id", F.lit("u").alias("user_id"), F.lit(False).alias("opted_out"))
    return ingest.observed(twice, nobody).select("message_id", F.coalesce("reason", "status").alias("outcome"))


@query("queue", sql=f""", live as (select distinct guild_id, subject_key from queue where status = 'claimed' and lease_until > {LATE}), k as (select *, row_number() over (partition by guild_id, subject_key order by created_at, message_id) as n from queue q where status = 'pending' and not exists (select 1 from live l where l.guild_id = q.guild_id and l.subject_key = q.subject_key))
  select q.message_id, case when k.n <= 10 then 'claimed' else q.status end as status, case when k.n <= 10 then 'w9' else q.lease_owner end as lease_owner from queue q left join k on k.guild_id = q.guild_id and k.message_id = q.message_id""")
def queue_leased(q):
    return ingest.leased(q, "w9", late()).select("message_id", "status", "lease_owner")


@query("queue", sql=f" select message_id, case when status = 'claimed' and lease_until <= {LATE} then 'pending' else status end as status, case when status = 'claimed' and lease_until <= {LATE} then null else lease_owner end as lease_owner from queue")
def queue_reclaimed(q):
    return ingest.reclaimed(q, late()).select("message_id", "status", "lease_owner")


@query("queue", sql=f" select message_id, cast(epoch_us(case when status = 'claimed' and lease_owner = 'w1' and lease_until > {LATE} then {LATE} + interval '60' second else lease_until end) // 1000000 as bigint) as until from queue")
def queue_heartbeat(q):
    return ingest.extended(q, "w1", late()).select("message_id", F.unix_seconds("lease_until").alias("until"))


@query("queue", sql=" select message_id, case when status = 'claimed' and lease_owner = 'w2' then case when cast(message_id as bigint) % 3 = 0 then 'dead' else 'processed' end else status end as status from queue")
def queue_finished(q):
    done = q.select("guild_id", "message_id", F.when(F.col("message_id").cast("long") % 3 == 0, "dead").otherwise("processed").alias("status"))
    return ingest.finished(q, "w2", done).select("message_id", "status")


# Writing


@query("facts", "vectors", sql=f""", v as (select id, guild_id, cast(embedding as double[]) as e from vectors), k as (select f.guild_id, f.id, f.subject_id, f.category, v.e from facts f join v on v.guild_id = f.guild_id and v.id = f.id where {ACTIVE}), p as (select f.guild_id, f.id, f.subject_id, f.category, f.text, v.e from facts f join v on v.guild_id = f.guild_id and v.id = f.id),
  s as (select p.id, p.text, p.category, k.id as target_id, k.category as kc, round(greatest(0, least(1, list_dot_product(p.e, k.e) / sqrt(list_dot_product(p.e, p.e) * list_dot_product(k.e, k.e)))), 6) as similarity from p join k on k.guild_id = p.guild_id and k.subject_id is not distinct from p.subject_id)
  select id as proposal_id, target_id, similarity from (select *, row_number() over (partition by id order by similarity desc, target_id) as n from s where similarity > 0) x where n <= 6 and (similarity >= 0.85 or (similarity >= 0.35 and category = kc))""")
def semantic_neighbours(f, v):
    proposals = f.join(v.select("guild_id", "id", "embedding"), ["guild_id", "id"]).select("guild_id", "id", "subject_id", "text", "category", "embedding")
    return facts.semantic_neighbours(proposals, f, v).select("proposal_id", "target_id", "similarity")


@query("facts", sql=f""", d as (select guild_id, subject_id, text_normalized, min(id) as keep from facts where {ACTIVE} group by 1, 2, 3), p as (select *, (cast(id as bigint) % 10) / 10.0e0 as similarity, case when cast(id as bigint) % 2 = 0 then 'x' else text_normalized end as said from facts)
  select p.id, case when d.keep is not null then 'reinforce' when similarity >= 0.85 then 'update' else 'add' end as kind, case when d.keep is not null then d.keep when similarity >= 0.85 then 't' end as target_id from p left join d on d.guild_id = p.guild_id and d.subject_id is not distinct from p.subject_id and d.text_normalized = p.said""")
def reconciled(f):
    proposals = f.withColumn("text_normalized", F.when(F.col("id").cast("long") % 2 == 0, "x").otherwise(F.col("text_normalized")))
    near = f.select("guild_id", F.col("id").alias("proposal_id"), F.lit("t").alias("target_id"), ((F.col("id").cast("long") % 10) / 10.0).alias("similarity"))
    return facts.reconciled(proposals, f, near).select("id", "kind", "target_id")


@query("facts", sql=f""", a as (select id, case when {ACTIVE} and cast(id as bigint) % 9 = 2 then true else false end as gone from facts) select id, 'invalidated' as kind, 2 as fact_version from a where gone""")
def fact_history(f):
    after = facts.invalidated(f, f.where(F.col("id").cast("long") % 9 == 2), now())
    return facts.history(f, after).select("id", "kind", "fact_version")


@query("facts", sql=f""", k as (select distinct guild_id, subject_id from facts where {ACTIVE} and text_normalized = '1-urgentf'), r as (select distinct guild_id, subject_id from facts)
  select r.guild_id, r.subject_id, case when r.subject_id like '%4' then 'repeated' when k.guild_id is not null then 'known' else 'stored' end as status from r left join k on k.guild_id = r.guild_id and k.subject_id is not distinct from r.subject_id""")
def remembered(f):
    asked = f.select("guild_id", "subject_id").distinct().withColumns({"text": F.lit("1-URGENTF is my favourite"), "idempotency_key": F.coalesce("subject_id", F.lit(""))})
    known = f.withColumn("text_normalized", F.when(F.col("text_normalized") == "1-urgentf", "1-urgentf is my favourite").otherwise(F.col("text_normalized")))
    done = f.where("subject_id like '%4'").select("guild_id", F.col("subject_id").alias("key"))
    return facts.remembered(known, asked, done).select("guild_id", "subject_id", "status")


@query("facts", sql=f""", x as (select *, coalesce({ACTIVE} and expires_at <= {NOW}, false) as ex from facts), y as (select *, not ex and {ACTIVE} and tier <> 'core' and not manual and exp(-{_AGE} / (greatest(1.0, strength) * 300.0)) < 0.2 as fo from x),
  z as (select *, row_number() over (partition by guild_id, coalesce(subject_id, '__server__') order by list_position(['short_term', 'mid_term', 'long_term', 'core'], tier), strength, confidence, id) as rn, count(*) over (partition by guild_id, coalesce(subject_id, '__server__')) as n from y where {ACTIVE} and not coalesce(ex, false) and not coalesce(fo, false) and not manual),
  p as (select id, guild_id from z where rn <= n - case when subject_id is null then 5 else 3 end)
  select case when ex then 'expired' when fo then 'forgotten' when p.id is not null then 'pruned' end as swept, count(*) as n from y left join p on p.guild_id = y.guild_id and p.id = y.id group by 1""")
def maintenance_sweep(f):
    return lifecycle.swept(f, now(), LIFE).groupBy("swept").agg(F.count("*").alias("n"))


# Attribution, embeddings and text


@query("says", sql=" select conv_id, turn, case when trim(text, E' \\t\\n\\r') = '' then 0.0e0 else 1.0e0 end as length from says")
def hashing_embedder(s):
    found = embed.embedded(s, ["conv_id", "turn"])
    return found.select("conv_id", "turn", F.round(score.dot(F.col("embedding"), F.col("embedding")), 4).alias("length"))


@table_query("exact_cites", "select b.item_id, d.doc_id from benchmark b join (select doc_id, text from documents union all select 1000000000 + row_number() over (order by item_id), concat('  ', text, ' !') from benchmark) d on trim(lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g'))), ' .!?…') = trim(lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))), ' .!?…')")
def exact_cites(spark, d):
    """Claims that are a source's very words; items with blanks and a mark are among the claims. Keys are hashed to meet, then compared."""
    items, docs = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("benchmark", "documents"))
    place = F.expr("1000000000 + row_number() over (order by item_id)").alias("doc_id")
    claims = docs.select("doc_id", "text").unionByName(items.select(place, F.concat(F.lit("  "), "text", F.lit(" !")).alias("text")))
    key = attribution.comparable(F.col("text"))
    left = items.select("item_id", key.alias("said")).withColumn("h", F.xxhash64("said"))
    right = claims.select("doc_id", key.alias("claim")).withColumn("h", F.xxhash64("claim"))
    return left.join(right, "h").where("said = claim").select("item_id", "doc_id")


@query("says", sql=""", s as (select conv_id as reply_id, turn as pos, case when turn % 5 = 4 then 'ftp://x' else concat('https://h/', cast(turn % 3 as string)) end as url from says),
  f as (select * from (select *, row_number() over (partition by reply_id, url order by pos) as n from s) x where n = 1), u as (select *, url like 'https%' as ok from f)
  select reply_id, pos, case when ok then cast(sum(case when ok then 1 else 0 end) over (partition by reply_id order by pos) as bigint) end as number from u""")
def citation_registry(s):
    url = F.when(F.col("turn") % 5 == 4, "ftp://x").otherwise(F.concat(F.lit("https://h/"), (F.col("turn") % 3).cast("string")))
    rows = s.select(F.col("conv_id").alias("reply_id"), F.col("turn").alias("pos"), url.alias("url"), F.col("text").alias("excerpt"))
    return attribution.registry(rows).select("reply_id", "pos", "number")


@query("says", sql=" select conv_id, turn, case when a < 1 then 'none' else 'remember' end as action from (select conv_id, turn, case when turn % 2 = 0 then 1 else 0 end as a from says) x")
def commands(s):
    said = F.when(F.col("turn") % 2 == 0, F.lit("remember that tea is green")).otherwise(F.lit("tea is green"))
    return s.select("conv_id", "turn", text.command(said)["action"].alias("action"))
