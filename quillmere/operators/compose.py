"""Whole reads put together from the operators (F16, RT9, RT15, RT16, RT19, GR2, GR19, J12, GOV6, L7, SRC12, SRC14, O1, O2)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmere.functions import text, valid
from quillmere.operators import facts as fact_ops
from quillmere.operators import governance, graph, identity, metering, names, retrieval

#: Facts that a context of extraction shows, and the likeness of the relevant ones.
ANCHORS = 6
RELEVANT = 12
LIKE = 0.5
#: Seconds between maintenance runs of a guild, and server facts in a prompt.
MAINTENANCE = 3600
SERVER_FACTS = 3
#: Tokens that names may take of a prompt.
NAME_TOKENS = 400

# Headings and labels of a prompt's sections, and the note on a person's names.
ASKER = "WHAT I KNOW ABOUT THE CURRENT ASKER\nFacts about the asker ONLY:"
REFERENCED = "REFERENCED USER: "
ABOUT = "Facts about {} ONLY. Do NOT attribute these to the asker."
SERVER = "SERVER COMMUNITY FACTS\nCommunity-wide traits:"
ONE_PERSON = "Coreference: these names all refer to ONE person: {}."
# Our own words around names and sections.
NAMED = "Address these people by the names that they chose; null is their name on the platform.\n"
BEFORE = "[MEMORY CONTEXT]\n\nWhat follows was learned over time and is not part of the talk at hand.\n\n"
AFTER = "\nUse it where it helps, and never say of one person what is known of another.\n"


def guild_ids(facts: DataFrame, messages: DataFrame) -> DataFrame:
    """J12, SO2: guilds that have facts or messages."""
    return facts.select("guild_id").union(messages.select("guild_id")).distinct()


def visible_facts(facts: DataFrame, blocked: DataFrame, allowed: Column | None, now: Column, states: DataFrame | None = None) -> DataFrame:
    """F16, GOV6: active, valid facts with consent whose sources an audience may see; with source states, only if all sources are current.

    Without an audience (allowed is None) nothing is shown.
    """
    if allowed is None:
        return facts.limit(0)
    rows = governance.visible(governance.consented(facts.where(valid.is_active() & valid.is_valid_at(now)), blocked), allowed)
    return rows if states is None else rows.join(fact_ops.stale(rows, states), ["guild_id", "id"], "left_anti")


def extraction_context(facts: DataFrame, vectors: DataFrame, batches: DataFrame, blocked: DataFrame, now: Column) -> DataFrame:
    """RT19: lines of what is known about each batch's subject (guild_id, query_id, subjects, embedding): its strongest facts, then the like ones."""
    open_ = retrieval.eligible(facts, blocked, now=now)
    pairs = retrieval.in_scope(retrieval.beside(open_, batches.select("guild_id", "query_id", "subjects")))
    order = Window.partitionBy("guild_id", "query_id").orderBy(F.desc("strength"), F.desc("confidence"), "id")
    first = pairs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= ANCHORS).select("guild_id", "query_id", "id", "n", F.lit(0).alias("part"))
    near = retrieval.top(retrieval.vector_search(vectors, batches, RELEVANT, LIKE).drop("rank"), RELEVANT)
    near = near.join(open_.select("guild_id", "id"), ["guild_id", "id"]).select("guild_id", "query_id", "id", F.col("rank").alias("n"), F.lit(1).alias("part"))
    best = first.unionByName(near).groupBy("guild_id", "query_id", "id").agg(F.min(F.struct("part", "n")).alias("at"))
    lines = best.join(open_.select("guild_id", "id", "text"), ["guild_id", "id"])
    return lines.select("guild_id", "query_id", "at", F.concat(F.lit("- ["), F.col("id"), F.lit("] "), F.col("text")).alias("line")).orderBy("guild_id", "query_id", "at")


def written_relations(proposed: DataFrame, rosters: DataFrame, aliases: DataFrame, entity_aliases: DataFrame) -> DataFrame:
    """GR2: observations of relations from proposals (guild_id, subject_key, fact_id, verb, from_token, from_entity, to_token, to_entity, confidence, seen_at).

    A token means a participant of the batch; a name means the one member who has
    it, else an entity. Proposals without two different ends are left out.
    """
    rows = proposed
    plain = identity.resolved(aliases, rows.select("guild_id", F.explode(F.array("from_entity", "to_entity")).alias("identifier")).where("identifier is not null").distinct())
    plain = plain.where("user_id is not null").select("guild_id", "identifier", F.col("user_id").alias("member"))
    slugs = identity.entity_slugs(rows.select("guild_id", F.explode(F.array("from_entity", "to_entity")).alias("name")).where("name is not null").distinct(), entity_aliases)
    for side, end in (("from", "src"), ("to", "dst")):
        people = rosters.select("guild_id", "subject_key", F.col("token").alias(f"{side}_token"), F.col("user_id").alias("person"))
        rows = rows.join(people, ["guild_id", "subject_key", f"{side}_token"], "left")
        rows = rows.join(plain.withColumnRenamed("identifier", f"{side}_entity"), ["guild_id", f"{side}_entity"], "left")
        rows = rows.join(slugs.select("guild_id", F.col("name").alias(f"{side}_entity"), F.col("slug").alias("thing")), ["guild_id", f"{side}_entity"], "left")
        user = F.coalesce("person", "member")
        rows = rows.withColumn(f"{end}_type", F.when(user.isNotNull(), "user").when(F.col("thing").isNotNull(), "entity")).withColumn(f"{end}_id", F.coalesce(user, "thing"))
        rows = rows.drop("person", "member", "thing")
    whole = rows.where("src_id is not null and dst_id is not null and not (src_type = dst_type and src_id = dst_id)")
    verb = F.replace(F.lower(text.stripped(F.col("verb"))), F.lit(" "), F.lit("_"))
    return whole.select("guild_id", "src_type", "src_id", "dst_type", "dst_id", verb.alias("verb"), "confidence", F.col("fact_id").alias("evidence_id"), "seen_at")


def matched_entities(names: DataFrame, entities: DataFrame, entity_aliases: DataFrame) -> DataFrame:
    """GR19, RT9: the entity that a name (guild_id, name) is the slug, the name or an alias of."""
    asked = identity.entity_slugs(names, entity_aliases)
    by_slug = asked.join(entities.select("guild_id", "slug", F.lit(0).alias("way")), ["guild_id", "slug"])
    named = asked.drop("slug").withColumn("k", text.normalize(F.col("name"))).join(entities.select("guild_id", text.normalize(F.col("name")).alias("k"), "slug", F.lit(1).alias("way")), ["guild_id", "k"]).drop("k")
    found = by_slug.select("guild_id", "name", "slug", "way").unionByName(named.select("guild_id", "name", "slug", "way"))
    return found.groupBy("guild_id", "name").agg(F.min(F.struct("way", "slug")).alias("m")).select("guild_id", "name", "m.slug")


def name_lines(members: DataFrame, chosen: DataFrame, facts: DataFrame, budget: int = NAME_TOKENS) -> DataFrame:
    """RT16: how to address a turn's members: query_id, lines (in order) and the tokens that they take with the words before them.

    members: guild_id, query_id, user_id, place (from 1); chosen: what
    names.conversational_names decided. At most eight members are named, none who has
    more than 500 active facts, and a line that does not fit is passed over.
    """
    asked = members.where(F.col("place") <= names.SUBJECTS)
    held = facts.where(valid.is_active()).select("guild_id", F.col("subject_id").alias("user_id"))
    many = held.join(asked.select("guild_id", "user_id").distinct(), ["guild_id", "user_id"], "left_semi").groupBy("guild_id", "user_id").agg(F.count("*").alias("n")).where(F.col("n") > names.FACTS)
    known = asked.join(many, ["guild_id", "user_id"], "left_anti").join(chosen.select("guild_id", "user_id", "name"), ["guild_id", "user_id"])
    quoted = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    line = F.concat(F.lit('{"user_id": '), quoted("user_id"), F.lit(', "name": '), F.when(F.col("name").isNull(), "null").otherwise(quoted("name")), F.lit("}"))
    listed = known.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("items"))

    def step(s, x):
        spent = s["spent"] + F.length(x["line"]) + 1
        fits = spent <= budget * 4
        return F.struct(F.when(fits, spent).otherwise(s["spent"]).alias("spent"), F.when(fits, F.concat(s["lines"], F.array(x["line"]))).otherwise(s["lines"]).alias("lines"))

    start = F.struct(F.lit(len(NAMED)).alias("spent"), F.array().cast("array<string>").alias("lines"))
    made = listed.select("query_id", F.aggregate("items", start, step).alias("s")).where(F.size("s.lines") > 0)
    return made.select("query_id", F.col("s.lines").alias("lines"), F.ceil(F.col("s.spent") / 4).cast("int").alias("tokens"))


def prompt_lines(recalled: DataFrame, server: DataFrame, facts: DataFrame, askers: DataFrame, aliases: DataFrame, chosen: DataFrame, budget: int, members: DataFrame | None = None) -> DataFrame:
    """RT15, RT12: lines for a prompt within a budget: facts about who asks, then about each other person, then the server's.

    recalled and server: guild_id, query_id, id, rank, recalled for the turn's members
    and for the server; askers: query_id, asker_id; chosen: names decided on;
    members as for name_lines, whose lines are paid for first. People come in the
    order of their first recalled fact, under the name they chose, else their
    strongest alias, else their id; who has several names has a note of them. See
    retrieval.injected for what is returned.
    """
    sources = F.coalesce(F.size(F.filter("citations", lambda c: (c["message_id"] != "") & (c["guild_id"] == F.col("guild_id")))), F.lit(0))
    held = facts.select("guild_id", "id", "subject_id", "text", "attribution", sources.alias("cited"))
    found = recalled.select("guild_id", "query_id", "id", "rank").join(held, ["guild_id", "id"]).where("subject_id is not null").join(askers, "query_id", "left")
    first = F.min("rank").over(Window.partitionBy("query_id", "subject_id"))
    own = F.coalesce(F.col("subject_id") == F.col("asker_id"), F.lit(False))
    found = found.withColumn("section", F.when(own, 0).otherwise(first).cast("int"))
    people = found.where("section > 0").select("guild_id", F.col("subject_id").alias("user_id")).distinct()
    called = aliases.join(people, ["guild_id", "user_id"], "left_semi")
    known = called.groupBy("guild_id", "user_id").agg(F.array_sort(F.collect_set("alias_norm")).alias("all")).join(identity.strongest(called), ["guild_id", "user_id"])
    people = people.join(known, ["guild_id", "user_id"], "left").join(chosen.select("guild_id", "user_id", "name"), ["guild_id", "user_id"], "left")
    note = F.when(F.size("all") > 1, F.concat(F.lit("\n"), F.replace(F.lit(ONE_PERSON), F.lit("{}"), F.array_join("all", ", "))))
    display = F.coalesce("name", "alias", "user_id")
    head = F.concat(F.lit(REFERENCED), display, F.coalesce(note, F.lit("")), F.lit("\n"), F.replace(F.lit(ABOUT), F.lit("{}"), display))
    found = found.join(people.select("guild_id", F.col("user_id").alias("subject_id"), head.alias("about")), ["guild_id", "subject_id"], "left")
    found = found.withColumn("head", F.when(F.col("section") == 0, ASKER).otherwise(F.col("about")))
    shared = server.where(F.col("rank") <= SERVER_FACTS).select("guild_id", "query_id", "id", "rank").join(held, ["guild_id", "id"]).where("subject_id is null")
    shared = shared.withColumn("section", F.lit(2**31 - 1)).withColumn("head", F.lit(SERVER))
    cols = ["query_id", "section", "rank", "id", "text", F.col("attribution.type").alias("attribution_type"), F.coalesce("attribution.speaker_name", "attribution.speaker_id").alias("speaker"), "head", "cited"]
    rows = found.select(*cols).unionByName(shared.select(*cols))
    room = budget
    if members is not None:
        rows = rows.join(name_lines(members, chosen, facts, min(NAME_TOKENS, budget)).select("query_id", "tokens"), "query_id", "left")
        room = F.lit(budget) - F.coalesce("tokens", F.lit(0))
    return retrieval.injected(rows, room, len(BEFORE) + len(AFTER))


def maintenance_due(cursors: DataFrame, now: Column, seconds: int = MAINTENANCE) -> DataFrame:
    """Guilds whose last run (key `maintenance`, an ISO time) is long enough ago."""
    last = F.try_to_timestamp("value")
    return cursors.where("key = 'maintenance'").where(last.isNull() | (F.unix_micros(now) - F.unix_micros(last) >= seconds * 1_000_000)).select("guild_id")


def health(facts: DataFrame, messages: DataFrame, vectors: DataFrame) -> DataFrame:
    """O1: for each guild its queue and the facts that wait for a vector; degraded if any message is dead."""
    waiting = fact_ops.pending_projections(facts, vectors).groupBy("guild_id").agg(F.count("*").alias("unprojected"))
    rows = guild_ids(facts, messages).join(metering.queue_counts(messages), "guild_id", "left").join(waiting, "guild_id", "left").na.fill(0)
    return rows.withColumn("status", F.when(F.col("dead") > 0, "degraded").otherwise("ok"))


def replayed(spark: SparkSession, path: str) -> DataFrame:
    """SRC14: messages of recorded conversations, JSON lines with case_id and messages, one row each in order."""
    schema = "case_id string, messages array<struct<message_id:string,channel_id:string,author_id:string,content:string,created_at:timestamp>>"
    return spark.read.schema(schema).json(path).select("case_id", F.posexplode("messages").alias("pos", "m")).select("case_id", "pos", "m.*")


def graph_page(nodes: DataFrame, edges: DataFrame, most: int = 5000) -> str:
    """SRC12, O3: a page that lists a graph's nodes and edges, for one guild's snapshot; refused above a size that a browser can show."""
    shown = {}
    for name, rows in (("nodes", nodes), ("edges", edges)):
        held = rows.limit(most + 1).collect()
        if len(held) > most:
            raise ValueError(f"more than {most} {name}; draw a part with graph.ego or graph.explorer")
        shown[name] = [r.asDict(recursive=True) for r in held]
    data = json.dumps(shown, default=str).replace("<", "\\u003c")
    script = "const d=JSON.parse(document.getElementById('d').textContent);for(const k of ['nodes','edges']){const t=document.createElement('pre');t.textContent=k+'\\n'+d[k].map(r=>Object.values(r).join('  ')).join('\\n');document.body.append(t)}"
    return f"<!doctype html><meta charset=utf-8><title>graph</title><script id=d type=application/json>{data}</script><script>addEventListener('load',()=>{{{script}}})</script>"
