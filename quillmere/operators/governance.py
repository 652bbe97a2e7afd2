"""Consent, fencing, visibility, purge and export (F5-F10, F16, GOV1-GOV6, SRC9, A13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions import valid

KEY = ["guild_id", "id"]


def merged_consent(current: DataFrame, changes: DataFrame) -> DataFrame:
    """GOV1: the latest choice of each member (guild_id, user_id, opted_out, at); generations stay."""
    last = changes.groupBy("guild_id", "user_id").agg(F.max_by("opted_out", "at").alias("now"))
    both = current.join(last, ["guild_id", "user_id"], "full_outer")
    return both.select("guild_id", "user_id", F.coalesce("now", "opted_out", F.lit(False)).alias("opted_out"), F.coalesce("generation", F.lit(0)).alias("generation"))


def bumped(consent: DataFrame, users: DataFrame) -> DataFrame:
    """GOV2: one more generation for some members (guild_id, user_id); members unknown so far begin at one."""
    more = users.select("guild_id", "user_id", F.lit(1).alias("more")).distinct()
    both = consent.join(more, ["guild_id", "user_id"], "full_outer")
    return both.select("guild_id", "user_id", F.coalesce("opted_out", F.lit(False)).alias("opted_out"), (F.coalesce("generation", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("generation"))


def involved(facts: DataFrame) -> DataFrame:
    """a row for each participant of each fact, with the generation stamped on the fact."""
    rows = facts.select(*KEY, "governance", F.explode(valid.participants()).alias("user_id"))
    return rows.select(*KEY, "user_id", F.coalesce(F.element_at("governance", F.col("user_id")), F.lit(0)).alias("stamped"))


def fenced(facts: DataFrame, consent: DataFrame) -> DataFrame:
    """facts without those that a participant's erasure has overtaken."""
    late = involved(facts).join(consent, ["guild_id", "user_id"]).where(F.col("generation") > F.col("stamped"))
    return facts.join(late.select(*KEY).distinct(), KEY, "left_anti")


def consented(facts: DataFrame, blocked: DataFrame) -> DataFrame:
    """Facts none of whose participants is blocked: opted out, or a bot (guild_id, user_id)."""
    bad = involved(facts).join(blocked.select("guild_id", "user_id").distinct(), ["guild_id", "user_id"], "left_semi")
    return facts.join(bad.select(*KEY).distinct(), KEY, "left_anti")


def visible(facts: DataFrame, allowed: Column) -> DataFrame:
    """facts all of whose sources lie in allowed channels (an array)."""
    return facts.where(valid.visible_in(allowed))


def audience_status(facts: DataFrame, allowed: Column) -> DataFrame:
    """for each guild what an audience sees: ready, restricted or unavailable."""
    seen = facts.groupBy("guild_id").agg(F.count("*").alias("n"), F.count_if(valid.visible_in(allowed)).alias("shown"))
    status = F.when(allowed.isNull(), "unavailable").when(F.col("shown") < F.col("n"), "restricted").otherwise("ready")
    return seen.select("guild_id", "n", "shown", status.alias("status"))


def allowed_channels(permissions: DataFrame) -> DataFrame:
    """channels that are open to all, or that every reader may read (guild_id, channel_id, reader, may_read, public)."""
    return permissions.groupBy("guild_id", "channel_id").agg((F.bool_or("public") | F.bool_and("may_read")).alias("allowed")).where("allowed").drop("allowed")


def batch_snapshot(messages: DataFrame) -> DataFrame:
    """GOV3: for each batch (guild_id, subject_key) the smallest generation that a participant had when its messages came."""
    rows = messages.select("guild_id", "subject_key", F.explode("governance").alias("user_id", "generation"))
    return rows.groupBy("guild_id", "subject_key", "user_id").agg(F.min("generation").alias("generation"))


def revoked(snapshot: DataFrame, consent: DataFrame) -> DataFrame:
    """GOV3: batches with a participant who opted out or was erased since."""
    late = snapshot.alias("s").join(consent.alias("c"), ["guild_id", "user_id"]).where("c.opted_out or c.generation > s.generation")
    return late.select("guild_id", "subject_key").distinct()


def personal_facts(facts: DataFrame, users: DataFrame) -> DataFrame:
    """GOV4: facts that a member has part in (guild_id, id, user_id)."""
    return involved(facts).join(users, ["guild_id", "user_id"]).select(*KEY, "user_id").distinct()


def purge_counts(facts: DataFrame, links: DataFrame, edges: DataFrame, aliases: DataFrame, messages: DataFrame, users: DataFrame) -> DataFrame:
    """GOV4, A13: rows that the erasure of each member would take: facts, links, relations, aliases, messages.

    Links go with their fact or their node, relations with an endpoint or their evidence.
    """
    own = personal_facts(facts, users)
    nodes = users.select("guild_id", "user_id", F.lit("user").alias("node_type"), F.col("user_id").alias("node_id"))
    by_fact = links.join(own.withColumnRenamed("id", "memory_id"), ["guild_id", "memory_id"]).select("user_id", *links.columns)
    by_node = links.join(nodes, ["guild_id", "node_type", "node_id"]).select("user_id", *links.columns)
    key = ["guild_id", "src_type", "src_id", "dst_type", "dst_id", "verb"]
    ends = [edges.where(f"{s}_type = 'user'").withColumn("user_id", F.col(f"{s}_id")).join(users, ["guild_id", "user_id"]).select("user_id", *key) for s in ("src", "dst")]
    shown = edges.select(*key, F.explode("evidence").alias("id")).join(own, KEY).select("user_id", *key)
    parts = {
        "facts": own.select("guild_id", "user_id"),
        "links": by_fact.unionByName(by_node).distinct().select("guild_id", "user_id"),
        "relations": ends[0].unionByName(ends[1]).unionByName(shown).distinct().select("guild_id", "user_id"),
        "aliases": aliases.join(users, ["guild_id", "user_id"]).select("guild_id", "user_id"),
        "messages": messages.withColumn("user_id", F.explode(F.array_distinct(F.concat(F.array("author_id"), "mention_ids")))).join(users, ["guild_id", "user_id"]).select("guild_id", "user_id"),
    }
    out = users.select("guild_id", "user_id").distinct()
    for name, rows in parts.items():
        out = out.join(rows.groupBy("guild_id", "user_id").agg(F.count("*").alias(name)), ["guild_id", "user_id"], "left")
    return out.select("guild_id", "user_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in parts))


def purged(facts: DataFrame, links: DataFrame, edges: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """GOV4: facts, links and relations after the erasure of some members."""
    own = personal_facts(facts, users).select(*KEY).distinct()
    left = links.join(own.withColumnRenamed("id", "memory_id"), ["guild_id", "memory_id"], "left_anti")
    nodes = users.select("guild_id", F.lit("user").alias("node_type"), F.col("user_id").alias("node_id"))
    left = left.join(nodes, ["guild_id", "node_type", "node_id"], "left_anti")
    for s in ("src", "dst"):
        edges = edges.join(nodes.withColumnsRenamed({"node_type": f"{s}_type", "node_id": f"{s}_id"}), ["guild_id", f"{s}_type", f"{s}_id"], "left_anti")
    key = ["guild_id", "src_type", "src_id", "dst_type", "dst_id", "verb"]
    shown = edges.select(*key, F.explode("evidence").alias("id")).join(own, KEY, "left_semi").select(*key).distinct()
    return facts.join(own, KEY, "left_anti"), left, edges.join(shown, key, "left_anti")


def without_author(messages: DataFrame, users: DataFrame) -> DataFrame:
    """GOV5: messages neither written by some members nor mentioning them."""
    rows = messages.withColumn("who", F.array_distinct(F.concat(F.array("author_id"), "mention_ids")))
    bad = rows.select("message_id", "guild_id", F.explode("who").alias("user_id")).join(users, ["guild_id", "user_id"], "left_semi")
    return messages.join(bad.select("guild_id", "message_id").distinct(), ["guild_id", "message_id"], "left_anti")


def exported(facts: DataFrame, entities: DataFrame, edges: DataFrame, consent: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC9, SO5, SO6: what a guild may take along: facts not fenced or blocked, entities without summaries, and edges all of whose evidence is among these facts."""
    kept = consented(fenced(facts, consent), consent.where("opted_out"))
    key = ["guild_id", "src_type", "src_id", "dst_type", "dst_id", "verb"]
    seen = edges.select(*key, F.explode(F.array_distinct("evidence")).alias("id")).join(kept.select(*KEY), KEY).groupBy(*key).agg(F.count("*").alias("seen"))
    drawn = edges.join(seen, key).where(F.col("seen") == F.size(F.array_distinct("evidence"))).drop("seen")
    return kept, entities.withColumn("summary", F.lit("")) if "summary" in entities.columns else entities, drawn
