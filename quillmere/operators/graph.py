"""Graph operators over links and typed relations (GR1-GR22, A8-A12, J6-J10, W7, SO1).

Relations: guild_id, src_type, src_id, dst_type, dst_id, verb, polarity, weight,
confidence, occurrences, evidence (array of fact ids). Every ranking is total:
weight first, then the edge's own key. Nodes are (type, id).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.functions import score, text

EDGE = ["guild_id", "src_type", "src_id", "dst_type", "dst_id", "verb"]
#: Evidence and citations that a row keeps, edges followed from a node, and hops.
KEEP = 8
FAN_OUT = 24
#: Factor on an edge's weight when a fact is withdrawn.
WITHDRAWN = 0.8


def by_weight() -> list[Column]:
    return [F.desc("weight"), *EDGE]


def merged_relations(observations: DataFrame, evidence: bool = True) -> DataFrame:
    """One active edge for each key from single observations (confidence, evidence_id, seen_at).

    Occurrences are counted, confidence is the largest, evidence the last few
    distinct facts by first sighting. Partial sums go before the shuffle; only the
    evidence of an edge is gathered, a row for each distinct fact, and only if asked for.
    """
    edges = observations.groupBy(*EDGE).agg(F.count("*").alias("occurrences"), F.max("confidence").alias("confidence"), F.max("seen_at").alias("last_seen_at"))
    if evidence:
        sighted = observations.groupBy(*EDGE, "evidence_id").agg(F.min("seen_at").alias("at"))
        order = Window.partitionBy(*EDGE).orderBy(F.desc("at"), F.desc("evidence_id"))
        last = sighted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= KEEP)
        kept = last.groupBy(*EDGE).agg(F.array_sort(F.collect_list(F.struct("at", "evidence_id"))).alias("e"))
        edges = edges.join(kept.select(*EDGE, F.col("e.evidence_id").alias("evidence")), EDGE)
    return edges.withColumn("polarity", text.polarity(F.col("verb"))).withColumn("weight", score.edge_weight(F.col("occurrences"), F.col("confidence")))


def upserted_relations(current: DataFrame, observations: DataFrame) -> DataFrame:
    """A8 against stored edges: occurrences add up, weight and confidence never fall, evidence is the last few."""
    new = merged_relations(observations).select(*EDGE, *(F.col(c).alias(f"n_{c}") for c in ("occurrences", "confidence", "evidence", "polarity", "weight")))
    both = current.join(new, EDGE, "full_outer")
    total = F.coalesce("occurrences", F.lit(0)) + F.coalesce("n_occurrences", F.lit(0))
    sure = F.greatest("confidence", "n_confidence")
    evidence = F.array_distinct(F.concat(F.coalesce("evidence", F.array().cast("array<string>")), F.coalesce("n_evidence", F.array().cast("array<string>"))))
    return both.select(
        *EDGE,
        total.alias("occurrences"),
        sure.alias("confidence"),
        F.slice(evidence, F.greatest(F.lit(1), F.size(evidence) - KEEP + 1), F.lit(KEEP)).alias("evidence"),
        F.coalesce("polarity", "n_polarity").alias("polarity"),
        F.greatest(F.coalesce("weight", F.lit(0.0)), score.edge_weight(total, sure)).alias("weight"),
    )


def collapsed(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """J8, GR4: endpoints that are a member's twin become the member; loops go, of equal edges the heaviest stays."""
    twins = entities.where("linked_user_id is not null").select("guild_id", F.col("slug").alias("twin"), F.col("linked_user_id").alias("member"))

    def end(df: DataFrame, side: str) -> DataFrame:
        t = twins.select(F.col("guild_id").alias("tg"), F.col("twin"), F.col("member"))
        hit = (F.col("guild_id") == F.col("tg")) & (F.col(f"{side}_type") == "entity") & (F.col(f"{side}_id") == F.col("twin"))
        df = df.join(t, hit, "left")
        df = df.withColumn(f"{side}_id", F.coalesce("member", f"{side}_id")).withColumn(f"{side}_type", F.when(F.col("member").isNotNull(), "user").otherwise(F.col(f"{side}_type")))
        return df.drop("tg", "twin", "member")

    moved = end(end(edges.withColumn("was", F.struct("src_type", "src_id", "dst_type", "dst_id")), "src"), "dst")
    moved = moved.where((F.col("src_type") != F.col("dst_type")) | (F.col("src_id") != F.col("dst_id")))
    order = Window.partitionBy(*EDGE).orderBy(F.desc("weight"), "was")
    return moved.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank", "was")


def twins_of(users: DataFrame, entities: DataFrame) -> DataFrame:
    """The nodes that stand for each user (guild_id, user_id): the user and its entity twins."""
    own = users.select("guild_id", "user_id", F.lit("user").alias("node_type"), F.col("user_id").alias("node_id"))
    twins = users.join(entities.select("guild_id", F.col("linked_user_id").alias("user_id"), F.col("slug").alias("node_id")), ["guild_id", "user_id"])
    return own.unionByName(twins.select("guild_id", "user_id", F.lit("entity").alias("node_type"), "node_id"))


def incident(edges: DataFrame, nodes: DataFrame, cap: int | None = None) -> DataFrame:
    """Edges that touch any of the nodes (guild_id, node_type, node_id), each once per node as node_*.

    Two joins on equality take the place of one with OR. With a cap, each node
    keeps its heaviest edges.
    """

    def side(s: str) -> DataFrame:
        return edges.withColumn("node_type", F.col(f"{s}_type")).withColumn("node_id", F.col(f"{s}_id")).join(nodes, ["guild_id", "node_type", "node_id"], "left_semi")

    found = side("src").unionByName(side("dst").where("src_type <> dst_type or src_id <> dst_id"))
    if cap is None:
        return found
    order = Window.partitionBy("guild_id", "node_type", "node_id").orderBy(*by_weight())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap).drop("rank")


def relations_of(edges: DataFrame, entities: DataFrame, users: DataFrame, limit: int = 50) -> DataFrame:
    """GR5, GR7: the heaviest edges of each user and its twins, collapsed."""
    nodes = twins_of(users, entities).select("guild_id", "node_type", "node_id")
    touching = incident(edges, nodes).drop("node_type", "node_id").dropDuplicates(EDGE)
    return collapsed(touching, entities).orderBy(*by_weight()).limit(limit)


def between(edges: DataFrame, left: str, right: str) -> DataFrame:
    """GR6: edges between two users in either direction."""
    users = (F.col("src_type") == "user") & (F.col("dst_type") == "user")
    pair = ((F.col("src_id") == left) & (F.col("dst_id") == right)) | ((F.col("src_id") == right) & (F.col("dst_id") == left))
    order = Window.partitionBy("guild_id", "src_id", "dst_id", "verb").orderBy(*by_weight())
    return edges.where(users & pair).withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def edges_between(edges: DataFrame, src: tuple[str, str], dst: tuple[str, str]) -> DataFrame:
    """GR17: directed and exact."""
    return edges.where((F.col("src_type") == src[0]) & (F.col("src_id") == src[1]) & (F.col("dst_type") == dst[0]) & (F.col("dst_id") == dst[1]))


def stances(edges: DataFrame) -> DataFrame:
    """A10, GR8: for each entity the sources on either side, heaviest first, and the evidence in all."""
    facing = edges.where("dst_type = 'entity'")
    ranked = facing.withColumn("r", F.row_number().over(Window.partitionBy("guild_id", "dst_id", "polarity").orderBy(*by_weight()))).where("r <= 100")

    def side(name: str, *values: str) -> Column:
        of = F.array_sort(F.collect_list(F.when(F.col("polarity").isin(*values), F.struct("r", "src_id"))))
        return F.transform(of, lambda x: x["src_id"]).alias(name)

    lists = ranked.groupBy("guild_id", F.col("dst_id").alias("slug")).agg(side("positive", "positive"), side("negative", "negative"), side("other", "neutral"))
    totals = facing.groupBy("guild_id", F.col("dst_id").alias("slug")).agg(F.sum("occurrences").alias("total_evidence"))
    return lists.join(totals, ["guild_id", "slug"])


def users_for_entity(edges: DataFrame, links: DataFrame, facts: DataFrame, slug: str) -> DataFrame:
    """GR10: members with a stance on an entity by kind, and those whose active facts mention it (guild_id, kind, user_id)."""
    kind = F.when(F.col("polarity") == "neutral", "other").otherwise(F.col("polarity"))
    stance = edges.where((F.col("dst_type") == "entity") & (F.col("dst_id") == slug) & (F.col("src_type") == "user")).select("guild_id", kind.alias("kind"), F.col("src_id").alias("user_id"))
    own = links.where((F.col("node_type") == "entity") & (F.col("node_id") == slug)).select("guild_id", F.col("memory_id").alias("id")).distinct()
    told = facts.where("valid_until is null and superseded_by_id is null").join(own, ["guild_id", "id"])
    said = told.select("guild_id", F.lit("mentioned").alias("kind"), F.explode(F.array("subject_id", "attribution.speaker_id")).alias("user_id"))
    return stance.unionByName(said.where("user_id is not null and user_id <> ''")).distinct()


def shared_n(edges: DataFrame, users: list[str], limit: int = 10) -> DataFrame:
    """SO1, GR9: edges of several users on the entities that all of them touch, in the first one's order."""
    own = edges.where((F.col("src_type") == "user") & F.col("src_id").isin(*users) & (F.col("dst_type") == "entity"))
    common = own.groupBy("guild_id", "dst_id").agg(F.count_distinct("src_id").alias("n"), F.max(F.when(F.col("src_id") == users[0], F.col("weight"))).alias("first"))
    order = Window.partitionBy("guild_id").orderBy(F.desc("first"), "dst_id")
    common = common.where(F.col("n") == len(set(users))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return own.join(common.select("guild_id", "dst_id", "rank"), ["guild_id", "dst_id"])


def similar_users(edges: DataFrame, user: str, limit: int = 10, both_directions: bool = False, digits: int = 4) -> DataFrame:
    """GR11 (and GR21 with both directions): users by Jaccard overlap of their entities with a user's.

    Entities of the user are looked up once; sizes of the other sets are counted,
    so no sets are gathered. There are no caps on entities or candidates.
    """
    touch = edges.where("src_type = 'user' and dst_type = 'entity'").select("guild_id", F.col("src_id").alias("user_id"), F.col("dst_id").alias("slug"))
    if both_directions:
        touch = touch.unionByName(edges.where("dst_type = 'user' and src_type = 'entity'").select("guild_id", F.col("dst_id").alias("user_id"), F.col("src_id").alias("slug")))
    touch = touch.distinct()
    own = touch.where(F.col("user_id") == user).select("guild_id", "slug")
    mine = own.groupBy("guild_id").agg(F.count("*").alias("mine"))
    shared = touch.where(F.col("user_id") != user).join(own, ["guild_id", "slug"]).groupBy("guild_id", "user_id").agg(F.count("*").alias("both"))
    theirs = touch.join(shared.select("guild_id", "user_id"), ["guild_id", "user_id"], "left_semi").groupBy("guild_id", "user_id").agg(F.count("*").alias("theirs"))
    found = shared.join(theirs, ["guild_id", "user_id"]).join(mine, "guild_id")
    found = found.select("guild_id", "user_id", F.round(score.jaccard(F.col("both"), F.col("mine"), F.col("theirs")), digits).alias("score"))
    return found.orderBy(F.desc("score"), "guild_id", "user_id").limit(limit)


def hops(edges: DataFrame, seeds: DataFrame, depth: int = 2, fan_out: int = FAN_OUT, undirected: bool = False) -> DataFrame:
    """GR12, RT8: nodes first reached from each seed (guild_id, node_type, node_id) within `depth` hops.

    From each node only its heaviest edges are followed, by default to where they
    point. A node belongs to the first way that reaches it: fewest hops, then the
    way's parents in their order, then weight. Returns guild_id, seed, node_type,
    node_id, level, strength (sum of weights), path (verbs).
    """
    steps = edges
    if undirected:
        flip = {"src_type": "dst_type", "src_id": "dst_id", "dst_type": "src_type", "dst_id": "src_id"}
        steps = edges.unionByName(edges.select(*(F.col(flip.get(c, c)).alias(c) for c in edges.columns)))
    order = Window.partitionBy("guild_id", "src_type", "src_id").orderBy(F.desc("weight"), "dst_type", "dst_id", "verb")
    steps = steps.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= fan_out).select("guild_id", "src_type", "src_id", "dst_type", "dst_id", "verb", "weight", "pick")
    start = F.concat_ws(":", "node_type", "node_id")
    front = seeds.select(
        "guild_id", start.alias("seed"), "node_type", "node_id", F.lit(0).alias("level"), F.lit(0.0).alias("strength"),
        F.array().cast("array<string>").alias("path"), F.array().cast("array<int>").alias("turn"),
    )
    found = front
    key = ["guild_id", "seed", "node_type", "node_id"]
    for level in range(1, depth + 1):
        near = front.withColumnsRenamed({"node_type": "src_type", "node_id": "src_id"}).join(steps, ["guild_id", "src_type", "src_id"])
        near = near.select(
            "guild_id", "seed", F.col("dst_type").alias("node_type"), F.col("dst_id").alias("node_id"), F.lit(level).alias("level"),
            (F.col("strength") + F.col("weight")).alias("strength"), F.concat("path", F.array("verb")).alias("path"), F.concat("turn", F.array("pick")).alias("turn"),
        )
        near = near.join(found.select(*key), key, "left_anti")
        first = near.groupBy(*key).agg(F.min_by(F.struct("level", "strength", "path", "turn"), "turn").alias("way")).select(*key, "way.*")
        front = first
        found = found.unionByName(first)
    return found.where("level > 0").select(*key, "level", F.round("strength", 6).alias("strength"), "path")


def ego(edges: DataFrame, node_type: str, node_id: str, depth: int = 2) -> DataFrame:
    """GR15: nodes within `depth` undirected hops of one, with their distance."""
    seed = edges.select("guild_id").distinct().select("guild_id", F.lit(node_type).alias("node_type"), F.lit(node_id).alias("node_id"))
    near = hops(edges, seed, depth, fan_out=2**31 - 1, undirected=True)
    return near.select("guild_id", "node_type", "node_id", "level")


def withdrawn(edges: DataFrame, facts: DataFrame, until: Column) -> DataFrame:
    """GR16: edges without the evidence of some facts (guild_id, id); weights fall, and an edge without evidence ends."""
    lost = edges.select(*EDGE, F.explode("evidence").alias("id")).join(facts.select("guild_id", "id"), ["guild_id", "id"], "left_semi")
    lost = lost.groupBy(*EDGE).agg(F.collect_set("id").alias("lost"))
    hit = F.col("lost").isNotNull()
    rest = F.array_except("evidence", "lost")
    out = edges.join(lost, EDGE, "left")
    out = out.withColumn("weight", F.when(hit, F.round(F.col("weight") * F.pow(F.lit(WITHDRAWN), F.size("lost")), 6)).otherwise(F.col("weight")))
    out = out.withColumn("valid_until", F.when(hit & (F.size(rest) == 0), until)).withColumn("evidence", F.when(hit, rest).otherwise(F.col("evidence")))
    return out.drop("lost")


def eligible_edges(edges: DataFrame, visible: DataFrame, every: bool = False) -> DataFrame:
    """J10, GR13: edges with no evidence or some that is visible; with `every`, with evidence that all is."""
    seen = edges.select(*EDGE, F.explode("evidence").alias("id")).join(visible.select("guild_id", "id").distinct(), ["guild_id", "id"])
    seen = seen.groupBy(*EDGE).agg(F.count_distinct("id").alias("seen"))
    n = F.size(F.array_distinct("evidence"))
    out = edges.join(seen, EDGE, "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    return out.where((n > 0) & (F.col("seen") == n) if every else (n == 0) | (F.col("seen") > 0)).drop("seen")


def fact_links(facts: DataFrame) -> DataFrame:
    """GR1, GR18: the links of each fact (mentioned_ids, entity_slugs), each once."""

    def kind(name: str, node: str, ids: Column) -> Column:
        return F.transform(ids, lambda i: F.struct(F.lit(node).alias("node_type"), i.alias("node_id"), F.lit(name).alias("kind")))

    speaker = F.col("attribution.speaker_id")
    about = kind("about_user", "user", F.array_except("related_user_ids", F.array("subject_id")))
    every = F.concat(
        kind("subject_of", "user", F.array("subject_id")),
        kind("speaker_of", "user", F.array(F.when(~speaker.eqNullSafe(F.col("subject_id")), speaker))),
        about,
        kind("mentioned_with", "user", F.array_except("mentioned_ids", F.array("subject_id"))),
        kind("about_entity", "entity", F.col("entity_slugs")),
    )
    return facts.select("guild_id", F.col("id").alias("memory_id"), F.explode(every).alias("l")).select("guild_id", "memory_id", "l.*").where("node_id is not null and node_id <> ''").distinct()


def merged_entities(entities: DataFrame, moves: DataFrame) -> DataFrame:
    """Entities after moving some slugs (guild_id, from_slug) to others (to_slug): counts add up, aliases join."""
    moved = entities.join(moves.withColumnRenamed("from_slug", "slug"), ["guild_id", "slug"], "left")
    names = F.when(F.col("to_slug").isNotNull(), F.array_union("aliases", F.array("slug"))).otherwise(F.col("aliases"))
    moved = moved.select("guild_id", F.coalesce("to_slug", "slug").alias("slug"), names.alias("aliases"), "fact_count")
    return moved.groupBy("guild_id", "slug").agg(F.sum("fact_count").alias("fact_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"))


def entity_counts(links: DataFrame) -> DataFrame:
    """Facts about each entity."""
    return links.where("kind = 'about_entity'").groupBy("guild_id", F.col("node_id").alias("slug")).agg(F.count_distinct("memory_id").alias("fact_count"))


def snapshot(facts: DataFrame, links: DataFrame, edges: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GR14: nodes and edges of the graph; identity edges tie twins to their members, and no edge dangles."""
    users = reduce(
        DataFrame.unionByName,
        [
            facts.select("guild_id", F.col("subject_id").alias("node_id")),
            facts.select("guild_id", F.explode("related_user_ids").alias("node_id")),
            links.where("node_type = 'user'").select("guild_id", "node_id"),
            edges.where("src_type = 'user'").select("guild_id", F.col("src_id").alias("node_id")),
            edges.where("dst_type = 'user'").select("guild_id", F.col("dst_id").alias("node_id")),
            entities.select("guild_id", F.col("linked_user_id").alias("node_id")),
        ],
    )
    nodes = users.where("node_id is not null").distinct().select("guild_id", F.lit("user").alias("node_type"), "node_id")
    nodes = nodes.unionByName(entities.select("guild_id", F.lit("entity").alias("node_type"), F.col("slug").alias("node_id")).distinct())
    drawn = edges.select(*EDGE, "polarity", "weight")
    same = entities.where("linked_user_id is not null").select(
        "guild_id", F.lit("entity").alias("src_type"), F.col("slug").alias("src_id"), F.lit("user").alias("dst_type"), F.col("linked_user_id").alias("dst_id"),
        F.lit("is").alias("verb"), F.lit("neutral").alias("polarity"), F.lit(1.0).alias("weight"),
    )
    ends = [nodes.withColumnsRenamed({"node_type": f"{s}_type", "node_id": f"{s}_id"}) for s in ("src", "dst")]
    whole = drawn.unionByName(same)
    for s, end in zip(("src", "dst"), ends, strict=True):
        whole = whole.join(end, ["guild_id", f"{s}_type", f"{s}_id"], "left_semi")
    return nodes, whole


def explorer(nodes: DataFrame, edges: DataFrame, types: list[str], search: str = "", polarities: list[str] | None = None, least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """GR20, GR22: nodes of some types whose id holds a string, and the edges of enough weight between them."""
    seen = nodes.where(F.col("node_type").isin(*types) & F.contains(F.lower("node_id"), F.lit(search.lower())))
    kept = edges.where(F.col("weight") >= least)
    if polarities is not None:
        kept = kept.where(F.col("polarity").isin(*polarities))
    for s in ("src", "dst"):
        kept = kept.join(seen.withColumnsRenamed({"node_type": f"{s}_type", "node_id": f"{s}_id"}), ["guild_id", f"{s}_type", f"{s}_id"], "left_semi")
    return seen, kept
