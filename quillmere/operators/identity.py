"""Identity operators: aliases, their resolution and the entities tied to members (ID1-ID14, W5, W6).

Aliases: guild_id, alias_norm, user_id, source, weight. A source has a rank; of
two rows for the same alias and user the higher rank wins, then the larger weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.functions import score, text

#: Candidates looked at, and shown; share of the best weight that makes a rival; letters of a prefix.
CANDIDATES = 8
SHOWN = 5
RIVAL = 0.85
PREFIX = 3
KEY = ["guild_id", "alias_norm", "user_id"]


def ranked(aliases: DataFrame) -> DataFrame:
    return aliases.withColumn("rank", text.rank_for_source(F.col("source")))


def upserted(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """ID3: a higher rank replaces, an equal one keeps the larger weight, a lower one changes nothing."""
    rows = ranked(current.select(*KEY, "source", "weight").unionByName(incoming.select(*KEY, "source", "weight")))
    best = rows.groupBy(*KEY).agg(F.max(F.struct("rank", "weight", "source")).alias("best"))
    return best.select(*KEY, "best.source", "best.weight")


def from_members(members: DataFrame) -> DataFrame:
    """ID8: alias rows of members (guild_id, user_id, username, display_name); digits alone are no name."""
    both = F.array(F.struct(F.lit("discord_username").alias("source"), F.col("username").alias("surface")), F.struct(F.lit("display_name").alias("source"), F.col("display_name").alias("surface")))
    rows = members.select("guild_id", "user_id", F.explode(both).alias("x")).select("guild_id", "user_id", "x.*").where("surface is not null")
    rows = rows.withColumn("alias_norm", text.normalize(F.col("surface"))).where(text.is_valid_alias(F.col("alias_norm")) & ~F.col("alias_norm").rlike("^[0-9]+$"))
    rows = rows.withColumn("weight", text.weight_for_source(F.col("source"), F.col("surface")))
    return upserted(rows.limit(0), rows)


def exact(aliases: DataFrame, names: DataFrame) -> DataFrame:
    """ID1, J11: for each name (guild_id, norm) its heaviest aliases."""
    found = ranked(aliases).join(names.withColumnRenamed("norm", "alias_norm"), ["guild_id", "alias_norm"])
    order = Window.partitionBy("guild_id", "alias_norm").orderBy(F.desc("weight"), "user_id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= CANDIDATES).withColumn("norm", F.col("alias_norm")).drop("n")


def prefixed(aliases: DataFrame, names: DataFrame) -> DataFrame:
    """ID2: aliases that begin with a name, one for each user, heaviest first.

    Names and aliases meet on their first letters, so this is a join on equality.
    """
    left = ranked(aliases).withColumn("head", F.substring("alias_norm", 1, PREFIX))
    right = names.where(F.length("norm") >= PREFIX).withColumn("head", F.substring("norm", 1, PREFIX))
    found = left.join(right, ["guild_id", "head"]).where(F.startswith("alias_norm", F.col("norm"))).drop("head")
    own = Window.partitionBy("guild_id", "norm", "user_id").orderBy(F.desc("weight"), "alias_norm")
    found = found.withColumn("n", F.row_number().over(own)).where("n = 1")
    order = Window.partitionBy("guild_id", "norm").orderBy(F.desc("weight"), "user_id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= CANDIDATES).drop("n")


def candidates(aliases: DataFrame, names: DataFrame) -> DataFrame:
    """ID4: what each name may mean, by exact match, else by prefix: adds fuzzy."""
    hit = exact(aliases, names).withColumn("fuzzy", F.lit(False))
    rest = names.join(hit.select("guild_id", "norm").distinct(), ["guild_id", "norm"], "left_anti")
    cols = ["guild_id", "norm", "alias_norm", "user_id", "source", "rank", "weight", "fuzzy"]
    return hit.select(*cols).unionByName(prefixed(aliases, rest).withColumn("fuzzy", F.lit(True)).select(*cols))


def resolved(aliases: DataFrame, identifiers: DataFrame) -> DataFrame:
    """ID4, ID5, W6, ID10: each identifier (guild_id, identifier) with the user it means, if that is plain.

    A long number is a user id already. Otherwise the best candidate by rank and
    weight is meant, unless candidates were cut off or another user comes near: of
    equal rank, or any in a search by prefix, with 0.85 of its weight or more.
    """
    asked = identifiers.withColumn("norm", text.normalize(F.col("identifier"))).distinct()
    bare = text.stripped(F.col("identifier"))
    numbers = asked.where(text.is_snowflake(bare)).select("guild_id", "identifier", bare.alias("user_id"), F.lit(1.0).alias("confidence"), F.lit(False).alias("ambiguous"), F.lit(1).alias("candidates"))
    names = asked.where(~text.is_snowflake(bare) & text.is_valid_alias(F.col("norm")))
    found = candidates(aliases, names.select("guild_id", "norm").distinct())
    best = found.groupBy("guild_id", "norm").agg(
        F.max(F.struct("rank", "weight", F.col("user_id"))).alias("best"), F.max("weight").alias("top"), F.count("*").alias("n"), F.count_distinct("user_id").alias("users")
    )
    judged = found.join(best, ["guild_id", "norm"])
    rival = (F.col("user_id") != F.col("best.user_id")) & (F.col("fuzzy") | (F.col("rank") == F.col("best.rank"))) & (F.col("weight") >= RIVAL * F.col("best.weight"))
    judged = judged.groupBy("guild_id", "norm").agg(F.first("best").alias("best"), F.first("top").alias("top"), F.first("users").alias("users"), (F.bool_or(rival) | (F.first("n") >= CANDIDATES)).alias("ambiguous"))
    sure = score.alias_confidence(F.col("best.rank"), F.col("best.weight"), F.col("top"))
    known = asked.where(~text.is_snowflake(bare)).join(judged, ["guild_id", "norm"], "left").select(
        "guild_id", "identifier",
        F.when(~F.col("ambiguous"), F.col("best.user_id")).alias("user_id"), F.when(~F.col("ambiguous"), sure).alias("confidence"),
        F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), F.coalesce(F.least("users", F.lit(SHOWN)), F.lit(0)).cast("int").alias("candidates"),
    )
    return numbers.unionByName(known)


def strongest(aliases: DataFrame, sources: tuple[str, ...] | None = None) -> DataFrame:
    """W5, ID7: each user's best alias by rank, then weight; with some sources only, the display name."""
    rows = ranked(aliases if sources is None else aliases.where(F.col("source").isin(*sources)))
    return rows.groupBy("guild_id", "user_id").agg(F.max_by("alias_norm", F.struct("rank", "weight", "alias_norm")).alias("alias"))


def without_user(aliases: DataFrame, users: DataFrame) -> DataFrame:
    """ID14: aliases without those of some users (guild_id, user_id)."""
    return aliases.join(users, ["guild_id", "user_id"], "left_anti")


def bridged(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """ID6: person entities tied to the one user who has their slug as an alias, and to none if several do."""
    named = aliases.select("guild_id", text.slug(F.col("alias_norm")).alias("slug"), "user_id").distinct()
    sole = named.groupBy("guild_id", "slug").agg(F.min("user_id").alias("member"), F.count("*").alias("n")).where("n = 1").drop("n")
    out = entities.join(sole, ["guild_id", "slug"], "left")
    return out.withColumn("linked_user_id", F.when(F.col("kind") == "person", F.col("member"))).drop("member")


def entity_slugs(names: DataFrame, entity_aliases: DataFrame) -> DataFrame:
    """ID11: the slug of each name (guild_id, name): a known alias's, else made from the name."""
    asked = names.withColumn("alias_norm", text.normalize(F.col("name")))
    known = entity_aliases.groupBy("guild_id", "alias_norm").agg(F.min("slug").alias("known"))
    return asked.join(known, ["guild_id", "alias_norm"], "left").select("guild_id", "name", F.coalesce("known", text.slug(F.col("name"))).alias("slug"))


def by_name_facts(facts: DataFrame, identifiers: DataFrame) -> DataFrame:
    """ID9: users whose facts say that they go by a name (guild_id, identifier): one such user at .6, else ambiguous."""
    asked = identifiers.withColumn("norm", text.normalize(F.col("identifier"))).distinct()
    said = facts.where("subject_id is not null").select("guild_id", "id", "subject_id", F.explode(text.self_names(F.col("text"))).alias("n"))
    said = said.select("guild_id", "id", "subject_id", text.normalize(F.col("n.name")).alias("norm"))
    found = asked.join(said, ["guild_id", "norm"]).groupBy("guild_id", "identifier").agg(F.count_distinct("subject_id").alias("users"), F.count_distinct("id").alias("hits"), F.min("subject_id").alias("user_id"))
    many = (F.col("users") > 1) | (F.col("hits") > 10)
    return found.select("guild_id", "identifier", F.when(~many, F.col("user_id")).alias("user_id"), F.when(~many, 0.6).alias("confidence"), many.alias("ambiguous"))


def mined(messages: DataFrame) -> DataFrame:
    """Alias rows from what authors say of themselves, without names that are somebody else's."""
    found = messages.select("guild_id", F.col("author_id").alias("user_id"), "content", F.explode(text.self_names(F.col("content"))).alias("n"))
    found = found.withColumn("alias_norm", text.normalize(F.col("n.name"))).where(text.is_valid_alias(F.col("alias_norm")) & ~text.is_third_party_name(F.col("content"), F.col("n.name")))
    return found.groupBy(*KEY).agg(F.lit("real_name").alias("source"), F.max("n.weight").alias("weight"))
