"""Lifecycle of facts: tiers, decay, expiry and pruning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.functions import score, text, valid

# Categories that last, the order in which tiers are pruned, and what makes a core fact.
DURABLE = ("personal", "relationships", "professional", "preferences", "interests", "personality")
TIERS = ("short_term", "mid_term", "long_term", "core")
CORE_CONFIDENCE = 0.95
CORE_OCCURRENCES = 3
SERVER_CONFIDENCE = 0.85


@dataclass(frozen=True)
class Lifecycle:
    """Days that tiers last (None: for ever), caps, and the floor below which facts are forgotten."""

    short_days: int = 7
    mid_days: int = 365
    long_days: int | None = None
    per_user: int = 300
    per_server: int = 500
    floor: float = 0.0
    stability_days: float = 1.0


def tier_of(life: Lifecycle = Lifecycle()) -> Column:
    """L1: struct(tier, days) from text, category, confidence, occurrences, manual and subject_id."""
    kind, sure = F.col("category"), F.col("confidence")
    server = F.col("subject_id").isNull() & kind.isin("rules", "culture")
    horizon = text.horizon_days(F.col("text"), life.short_days)
    core = (sure >= CORE_CONFIDENCE) & (F.col("occurrences") >= CORE_OCCURRENCES) & kind.isin(*DURABLE)

    def tier(name: str, days: Column | int | None) -> Column:
        days = days if isinstance(days, Column) else F.lit(days)
        return F.struct(F.lit(name).alias("tier"), days.cast("int").alias("days"))

    return (
        F.when(F.col("manual"), tier("core", None))
        .when(server & (sure >= SERVER_CONFIDENCE), tier("core", None))
        .when(server, tier("long_term", life.long_days))
        .when(horizon.isNotNull(), tier("short_term", horizon))
        .when(core, tier("core", None))
        .when(kind.isin(*DURABLE, "experiences"), tier("long_term", life.long_days))
        .otherwise(tier("mid_term", life.mid_days))
    )


def expired(facts: DataFrame, now: Column) -> DataFrame:
    """Active facts past their retention."""
    return facts.where(valid.is_active() & (F.col("expires_at") <= now))


def forgotten(facts: DataFrame, now: Column, life: Lifecycle) -> DataFrame:
    """L4: active facts, neither core nor manual, of which less is left than the floor; adds retained."""
    left = score.retention(F.col("last_reinforced_at"), now, F.col("strength"), life.stability_days)
    if life.floor <= 0:
        return facts.withColumn("retained", left).limit(0)
    weak = valid.is_active() & (F.col("tier") != "core") & ~F.col("manual") & F.col("last_reinforced_at").isNotNull()
    return facts.withColumn("retained", left).where(weak & (F.col("retained") < life.floor))


def prune_victims(facts: DataFrame, life: Lifecycle = Lifecycle()) -> DataFrame:
    """The weakest active facts of each subject, or of the server, beyond its cap; manual ones are exempt.

    Ascending by tier, strength, confidence and id. Only facts that can be a
    victim are ranked, after counting, so a subject within its cap is not sorted.
    """
    open_ = facts.where(valid.is_active() & ~F.col("manual")).withColumn("anchor", F.coalesce("subject_id", F.lit("__server__")))
    cap = F.when(F.col("subject_id").isNull(), life.per_server).otherwise(life.per_user)
    over = open_.groupBy("guild_id", "anchor").agg(F.count("*").alias("n"), F.first(cap).alias("cap")).where("n > cap")
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    order = Window.partitionBy("guild_id", "anchor").orderBy(rank, "strength", "confidence", "id")
    return open_.join(over, ["guild_id", "anchor"]).withColumn("rank", F.row_number().over(order)).where("rank <= n - cap").drop("n", "cap")


def extensions(facts: DataFrame, now: Column, life: Lifecycle = Lifecycle()) -> DataFrame:
    """Later ends of retention that the policy now grants; never shorter ones, never for a fact that has ended."""
    open_ = valid.is_active() & valid.is_valid_at(now) & F.col("expires_at").isNotNull() & (F.col("tier") != "short_term") & ~F.col("manual")
    fresh = facts.where(open_).withColumn("t", tier_of(life)).where("t.tier <> 'short_term'")
    end = F.col("last_reinforced_at") + F.make_dt_interval(F.col("t.days"))
    later = F.col("t.days").isNull() | (end > F.col("expires_at"))
    return fresh.where(later & (F.col("t.days").isNull() | F.col("last_reinforced_at").isNotNull())).select("guild_id", "id", "t.tier", end.alias("new_expires_at"))


def swept(facts: DataFrame, now: Column, life: Lifecycle = Lifecycle()) -> DataFrame:
    """All facts after expiry, forgetting and pruning, in this order; adds `swept` (why a fact ended, or null)."""

    def ended(rows: DataFrame, victims: DataFrame, why: str) -> DataFrame:
        gone = victims.select("guild_id", "id", F.lit(why).alias("why"))
        out = rows.join(gone, ["guild_id", "id"], "left")
        out = out.withColumn("valid_until", F.when(F.col("why").isNotNull(), now).otherwise(F.col("valid_until")))
        return out.withColumn("swept", F.coalesce("swept", "why")).drop("why")

    rows = facts.withColumn("swept", F.lit(None).cast("string"))
    rows = ended(rows, expired(rows, now), "expired")
    rows = ended(rows, forgotten(rows, now, life), "forgotten")
    return ended(rows, prune_victims(rows, life), "pruned")


def prune_processed(messages: DataFrame, cutoff: Column) -> DataFrame:
    """Messages without those processed before a time."""
    return messages.where(~((F.col("status") == "processed") & (F.col("created_at") < cutoff)))
