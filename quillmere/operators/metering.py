"""Queues, statistics, budgets and summaries (A1-A7, A15, A16, A18, M21, M22, W8, W9, ST3, O1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.functions import score, text

#: A batch is due with so many messages or after so many seconds; share of a budget at which reconciling stops.
BATCH = 10
MAX_AGE = 300
WARN = 0.8
#: Facts that a profile is made from, new facts that make it due, and tokens reserved beside a prompt's bytes.
PROFILE_FACTS = 50
PROFILE_DUE = 5
CENTROID_FACTS = 20
SANE = 0.55
RESERVE = 512


def due_batches(messages: DataFrame, now: Column, batch: int = BATCH, max_age: int = MAX_AGE) -> DataFrame:
    """A1: keys with enough pending messages, or one that has waited long enough; oldest first."""
    open_ = messages.where("status = 'pending'").groupBy("guild_id", "subject_key").agg(F.count("*").alias("n"), F.min("created_at").alias("oldest"))
    old = F.unix_micros(now) - F.unix_micros("oldest") >= max_age * 1_000_000
    return open_.where((F.col("n") >= batch) | old).orderBy("oldest", "guild_id", "subject_key")


def claimed(messages: DataFrame, limit: int = BATCH) -> DataFrame:
    """ST3: the oldest pending messages of each key."""
    order = Window.partitionBy("guild_id", "subject_key").orderBy("created_at", "message_id")
    return messages.where("status = 'pending'").withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")


def recent(messages: DataFrame, limit: int = 20) -> DataFrame:
    """The newest messages of each guild, in ascending order."""
    order = Window.partitionBy("guild_id").orderBy(F.desc("created_at"), F.desc("message_id"))
    return messages.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).orderBy("guild_id", F.desc("n")).drop("n")


def window_after(messages: DataFrame, cursors: DataFrame, batch: int = BATCH, limit: int = 100) -> DataFrame:
    """W9, ST7: for each guild the messages after its cursor (at, message_id), if there are enough of them, with the new cursor."""
    at = F.struct(F.col("created_at").alias("at"), F.col("message_id").alias("id"))
    rows = messages.join(cursors.select("guild_id", F.struct("at", F.col("message_id").alias("id")).alias("cursor")), "guild_id", "left")
    rows = rows.where(F.col("cursor").isNull() | (at > F.col("cursor")))
    order = Window.partitionBy("guild_id").orderBy("created_at", "message_id")
    rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
    found = rows.groupBy("guild_id").agg(F.count("*").alias("n"), F.max(at).alias("cursor"))
    return found.where(F.col("n") >= batch).select("guild_id", "n", "cursor.at", F.col("cursor.id").alias("message_id"))


def queue_counts(messages: DataFrame) -> DataFrame:
    """A3: messages of each guild by status."""
    return messages.groupBy("guild_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("pending", "claimed", "processed", "dead")))


def guild_stats(facts: DataFrame, entities: DataFrame, edges: DataFrame, messages: DataFrame) -> DataFrame:
    """A2: totals of each guild; tiers and scopes count active facts."""
    open_ = F.col("valid_until").isNull() & F.col("superseded_by_id").isNull()
    tiers = ("short_term", "mid_term", "long_term", "core")
    main = facts.groupBy("guild_id").agg(
        F.count("*").alias("facts"), F.count_if(open_).alias("active"), *(F.count_if(open_ & (F.col("tier") == t)).alias(t) for t in tiers),
        F.count_if(open_ & F.col("subject_id").isNull()).alias("server_scope"), F.count_if(open_ & F.col("subject_id").isNotNull()).alias("user_scope"),
        F.count_distinct(F.when(open_, F.col("subject_id"))).alias("subjects"),
    )
    for rows, name in ((entities, "entities"), (edges, "relations")):
        main = main.join(rows.groupBy("guild_id").agg(F.count("*").alias(name)), "guild_id", "left")
    main = main.join(queue_counts(messages).drop("processed"), "guild_id", "left")
    return main.na.fill(0)


def token_usage(calls: DataFrame) -> DataFrame:
    """A4: prompt tokens of each guild by day and by month, in one pass."""
    day, month = F.date_format("at", "yyyy-MM-dd"), F.date_format("at", "yyyy-MM")
    return calls.select("guild_id", F.explode(F.array(day, month)).alias("period_key"), "prompt_tokens").groupBy("guild_id", "period_key").agg(F.sum("prompt_tokens").alias("prompt_tokens"))


def budget_steps(usage: DataFrame, day_limit: int, month_limit: int) -> DataFrame:
    """What to leave out in each period: extraction over its limit, reconciling over four fifths of it."""
    limit = F.when(F.length("period_key") == 10, day_limit).otherwise(month_limit)
    step = F.when(F.col("prompt_tokens") >= limit, "skip_extraction").when(F.col("prompt_tokens") >= WARN * limit, "skip_reconcile").otherwise("none")
    return usage.withColumn("step", step)


def reserved(calls: DataFrame, limit: int) -> DataFrame:
    """Calls in order, each granted if what is used and reserved before it leaves room for its bytes and a margin; then settled.

    What was used before is summed inside each day and over the days before, so that
    a guild's calls are not one task.
    """
    rows = calls.withColumn("_day", F.coalesce(F.to_date("at"), F.to_date(F.lit("0001-01-01"))))
    inside = Window.partitionBy("guild_id", "_day").orderBy("at", "call_id").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("guild_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy("guild_id", "_day").agg(F.sum("prompt_tokens").alias("n")).select("guild_id", "_day", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_own", F.coalesce(F.sum("prompt_tokens").over(inside), F.lit(0))).join(days, ["guild_id", "_day"])
    rows = rows.withColumn("used", F.col("_own") + F.col("_before")).drop("_day", "_own", "_before")
    return rows.withColumn("granted", F.col("used") + F.col("prompt_bytes") + RESERVE <= limit)


def meter(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """A5: calls, tokens and cost by purpose; a cost not reported is that of the first price whose name the model's holds.

    prices: pattern, prompt_usd and completion_usd for a million tokens, place. All
    parts of a model's name meet the patterns by equality, so neither list is bounded.
    """
    unknown = calls.withColumn("call", F.struct("purpose", "model", "prompt_tokens", "completion_tokens", "cost_usd"))
    named = calls.select("model").distinct().where("model is not null").withColumn("low", F.lower("model"))
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("low"))), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("low"))), lambda i: F.substring("low", i, n))))
    models = named.select("model", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), parts))).alias("pattern")).join(prices, "pattern")
    price = models.groupBy("model").agg(F.min_by(F.struct("prompt_usd", "completion_usd"), "place").alias("price"))
    made = (F.col("prompt_tokens") * F.col("price.prompt_usd") + F.col("completion_tokens") * F.col("price.completion_usd")) / 1e6
    rows = unknown.join(price, "model", "left").withColumn("cost", F.coalesce("cost_usd", made, F.lit(0.0)))
    return rows.groupBy("purpose").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum("cost"), 6).alias("cost_usd"))


def worth_extracting(messages: DataFrame, least: int = 28) -> DataFrame:
    """SC14: batches (guild_id, subject_key) with something to extract: a durable marker, a name, enough words or one long message."""
    norm = text.normalize(F.col("content"))
    named = F.size(text.self_names(F.col("content"))) > 0
    sums = messages.groupBy("guild_id", "subject_key").agg(
        (F.sum(F.length(norm)) + F.count_if(norm != "") - 1).alias("length"), F.max(F.length(norm)).alias("longest"),
        F.sum(F.when(norm == "", 0).otherwise(F.size(F.split(norm, " ")))).alias("words"), F.bool_or(text.any_of(norm, text.DURABLE_MARKERS) | named).alias("durable"),
    )
    worth = (F.col("length") >= 8) & (F.col("durable") | (F.col("words") >= 12) | (F.col("longest") >= least))
    return sums.select("guild_id", "subject_key", F.coalesce(worth, F.lit(False)).alias("worth"))


def profile_due(facts: DataFrame, summaries: DataFrame) -> DataFrame:
    """Subjects whose profile is to be written anew, with a fingerprint of what it would rest on.

    Due with five active facts or more, five more than the last profile rested on.
    """
    open_ = facts.where("valid_until is null and superseded_by_id is null and subject_id is not null")
    counts = open_.groupBy("guild_id", "subject_id").agg(F.count("*").alias("n"))
    last = summaries.select("guild_id", "subject_id", "source_fact_count")
    due = counts.join(last, ["guild_id", "subject_id"], "left").where((F.col("n") >= PROFILE_DUE) & (F.col("n") - F.coalesce("source_fact_count", F.lit(0)) >= PROFILE_DUE))
    order = Window.partitionBy("guild_id", "subject_id").orderBy(F.desc("strength"), F.desc("confidence"), "id")
    best = open_.withColumn("n", F.row_number().over(order)).where(F.col("n") <= PROFILE_FACTS)
    prints = best.groupBy("guild_id", "subject_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "id", "version"))), ","), 256).alias("fingerprint"))
    return due.select("guild_id", "subject_id", "n").join(prints, ["guild_id", "subject_id"])


def valid_summaries(summaries: DataFrame, facts: DataFrame) -> DataFrame:
    """Summaries all of whose sources (fact_id, version) are still current and active."""
    used = summaries.select("guild_id", "subject_id", F.explode("sources").alias("s")).select("guild_id", "subject_id", F.col("s.fact_id").alias("id"), "s.version")
    now = facts.where("valid_until is null and superseded_by_id is null").select("guild_id", "id", "version")
    bad = used.join(now, ["guild_id", "id", "version"], "left_anti").select("guild_id", "subject_id").distinct()
    return summaries.join(bad, ["guild_id", "subject_id"], "left_anti")


def centroids(vectors: DataFrame, groups: list[str], limit: int = CENTROID_FACTS) -> DataFrame:
    """The unit mean of the first vectors of each group."""
    order = Window.partitionBy(*groups).orderBy("id")
    rows = vectors.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
    parts = rows.select(*groups, F.posexplode("embedding").alias("at", "x")).groupBy(*groups, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = parts.groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("mean"))
    size = F.sqrt(score.dot(F.col("mean"), F.col("mean")))
    return means.withColumn("size", size).select(*groups, F.transform("mean", lambda x: F.try_divide(x, F.col("size"))).alias("centroid"))


def commit_summary(outcomes: DataFrame) -> DataFrame:
    """Adds, reinforcements, updates and invalidations of each batch over its channels."""
    return outcomes.groupBy("guild_id", "subject_key").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("add", "reinforce", "update", "invalidate")))


def probe_metrics(results: DataFrame) -> DataFrame:
    """For each case its probes, expected and matched facts, returned ones, forbidden hits and right abstentions."""
    return results.groupBy("case_id").agg(
        F.count("*").alias("probes"), F.sum("expected").alias("expected"), F.sum("matched").alias("matched"), F.sum("returned").alias("returned"),
        F.sum("forbidden").alias("forbidden"), F.count_if(F.col("must_abstain") & (F.col("returned") == 0)).alias("abstained"),
    )
