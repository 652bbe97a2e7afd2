"""The message stream: admission, count-or-age batches, retries and commits (SRC1-SRC5, ST1-ST11).

Batch and stream share the column expressions; what differs is only how state is
kept. In a stream Spark owns the assignment of keys to tasks; a queue in a table
has leases.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillmere.functions import text

#: Characters of a message, rows of a batch, seconds that one waits, and pending rows of a guild.
MIN_CHARS = 3
BATCH = 10
MAX_AGE = 300
MAX_DEPTH = 10_000
#: Seconds before a first retry and at most, and attempts before a batch is dead.
RETRY_FIRST = 5
RETRY_MOST = 300
ATTEMPTS = 3
#: Seconds that a claim holds without a heartbeat.
LEASE = 60


def verdict(ignore: list[str] | None = None, opted_out: Column | None = None) -> Column:
    """SRC1: why a message is ignored, or null if it is accepted: bots, members who opted out, too short, patterns."""
    bare = text.stripped(F.coalesce(F.col("content"), F.lit("")))
    why = F.when(F.col("author_is_bot"), "bot_author")
    if opted_out is not None:
        why = why.when(F.coalesce(opted_out, F.lit(False)), "opted_out")
    why = why.when(F.length(bare) < MIN_CHARS, "empty_content")
    for pattern in ignore or []:
        why = why.when(F.col("content").rlike(pattern), "ignored_pattern")
    return why


def observed(messages: DataFrame, consent: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """SRC1-SRC3: messages with status (accepted or ignored) and reason; repeats of an id are duplicates, edits have ids of their own."""
    known = consent.select("guild_id", F.col("user_id").alias("author_id"), "opted_out")
    rows = messages.join(known, ["guild_id", "author_id"], "left")
    revision = F.sha2(F.concat(F.coalesce(F.col("edited_at").cast("string"), F.lit("")), F.coalesce("content", F.lit(""))), 256)
    rows = rows.withColumn("entry_id", F.when(F.coalesce("edited", F.lit(False)), F.concat_ws("@", "message_id", revision)).otherwise(F.col("message_id")))
    # Of rows with one id the first counts, whatever the times of the others.
    order = Window.partitionBy("guild_id", "entry_id").orderBy("created_at", F.xxhash64(F.col("content")))
    rows = rows.withColumn("reason", verdict(ignore, F.col("opted_out"))).withColumn("n", F.row_number().over(order))
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.col("n") > 1, "duplicate")))
    return rows.withColumn("status", F.when(F.col("reason").isNull(), "accepted").otherwise("ignored")).drop("opted_out", "n")


def admitted(stream: DataFrame, delay: str = "1 hour", ignore: list[str] | None = None) -> DataFrame:
    """SRC1, SRC3 on a stream: accepted messages, each id once within the watermark."""
    rows = stream.withWatermark("created_at", delay).where(verdict(ignore).isNull())
    return rows.dropDuplicatesWithinWatermark(["guild_id", "message_id"])


def private(messages: DataFrame) -> DataFrame:
    """SRC4: contents replaced by the first 16 hex digits of their SHA-256."""
    return messages.withColumn("content", F.substring(F.sha2("content", 256), 1, 16))


_BATCH = "guild_id string, subject_key string, channel_id string, reason string, message_ids array<string>, contents array<string>, oldest timestamp"
_STATE = "ids array<string>, contents array<string>, times array<bigint>"


def _batches(size: int, age: int):
    """ST1: state is the waiting messages of a key; they leave by count at once, and by age when the time is up."""

    def out(key: tuple, why: str, ids: list, contents: list, times: list) -> pd.DataFrame:
        return pd.DataFrame([(*key, why, ids, contents, pd.Timestamp(min(times), unit="us"))], columns=[c.split()[0] for c in _BATCH.split(", ")])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, contents, times = (list(x) for x in state.get) if state.exists else ([], [], [])
        if state.hasTimedOut:
            state.remove()
            if ids:
                yield out(key, "age", ids, contents, times)
            return
        for frame in frames:
            frame = frame.sort_values(["created_at", "message_id"])
            ids += frame["message_id"].tolist()
            contents += frame["content"].tolist()
            times += (frame["created_at"].astype("datetime64[us]").astype("int64")).tolist()
        order = sorted(range(len(ids)), key=lambda i: (times[i], ids[i]))
        ids, contents, times = ([x[i] for i in order] for x in (ids, contents, times))
        while len(ids) >= size:
            yield out(key, "count", ids[:size], contents[:size], times[:size])
            ids, contents, times = ids[size:], contents[size:], times[size:]
        if ids:
            state.update((ids, contents, times))
            state.setTimeoutTimestamp(max(min(times) // 1000 + age * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    return run


def batched(messages: DataFrame, size: int = BATCH, age: int = MAX_AGE) -> DataFrame:
    """ST1, ST3, ST8: batches of each author and channel, by count or by age in event time (the stream needs a watermark)."""
    keyed = messages.select("guild_id", "subject_key", "channel_id", "message_id", F.coalesce("content", F.lit("")).alias("content"), "created_at")
    return keyed.groupBy("guild_id", "subject_key", "channel_id").applyInPandasWithState(_batches(size, age), _BATCH, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def within_depth(messages: DataFrame, most: int = MAX_DEPTH) -> DataFrame:
    """SRC3: adds `over`: whether a guild already had so many pending messages before this one.

    Only the first pending messages of a guild are ranked, which each task cuts to so
    many; the last of them, where there are so many, is the line for all others.
    """
    if most <= 0:
        return messages.withColumn("over", F.lit(True))
    order = Window.partitionBy("guild_id").orderBy("created_at", "message_id")
    pending = messages.where("status = 'pending'").select("guild_id", "created_at", "message_id")
    last = pending.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).where(F.col("n") == most)
    line = last.select("guild_id", F.struct("created_at", "message_id").alias("_line"))
    over = F.coalesce(F.struct("created_at", "message_id") > F.col("_line"), F.lit(False))
    return messages.join(line, "guild_id", "left").withColumn("over", over).drop("_line")


def without_receipts(messages: DataFrame, receipts: DataFrame, scope: str = "user") -> DataFrame:
    """ST6: messages that no receipt (key) of this scope shows as done, with their own receipt key."""
    rows = messages.withColumn("receipt", F.concat(F.lit(f"ingest:{scope}:"), F.sha2("message_id", 256)))
    return rows.join(receipts.select(F.col("key").alias("receipt")), "receipt", "left_anti")


def after_failure(batches: DataFrame, now: Column) -> DataFrame:
    """ST5: one more attempt; after the last a batch is dead, before it waits between half and all of 5 s, 10 s, 20 s ..., 300 s at most.

    The wait is drawn by a hash of key and attempt, so reruns agree.
    """
    cap = F.least(F.lit(RETRY_MOST), F.lit(RETRY_FIRST) * F.pow(F.lit(2), F.col("attempts")))
    share = F.pmod(F.xxhash64("guild_id", "subject_key", "attempts"), F.lit(10_000)) / 10_000
    wait = cap / 2 + cap / 2 * share
    tried = batches.withColumn("wait", F.round(wait, 3)).withColumn("attempts", F.col("attempts") + 1)
    return tried.withColumn("status", F.when(F.col("attempts") >= ATTEMPTS, "dead").otherwise("pending")).withColumn("next_attempt_at", F.when(F.col("attempts") < ATTEMPTS, F.timestamp_micros((F.unix_micros(now) + F.col("wait") * 1e6).cast("long"))))


def leased(messages: DataFrame, owner: str, now: Column, seconds: int = LEASE, limit: int = BATCH) -> DataFrame:
    """ST2, ST3: the queue after an owner claimed the oldest pending messages of each key that no live lease holds."""
    live = messages.where((F.col("status") == "claimed") & (F.col("lease_until") > now)).select("guild_id", "subject_key").distinct()
    free = messages.where("status = 'pending'").join(live, ["guild_id", "subject_key"], "left_anti")
    order = Window.partitionBy("guild_id", "subject_key").orderBy("created_at", "message_id")
    taken = free.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).select("guild_id", "message_id", F.lit(True).alias("taken"))
    rows = messages.join(taken, ["guild_id", "message_id"], "left")
    until = F.timestamp_micros(F.unix_micros(now) + seconds * 1_000_000)
    return rows.withColumns({
        "status": F.when(F.col("taken"), "claimed").otherwise(F.col("status")), "lease_owner": F.when(F.col("taken"), owner).otherwise(F.col("lease_owner")),
        "lease_until": F.when(F.col("taken"), until).otherwise(F.col("lease_until")),
    }).drop("taken")


def extended(messages: DataFrame, owner: str, now: Column, seconds: int = LEASE) -> DataFrame:
    """ST2: the queue after an owner's heartbeat; leases that ran out are not revived."""
    own = (F.col("status") == "claimed") & (F.col("lease_owner") == owner) & (F.col("lease_until") > now)
    return messages.withColumn("lease_until", F.when(own, F.timestamp_micros(F.unix_micros(now) + seconds * 1_000_000)).otherwise(F.col("lease_until")))


def reclaimed(messages: DataFrame, now: Column) -> DataFrame:
    """ST2: the queue with claimed messages whose lease ran out pending again."""
    gone = (F.col("status") == "claimed") & (F.coalesce(F.col("lease_until") <= now, F.lit(True)))
    return messages.withColumns({"status": F.when(gone, "pending").otherwise(F.col("status")), "lease_owner": F.when(~gone, F.col("lease_owner")), "lease_until": F.when(~gone, F.col("lease_until"))})


def finished(messages: DataFrame, owner: str, done: DataFrame) -> DataFrame:
    """ST4: the queue after an owner is done with messages (guild_id, message_id, status: processed or dead); those that another holds stay."""
    ends = done.select("guild_id", "message_id", F.col("status").alias("end"))
    rows = messages.join(ends.dropDuplicates(["guild_id", "message_id"]), ["guild_id", "message_id"], "left")
    own = F.col("end").isNotNull() & (F.col("status") == "claimed") & (F.col("lease_owner") == owner)
    return rows.withColumn("status", F.when(own, F.col("end")).otherwise(F.col("status"))).drop("end")


def requeued(messages: DataFrame, guild: str | None = None) -> DataFrame:
    """ST4: dead messages, of one guild or all, are pending again."""
    hit = (F.col("status") == "dead") & (F.lit(True) if guild is None else F.col("guild_id") == guild)
    return messages.withColumn("status", F.when(hit, "pending").otherwise(F.col("status")))


def committed_by(store, handler: Callable[[DataFrame], dict[str, DataFrame]], name: str = "ingest") -> Callable[[DataFrame, int], None]:
    """ST6, ST10, ST11: a foreachBatch sink that commits what a handler makes of a batch once, whatever is repeated."""

    def write(batch: DataFrame, batch_id: int) -> None:
        receipt = (name, batch_id)
        if not store.done(receipt):
            store.commit(handler(batch), receipt)

    return write
