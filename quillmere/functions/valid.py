"""Validity, participants and visibility of facts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_active() -> Column:
    """F1."""
    return F.col("valid_until").isNull() & F.col("superseded_by_id").isNull()


def as_of(moment: Column) -> Column:
    """valid in the world at a moment; the interval is open at its end."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= moment)) & (F.col("valid_until").isNull() | (moment < F.col("valid_until")))


def is_valid_at(moment: Column) -> Column:
    """F3 and not past retention."""
    return as_of(moment) & (F.col("expires_at").isNull() | (moment < F.col("expires_at")))


def scope(subjects: list[str] | None, server_only: bool = False) -> Column:
    """server facts, or facts whose subject or one of whose related users is asked for."""
    if server_only:
        return F.col("subject_id").isNull()
    if subjects is None:
        return F.lit(True)
    asked = F.array(*map(F.lit, subjects)) if subjects else F.array().cast("array<string>")
    return F.coalesce(F.array_contains(asked, F.col("subject_id")), F.lit(False)) | F.coalesce(F.arrays_overlap("related_user_ids", asked), F.lit(False))


def participants() -> Column:
    """subject, speaker, actor, related users and authors of citations, in this order, each once."""
    several = F.concat(
        F.array("subject_id", "attribution.speaker_id", "attribution.actor_id"),
        F.coalesce("related_user_ids", F.array().cast("array<string>")),
        F.coalesce(F.transform("citations", lambda c: c["author_id"]), F.array().cast("array<string>")),
    )
    return F.array_distinct(F.filter(several, lambda x: x.isNotNull() & (x != "")))


def source_channels() -> Column:
    """the channels of a fact's citations; none unless every citation has one, in the fact's own guild."""
    whole = (F.size("citations") > 0) & F.forall("citations", lambda c: (F.coalesce(c["channel_id"], F.lit("")) != "") & (c["guild_id"] == F.col("guild_id")))
    return F.when(whole, F.array_distinct(F.transform("citations", lambda c: c["channel_id"]))).otherwise(F.array().cast("array<string>"))


def visible_in(allowed: Column) -> Column:
    """all of a fact's channels are allowed, and it has some."""
    return (F.size(source_channels()) > 0) & (F.size(F.array_except(source_channels(), allowed)) == 0)


def source_is_current(revision: Column, known: Column, deleted: Column) -> Column:
    """without a recorded state only the empty revision is current."""
    return F.when(known.isNull() & deleted.isNull(), revision == "").otherwise(~F.coalesce(deleted, F.lit(False)) & (known == revision))
