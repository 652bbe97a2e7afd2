"""Writing, merging and reading facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.functions import text, valid

KEY = ["guild_id", "id"]
# Fixed value: words that speak of a change of state, so that a fact may contradict one it hardly resembles.
STATE_CHANGE = r"(?iU)\b(quit|stopped|no longer|not anymore|anymore|never|(?:do|does|did)(?:n'?t| not)\b|moved|promoted|hired|fired|graduated|switched|left|broke up|divorced|retired|sold)\b"
#: Likeness of facts that collide in any case, and of those that may; neighbours looked at.
COLLIDE = 0.85
MAY_COLLIDE = 0.35
NEIGHBOURS = 6
#: Citations that a fact keeps, and facts that a source's search returns.
CITATIONS = 8
SOURCE_LIMIT = 100


def current(log: DataFrame) -> DataFrame:
    """The last version of each fact in an append-only log."""
    cols = [c for c in log.columns if c not in KEY]
    last = log.groupBy(*KEY).agg(F.max_by(F.struct(*cols), "version").alias("row"))
    return last.select(*KEY, "row.*")


def duplicates(facts: DataFrame, incoming: DataFrame) -> DataFrame:
    """M1: incoming facts with the active one that says the same of the same subject (existing_id; the smallest id)."""
    known = facts.where(valid.is_active()).groupBy("guild_id", "subject_id", "text_normalized").agg(F.min("id").alias("existing_id"))
    known = known.select(F.col("guild_id").alias("_g"), F.col("subject_id").alias("_s"), F.col("text_normalized").alias("_t"), "existing_id")
    same = (F.col("guild_id") == F.col("_g")) & F.col("subject_id").eqNullSafe(F.col("_s")) & (F.col("text_normalized") == F.col("_t"))
    return incoming.join(known, same, "left").drop("_g", "_s", "_t")


def first_said(proposals: DataFrame, order: str = "at") -> DataFrame:
    """Of proposals with the same subject and text the first one of a batch."""
    w = Window.partitionBy("guild_id", "subject_id", "text_normalized").orderBy(order, "id")
    return proposals.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def reinforced(observations: DataFrame, order: str = "at") -> DataFrame:
    """M3: repeated observations folded into one fact for each guild, subject and text.

    Occurrences add up, strength grows by one with each repeat, confidence is the
    largest, the first sighting gives id and citations begin with it.
    """
    key = ["guild_id", "subject_id", "text_normalized"]
    sums = observations.groupBy(*key).agg(
        F.min_by("id", F.struct(order, "id")).alias("id"), F.count("*").alias("occurrences"), F.max("confidence").alias("confidence"),
        F.min(order).alias("created_at"), F.max(order).alias("last_reinforced_at"),
    )
    w = Window.partitionBy(*key).orderBy(order, "id")
    cited = observations.withColumn("n", F.row_number().over(w)).where(F.col("n") <= CITATIONS)
    cited = cited.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("citations"))
    cited = cited.select(*(F.col(c).alias(f"_{c}") for c in key), "citations")
    rows = sums.join(cited, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]).drop(*(f"_{c}" for c in key))
    return rows.withColumn("strength", F.col("occurrences").cast("double")).withColumn("version", F.col("occurrences"))


def reinforce(facts: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """M3, M9: new versions of facts that were said again (hits: guild_id, id, confidence, citations)."""
    sums = hits.groupBy(*KEY).agg(F.count("*").alias("more"), F.max("confidence").alias("sure"), F.flatten(F.collect_list("citations")).alias("cited"))
    rows = facts.join(sums, KEY)
    return rows.withColumns({
        "occurrences": F.col("occurrences") + F.col("more"), "strength": F.col("strength") + F.col("more"), "confidence": F.greatest("confidence", "sure"),
        "citations": F.slice(F.array_distinct(F.concat("citations", "cited")), 1, CITATIONS), "version": F.col("version") + 1, "last_reinforced_at": now,
    }).drop("more", "sure", "cited")


def superseded(facts: DataFrame, pairs: DataFrame, now: Column) -> DataFrame:
    """M4, M8: facts after some (guild_id, old_id) gave way to others (new_id), where the version read is still the current one.

    pairs may carry `expected_version`; a pair that read another version is left out (J14).
    """
    moves = pairs.select("guild_id", F.col("old_id").alias("id"), "new_id", *(["expected_version"] if "expected_version" in pairs.columns else []))
    rows = facts.join(moves.dropDuplicates(KEY), KEY, "left")
    takes = F.col("new_id").isNotNull() & valid.is_active()
    if "expected_version" in moves.columns:
        takes = takes & (F.col("version") == F.col("expected_version"))
    back = moves.select("guild_id", F.col("new_id").alias("id"), F.col("id").alias("old")).dropDuplicates(KEY)
    rows = rows.withColumns({
        "superseded_by_id": F.when(takes, F.col("new_id")).otherwise(F.col("superseded_by_id")), "valid_until": F.when(takes, now).otherwise(F.col("valid_until")),
        "version": F.col("version") + F.when(takes, 1).otherwise(0),
    }).drop("new_id", "expected_version")
    return rows.join(back, KEY, "left").withColumn("supersedes_id", F.coalesce("old", "supersedes_id")).drop("old")


def invalidated(facts: DataFrame, gone: DataFrame, now: Column) -> DataFrame:
    """M5, M6: active facts named in `gone` (guild_id, id) end now, with a new version."""
    rows = facts.join(gone.select(*KEY, F.lit(True).alias("gone")).distinct(), KEY, "left")
    hit = F.col("gone") & valid.is_active()
    return rows.withColumn("version", F.col("version") + F.when(hit, 1).otherwise(0)).withColumn("valid_until", F.when(hit, now).otherwise(F.col("valid_until"))).drop("gone")


def for_sources(facts: DataFrame, messages: DataFrame, limit: int = SOURCE_LIMIT) -> DataFrame:
    """Active facts that cite a message (guild_id, message_id)."""
    cited = facts.where(valid.is_active()).select("*", F.explode(F.array_distinct("citations.message_id")).alias("message_id"))
    found = cited.join(messages, ["guild_id", "message_id"])
    w = Window.partitionBy("guild_id", "message_id").orderBy("id")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).drop("n")


def source_states(changes: DataFrame) -> DataFrame:
    """ST9: the state of each message: a deletion is final, otherwise the latest edit holds."""
    return changes.groupBy("guild_id", "message_id").agg(F.bool_or("deleted").alias("deleted"), F.max_by("revision", F.struct("changed_at", "revision")).alias("revision"))


def stale(facts: DataFrame, states: DataFrame) -> DataFrame:
    """Active facts with a citation whose source was deleted or edited since."""
    cited = facts.where(valid.is_active()).select(*KEY, F.explode("citations").alias("c")).select(*KEY, "c.message_id", F.coalesce("c.revision", F.lit("")).alias("cited"))
    found = cited.join(states, ["guild_id", "message_id"])
    return found.where(~valid.source_is_current(F.col("cited"), F.col("revision"), F.col("deleted"))).select(*KEY).distinct()


def page(facts: DataFrame, subject: str, cursor: str = "", limit: int = 50, include_server: bool = False, active_only: bool = True) -> DataFrame:
    """Facts of a subject in the order of ids, after a cursor; one more than the limit says that there are others."""
    who = F.col("subject_id") == subject
    rows = facts.where((who | F.col("subject_id").isNull()) if include_server else who)
    rows = rows.where(valid.is_active()) if active_only else rows
    return rows.where(F.col("id") > cursor).orderBy("guild_id", "id").limit(limit + 1)


def top_strength(facts: DataFrame, subjects: list[str] | None = None, limit: int = 10, moment: Column | None = None, server_only: bool = False) -> DataFrame:
    """The strongest facts, then the surest, then by id."""
    rows = facts.where(valid.is_active() if moment is None else valid.as_of(moment)).where(valid.scope(subjects, server_only))
    return rows.orderBy(F.desc("strength"), F.desc("confidence"), "guild_id", "id").limit(limit)


def get_many(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """facts by id (guild_id, id, pos), in the order asked for; unknown ones are left out."""
    return facts.join(ids, KEY).orderBy("pos")


def revalidated(cited: DataFrame, facts: DataFrame) -> DataFrame:
    """Cited facts (guild_id, id, version) that are still current in this version."""
    return cited.join(facts.where(valid.is_active()).select(*KEY, "version"), [*KEY, "version"], "left_semi")


def pending_projections(facts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Active facts whose vector is missing or of an older version."""
    have = vectors.select(*KEY, F.col("version").alias("have"))
    return facts.where(valid.is_active()).join(have, KEY, "left").where("have is null or have < version").drop("have")


def upserted_vectors(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The vector of the highest version for each fact."""
    return current.unionByName(incoming).groupBy(*KEY).agg(F.max_by("embedding", "version").alias("embedding"), F.max("version").alias("version"))


def reconciled(proposals: DataFrame, facts: DataFrame, neighbours: DataFrame) -> DataFrame:
    """What becomes of each proposal: reinforce, update, invalidate or add, with its target.

    neighbours: proposal id, target_id and similarity. The judge is a rule of ours
    in place of a language model: the same text reinforces; a change of state with
    a similar fact (.35) ends it; a very similar fact (.85) is updated; else add.
    """
    change = F.col("text").rlike(STATE_CHANGE)
    near = neighbours.groupBy("guild_id", F.col("proposal_id").alias("id")).agg(F.max(F.struct("similarity", "target_id")).alias("best"))
    rows = duplicates(facts, proposals).join(near, KEY, "left")
    kind = (
        F.when(F.col("existing_id").isNotNull(), "reinforce")
        .when(change & (F.col("best.similarity") >= MAY_COLLIDE), "invalidate")
        .when(F.col("best.similarity") >= COLLIDE, "update")
        .otherwise("add")
    )
    target = F.coalesce("existing_id", F.when(kind != "add", F.col("best.target_id")))
    return rows.select(*KEY, kind.alias("kind"), target.alias("target_id"))


def semantic_neighbours(proposals: DataFrame, facts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Active facts of a proposal's subject (guild_id, id, subject_id, text, category, embedding) that it may contradict.

    Of the six nearest those that are very like it, or somewhat like it and of its
    category, or somewhat like it where it speaks of a change. Pairs meet by subject.
    """
    from quillmere.functions import score

    known = facts.where(valid.is_active()).select("guild_id", F.col("id").alias("target_id"), F.col("subject_id").alias("_s"), F.col("category").alias("_c"))
    known = known.join(vectors.select("guild_id", F.col("id").alias("target_id"), F.col("embedding").alias("_e")), ["guild_id", "target_id"])
    asked = proposals.withColumn("_g", F.col("guild_id")).drop("guild_id")
    pairs = asked.join(known, (F.col("_g") == F.col("guild_id")) & F.col("subject_id").eqNullSafe(F.col("_s")))
    pairs = pairs.withColumn("similarity", F.round(score.cosine(F.col("embedding"), F.col("_e")), 6)).where("similarity > 0")
    order = Window.partitionBy("guild_id", "id").orderBy(F.desc("similarity"), "target_id")
    near = pairs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= NEIGHBOURS)
    some = (F.col("similarity") >= MAY_COLLIDE) & (F.col("text").rlike(STATE_CHANGE) | (F.col("category") == F.col("_c")))
    return near.where((F.col("similarity") >= COLLIDE) | some).select("guild_id", F.col("id").alias("proposal_id"), "target_id", "similarity")


def touched(facts: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """RT17: facts that were recalled (guild_id, id) count as reinforced now; their version stays."""
    seen = facts.join(hits.select(*KEY, F.lit(True).alias("hit")).distinct(), KEY, "left")
    return seen.withColumn("last_reinforced_at", F.when(F.col("hit"), now).otherwise(F.col("last_reinforced_at"))).drop("hit")


def remembered(facts: DataFrame, requests: DataFrame, receipts: DataFrame) -> DataFrame:
    """M7, SC24: what becomes of requests to remember (guild_id, subject_id, text, idempotency_key): status and the id to be.

    Refused by hygiene; repeated if a receipt shows the same key; known if an active
    fact says so already; else stored, as a manual core fact.
    """
    own = text.content_id(F.col("guild_id"), F.col("subject_id"), F.col("text"))
    asked = requests.withColumns({"text_normalized": text.normalize(F.col("text")), "id": F.concat(F.lit("fct_"), F.substring(own, 1, 26)), "why": text.hygiene(F.col("text"))})
    done = receipts.select("guild_id", F.col("key").alias("idempotency_key"), F.lit(True).alias("done")).distinct()
    rows = duplicates(facts, asked.join(done, ["guild_id", "idempotency_key"], "left"))
    status = F.when(F.col("why").isNotNull(), F.col("why")).when(F.col("done"), "repeated").when(F.col("existing_id").isNotNull(), "known").otherwise("stored")
    return rows.select("guild_id", "subject_id", "text", "idempotency_key", F.coalesce("existing_id", "id").alias("id"), status.alias("status"))


def vetted(proposals: DataFrame, least: float = 0.55) -> DataFrame:
    """Adds `rejected`, the first reason why a proposal is not stored, or null."""
    t, c = F.col("text"), F.col("confidence")
    return proposals.withColumn("rejected", F.coalesce(text.hygiene(t), text.share(t), text.frame_gate(t), text.confidence_gate(c, t, least)))


def picked_citations(indexes: Column, refs: Column) -> Column:
    """The cited sources by index, each once, unknown ones left out; the last is primary."""
    known = F.array_distinct(F.filter(indexes, lambda i: (i >= 0) & (i < F.size(refs))))
    return F.transform(known, lambda i, n: F.struct(F.get(refs, i).alias("ref"), F.when(n == F.size(known) - 1, "primary").otherwise("supporting").alias("role")))


def rosters(messages: DataFrame) -> DataFrame:
    """Tokens p0, p1, ... for the participants of each batch (guild_id, subject_key), author first, then by appearance."""
    seen = messages.select("guild_id", "subject_key", "created_at", "message_id", F.posexplode(F.concat(F.array("author_id"), "mention_ids")).alias("pos", "user_id"))
    first = seen.groupBy("guild_id", "subject_key", "user_id").agg(F.min(F.struct("created_at", "message_id", "pos")).alias("at"))
    w = Window.partitionBy("guild_id", "subject_key").orderBy((F.col("user_id") != F.col("subject_key")).cast("int"), "at", "user_id")
    return first.withColumn("token", F.concat(F.lit("p"), (F.row_number().over(w) - 1).cast("string"))).select("guild_id", "subject_key", "user_id", "token")


def history(before: DataFrame, after: DataFrame) -> DataFrame:
    """What happened to each fact between two snapshots: created, superseded, invalidated, reinstated, reinforced or relabelled."""
    b, a = (df.select(*KEY, *(F.col(c).alias(f"{p}_{c}") for c in ("version", "valid_until", "superseded_by_id", "occurrences"))) for p, df in (("b", before), ("a", after)))
    both = a.join(b, KEY, "left").where("b_version is null or b_version < a_version")
    kind = (
        F.when(F.col("b_version").isNull(), "created")
        .when(F.col("a_superseded_by_id").isNotNull() & F.col("b_superseded_by_id").isNull(), "superseded")
        .when(F.col("a_valid_until").isNotNull() & F.col("b_valid_until").isNull(), "invalidated")
        .when(F.col("a_valid_until").isNull() & F.col("b_valid_until").isNotNull(), "reinstated")
        .when(F.col("a_occurrences") > F.col("b_occurrences"), "reinforced")
        .otherwise("relabelled")
    )
    return both.select(*KEY, kind.alias("kind"), F.col("a_version").alias("fact_version"))
