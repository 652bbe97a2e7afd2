"""Sentences of replies tied to a closed set of sources (SC30, C1-C5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.functions import score, text

#: Sentences of a reply, sources of a reply and of a sentence, letters of a sentence, and likeness of a candidate.
CLAIMS = 12
SOURCES = 100
PER_CLAIM = 3
LETTERS = 3
LIKE = 0.55
_END = r"[.!?…]+(?=[ \t\n]|\z)|\n"


def segments(replies: DataFrame, content: str = "text", most: int | None = CLAIMS) -> DataFrame:
    """SC30: sentences of each reply (reply_id) with their place: claim_at, start, end (exclusive), claim.

    A sentence ends at a line's end, or at closing marks before white space; it has
    three letters or digits. Lengths of what lies between the ends give the places.
    """
    parts = F.split(F.regexp_replace(F.coalesce(F.col(content), F.lit("")), rf"(?<=[.!?…])(?=[ \t\n])|(?=\n)", "\u0000"), "\u0000")
    rows = replies.select("reply_id", F.posexplode(parts).alias("at", "piece"))
    order = Window.partitionBy("reply_id").orderBy("at")
    rows = rows.withColumn("begin", F.sum(F.length("piece")).over(order) - F.length("piece"))
    lead = F.length("piece") - F.length(F.regexp_replace("piece", r"\A[ \t\n]+", ""))
    claim = F.regexp_replace(F.regexp_replace("piece", r"\A[ \t\n]+", ""), r"[ \t\n]+\z", "")
    rows = rows.select("reply_id", "at", (F.col("begin") + lead).cast("int").alias("start"), claim.alias("claim"))
    rows = rows.where(F.length(F.regexp_replace("claim", r"(?U)[^\p{L}\p{N}]", "")) >= LETTERS)
    rows = rows.withColumn("claim_at", F.row_number().over(order)).withColumn("end", F.col("start") + F.length("claim")).drop("at")
    return rows if most is None else rows.where(F.col("claim_at") <= most)


def comparable(value: Column) -> Column:
    """How claims and excerpts are compared: normal form without closing marks."""
    return F.regexp_replace(text.normalize(value), r"[\s.!?…]+\z", "")


def registry(sources: DataFrame) -> DataFrame:
    """Each reply's sources, one for each address, numbered from 1 in order of appearance (reply_id, pos, url, excerpt).

    Sources without a safe address keep their place but get no number.
    """
    first = Window.partitionBy("reply_id", "url").orderBy("pos")
    rows = sources.withColumn("n", F.when(F.coalesce(F.col("url"), F.lit("")) == "", 1).otherwise(F.row_number().over(first))).where("n = 1").drop("n")
    usable = text.is_safe_url(F.col("url"))
    return rows.withColumn("number", F.when(usable, F.count_if(usable).over(Window.partitionBy("reply_id").orderBy("pos"))))


def exact(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims that say just what a source's excerpt does: reply_id, claim_at, number; the first few sources of each."""
    left = claims.select("reply_id", "claim_at", comparable(F.col("claim")).alias("key"))
    right = sources.where(F.col("number").isNotNull() & (F.col("number") <= SOURCES)).select("reply_id", "number", comparable(F.col("excerpt")).alias("key")).where("key <> ''")
    order = Window.partitionBy("reply_id", "claim_at").orderBy("number")
    return left.join(right, ["reply_id", "key"]).withColumn("n", F.row_number().over(order)).where(F.col("n") <= PER_CLAIM).drop("n", "key")


def shortlisted(claims: DataFrame, sources: DataFrame, least: float = LIKE) -> DataFrame:
    """For each claim the sources nearest in meaning (both with embedding), for a verifier to judge."""
    pairs = claims.select("reply_id", "claim_at", F.col("embedding").alias("a")).join(sources.where("number is not null").select("reply_id", "number", F.col("embedding").alias("b")), "reply_id")
    scored = pairs.withColumn("score", F.round(score.cosine(F.col("a"), F.col("b")), 6)).where(F.col("score") >= least)
    order = Window.partitionBy("reply_id", "claim_at").orderBy(F.desc("score"), "number")
    return scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= PER_CLAIM).select("reply_id", "claim_at", "number", "score")


def woven(replies: DataFrame, claims: DataFrame, cited: DataFrame, sources: DataFrame) -> DataFrame:
    """Replies with links after the claims they support, put in from the back so that places stay true."""
    links = cited.join(sources.select("reply_id", "number", "url"), ["reply_id", "number"]).join(claims, ["reply_id", "claim_at"])
    mark = F.concat(F.lit(" [["), F.col("number").cast("string"), F.lit("]](<"), F.col("url"), F.lit(">)"))
    per = links.groupBy("reply_id", "end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", mark.alias("m")))), lambda x: x["m"]), "").alias("m"))
    marks = per.groupBy("reply_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("end", "m")))).alias("marks"))
    put = F.aggregate("marks", F.col("text"), lambda t, x: F.concat(F.substring(t, F.lit(1), x["end"]), x["m"], F.substring(t, x["end"] + 1, F.length(t))))
    return replies.join(marks, "reply_id", "left").select("reply_id", F.when(F.col("marks").isNull(), F.col("text")).otherwise(put).alias("text"))


def fact_list(facts: DataFrame) -> DataFrame:
    """A line for each fact (list_id, pos, text, urls) with numbered links; an address keeps its number in a list."""
    seen = facts.select("list_id", "pos", F.posexplode("urls").alias("at", "url"))
    first = seen.groupBy("list_id", "url").agg(F.min(F.struct("pos", "at")).alias("first"))
    numbered = first.withColumn("number", F.row_number().over(Window.partitionBy("list_id").orderBy("first")))
    rows = seen.join(numbered.select("list_id", "url", "number"), ["list_id", "url"])
    mark = F.concat(F.lit("[["), F.col("number").cast("string"), F.lit("]](<"), F.col("url"), F.lit(">)"))
    links = rows.groupBy("list_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", mark.alias("m")))), lambda x: x["m"]).alias("links"))
    line = F.concat_ws(" ", F.concat(F.lit("- "), F.col("text")), F.array_join(F.array_distinct("links"), " "))
    return facts.join(links, ["list_id", "pos"], "left").select("list_id", "pos", F.when(F.col("links").isNull(), F.concat(F.lit("- "), F.col("text"))).otherwise(line).alias("line"))
