"""Information-theoretic sanitisation, with SQL functions alone.

Patterns find personal data first: the protected entities, each also in a coarser
form (domain, network, number prefix). Other words of the document may give them
away. How much a word tells of an entity is its pointwise mutual information with
it, counted over the documents of the whole corpus; as a share of all that there
is to tell of the entity (its information content), it is at most one, which a
word comes near that appears with this entity alone. One more document with the
word, like the corpus on average, is added to the counts, so that a word seen once
tells less than one seen often. Words whose share exceeds a threshold are
generalised, those above a higher one removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import dropped, prefix_sums, row_key, table, written

#: Kinds in order. Possessive forms of the contract's patterns: what they match is the same, in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
TERM = "term"
WORD = r"\p{L}{4,}"
#: Documents in which word and entity meet, at least; shares of the entity's information.
SUPPORT = 1
GENERALISE = 0.8
REMOVE = 0.95

_PART = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"\A{_PART}(\.{_PART}){{3}}\z")
    if kind == "card":
        return (F.length(digits) >= 14) & (F.length(digits) <= 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return (F.length(digits) >= 10) & (F.length(digits) <= 15)
    return F.lit(True)


def _steps(hits: str, gaps: str) -> Column:
    """How far each hit's start is from that of the one before."""
    return F.transform(hits, lambda h, j: F.length(F.get(F.col(gaps), j)) + F.when(j > 0, F.length(F.get(F.col(hits), j - 1))).otherwise(0))


def _spans(rank: int, kind: str, hits: str, gaps: str, steps: str, offs: str) -> Column:
    def span(h, j):
        start = F.get(F.col(offs), j) + F.get(F.col(steps), j)
        return F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(h)).alias("end"), F.lit(kind).alias("kind"),
            h.alias("value"), _valid(kind, h).alias("valid"),
        )

    return F.filter(F.transform(hits, span), lambda s: s["valid"])


def base_spans(rows: DataFrame) -> DataFrame:
    """Adds `base` to rows with a text: the spans of all kinds by start, then kind."""
    cols, none = rows.columns, F.array().cast("array<string>")
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        hits, gaps, steps, offs = (f"_{x}_{kind}" for x in ("hits", "gaps", "steps", "offs"))
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        rows = rows.withColumn(hits, F.when(F.instr("text", HINTS[kind]) > 0, found).otherwise(none) if kind in HINTS else found)
        rows = rows.withColumn(gaps, F.when(F.size(hits) > 0, F.split("text", pattern, -1)).otherwise(none))
        rows = rows.withColumn(steps, _steps(hits, gaps)).withColumn(offs, F.expr(prefix_sums(steps)))
        rows = rows.withColumn(f"_{kind}", _spans(rank, kind, hits, gaps, steps, offs))
    return rows.select(*cols, F.array_sort(F.concat(*(f"_{kind}" for kind in PATTERNS))).alias("base"))


def entities(held: DataFrame) -> DataFrame:
    """Entities of each row with personal data, exact and coarser: r1, r2, entity."""
    hits = held.select("r1", "r2", F.explode("base").alias("b")).select("r1", "r2", "b.kind", F.lower("b.value").alias("value"))
    digits = F.regexp_replace("value", "[^0-9]", "")
    coarser = F.when(F.col("kind") == "email", F.substring_index("value", "@", -1)).when(F.col("kind") == "ip", F.substring_index("value", ".", 3)).otherwise(F.substring(digits, 1, 6))
    both = F.array(F.concat_ws(":", "kind", "value"), F.concat_ws(":", F.lit("like"), "kind", coarser))
    return hits.select("r1", "r2", F.explode(both).alias("entity")).distinct()


def disclosing(rows: DataFrame, held: DataFrame, support: int = SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """Words of each row that disclose one of its entities: r1, r2, word, share (the largest).

    rows (r1, r2, text) is the whole corpus, held its rows with personal data (r1,
    r2, text, base), each once. Entities that occur in the same rows are told of
    alike and are counted as one. A word in so many documents that its share of an
    entity cannot reach the threshold is left out before the two are paired.
    """
    named = written(entities(held), "entities")
    total = rows.count()
    own = named.groupBy("entity").agg(F.bit_xor("r1").alias("e1"), F.bit_xor("r2").alias("e2"), F.count("*").alias("with_entity"))
    prior = F.col("with_entity") / F.lit(float(max(1, total)))
    most = (F.col("with_entity") + prior) / F.pow(prior, F.lit(1 - threshold)) - 1
    own = own.where(F.col("with_entity") < total).select("entity", "e1", "e2", "with_entity", (most * (1 + 1e-9)).alias("most"))
    groups = written(named.join(own, "entity").select("r1", "r2", "e1", "e2", "with_entity", "most").distinct(), "groups")
    dropped(named)
    most = groups.agg(F.max("most")).first()[0] or 0.0

    words = lambda df: df.select("r1", "r2", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).alias("word"))
    of_word = written(words(rows).groupBy("word").agg(F.count("*").alias("with_word")), "words")
    # Words in a hundredth of the documents are few at any size, and would be large keys.
    common = of_word.where(F.col("with_word") > max(most, total / 100)).select("word")
    rare = of_word.where(F.col("with_word") <= most)
    met = words(held).join(F.broadcast(common), "word", "left_anti").join(rare, "word")
    met = written(met.join(groups, ["r1", "r2"]).where(F.col("with_word") <= F.col("most")).select("r1", "r2", "word", "with_word", "e1", "e2", "with_entity"), "met")
    together = met.groupBy("e1", "e2", "with_entity", "word", "with_word").agg(F.count("*").alias("both")).where(F.col("both") >= support)
    prior = F.col("with_entity") / F.lit(float(max(1, total)))
    share = F.log((F.col("both") + prior) / (F.col("with_word") + 1) / prior) / -F.log(prior)
    told = together.withColumn("share", share).where(F.col("share") >= threshold).select("e1", "e2", "with_entity", "word", "share")
    return met.join(told, ["e1", "e2", "with_entity", "word"]).groupBy("r1", "r2", "word").agg(F.max("share").alias("share"))


def occurrences(held: DataFrame) -> DataFrame:
    """Words of each row at each of their places: r1, r2, word, start, end."""
    texts = held.select("r1", "r2", "text").withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).where(F.size("words") > 0).withColumn("gaps", F.split("text", WORD, -1))
    texts = texts.withColumn("steps", _steps("words", "gaps")).withColumn("offs", F.expr(prefix_sums("steps")))
    placed = F.transform("words", lambda w, j: F.struct(F.lower(w).alias("word"), (F.get(F.col("offs"), j) + F.get(F.col("steps"), j)).alias("start"), F.length(w).alias("n")))
    return texts.select("r1", "r2", F.explode(placed).alias("w")).select("r1", "r2", "w.word", "w.start", (F.col("w.start") + F.col("w.n")).alias("end"))


def protected_spans(docs: DataFrame, support: int = SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """Per document its personal data and the words that disclose it.

    docs has doc_id and text; other columns are left out. A null or empty text has
    no spans. Repeated rows come out alike and count once in the statistics. Words
    that overlap personal data are no terms. Whole texts are searched, in time
    linear in their length; of words that tell of several entities the largest
    share counts. An empty table gives an empty result.

    Returns doc_id, base (spans by start, then kind) and terms (every place of a
    disclosing word: start, end, share of the information on an entity, the largest
    of all in the document).
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *row_key("doc_id", "text"))
    found = written(base_spans(rows).select("doc_id", "r1", "r2", "base", F.when(F.size("base") > 0, F.col("text")).alias("text")), "base")
    held = found.where(F.size("base") > 0).dropDuplicates(["r1", "r2"])
    # Equal rows count once in the statistics.
    again = not found.groupBy("r1", "r2").count().where("count > 1").isEmpty()
    flagged = written(disclosing(rows.dropDuplicates(["r1", "r2"]) if again else rows, held, support, threshold), "flagged")
    spans = occurrences(held).join(flagged, ["r1", "r2", "word"])
    spans = written(spans.groupBy("r1", "r2").agg(F.array_sort(F.collect_list(F.struct("start", "end", "share"))).alias("terms")), "terms")
    dropped(flagged)
    found = found.drop("text")
    clear = F.filter("terms", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    none = F.array().cast("array<struct<start:int,end:int,share:double>>")
    out = found.join(spans, ["r1", "r2"], "left").withColumn("terms", F.when(F.col("terms").isNull(), none).otherwise(clear))
    bare = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["rank"].alias("rank"), b["end"].alias("end"), b["kind"].alias("kind")))
    return out.select("doc_id", bare.alias("base"), "terms", "r1", "r2")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _with_terms() -> Column:
    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(len(PATTERNS)).alias("rank"), t["end"].alias("end"), F.lit(TERM).alias("kind")))
    return F.concat(F.col("base"), terms)


def sanitised(docs: DataFrame, support: int = SUPPORT, threshold: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Per document its text with personal data and disclosing words replaced: doc_id, sanitised.

    Personal data become their kind in brackets, words are removed, or where they
    tell less, generalised to [WORD]. Of overlapping spans the first is replaced.
    Null texts become empty ones. Equal rows come out alike, each as often as it
    went in; null doc_ids stay. An empty table stays empty.
    """
    spans = protected_spans(docs, support, threshold)
    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["share"] >= remove, "").otherwise("[WORD]").alias("put")))
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.concat(F.lit("["), F.upper(b["kind"]), F.lit("]")).alias("put")))
    spans = spans.select("r1", "r2", F.array_sort(F.concat(base, terms)).alias("puts")).dropDuplicates(["r1", "r2"])
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *row_key("doc_id", "text")).join(spans, ["r1", "r2"])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(state, s):
        step = F.concat(state["out"], F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"]), s["put"])
        return F.when(s["start"] >= state["at"], F.struct(s["end"].alias("at"), step.alias("out"))).otherwise(state)

    done = F.aggregate("puts", start, put, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    return rows.select("doc_id", done.alias("sanitised"))


def query(spark, sf_dir):
    found = protected_spans(table(spark, sf_dir, "documents"))
    counts = [F.size(F.expr(f"filter(base, b -> b.kind = '{kind}')")).cast("long").alias(f"n_{kind}") for kind in PATTERNS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(_with_terms()).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )
