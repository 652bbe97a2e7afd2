"""Benchmark decontamination by winnowing, with SQL functions alone.

Of every run of overlapping word k-grams, as many as a shared span must hold,
the smallest hash is kept, the first of equal ones, of documents and of benchmark
items alike; equal spans keep equal hashes at equal places. Documents' kept
hashes are joined with the items'; each hit is then extended word by word as far
as a span may reach, so that nothing rests on hashes alone. Items shorter than a
span are one gram of their own length. Words, hashed or compared, are in lower
case as to A-Z alone.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import row_key, table, written

#: Words of a shared span, and of a hashed gram.
SPAN = 13
GRAM = 6
#: Kept hashes of the benchmark that may be broadcast: 24 bytes each.
BROADCAST_HASHES = 1_000_000

_BETWEEN = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Low bits of a packed hash that hold its place; no text that Spark can hold has more words.
_PLACE = (1 << 30) - 1


def _words(text: str) -> str:
    lowered = f"translate({text}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"filter(split({lowered}, '{_BETWEEN}'), w -> w <> '')"


def _kept(span: int, gram: int) -> str:
    """Places, from 1, of the grams that winnowing keeps: the smallest of each run, packed with its place."""
    width = span - gram + 1
    runs = f"transform(sequence(1, greatest(1, size(p{span}) - {width - 1})), i -> array_min(slice(p{span}, i, {width})) & {_PLACE})"
    return f"if(size(p{span}) < {width}, array(), array_distinct({runs}))"


def _kept_grams(texts: DataFrame, units: list[tuple[int, int]]) -> DataFrame:
    """Adds words, their number n, and kept: for each unit the places p of the kept grams and their hashes v."""
    texts = texts.withColumn("words", F.expr(_words("text"))).withColumn("n", F.size("words")).withColumn("hashes", F.expr("transform(words, w -> xxhash64(w))"))
    found = []
    for span, gram in units:
        packed = f"transform(sequence(1, greatest(1, n - {gram - 1})), i -> (xxhash64(slice(hashes, i, {gram}), {span}) & {~_PLACE}) | i)"
        texts = texts.withColumn(f"p{span}", F.expr(f"if(n < {gram}, array(), {packed})"))
        found.append(f"transform({_kept(span, gram)}, i -> named_struct('span', {span}, 'gram', {gram}, 'p', cast(i as int), 'v', xxhash64(slice(hashes, cast(i as int), {gram}), {span})))")
    return texts.withColumn("kept", F.expr(f"concat({', '.join(found)})"))


#: What is kept, each with the exact words that a span around the gram may hold, and the place of the first; made before
#: the rows are spread out, since each would carry the whole text along.
_SPREAD = (
    "explode(transform(kept, k -> named_struct('span', k.span, 'gram', k.gram, 'p', k.p, 'v', k.v, 'low', greatest(1, k.p - (k.span - k.gram)), "
    "'around', slice(words, greatest(1, k.p - (k.span - k.gram)), least(size(words), k.p + k.span - 1) - greatest(1, k.p - (k.span - k.gram)) + 1)))) as k"
)


def contaminated_words(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Per document the words inside passages it shares with benchmark items.

    docs has doc_id (long) and text, benchmark has item_id and text; other
    columns are left out. Nulls and texts without words share nothing. Items
    with the same item_id count as one, a null item_id as none. Repeated
    documents each come back. Either table may be empty. The work on a text grows
    with its length, however long it is or how much of it is hit; of equal hashes
    in a run the first is kept, in documents and items alike.

    Returns r1, r2 (which name a row by its contents), doc_id, n_words, n_hit,
    n_items, items (sorted as strings).
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").distinct()
    counted = items.select("item_id", "text", F.size(F.expr(_words("text"))).alias("m")).where("m > 0")
    short = sorted(r.m for r in counted.where(F.col("m") < span).select("m").distinct().collect())
    units = [(span, gram), *((m, m) for m in short)]

    kept = [_kept_grams(counted.where(F.col("m") >= span if u[0] == span else F.col("m") == u[0]), [u]).selectExpr("item_id", "m", _SPREAD) for u in units]
    seeds = kept[0]
    for more in kept[1:]:
        seeds = seeds.unionByName(more)
    seeds = written(seeds.select("item_id", "m", "k.*").drop("gram"), "benchmark")
    hashes = seeds.select("v").distinct()
    if hashes.count() <= BROADCAST_HASHES:
        hashes = F.broadcast(hashes)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *row_key("doc_id", "text"))
    none = F.lit(0)
    row = F.struct(none.alias("span"), none.alias("gram"), none.alias("p"), F.xxhash64("r1", "r2").alias("v"))
    marked = _kept_grams(rows, units).select("r1", "r2", "doc_id", "n", F.explode(F.concat("kept", F.array(row))).alias("k")).select("r1", "r2", "doc_id", "n", "k.*")
    found = written(marked.join(hashes.withColumn("hit", F.lit(True)), "v", "left").where("span = 0 or hit").withColumn("row", F.col("span") == 0), "hits")

    hits = found.where("not row").groupBy("r1", "r2").agg(F.collect_set(F.struct("span", "gram", "p", "v")).alias("kept"))
    again = rows.select("r1", "r2", "text").join(hits, ["r1", "r2"]).dropDuplicates(["r1", "r2"]).select("r1", "r2", F.expr(_words("text")).alias("words"), "kept")
    places = again.selectExpr("r1", "r2", _SPREAD).select("r1", "r2", "k.*")
    theirs = seeds.select("v", "span", "item_id", "m", F.col("p").alias("q"), F.col("low").alias("item_low"), F.col("around").alias("item_around"))
    starts = F.expr(
        "filter(sequence(p - span + gram, p), s -> s >= low and s - p + q >= item_low and s - low + span <= size(around) and s - p + q - item_low + span <= size(item_around) "
        "and slice(around, s - low + 1, span) = slice(item_around, s - p + q - item_low + 1, span))"
    )
    shared = places.join(theirs, ["v", "span"]).select("r1", "r2", "item_id", "span", F.explode(starts).alias("s"))
    spans = shared.groupBy("r1", "r2").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.collect_set(F.struct("s", "span")).alias("spans"))
    spans = spans.select("r1", "r2", "items", F.expr("size(array_distinct(flatten(transform(spans, x -> sequence(x.s, x.s + x.span - 1)))))").cast("long").alias("n_hit"))
    return (
        found.where("row")
        .select("r1", "r2", "doc_id", F.col("n").cast("long").alias("n_words"))
        .join(spans, ["r1", "r2"], "left")
        .select(
            "r1", "r2", "doc_id", "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """A document is contaminated if a twentieth of its words, and one at least, are hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def query(spark, sf_dir):
    found = contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that are not contaminated.

    Texts without words, null and empty ones among them, and all texts where the
    benchmark is empty, stay. Equal rows stay or go together. Texts of any length
    are judged whole. Columns may have any names but those that begin with `_qm_`.
    An empty table stays empty.
    """
    bad = contaminated_words(docs, benchmark).where(contaminated()).select(F.col("r1").alias("_qm_r1"), F.col("r2").alias("_qm_r2")).distinct()
    keys = [k.alias(f"_qm_r{i}") for i, k in enumerate(row_key("doc_id", F.coalesce("text", F.lit(""))), 1)]
    return docs.select("*", *keys).join(bad, ["_qm_r1", "_qm_r2"], "left_anti").select(*docs.columns)


#: The contract in DuckDB's words: windows of items looked up among windows of documents.
ORACLE = r"""
with w as (select doc_id, text, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as words from documents),
d as (select row_number() over (order by doc_id) as r, doc_id, words from w),
b as (select item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as words from benchmark where text is not null),
s as (select item_id, words, least(13, len(words)) as k from b where len(words) > 0),
iw as (select distinct item_id, k, array_to_string(list_slice(words, i, i + k - 1), ' ') as win from (select *, unnest(range(1, len(words) - k + 2)) as i from s)),
dw as (select r, k, i, array_to_string(list_slice(words, i, i + k - 1), ' ') as win from (select r, words, k, unnest(range(1, len(words) - k + 2)) as i from d cross join (select distinct k from s) where len(words) >= k)),
hit as (select r, i, dw.k, item_id from dw join iw on dw.k = iw.k and dw.win = iw.win),
pos as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from hit) group by r),
its as (select r, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct r, cast(item_id as varchar) as id from hit) group by r)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from d left join pos using (r) left join its using (r)
"""
