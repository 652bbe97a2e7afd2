"""Two-pass external shuffle into shards, with SQL functions alone.

The first pass scatters whole records over buckets by seeded hashes; there are so
many buckets that each fits in memory. The second pass puts each bucket in a fixed
order, runs a seeded Fisher-Yates shuffle over it (Spark's shuffle()), counts on
through the buckets and writes it. A record's place in that count, modulo the
number of shards, is its shard, so shards differ by one record at most and every
record may come to stand anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.llm.common import scratch_path, table, written

SHARDS = 8
SEED = 20240229
#: Bytes that a bucket should hold, and records at most.
BUCKET_BYTES = 32 << 20
BUCKET_ROWS = 4096
#: Buckets whose counts are summed up together.
TOGETHER = 4096


def scattered(records: DataFrame, key, size, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """First pass: adds `_qm_bucket`, a seeded hash of the key.

    A key with more rows than half a bucket is spread by the rows' places in the
    input as well. There are fewer such keys than twice as many as buckets; only
    they are looked up, by broadcast where Spark finds their table small. Their
    rows are written with their places first, so that a task that runs again
    finds them where they were.
    """
    keyed = records.withColumn("_qm_key", key)
    total = keyed.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    buckets = max(1, -(-total["n"] * 2 // bucket_rows), -(-total["b"] * 2 // bucket_bytes))
    hot = keyed.groupBy("_qm_key").agg(F.count("*").alias("_qm_n")).where(F.col("_qm_n") * 2 > bucket_rows).select("_qm_key")
    hot = written(hot, "hot")
    keyed = keyed.withColumn("_qm_at", F.lit(0).cast("long"))
    if not hot.isEmpty():
        many = keyed.join(hot, "_qm_key", "left_semi").withColumn("_qm_at", F.monotonically_increasing_id())
        keyed = keyed.join(hot, "_qm_key", "left_anti").unionByName(written(many, "placed"))
    return keyed.withColumn("_qm_bucket", F.pmod(F.xxhash64(F.lit(seed), "_qm_key", "_qm_at"), F.lit(buckets)).cast("long")).select(*records.columns, "_qm_bucket")


def _running(counts: DataFrame) -> DataFrame:
    """Records in the buckets before each: sums inside groups of buckets, and over the groups."""
    inside = counts.withColumn("_qm_group", F.floor(F.col("_qm_bucket") / TOGETHER))
    inside = inside.withColumn("inside", F.sum("n").over(Window.partitionBy("_qm_group").orderBy("_qm_bucket")) - F.col("n"))
    groups = counts.groupBy(F.floor(F.col("_qm_bucket") / TOGETHER).alias("_qm_group")).agg(F.sum("n").alias("m"))
    groups = groups.select("_qm_group", (F.sum("m").over(Window.orderBy("_qm_group")) - F.col("m")).alias("outside"))
    return inside.join(groups, "_qm_group").select("_qm_bucket", (F.col("inside") + F.col("outside")).alias("before"))


def shuffled(records: DataFrame, key, size, seed: int = SEED, **limits) -> DataFrame:
    """Both passes: each record as a struct `record`, with its `place` in the whole, from zero.

    Buckets stand in order in a fixed number of partitions and records in order
    in their buckets before the seeded shuffle, so a task that runs again, on
    another executor, gives the same places.
    """
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = scattered(records, key, size, seed, **limits).select("_qm_bucket", F.struct(*records.columns).alias("record"))
    ordered = F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(seed), "record").alias("h"), "record")))
    buckets = spread.repartition(parts, "_qm_bucket").groupBy("_qm_bucket").agg(ordered.alias("rows"))
    # Counted before the records are dealt, and written, so that the join with the records needs no shuffle of these.
    before = written(_running(spread.groupBy("_qm_bucket").agg(F.count("*").alias("n"))), "before")
    dealt = buckets.sortWithinPartitions("_qm_bucket").select("_qm_bucket", F.expr(f"shuffle(rows, {seed})").alias("rows"))
    dealt = dealt.select("_qm_bucket", F.posexplode("rows").alias("at", "row"))
    return dealt.join(before, "_qm_bucket").select("row.record", (F.col("before") + F.col("at")).alias("place"))


def write_shards(records: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, **limits) -> None:
    """Shuffles whole records, text and all, and writes one folder for each shard.

    The records must have a doc_id and a text; other columns go along, under any
    names but those that begin with `_qm_`. `_qm_slot` is a record's place in its
    shard; files hold their records in slot order. Null texts are kept. Records
    equal in doc_id and text are dealt like others. A text of any length is one
    record, and a bucket may exceed its size by one. An empty table leaves an
    empty folder with the columns.
    """
    placed = shuffled(records, F.struct("doc_id", F.xxhash64("text")), F.coalesce(F.octet_length("text"), F.lit(0)) + 64, seed, **limits)
    out = placed.select("record.*", F.pmod("place", F.lit(shards)).cast("int").alias("_qm_shard"), F.floor(F.col("place") / shards).cast("long").alias("_qm_slot"))
    out.sortWithinPartitions("_qm_shard", "_qm_slot").write.partitionBy("_qm_shard").option("compression", "zstd").parquet(path)


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, **limits) -> DataFrame:
    """Writes the documents into shards and returns for each, read back, its shard and slot.

    docs has doc_id (long) and text; other columns are left out. Counts are at most
    one apart and slots have no gaps. A null text has no bytes; one of any length
    stays whole. Rows that are equal in doc_id and text are exchangeable; their
    order has no bearing on the result. An empty table gives an empty result.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "shards")
    write_shards(docs.select("doc_id", "text"), path, shards, seed, **limits)
    back = spark.read.schema("doc_id long, text string, _qm_slot long, _qm_shard int").parquet(path)
    return back.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("_qm_shard").alias("shard"),
        F.col("_qm_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark, sf_dir):
    return sharded(table(spark, sf_dir, "documents"))
