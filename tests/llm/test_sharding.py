import zlib
from collections import Counter

import pytest

from quillmere.llm import sharding
from quillmere.llm.sharding import sharded, write_shards


def check(rows, texts, shards=8):
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(i, [])) for i in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)


@pytest.mark.parametrize("bucket_rows", [4096, 16])
def test_law_holds(spark, bucket_rows):
    texts = [(i % 400, f"text é {i % 37}" * (i % 5)) for i in range(1003)] + [(None, None), (5, None)] + [(7, "hot")] * 300
    df = spark.createDataFrame([(*t, 1, "x") for t in texts], "doc_id long, text string, size int, _bucket string")
    got = sharded(df, bucket_rows=bucket_rows).collect()
    check(got, texts)
    assert Counter(got) == Counter(sharded(df, bucket_rows=bucket_rows).collect())
    spread = [r.shard for r in got if r.doc_id is not None and r.doc_id < 100]
    assert min(Counter(spread).values()) > len(spread) / 16


def test_empty_table_and_few_rows(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    check(sharded(df).collect(), [(1, "a")])
    assert sharded(df.limit(0)).count() == 0


def test_shards_are_written_whole(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i % 9}", i % 2) for i in range(100)], "doc_id long, text string, slot int")
    write_shards(df, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.groupBy("_qm_shard").count().toPandas()["count"]) == [33, 33, 34]
    assert sorted(tuple(r) for r in back.select("doc_id", "text", "slot").collect()) == sorted(tuple(r) for r in df.collect())


def test_very_long_texts_and_clashing_names(spark, tmp_path):
    texts = [(i, "long " * 200_000 if i % 10 == 0 else f"t{i}") for i in range(40)]
    df = spark.createDataFrame([(*t, 5, 6) for t in texts], "doc_id long, text string, slot int, record int")
    check(sharded(df, bucket_bytes=1 << 20).collect(), texts)
    write_shards(df, str(tmp_path / "out"), bucket_bytes=1 << 20)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {tuple(r) for r in back.select("slot", "record").collect()} == {(5, 6)} and back.count() == 40


def test_sums_over_groups_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "TOGETHER", 3)
    texts = [(i, f"t{i}") for i in range(500)]
    check(sharded(spark.createDataFrame(texts, "doc_id long, text string"), bucket_rows=16).collect(), texts)
