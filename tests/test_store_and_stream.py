"""The store's commits and backups, ports, and the message stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillmere import schemas
from quillmere.sources import ports, store
from quillmere.streaming import ingest

T = dt.datetime(2024, 1, 1)


def entities(spark, *slugs):
    return schemas.conformed(spark.createDataFrame([("g", s, s.title()) for s in slugs], "guild_id string, slug string, name string"), "entities")


def test_commits_are_atomic_and_repeatable(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/db")
    assert s.table("entities").count() == 0
    assert s.commit({"entities": entities(spark, "tea")}, receipt="r1")
    before = s.manifest()
    assert not s.commit({"entities": entities(spark, "golf")}, receipt="r1")
    assert s.merge("entities", entities(spark, "tea", "golf").withColumn("name", F.upper("name")))
    assert {(r.slug, r.name) for r in s.table("entities").collect()} == {("tea", "TEA"), ("golf", "GOLF")}
    assert [r.name for r in s.table("entities", before).collect()] == ["Tea"]
    with pytest.raises(store.Conflict):
        s.commit({"entities": entities(spark, "late")}, base=before)
    with pytest.raises(ValueError):
        schemas.conformed(spark.range(1), "entities")


def test_merges_add_layers(spark, tmp_path, monkeypatch):
    s = store.Store(spark, f"file://{tmp_path}/db")
    monkeypatch.setattr(store, "LAYERS", 2)
    monkeypatch.setattr(store, "SHARE", 100)  # files this small are mostly footers
    many = [f"s{i}" for i in range(3000)]
    want = {m: m.title() for m in many}
    assert s.merge("entities", entities(spark, *many), receipt="first") and not s.merge("entities", entities(spark, "x"), receipt="first")
    sizes = []
    for i in range(6):
        some = [f"s{i}", f"s{i + 1}", f"new{i}"]
        assert s.merge("entities", entities(spark, *some).withColumn("name", F.lit(f"at {i}")), receipt=("stream", i))
        assert not s.merge("entities", entities(spark, "x"), receipt=("stream", i - 1 if i else 0))
        want |= dict.fromkeys(some, f"at {i}")
        sizes.append(len(s.manifest()["tables"]["entities"]))
        assert {r.slug: r.name for r in s.table("entities").collect()} == want
    assert sizes == [2, 3, 2, 3, 2, 3] and s.manifest()["receipts"] == ["first"] and s.manifest()["progress"] == {"stream": 5}
    assert s.merge("entities", entities(spark, *many))
    monkeypatch.setattr(store, "SHARE", 0.1)
    assert s.merge("entities", entities(spark, "tea")) and len(s.manifest()["tables"]["entities"]) == 1
    before = sorted(s.table("entities").collect())
    assert s.vacuum(100) == 0 and s.vacuum(1) == 8 and s.vacuum(1) == 0
    assert sorted(s.table("entities").collect()) == before and s.table("entities").where("slug = 'tea'").count() == 1


def test_backup_and_restore(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/db")
    m = schemas.conformed(spark.createDataFrame([("g", "1", "claimed"), ("g", "2", "dead")], "guild_id string, message_id string, status string"), "messages")
    s.commit({"entities": entities(spark, "tea"), "messages": m})
    s.backup(f"file://{tmp_path}/saved")
    r = store.Store.restore(spark, f"file://{tmp_path}/saved", f"file://{tmp_path}/again")
    assert {(x.message_id, x.status) for x in r.table("messages").collect()} == {("1", "pending"), ("2", "dead")}
    with pytest.raises(FileExistsError):
        store.Store.restore(spark, f"file://{tmp_path}/saved", f"file://{tmp_path}/again")
    entities(spark, "bad").write.mode("overwrite").parquet(f"{tmp_path}/saved/entities")
    with pytest.raises(ValueError):
        store.Store.restore(spark, f"file://{tmp_path}/saved", f"file://{tmp_path}/third")


def test_export_round_trip(spark, tmp_path):
    f = schemas.conformed(spark.createDataFrame([("g", "1", "likes tea", T)], "guild_id string, id string, text string, created_at timestamp"), "facts")
    e = schemas.conformed(spark.createDataFrame([("g", "user", "a", "entity", "tea", "likes", T)], "guild_id string, src_type string, src_id string, dst_type string, dst_id string, verb string, valid_until timestamp"), "relations")
    store.write_export(f"{tmp_path}/x", f, entities(spark, "tea"), e)
    back = store.read_export(spark, f"{tmp_path}/x")
    assert back["facts"].collect() == f.collect() and back["relations"].collect() == e.collect()
    store.write_export(f"{tmp_path}/y", f.unionByName(f), entities(spark, "tea"), e)
    with pytest.raises(ValueError):
        store.read_export(spark, f"{tmp_path}/y")


def test_ports(spark):
    p = spark.createDataFrame([("a",), ("b",), ("a",)], "prompt string")
    got = ports.answered(p, lambda ps: [f'ok {{"q": "{x}"}}' for x in ps], "m")
    assert sorted(r.answer for r in got.collect()) == ['{"q": "a"}', '{"q": "a"}', '{"q": "b"}']
    known = got.where("prompt = 'a'").select("key", "answer").distinct()
    assert {(r.prompt, r.answer) for r in ports.answered(p, lambda ps: ["none"] * len(ps), "m", known).collect()} == {("a", '{"q": "a"}'), ("b", None)}
    v = ports.vectors_of(p.withColumnRenamed("prompt", "text"), lambda ts: [[float(len(t)), 0.0] for t in ts], 2)
    assert v.count() == 2
    pairs = spark.createDataFrame([("g", "q", "1", "x", "y")], "guild_id string, query_id string, id string, query string, text string")
    assert ports.rerank_scores(pairs, lambda q, t: 1 / 0).count() == 0
    assert ports.rerank_scores(pairs, lambda q, t: [0.5]).first().rerank == 0.5


def messages(spark, n=0):
    rows = [("g", str(i), "c", "u1", "u1", f"hello {i}", T + dt.timedelta(seconds=i), False) for i in range(n)]
    return spark.createDataFrame(rows, "guild_id string, message_id string, channel_id string, author_id string, subject_key string, content string, created_at timestamp, author_is_bot boolean")


def test_admission_and_retries(spark):
    m = messages(spark, 3).unionByName(messages(spark, 1)).unionByName(messages(spark, 2).withColumn("content", F.lit(" x ")).withColumn("message_id", F.concat(F.lit("s"), "message_id")))
    c = spark.createDataFrame([("g", "u1", False)], "guild_id string, user_id string, opted_out boolean")
    m = m.withColumn("edited", F.lit(False)).withColumn("edited_at", F.lit(None).cast("timestamp"))
    got = [(r.message_id, r.reason) for r in ingest.observed(m, c).collect()]
    assert sorted(x for x in got if x[1]) == [("0", "duplicate"), ("s0", "empty_content"), ("s1", "empty_content")]
    assert ingest.observed(m, c.withColumn("opted_out", F.lit(True))).where("reason = 'opted_out'").count() == m.count()
    b = spark.createDataFrame([("g", "k", 0), ("g", "k", 2)], "guild_id string, subject_key string, attempts int")
    r = {x.attempts: x for x in ingest.after_failure(b, F.lit(T)).collect()}
    assert r[1].status == "pending" and 2.5 <= r[1]["wait"] <= 5 and r[3].status == "dead" and r[3].next_attempt_at is None
    assert ingest.private(messages(spark, 1)).first().content != "hello 0"
    done = spark.createDataFrame([("ingest:user:" + __import__("hashlib").sha256(b"0").hexdigest(),)], "key string")
    assert sorted(x.message_id for x in ingest.without_receipts(messages(spark, 3), done).collect()) == ["1", "2"]
    over = ingest.within_depth(messages(spark, 5).withColumn("status", F.lit("pending")), most=3)
    assert [x.over for x in over.orderBy("created_at").collect()] == [False, False, False, True, True]


def test_stream_batches_by_count_and_age(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = messages(spark).schema
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    messages(spark, 23).coalesce(1).write.mode("append").json(source)
    stream = lambda: ingest.batched(ingest.admitted(spark.readStream.schema(schema).json(source), "10 seconds"), size=10, age=60)
    db = store.Store(spark, f"file://{tmp_path}/db")
    seen = []

    def run():
        q = stream().writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, i: seen.extend(df.collect())).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    assert [(r.reason, len(r.message_ids)) for r in seen] == [("count", 10), ("count", 10)]
    late = [("g", "x", "c", "u2", "u2", "much later", T + dt.timedelta(hours=1), False), ("g", "3", "c", "u1", "u1", "hello 3", T + dt.timedelta(hours=1), False)]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").json(source)
    run()
    spark.createDataFrame([("g", "y", "c", "u2", "u2", "later still", T + dt.timedelta(hours=2), False)], schema).coalesce(1).write.mode("append").json(source)
    run()
    aged = [r for r in seen if r.reason == "age"]
    assert aged and aged[0].message_ids[:3] == ["20", "21", "22"]
    sink = ingest.committed_by(db, lambda df: {"entities": entities(spark, "tea")})
    sink(messages(spark, 1), 0)
    sink(messages(spark, 1), 0)
    assert db.manifest()["version"] == 1
