import hashlib
import random
import re

import pytest

from quillmere.llm import decontam
from quillmere.llm.decontam import clean, contaminated, contaminated_words


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, t in items:
            own = words(t)
            k = min(13, len(own))
            wins = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if k else set()
            for i in range(len(w) - k + 1) if k else ():
                if tuple(w[i : i + k]) in wins:
                    hit |= set(range(i, i + k))
                    ids.add(str(item_id))
        out.append((doc_id, len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"{a}{b}" for a in ("ab", "Éx", "zz", "q") for b in range(8)] + ["KK", "İs", "ΟΔΟΣ"]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, say(rng.randint(13, 60))) for i in range(12)] + [(20, say(5)), (21, say(1) + "!"), (22, "x " * 30), (23, None), (24, " . "), (25, say(12)), (3, items_extra := say(15)), (None, say(14))]
    texts = [None, "", "...", "x " * 40, "a b", items_extra]
    for _, t in items[:12]:
        w = t.split()
        for n in (11, 12, 13, 14, len(w)):
            at = rng.randint(0, max(0, len(w) - n))
            texts.append(say(rng.randint(0, 300)) + ", " + "-".join(w[at : at + n]).upper() + "\n" + say(rng.randint(0, 40)))
    docs = list(enumerate(texts))
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n int")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, v int")
    known = [x for x in items if x[0] is not None]
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.bad) for r in contaminated_words(d, b).withColumn("bad", contaminated()).collect()), key=str)
    want = brute(docs, known)
    for x, y in zip(got, want):
        assert x[0] == y[0] and x[3] == y[3]
    with_null = [(a, w, h, bad) for a, w, h, _, bad in brute(docs, items)]
    assert [(a, w, h, bad) for a, w, h, _, bad in got] == with_null
    assert sorted(r.doc_id for r in clean(d, b).collect()) == sorted(x[0] for x in with_null if not x[3])


def test_empty_tables_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(20))
    d = spark.createDataFrame([(1, text), (1, text), (None, "a")], "doc_id long, text string")
    b = spark.createDataFrame([(7, text), (7, text)], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.n_hit, r["items"]) for r in contaminated_words(d, b).collect()) == [(0, 0, []), (1, 20, ["7"]), (1, 20, ["7"])]
    assert contaminated_words(d, b.limit(0)).where("n_hit = 0").count() == 3
    assert contaminated_words(d.limit(0), b).count() == 0
    assert clean(d, b).count() == 1


def test_query_matches_sql(spark, tmp_path):
    import duckdb

    from quillmere.llm.decontam import ORACLE, query

    rows = [(i, " ".join(f"w{(i * j) % 31}" for j in range(60))) for i in range(30)] + [(90, None), (91, "A é B")]
    items = [(i, " ".join(f"W{(i * j) % 31}" for j in range(20))) for i in range(5)] + [(8, "é b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.execute(ORACLE).fetchall())
    assert sorted(tuple(r) for r in query(spark, str(tmp_path)).collect()) == want
    assert hashlib.sha256(b"").hexdigest() in {w[4] for w in want}


def test_capital_sigma_is_no_ascii_letter(spark):
    words = [("ΑΣ", "Β")[i % 2] for i in range(13)]
    d = spark.createDataFrame([(1, "'".join(words))], "doc_id long, text string")
    b = spark.createDataFrame([(5, " ".join(words))], "item_id long, text string")
    assert [(r.n_hit, r["items"]) for r in contaminated_words(d, b).collect()] == [(13, ["5"])]


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_very_long_texts_and_ties(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontam, "BROADCAST_HASHES", broadcast)
    rng = random.Random(5)
    item = " ".join(f"w{rng.randrange(900)}" for _ in range(400))
    long = " ".join(f"v{rng.randrange(50)}" for _ in range(60_000)) + " " + " ".join([item] * 20) + " same" * 30
    d = spark.createDataFrame([(1, long), (2, "same " * 13), (3, "same " * 12)], "doc_id long, text string")
    b = spark.createDataFrame([(5, item), (6, "same " * 40)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in contaminated_words(d, b).collect()}
    assert got == {1: (68_030, 8_030, ["5", "6"]), 2: (13, 13, ["6"]), 3: (12, 0, [])}
