import random
from collections import Counter, defaultdict

import test_decontam
import test_langid
import test_mixing
import test_simhash

import corpus_pipeline


def test_stages_match_brute_force(spark, tmp_path):
    rng = random.Random(12)
    words = [w for ws in test_langid.WORDS.values() for w in ws] + [f"{w}{i}" for i, ws in enumerate(test_langid.WORDS.values()) for w in ws]
    items = [(i, " ".join(rng.choices(words, k=20))) for i in range(5)]
    rows = []
    for i in range(160):
        lang = rng.choice(list(test_langid.WORDS))
        text = " ".join(rng.choices(test_langid.WORDS[lang], k=rng.randint(4, 120)))
        if i % 11 == 0:
            text += " " + " ".join(items[i % 5][1].split()[2:17]).upper()
        rows.append((i, text, lang, f"s{rng.randrange(4)}", len(text)))
    rows += [(200 + i, rows[i][1], "en", "s0", 0) for i in range(25)] + [(300, None, "en", "s1", 0), (301, "?! 12", None, None, 5), (302, "", "de", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    seen, docs = [], spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen.append(docs.collect())
    text = {r[0]: r[1] for r in rows}

    kept = sorted(i for i, t in text.items() if any(c.isalpha() for c in t or ""))
    assert sorted(r.doc_id for r in seen[0]) == kept

    kept = test_simhash.plain_kept({i: text[i] for i in kept})
    assert sorted(r.doc_id for r in seen[1]) == kept and len(kept) <= 160

    bad = {r[0] for r in test_decontam.brute([(i, text[i]) for i in kept], items) if r[-1]}
    kept = [i for i in kept if i not in bad]
    assert bad and sorted(r.doc_id for r in seen[2]) == kept

    sizes, taken, source = defaultdict(int), defaultdict(int), {r[0]: r[3] for r in rows}
    for i in kept:
        sizes[source[i]] += len(text[i].split())
    for r in seen[3]:
        taken[r.source] += len(r.text.split())
    assert set(r.doc_id for r in seen[3]) <= set(kept) and max(Counter(r.doc_id for r in seen[3]).values()) <= 3
    for s, t in test_mixing.plain_targets(sizes).items():
        assert abs(taken[s] - t) <= max(3, 0.02 * t)

    assert Counter(tuple(r)[:5] for r in seen[4]) == Counter(tuple(r) for r in seen[3])
    slots = defaultdict(list)
    for r in seen[4]:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    counts = [len(slots[i]) for i in range(8)]
    assert max(counts) - min(counts) <= 1
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])


def test_stages_on_empty_tables_and_odd_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard int, _bucket string, _key int, record int, fp long, part int, h int, rows int"
    rows = [(i, "the of and with that this" * (i % 3 + 1), "en", "a", 1, 9, "b", 3, 4, 5, 6, 7, 8) for i in range(40)] + [(None,) * 13]
    items = spark.createDataFrame([(1, "nothing of the kind here")], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    for n, docs in enumerate((spark.createDataFrame(rows, schema), spark.createDataFrame([], schema))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert k == 4 or out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"odd{n}-{k}"))
            docs = spark.read.parquet(str(tmp_path / f"odd{n}-{k}"))
        got = docs.collect()
        assert (n == 1) == (not got)
        assert all(r._bucket == "b" and r._key == 3 and r.record == 4 and r.shard == 9 and r.shard_ < 8 and r.slot >= 0 for r in got)
