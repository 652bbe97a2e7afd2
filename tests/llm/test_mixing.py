import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillmere.llm.mixing import flight, landing, mixed, mixed_sizes, words


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full, target = sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        open_ = sum(weight[s] for s in order if s not in full)
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / open_ for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def corpus(n=700):
    rng = random.Random(2)
    sources = ["a", "b", "ü", "z", "", None, "tiny", "B"]
    rows = []
    for i in range(n):
        s = rng.choice(sources[:6] + ["a"] * 6)
        rows.append((i, "  ".join("w" for _ in range(int(rng.paretovariate(1.1)) * 3)) + " x", s, 1.5))
    return rows + [(n, None, "z", 0.0), (n + 1, "one two", "tiny", 0.0), (None, "\t ", None, 0.0)] + [(5000, "a b c", "B", 0.0)] * 90


@pytest.mark.parametrize("block", [4096, 40])
def test_mix_meets_targets(spark, block):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size double")
    got = mixed_sizes(df, block=block).collect()
    n_words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], n_words(r[1])) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += n_words(r[1])
    target, source = plain_targets(sizes), {r[0]: r[2] for r in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(3, 0.01 * target[s]), (s, taken[s], target[s])
    assert Counter(got) == Counter(mixed_sizes(df, block=block).collect())
    whole = mixed(df, block=block)
    assert whole.columns == df.columns
    back = defaultdict(int)
    for r in whole.collect():
        back[r.source] += n_words(r.text)
    assert {s: n for s, n in back.items() if n} == {s: n for s, n in taken.items() if n}


def test_empty_table(spark):
    df = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [tuple(r) for r in mixed_sizes(df).collect()] == [(1, 0, 0, 0.0, 0)]
    assert mixed_sizes(df.limit(0)).count() == 0
    assert mixed(df.limit(0)).count() == 0


def test_words(spark):
    texts = [None, "", " \n", "a", " a b\x0bc\x1cd e ", "a\n\n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(words()).collect()] == [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for t in texts]


def test_flight_keeps_totals():
    rng = random.Random(1)
    sizes = [rng.choice([0, 3, rng.randint(1, 900)]) for _ in range(500)]
    chances = [0.37] * 500
    out = flight(sizes, chances, rng)
    assert sum(0 < x < 1 for x in out) <= 2
    assert abs(sum(out) - sum(chances)) < 1e-6
    assert abs(sum(a * b for a, b in zip(out, sizes)) - sum(a * b for a, b in zip(chances, sizes))) < 1e-3
    assert landing(np.array([1.0, 2.0, 4.0]), np.array([0.5, 0.5, 0.5])).tolist() in ([1, 1, 0], [0, 0, 1])
