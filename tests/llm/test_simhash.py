import random
import re

import numpy as np
import pytest
import xxhash

from quillmere.llm import simhash
from quillmere.llm.components import components
from quillmere.llm.simhash import GrayIndex, fingerprint, leaf_links, near_duplicates, one_of_each, spanning_links


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", lowered)


def plain_kept(texts):
    """Ids, of a dict of texts, that stay: leaders of groups linked by two-word prints, all others being like one of them."""
    prints = {i: plain_print(t, 2) for i, t in texts.items()}
    links = [(a, b) for a in texts for b in texts if a < b and (prints[a] ^ prints[b]).bit_count() <= 7]
    root = roots(sorted(texts), links)
    sets = {}
    for i, t in texts.items():
        w = plain_words(t)
        n = min(5, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
    kept = []
    for i in sorted(texts):
        like = lambda j: texts[i] == texts[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])  # noqa: E731, B023
        if not any(root[i] == root[j] and like(j) for j in kept):
            kept.append(i)
    return kept


def plain_print(text, size=3):
    words = plain_words(text)
    if not words:
        return 0
    n = min(size, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), seed=42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_fingerprint():
    for t in (None, "", " \t\n", "One", "one TWO", "Ünë  a\x0bb\x1cc d e f", "x y " * 50):
        assert fingerprint(t) == plain_print(t)


@pytest.mark.parametrize("n", [2, 9, 70, 600])
def test_index_finds_every_pair(n):
    rng = random.Random(n)
    fps = [rng.getrandbits(64) for _ in range(max(1, n // 8))]
    while len(fps) < n:
        fps = list(dict.fromkeys([*fps, rng.choice(fps) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))]))
    fps = np.array(fps, np.uint64)
    index = GrayIndex(fps)
    got = {tuple(sorted((int(index.fps[a]), int(index.fps[b])))) for x in index.near(2) for a, b in zip(*x)}
    want = {tuple(sorted((int(a), int(b)))) for i, a in enumerate(fps) for b in fps[i + 1 :] if (int(a) ^ int(b)).bit_count() <= 2}
    assert got == want
    a, b = spanning_links(fps, 2)
    nodes = [int(x) for x in fps]
    assert len(a) < n
    assert roots(nodes, zip(a.tolist(), b.tolist())) == roots(nodes, want)


def test_many_small_groups_at_once():
    rng = random.Random(3)
    group = sorted(rng.choices(range(40), k=300))
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = [base[g] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for g in group]
    want = {(a, b) for i, a in enumerate(fps) for j, b in enumerate(fps[:i]) if group[i] == group[j] and (a ^ b).bit_count() <= 2}
    u, v = leaf_links(np.array(fps, np.uint64), np.array(group), 2)
    assert roots(fps, zip(u.tolist(), v.tolist())) == roots(fps, want)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40) if i % 9] + [(100, 3), (7, 7), (None, 5), (50, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    links = [x for x in links if None not in x]
    want = roots({n for x in links for n in x}, links)
    assert got == {n: r for n, r in want.items() if n != r}


def test_matches_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 90))) for _ in range(40)]
    for t in texts[:20]:
        parts = t.split()
        parts[rng.randrange(len(parts))] = "zz"
        texts += [t.upper(), " ".join(parts), t + " end"]
    long = rng.choices(words, k=3000)
    for _ in range(30):
        long[rng.randrange(3000)] = "q"
        texts.append(" ".join(long))
    texts += [None, "", " ", texts[0]]
    rows = [(1000 - i, t, 0) for i, t in enumerate(texts)]
    fps = {i: plain_print(t) for i, t, _ in rows}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    want = {i: (f"{fps[i]:016x}", r) for i, r in roots(list(fps), links).items()}
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(df).collect()} == want
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept({i: t or "" for i, t, _ in rows})


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "x y z"), (None, None), (4, "")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in near_duplicates(df).collect())
    assert got == [(0, 0), (0, 4), (1, 1), (1, 1), (4, 4)]
    assert sorted((r.doc_id or 0) for r in one_of_each(df).collect()) == [0, 1, 4]
    assert near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("heads", [64, 7])
def test_near_copies_go_and_others_stay(spark, monkeypatch, heads):
    monkeypatch.setattr(simhash, "HEADS", heads)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    texts = {}
    for i in range(0, 600, 10):
        own = rng.choices(words, k=200)
        texts[i] = " ".join(own)
        for j, edits in enumerate((1, 2, 8, 40), 1):
            for _ in range(edits):
                own[rng.randrange(200)] = rng.choice(words)
            texts[i + j] = " ".join(own)
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, root string")
    got = sorted(r.doc_id for r in one_of_each(df).collect())
    assert got == plain_kept(texts)
    assert {i for i in texts if i % 10 in (0, 4)} <= set(got) and sum(i % 10 in (1, 2) for i in got) < 20
    long = " ".join(rng.choices(words, k=150_000))
    many = spark.createDataFrame([(1, long), (2, long + " end"), (3, "a " * 90_000), (4, None), (5, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in one_of_each(many).collect()) == [1, 3, 4]
    assert one_of_each(many.limit(0)).count() == 0


@pytest.mark.parametrize("heads, held, most", [(None, None, 1), (50, None, 6), (None, 20_000, 6)])
def test_a_large_group_of_unlike_texts_takes_few_rounds(spark, monkeypatch, heads, held, most):
    for name, value in (("HEADS", heads), ("HELD", held)):
        if value:
            monkeypatch.setattr(simhash, name, value)
    labels, written = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, label: labels.append(label) or written(df, label))
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    base, texts = rng.choices(words, k=400), {}
    for i in range(300):
        own = list(base)
        for _ in range(2 if i % 4 == 1 else 12):
            own[rng.randrange(400)] = rng.choice(words)
        texts[i] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = sorted(r.doc_id for r in one_of_each(df).collect())
    assert got == plain_kept(texts) and len(got) > 200
    assert labels.count("leaders") <= most
