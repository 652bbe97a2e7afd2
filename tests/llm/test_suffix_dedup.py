import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quillmere.llm import suffix_dedup
from quillmere.llm.suffix_dedup import merged, repeated_spans, repeated_starts, without_repeats


def brute(texts, window):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + window] for b in bodies for i in range(len(b) - window + 1))
    out = []
    for b in bodies:
        spans = merged([(i, i + window) for i in range(len(b) - window + 1) if seen[b[i : i + window]] > 1])
        kept = b"".join(b[x:y] for x, y in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(b)]))
        out.append((len(b), sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 8)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(5)]
    texts = [None, "", "short", "a" * 700, "ab" * 400, "ab" * 300 + "c", "\0" * 300, "\0" * 250 + "x"]
    texts += [" ".join(word() for _ in range(rng.randint(0, 120))) + rng.choice(["", *passages]) + " ".join(word() for _ in range(40)) for _ in range(60)]
    texts += [texts[-1], texts[-2][:-3], passages[0][:230]] * 3
    return texts


@pytest.mark.parametrize("hot_rows, hot_pieces", [(2000, 512), (1, 512), (1, 1)])
def test_matches_brute_force(spark, hot_rows, hot_pieces):
    texts = corpus()
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = {r.doc_id: tuple(r)[1:5] for r in repeated_spans(spark.createDataFrame(rows, "doc_id long, text string, h string"), hot_rows=hot_rows, hot_pieces=hot_pieces).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 200)


@pytest.mark.parametrize("known", [200_000, 0])
def test_places_of_one_stretch_are_dealt_apart(spark, monkeypatch, known):
    monkeypatch.setattr(suffix_dedup, "PLACES", 7)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_STRETCHES", known)
    texts = corpus() + [corpus()[-1]] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:5] for r in repeated_spans(docs, hot_rows=1).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 200)


def test_repeated_rows_and_empty_table(spark):
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(300))
    df = spark.createDataFrame([(1, text), (1, text), (None, "x")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed, r.n_spans) for r in repeated_spans(df).collect())
    assert got == [(0, 0, 0), (1, 300, 1), (1, 300, 1)]
    assert repeated_spans(df.limit(0)).count() == 0
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh") for _ in range(300))
    other = spark.createDataFrame([(1, text), (1, "y"), (None, text[:250]), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, bytes(r.kept)) for r in without_repeats(other).collect()) == [(0, b""), (0, b""), (1, text[250:].encode()), (1, b"y")]
    assert without_repeats(other.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_two_stage_sort_small_alphabets(seed):
    rng = random.Random(seed)
    pieces = list({bytes(rng.choice(b"ab\0"[: rng.randint(1, 3)]) for _ in range(rng.randint(5, 40))) for _ in range(rng.randint(1, 12))})
    seen = Counter(p[i : i + 5] for p in pieces for i in range(len(p) - 4))
    got = repeated_starts(pieces, [1] * len(pieces), 5)
    assert [m.tolist() for m in got] == [[seen[p[i : i + 5]] > 1 for i in range(len(p) - 4)] for p in pieces]
    assert all(m.dtype == np.bool_ for m in got)


def test_a_passage_in_many_surroundings_makes_no_large_group(spark, monkeypatch):
    rng = random.Random(6)
    say = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = say(500)
    texts = [say(300) + passage + say(300) for _ in range(600)]
    made, cut = [], suffix_dedup._block_ranges

    def counted(pieces, *rest):
        out = cut(pieces, *rest)
        made.append(rest[1])
        return out

    monkeypatch.setattr(suffix_dedup, "_block_ranges", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:5] for r in repeated_spans(docs, hot_pieces=64).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 200)
    assert set(made) == {(32, 8, 1), (8, 1), (1,)}
