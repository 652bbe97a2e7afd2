"""Texts longer than the steps in which the operators work through them."""

import hashlib
import random
from collections import Counter

import numpy as np
from test_simhash import plain_print

from quillmere.llm import langid, simhash, suffix_dedup
from quillmere.llm.line_dedup import without_repeated_chunks
from quillmere.llm.mixing import mixed_sizes


def words(n, seed):
    rng = random.Random(seed)
    return [f"{rng.choice('abcdefg')}{rng.randrange(10**7)}" for _ in range(n)]


def test_repeated_bytes_across_chunks_and_blocks(spark):
    rng = np.random.default_rng(5)
    noise = rng.integers(33, 127, 2_600_000, dtype=np.uint8).tobytes()
    passage = noise[:150_000]
    edge = suffix_dedup.CHUNK - 100
    whole = noise[150_000 : 150_000 + edge] + passage + noise[-900_000:]
    texts = [whole, "é" * 90 + noise[1_300_000:1_300_050].decode(), passage[1000:1400].decode(), noise[-900_000:-899_750].decode() + "z"]
    texts = [t if isinstance(t, str) else t.decode() for t in texts] + [noise[-400:].decode() * 2]
    bodies = [t.encode() for t in texts]
    seen = Counter(hash(b[i : i + 200]) for b in bodies for i in range(len(b) - 199))
    got = {r.doc_id: r for r in suffix_dedup.repeated_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, b in enumerate(bodies):
        gone = bytearray(len(b))
        for at in range(len(b) - 199):
            if seen[hash(b[at : at + 200])] > 1:
                gone[at : at + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len([s for s in bytes(gone).split(b"\0") if s])
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    assert got[0].n_removed == 400 + 250 + 400 and got[2].n_removed == 400


def test_fingerprints_across_steps(spark):
    texts = [" ".join(words(n, n)) for n in (simhash.STEP + 1, simhash.STEP + 2, simhash.STEP + 3, 2 * simhash.STEP + 9)]
    got = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: f"{plain_print(t):016x}" for i, t in enumerate(texts)}


def test_long_near_copies_go(spark):
    own = words(90_000, 1)
    copy = list(own)
    for at in range(0, 90_000, 900):
        copy[at] = "other"
    rows = [(1, " ".join(own)), (2, " ".join(copy)), (3, " ".join(own)), (4, " ".join(words(90_000, 2)))]
    assert sorted(r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 4]


def test_long_passages_of_lines_go(spark):
    lines = [" ".join(words(8, i)) for i in range(30_000)]
    own = [" ".join(words(8, 10**6 + i)) for i in range(300)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(own[:150] + lines[5000:25_000] + own[150:]))]
    found = without_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string"), whole=True, words=50).collect()
    kept = {r.doc_id: bytes(r.kept).decode() for r in found}
    assert kept[1] == "\n".join(lines)
    left = kept[2].split("\n")
    assert set(own) <= set(left) and len(left) < 300 + 20


def test_trigrams_across_steps(monkeypatch):
    text = " ".join(words(150_000, 3)) + " über ÀÉ 中文"
    assert len(text.encode()) > langid.STEP
    whole = langid.trigrams(text)
    monkeypatch.setattr(langid, "STEP", 1 << 30)
    assert np.array_equal(whole, langid.trigrams(text))
    monkeypatch.setattr(langid, "STEP", 1001)
    assert np.array_equal(whole, langid.trigrams(text))


def test_words_of_a_long_text(spark):
    rows = [(1, "\t\n".join(words(300_000, 4)), "a"), (2, "one\x85two \x1c three", "a"), (3, " " * 10**6, "b")]
    got = {r.doc_id: r["size"] for r in mixed_sizes(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {1: 300_000, 2: 3, 3: 0}
