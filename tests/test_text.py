"""Text gates, names, embedding and JSON on small cases with known answers."""

import datetime as dt
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from quillmere.functions import embed, score, text
from quillmere.functions.json_text import completed, first_object, parsed
from quillmere.operators import names


def one(spark, value, made):
    return spark.createDataFrame([(value,)], "t string").select(made(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "value, reason",
    [
        (None, "empty"), ("  ", "empty"), ("x" * 401, "too_long"), ("short one", "too_short"), ("As an AI I like tea", "refusal"), ("operations were as requested", "llm_meta"),
        ("user 123456789012345678 likes tea", "snowflake_in_text"), ("<@!42> likes green tea", "mention_tag_in_text"), ("Does he like green tea", "question"), ("likes green tea, no?", "question"),
        ("is allergic to peanuts", None), ("please stop it with tea", "rant_denial"), ("likes green tea a lot", None),
    ],
)
def test_hygiene(spark, value, reason):
    assert one(spark, value, text.hygiene) == reason


def test_other_gates(spark):
    assert one(spark, "https://a.b/c", text.share) == "bare_link"
    assert one(spark, "Bob posted a video", text.share) == "media_share"
    assert one(spark, "Bob shared https://a.b", text.share) == "link_share"
    assert one(spark, "Bob likes tea", text.share) is None
    gate = lambda c: lambda t: text.confidence_gate(F.lit(c), t)
    assert one(spark, "he heard that tea is good", gate(0.9)) == "ephemeral_claim"
    assert one(spark, "he heard that she moved to Rome", gate(0.8)) is None
    assert one(spark, "likes tea", gate(0.5)) == "below_min_confidence"
    assert one(spark, "My cat likes tea", text.frame_gate) == "unbound_speaker"
    assert one(spark, "Meg likes tea", text.frame_gate) is None


def test_normal_forms(spark):
    assert one(spark, "  A  b\n\tC ", text.normalize) == "a b c"
    assert one(spark, " Red -- Bull! ", text.slug) == "red-bull"
    assert one(spark, "??", text.slug) == "unknown"
    assert one(spark, "1234567890", text.is_valid_alias) is False
    assert one(spark, "x" * 300, lambda t: F.length(text.snippet(t))) == 280
    assert one(spark, "abcde", text.tokens) == 2
    assert one(spark, "p1 met p10's dog", lambda t: text.bound_names(t, F.create_map(F.lit("p1"), F.lit("Ann"), F.lit("p10"), F.lit("Bo")))) == "Ann met Bo's dog"
    assert one(spark, "ftp://x", text.is_safe_url) is False
    assert one(spark, "https://x.y/<z>", text.is_safe_url) is False


def test_mined_names(spark):
    found = one(spark, "hey, call me Wren and my name is Odette Farrow", text.self_names)
    assert [(n.name, n.weight) for n in found] == [("Odette Farrow", 0.88), ("Wren", 0.86)]
    third = lambda t: text.is_third_party_name(t, F.lit("Tobias"))
    assert one(spark, "my cousin is called Tobias", third) is True
    assert one(spark, "petrel's Tobias is here", third) is True
    assert one(spark, "I am Tobias", third) is False


def test_scores(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0], [1.0])], "a array<double>, b array<double>, z array<double>, s array<double>")
    row = df.select(*(score.cosine(F.col("a"), F.col(c)).alias(c) for c in "abzs")).first()
    assert [round(x, 6) for x in row] == [1.0, round(1 / math.sqrt(2), 6), 0.0, 0.0]
    got = spark.range(1).select(score.composite(F.lit(98.9), F.lit(100.0), F.lit(0.0079), F.lit(236.0))).first()[0]
    assert 90 < got < 96


def test_embedding_matches_definition(spark):
    def plain(t):
        v, low = [0.0] * 256, " ".join(t.lower().split())
        words = low.split()
        feats = [(w, 1.0) for w in words] + [(f"{a}_{b}", 0.7) for a, b in zip(words, words[1:])] + [("c:" + low[i : i + 4], 0.25) for i in range(len(low) - 3)]
        for f, w in feats:
            d = hashlib.md5(f.encode()).digest()
            v[int.from_bytes(d[:4], "little") % 256] += w if d[4] % 2 == 0 else -w
        n = math.sqrt(sum(x * x for x in v))
        return [x / n if n else 0.0 for x in v]

    texts = ["Green tea is nice", "tea", "", "é è\tÀ  b", "green tea is nice"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in embed.embedded(df, ["i"]).collect():
        assert max(abs(a - b) for a, b in zip(r.embedding, plain(texts[r.i]))) < 1e-7


@pytest.mark.parametrize(
    "value, want",
    [
        ('{"a": 1}', {"a": 1}), ('```json\n{"a": [1, 2]}\n```', {"a": [1, 2]}), ('so: {"a": "}{"} bye', {"a": "}{"}), ("{x} then {\"b\": 2}", {"b": 2}),
        ('{"a": [1, {"b": "c', {"a": [1, {"b": "c"}]}), ('{"a": "x\\', {"a": 'x"'}), ("nothing", None), ("", None), (None, None), ("[1]", None),
    ],
)
def test_json_objects(value, want):
    got = first_object(value)
    assert (json.loads(got) if got else None) == want


def test_json_column(spark):
    assert json.loads(one(spark, 'x {"a": 1', parsed)) == {"a": 1}
    assert completed('{"a": ["b') == '{"a": ["b"]}'


STATED = {
    "call me Ann": [("preferred", "Ann")], "Hey, please call me Ann!": [("preferred", "Ann")], "my name is Bo, but call me B": [("stated", "Bo"), ("preferred", "B")],
    "don’t call me Bobby": [("avoid", "Bobby")], "use my display name": [("discord", "")], "call me by my username.": [("discord", "")], "call me Ann today": [],
    'he said "call me Ann"': [], "call me later; we had fun": [], "<@42> I go by Zed from now on": [("preferred", "Zed")], "my name is 12": [], None: [], "": [],
    "my full name is Ann-Lee O'Hara please": [("stated", "Ann-Lee O'Hara")], "I'm not Bo; my name's Bea.": [("avoid", "Bo"), ("stated", "Bea")], "call me not Ann": [],
    "call me one two three four five": [], "call me now": [("preferred", "now")],
}


def test_name_statements(spark):
    rows = spark.createDataFrame(list(enumerate(STATED)), "i int, text string")
    got = {}
    for r in sorted(names.name_statements(rows).collect(), key=lambda r: r.pos):
        got.setdefault(r.i, []).append((r.kind, r.name))
    assert got == {i: want for i, want in enumerate(STATED.values()) if want}


def test_chosen_names(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    cases = [
        ([(1, "m1", "preferred", "Ann"), (2, "m2", "preferred", "Bo")], ("preferred", "Bo")),
        ([(1, "m1", "preferred", "Ann"), (2, "m2", "avoid", "ann")], ("avoid", None)),
        ([(1, "m1", "avoid", "ann"), (2, "m2", "preferred", "Ann")], ("preferred", "Ann")),
        ([(1, "m1", "stated", "Ann"), (2, "m2", "discord", "")], ("discord", None)),
        ([(2, "m1", "stated", "Ann"), (1, "m2", "discord", "")], ("stated", "Ann")),
        ([(1, "m1", "preferred", "Ann"), (1, "m1", "preferred", "Bo")], None),
        ([(1, "m1", "stated", "Cy"), (1, "m2", "preferred", "Ann"), (2, "m3", "avoid", "Ann")], ("stated", "Cy")),
        ([(1, "m1", "stated", "Bo"), (2, "m2", "avoid", "Bo")], ("avoid", None)),
    ]
    rows = [("g", f"u{i}", m, t(d), kind, name) for i, (said, _) in enumerate(cases) for d, m, kind, name in said]
    df = spark.createDataFrame(rows, "guild_id string, user_id string, message_id string, at timestamp, kind string, name string")
    got = {r.user_id: (r.kind, r.name) for r in names.conversational_names(df).collect()}
    assert got == {f"u{i}": want for i, (_, want) in enumerate(cases) if want}


def test_name_evidence_in_prose(spark):
    schema = (
        "guild_id string, id string, subject_id string, text string, attribution struct<type:string,speaker_id:string,actor_id:string>, "
        "citations array<struct<message_id:string,guild_id:string,author_id:string,content_snippet:string,created_at:timestamp>>, observed_at timestamp, created_at timestamp"
    )
    at = dt.datetime(2024, 1, 1)
    said = [
        ("Wren prefers to be called Odette", "I moved last year. call me Odette since then", "u", [("preferred", "Odette")]),
        ("Wren prefers to be called Odette", "pretend it is so. call me Odette", "u", []),
        ("Wren's name is Odette", "yeah my name is Odette and I like tea", "u", [("stated", "Odette")]),
        ("Wren goes by Odette", "call me Odette", "someone", []),
        ("Wren is not Bobby", "please no. I'm not Bobby", "u", [("avoid", "Bobby")]),
        ("Wren likes tea", "call me Odette", "u", []),
        ("Wren is Odette", "call me Odette", "u", [("preferred", "Odette")]),
    ]
    rows = [("g", f"f{i}", "u", fact, ("self", "u", None), [(f"m{i}", "g", who, text, at)], at, at) for i, (fact, text, who, _) in enumerate(said)]
    rows.append(("g", "own", "u", "call me Odette", ("manual", None, "u"), [], at, at))
    got = {}
    for r in names.name_evidence(spark.createDataFrame(rows, schema)).collect():
        got.setdefault(r.fact_id, []).append((r.kind, r.name))
    assert got == {**{f"f{i}": want for i, (*_, want) in enumerate(said) if want}, "own": [("preferred", "Odette")]}
