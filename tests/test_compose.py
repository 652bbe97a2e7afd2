"""Reads put together from several operators."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillmere.functions import text
from quillmere.operators import compose, facts

T = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize(
    "value, action, target",
    [("remember I like tea.", "remember", "I like tea"), ("please remember that golf rules", "remember", "that golf rules"), ("forget it all", "forget", ""), ("what do you know", "none", ""), ("hello", "none", "")],
)
def test_commands(spark, value, action, target):
    r = spark.createDataFrame([(value,)], "t string").select(text.command(F.col("t")).alias("c")).first().c
    assert (r.action, r.target) == (action, target)


def test_relations_find_members_first(spark):
    p = spark.createDataFrame(
        [("g", "k", "f1", "Likes", "p0", None, None, "Green Tea", 0.9, T), ("g", "k", "f2", "friends with", "p0", None, None, "Ann", 0.8, T), ("g", "k", "f3", "knows", None, "Ann", "p9", "ann", 0.8, T), ("g", "k", "f4", "x", "p7", None, None, "Tea", 0.1, T)],
        "guild_id string, subject_key string, fact_id string, verb string, from_token string, from_entity string, to_token string, to_entity string, confidence double, seen_at timestamp",
    )
    rosters = spark.createDataFrame([("g", "k", "1", "p0")], "guild_id string, subject_key string, user_id string, token string")
    aliases = spark.createDataFrame([("g", "ann", "2", "real_name", 0.85)], "guild_id string, alias_norm string, user_id string, source string, weight double")
    ea = spark.createDataFrame([("g", "green tea", "matcha")], "guild_id string, alias_norm string, slug string")
    got = {(r.src_id, r.verb, r.dst_type, r.dst_id) for r in compose.written_relations(p, rosters, aliases, ea).collect()}
    assert got == {("1", "likes", "entity", "matcha"), ("1", "friends_with", "user", "2")}


def test_remembering(spark):
    f = spark.createDataFrame([("g", "1", "a", "likes green tea", None, None)], "guild_id string, id string, subject_id string, text_normalized string, valid_until timestamp, superseded_by_id string")
    r = spark.createDataFrame([("g", "a", "Likes  green tea", "k1"), ("g", "a", "likes golf a lot", "k2"), ("g", "a", "likes rugby a lot", "k3"), ("g", "a", "hm", "k4")], "guild_id string, subject_id string, text string, idempotency_key string")
    done = spark.createDataFrame([("g", "k3")], "guild_id string, key string")
    got = {x.idempotency_key: (x.status, x.id) for x in facts.remembered(f, r, done).collect()}
    assert got["k1"] == ("known", "1") and got["k2"][0] == "stored" and got["k2"][1].startswith("fct_") and got["k3"][0] == "repeated" and got["k4"][0] == "too_short"


def test_neighbours_of_proposals(spark):
    f = spark.createDataFrame([("g", "1", "a", "personal", None, None), ("g", "2", "a", "general", None, None), ("g", "3", "b", "personal", None, None)], "guild_id string, id string, subject_id string, category string, valid_until timestamp, superseded_by_id string")
    v = spark.createDataFrame([("g", "1", [1.0, 1.0]), ("g", "2", [1.0, 1.2]), ("g", "3", [1.0, 0.0])], "guild_id string, id string, embedding array<double>")
    p = spark.createDataFrame([("g", "p", "a", "likes tea", "personal", [1.0, 0.0]), ("g", "q", "a", "quit tea", "rules", [1.0, 0.0])], "guild_id string, id string, subject_id string, text string, category string, embedding array<double>")
    assert {(r.proposal_id, r.target_id) for r in facts.semantic_neighbours(p, f, v).collect()} == {("p", "1"), ("q", "1"), ("q", "2")}


def test_small_reads(spark):
    a, b = spark.createDataFrame([("g1",)], "guild_id string"), spark.createDataFrame([("g1",), ("g2",)], "guild_id string")
    assert {r.guild_id for r in compose.guild_ids(a, b).collect()} == {"g1", "g2"}
    c = spark.createDataFrame([("g1", "maintenance", "2024-01-01T00:00:00Z"), ("g2", "maintenance", "2023-12-31T00:00:00Z"), ("g3", "other", "")], "guild_id string, key string, value string")
    assert [r.guild_id for r in compose.maintenance_due(c, F.lit("2024-01-01 00:30:00").cast("timestamp")).collect()] == ["g2"]
    n = spark.createDataFrame([("g", "Tea"), ("g", "the leaf"), ("g", "none")], "guild_id string, name string")
    e = spark.createDataFrame([("g", "tea", "Tea"), ("g", "leaf", "The  Leaf")], "guild_id string, slug string, name string")
    ea = spark.createDataFrame([], "guild_id string, alias_norm string, slug string")
    assert {(r.name, r.slug) for r in compose.matched_entities(n, e, ea).collect()} == {("Tea", "tea"), ("the leaf", "leaf")}
    page = compose.graph_page(n, e)
    assert "</script><script>" in page and json.loads(page.split("application/json>")[1].split("</script>")[0])["nodes"][0]["name"] == "Tea"
    with pytest.raises(ValueError):
        compose.graph_page(n, e, most=1)


def test_prompt_lines(spark):
    source = "struct<message_id:string,guild_id:string>"
    f = spark.createDataFrame(
        [
            ("g", "1", "a", "likes tea", ("self", "a", None), [("m1", "g"), ("m2", "g")], None, None),
            ("g", "2", "b", "plays golf", ("third_party", "c", None), [("m3", "g"), ("m4", "other"), ("", "g")], None, None),
            ("g", "3", "c", "sings", ("third_party", "a", "Al"), [], None, None),
            ("g", "4", "b", "runs", ("self", "b", None), None, None, None),
            ("g", "5", None, "meets on Mondays", ("self", "a", None), [("m5", "g")], None, None),
        ],
        f"guild_id string, id string, subject_id string, text string, attribution struct<type:string,speaker_id:string,speaker_name:string>, citations array<{source}>, valid_until timestamp, superseded_by_id string",
    )
    ranks = "guild_id string, query_id string, id string, rank int"
    recalled = spark.createDataFrame([("g", "q", "3", 1), ("g", "q", "2", 2), ("g", "q", "1", 3), ("g", "q", "4", 4), ("g", "q", "5", 5)], ranks)
    server = spark.createDataFrame([("g", "q", "5", 1), ("g", "q", "4", 2)], ranks)
    askers = spark.createDataFrame([("q", "a")], "query_id string, asker_id string")
    aliases = spark.createDataFrame([("g", "bee", "b", "real_name", 0.9), ("g", "buzz", "b", "mention", 0.9), ("g", "cy", "c", "mention", 0.5)], "guild_id string, alias_norm string, user_id string, source string, weight double")
    chosen = spark.createDataFrame([("g", "c", "stated", "Cyd"), ("g", "a", "discord", None), ("g", "x", "stated", "Ex")], "guild_id string, user_id string, kind string, name string")
    members = spark.createDataFrame([("g", "q", "c", 2), ("g", "q", "a", 1), ("g", "q", "x", 9)], "guild_id string, query_id string, user_id string, place int")
    named = compose.name_lines(members, chosen, f).first()
    assert named.lines == ['{"user_id": "a", "name": null}', '{"user_id": "c", "name": "Cyd"}']
    assert named.tokens == -(-len(compose.NAMED + "".join(x + "\n" for x in named.lines)) // 4)
    assert compose.name_lines(members, chosen, f, 1).count() == 0
    got = compose.prompt_lines(recalled, server, f, askers, aliases, chosen, 300, members).orderBy("at").collect()
    assert [(r.id, r.line, r.ref) for r in got] == [
        ("1", "- likes tea", 1), ("3", "- sings [reported by Al]", 3), ("2", "- plays golf [reported by c]", 3), ("4", "- runs", 4), ("5", "- meets on Mondays", 4),
    ]
    heads = [r.head for r in got]
    assert heads[0] == compose.ASKER and heads[4] == compose.SERVER and heads[1].startswith("REFERENCED USER: Cyd\nFacts about Cyd ONLY.")
    assert heads[2].startswith("REFERENCED USER: bee\nCoreference: these names all refer to ONE person: bee, buzz.\nFacts about bee ONLY.")
    block = compose.BEFORE + "".join(f"{r.head}\n{r.line}\n\n" for r in got[:1]) + compose.AFTER
    least = -(-len(block) // 4)
    for budget, want in ((least, ["1"]), (least - 1, ["3"] if len(heads[1] + got[1].line) < len(heads[0] + got[0].line) else ["5"])):
        lines = compose.prompt_lines(recalled, server, f, askers, aliases, chosen, budget).orderBy("at").collect()
        assert [r.id for r in lines] == want and all(r.trimmed for r in lines)


def test_extraction_context_shows_the_strongest_then_the_like(spark):
    fields = "guild_id string, id string, subject_id string, text string, strength double, confidence double, valid_from timestamp, valid_until timestamp, expires_at timestamp, superseded_by_id string, attribution struct<speaker_id:string,actor_id:string>, related_user_ids array<string>, citations array<struct<author_id:string>>"
    held = [("g", str(i), "a" if i < 8 else "b", f"fact {i}", float(9 - i), 0.5, T, None, None, None, None, None, None) for i in range(10)]
    f = spark.createDataFrame([*held, ("g", "gone", "a", "gone", 99.0, 0.5, T, T, None, None, None, None, None)], fields)
    v = spark.createDataFrame([("g", str(i), "a" if i < 8 else "b", [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(10)], "guild_id string, id string, subject_id string, embedding array<double>")
    q = spark.createDataFrame([("g", "q", ["a"], [1.0, 0.1])], "guild_id string, query_id string, subjects array<string>, embedding array<double>")
    blocked = spark.createDataFrame([], "guild_id string, user_id string")
    got = compose.extraction_context(f, v, q, blocked, F.lit(T + dt.timedelta(days=1))).collect()
    assert [r.line for r in got] == [f"- [{i}] fact {i}" for i in (0, 1, 2, 3, 4, 5, 7)]
