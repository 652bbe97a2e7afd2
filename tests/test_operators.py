"""Operators on small cases with answers worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillmere.operators import attribution, facts, governance, graph, identity, lifecycle, metering, retrieval

T = lambda d: dt.datetime(2024, 1, d)
EDGE = "guild_id string, src_type string, src_id string, dst_type string, dst_id string, verb string, polarity string, weight double, occurrences long, confidence double, evidence array<string>"


def edges(spark, rows):
    return spark.createDataFrame([("g", st, s, dtp, d, v, p, float(w), 1, 0.5, list(e)) for st, s, dtp, d, v, p, w, e in rows], EDGE)


def some_edges(spark):
    return edges(
        spark,
        [
            ("user", "a", "entity", "tea", "likes", "positive", 3, "12"), ("user", "b", "entity", "tea", "dislikes", "negative", 2, "3"), ("user", "a", "entity", "golf", "plays", "neutral", 1, ""),
            ("user", "b", "entity", "golf", "likes", "positive", 5, "4"), ("user", "a", "entity", "ann", "knows", "neutral", 1, "5"), ("user", "c", "entity", "ann", "knows", "neutral", 4, "6"),
            ("user", "c", "user", "z", "knows", "neutral", 2, "7"), ("entity", "tea", "user", "c", "is", "neutral", 1, "8"),
        ],
    )


def test_merging_counts_and_keeps_last_evidence(spark):
    rows = [("g", "user", "a", "entity", "tea", "likes", 0.5 + i / 100, f"f{i}", T(i + 1)) for i in range(10)]
    o = spark.createDataFrame(rows, "guild_id string, src_type string, src_id string, dst_type string, dst_id string, verb string, confidence double, evidence_id string, seen_at timestamp")
    e = graph.merged_relations(o).first()
    assert (e.occurrences, e.confidence, e.polarity, e.evidence) == (10, 0.59, "positive", [f"f{i}" for i in range(2, 10)])
    again = graph.upserted_relations(graph.merged_relations(o), o.limit(1)).first()
    assert again.occurrences == 11 and again.weight >= e.weight and len(again.evidence) == 8


def test_collapse_and_twins(spark):
    ents = spark.createDataFrame([("g", "ann", "z"), ("g", "tea", None)], "guild_id string, slug string, linked_user_id string")
    got = {(e.src_id, e.dst_type, e.dst_id, e.verb, e.weight) for e in graph.collapsed(some_edges(spark), ents).collect()}
    assert ("a", "user", "z", "knows", 1.0) in got and ("c", "user", "z", "knows", 4.0) in got and not any(x[2] == "ann" for x in got)
    nodes = graph.twins_of(spark.createDataFrame([("g", "z")], "guild_id string, user_id string"), ents)
    assert {(n.node_type, n.node_id) for n in nodes.collect()} == {("user", "z"), ("entity", "ann")}


def test_hops_go_where_edges_point(spark):
    seeds = spark.createDataFrame([("g", "user", "a")], "guild_id string, node_type string, node_id string")
    got = {(n.node_id, n.level, n.strength, tuple(n.path)) for n in graph.hops(some_edges(spark), seeds).collect()}
    assert got == {("tea", 1, 3.0, ("likes",)), ("golf", 1, 1.0, ("plays",)), ("ann", 1, 1.0, ("knows",)), ("c", 2, 4.0, ("likes", "is"))}
    near = {(n.node_id, n.level) for n in graph.ego(some_edges(spark), "user", "a").collect()}
    assert ("b", 2) in near and ("c", 2) in near and ("a", 0) not in near


def test_sets_of_entities(spark):
    e = some_edges(spark)
    assert {(r.src_id, r.dst_id) for r in graph.shared_n(e, ["a", "b"]).collect()} == {("a", "tea"), ("b", "tea"), ("a", "golf"), ("b", "golf")}
    assert [(r.user_id, r.score) for r in graph.similar_users(e, "a").collect()] == [("b", 0.6667), ("c", 0.3333)]
    s = {r.slug: (r.positive, r.negative, r.other, r.total_evidence) for r in graph.stances(e).collect()}
    assert s["tea"] == (["a"], ["b"], [], 2) and s["golf"] == (["b"], [], ["a"], 2)


def test_withdrawn_evidence(spark):
    gone = spark.createDataFrame([("g", "1"), ("g", "3")], "guild_id string, id string")
    got = {(r.src_id, r.dst_id): (r.evidence, r.weight, r.valid_until) for r in graph.withdrawn(some_edges(spark), gone, F.lit(T(9))).collect()}
    assert got["a", "tea"] == (["2"], 2.4, None) and got["b", "tea"][:2] == ([], 1.6) and got["b", "tea"][2] is not None and got["c", "ann"] == (["6"], 4.0, None)
    seen = spark.createDataFrame([("g", "1"), ("g", "4")], "guild_id string, id string")
    assert {(r.src_id, r.dst_id) for r in graph.eligible_edges(some_edges(spark), seen).collect()} == {("a", "tea"), ("b", "golf"), ("a", "golf")}
    assert {(r.src_id, r.dst_id) for r in graph.eligible_edges(some_edges(spark), seen, every=True).collect()} == {("b", "golf")}


def test_aliases(spark):
    sch = "guild_id string, alias_norm string, user_id string, source string, weight double"
    a = spark.createDataFrame([("g", "petr", "1", "discord_username", 1.0), ("g", "petr", "2", "mention", 0.6), ("g", "sam", "3", "display_name", 0.7), ("g", "sam", "4", "display_name", 0.65), ("g", "petrber", "5", "mention", 0.6)], sch)
    names = ["Petr", "sam", "petrb", "x", "123456789012345678", "nobody", ""]
    got = {r.identifier: (r.user_id, r.confidence, r.ambiguous) for r in identity.resolved(a, spark.createDataFrame([("g", n) for n in names], "guild_id string, identifier string")).collect()}
    assert got["Petr"] == ("1", 1.0, False) and got["sam"] == (None, None, True) and got["petrb"] == ("5", 0.76, False)
    assert got["x"] == (None, None, False) and got["123456789012345678"] == ("123456789012345678", 1.0, False) and got["nobody"][0] is None and got[""][0] is None
    up = identity.upserted(a, spark.createDataFrame([("g", "petr", "1", "mention", 0.9), ("g", "sam", "3", "real_name", 0.1)], sch))
    assert {(r.alias_norm, r.user_id): (r.source, r.weight) for r in up.collect()}["petr", "1"] == ("discord_username", 1.0)
    assert {(r.alias_norm, r.user_id): r.source for r in up.collect()}["sam", "3"] == "real_name"
    ents = spark.createDataFrame([("g", "sam", "person"), ("g", "petrber", "person"), ("g", "tea", "concept")], "guild_id string, slug string, kind string")
    assert {r.slug: r.linked_user_id for r in identity.bridged(ents, a).collect()} == {"sam": None, "petrber": "5", "tea": None}
    m = spark.createDataFrame([("g", "1", "Anna_K", "Anna"), ("g", "2", "123456", None)], "guild_id string, user_id string, username string, display_name string")
    assert {(r.alias_norm, r.source) for r in identity.from_members(m).collect()} == {("anna_k", "discord_username"), ("anna", "display_name")}
    said = spark.createDataFrame([("g", "9", "call me Ivan"), ("g", "8", "my brother said call me Ivan")], "guild_id string, author_id string, content string")
    assert [(r.user_id, r.alias_norm) for r in identity.mined(said).collect()] == [("9", "ivan")]


FACT = "guild_id string, id string, subject_id string, text string, text_normalized string, confidence double, strength double, tier string, manual boolean, version long, occurrences long, valid_from timestamp, valid_until timestamp, superseded_by_id string, expires_at timestamp, last_reinforced_at timestamp, created_at timestamp, citations array<string>"


def some_facts(spark):
    row = lambda i, s, t, **k: {"guild_id": "g", "id": i, "subject_id": s, "text": t, "text_normalized": t.lower(), "confidence": 0.5, "strength": 1.0, "tier": "mid_term", "manual": False, "version": 1, "occurrences": 1, "valid_from": T(1), "created_at": T(1), "last_reinforced_at": T(1), "valid_until": None, "superseded_by_id": None, "expires_at": None, "citations": ["c1"]} | k
    return spark.createDataFrame([row("1", "a", "likes tea"), row("2", "a", "likes golf", strength=4.0), row("3", None, "server fact", tier="short_term"), row("4", "a", "old", valid_until=T(5)), row("5", "a", "ends", expires_at=T(3))], FACT)


def test_fact_merges(spark):
    f = some_facts(spark)
    new = spark.createDataFrame([("g", "n1", "a", "likes tea"), ("g", "n2", None, "server fact"), ("g", "n3", "b", "likes tea"), ("g", "n4", "a", "old")], "guild_id string, id string, subject_id string, text_normalized string")
    assert {r.id: r.existing_id for r in facts.duplicates(f, new).collect()} == {"n1": "1", "n2": "3", "n3": None, "n4": None}
    hits = spark.createDataFrame([("g", "1", 0.9, ["c1", "c2"]), ("g", "1", 0.7, ["c3"])], "guild_id string, id string, confidence double, citations array<string>")
    r = facts.reinforce(f, hits, F.lit(T(7))).first()
    assert (r.occurrences, r.strength, r.confidence, r.version) == (3, 3.0, 0.9, 2) and set(r.citations) == {"c1", "c2", "c3"}
    pairs = spark.createDataFrame([("g", "1", "2", 1), ("g", "2", "9", 7)], "guild_id string, old_id string, new_id string, expected_version long")
    got = {x.id: (x.superseded_by_id, x.supersedes_id, x.version) for x in facts.superseded(f.withColumn("supersedes_id", F.lit(None).cast("string")), pairs, F.lit(T(9))).collect()}
    assert got["1"] == ("2", None, 2) and got["2"] == (None, "1", 1)
    after = facts.invalidated(f, f.where("id in ('1', '4')"), F.lit(T(9)))
    assert {(x.id, x.kind) for x in facts.history(f, after).collect()} == {("1", "invalidated")}
    log = f.unionByName(after)
    assert {x.id: x.version for x in facts.current(log).collect()}["1"] == 2


def test_reconciling(spark):
    f = some_facts(spark)
    p = spark.createDataFrame([("g", "p1", "a", "likes tea", "likes tea"), ("g", "p2", "a", "quit golf", "quit golf"), ("g", "p3", "a", "likes green tea", "likes green tea"), ("g", "p4", "a", "new", "new")], "guild_id string, id string, subject_id string, text string, text_normalized string")
    n = spark.createDataFrame([("g", "p2", "2", 0.5), ("g", "p3", "1", 0.9), ("g", "p4", "1", 0.4)], "guild_id string, proposal_id string, target_id string, similarity double")
    assert {r.id: (r.kind, r.target_id) for r in facts.reconciled(p, f, n).collect()} == {"p1": ("reinforce", "1"), "p2": ("invalidate", "2"), "p3": ("update", "1"), "p4": ("add", None)}


def test_lifecycle(spark):
    f = some_facts(spark)
    assert [r.id for r in lifecycle.expired(f, F.lit(T(4))).collect()] == ["5"]
    life = lifecycle.Lifecycle(per_user=1, per_server=5, floor=0.3)
    assert {r.id for r in lifecycle.forgotten(f, F.lit(T(4)), life).collect()} == {"1", "3", "5"}
    assert {r.id for r in lifecycle.prune_victims(f, life).collect()} == {"1", "5"}
    assert {r.id: r.swept for r in lifecycle.swept(f, F.lit(T(4)), life).collect()} == {"1": "forgotten", "2": None, "3": "forgotten", "4": None, "5": "expired"}
    assert lifecycle.forgotten(f, F.lit(T(4)), lifecycle.Lifecycle()).count() == 0


def test_fusion_and_caps(spark):
    ch = lambda name, ids: spark.createDataFrame([("g", "q", i, name, 1.0, n) for n, i in enumerate(ids, 1)], "guild_id string, query_id string, id string, channel string, score double, rank int")
    got = [(r.id, round(r.score, 6), r.channels) for r in retrieval.fused([ch("vector", "abc"), ch("keyword", "cb")]).orderBy("rank").collect()]
    assert [g[0] for g in got] == ["c", "b", "a"] and got[0][2] == ["vector", "keyword"] and got[0][1] == round(1 / 63 + 1 / 61, 6)
    rows = spark.createDataFrame([("g", "q", f"f{i}", "s" if i < 6 else f"o{i}", 1.0 - i / 100) for i in range(12)], "guild_id string, query_id string, id string, subject_id string, score double")
    kept = retrieval.capped(rows, top_k=6).orderBy("rank").collect()
    assert [r.id for r in kept] == ["f0", "f1", "f2", "f3", "f6", "f7"] and all(r.trimmed for r in kept)
    scores = spark.createDataFrame([("g", "q", f"f{i}", float(i)) for i in range(12)], "guild_id string, query_id string, id string, rerank double")
    assert [r.id for r in retrieval.reranked(rows, scores).orderBy("place").limit(2).collect()] == ["f11", "f10"]
    assert [r.id for r in retrieval.reranked(rows, scores.limit(3)).orderBy("place").limit(2).collect()] == ["f0", "f1"]


def test_entity_mentions_take_longest_first(spark):
    al = spark.createDataFrame([("g", "red bull", "red-bull"), ("g", "bull", "bull"), ("g", "red bull racing", "rbr"), ("g", "tea", "tea")], "guild_id string, alias_norm string, slug string")
    q = spark.createDataFrame([("g", "1", "who likes Red Bull racing and tea"), ("g", "2", "a bull"), ("g", "3", "")], "guild_id string, query_id string, text string")
    assert {(r.query_id, r.slug) for r in retrieval.entity_mentions(q, al).collect()} == {("1", "rbr"), ("1", "tea"), ("2", "bull")}


def test_turn_pairs_and_injection(spark):
    t = spark.createDataFrame([("g", "q", ["a", "b", "a", "c"])], "guild_id string, query_id string, members array<string>")
    assert [(r.a, r.b) for r in retrieval.turn_pairs(t).orderBy("pos").collect()] == [("a", "b"), ("a", "c"), ("b", "c")]
    schema = "query_id string, section int, rank int, id string, text string, attribution_type string, speaker string, head string, cited int"
    said = [(0, 1, "x" * 30, "self", None), (0, 2, "y" * 30, "third_party", "Bo"), (1, 1, "z" * 400, "self", None), (1, 2, "w", "self", None), (2, 1, "v", "self", None)]
    rows = spark.createDataFrame([("q", s, r, f"{s}{r}", t, kind, who, None, 2) for s, r, t, kind, who in said], schema)
    got = retrieval.injected(rows, 30).orderBy("at").collect()
    assert [(r.id, r.ref) for r in got] == [("01", 1), ("02", 3), ("21", 5)] and all(r.trimmed for r in got)
    assert got[1].line == "- " + "y" * 30 + " [reported by Bo]"


def fitting(sections, budget, before, after):
    """The lines that a prompt can hold, by writing it out anew for each."""
    kept, block = [], []
    for head, lines in sections:
        own = []
        for name, line in lines:
            tried = [*block, head, *(x for _, x in own), line, ""]
            if -(-len(before + "".join(f"{x}\n" for x in tried) + after) // 4) > budget:
                break
            own.append((name, line))
        if own:
            block += [head, *(x for _, x in own), ""]
            kept += [n for n, _ in own]
    return kept


@pytest.mark.parametrize("budget", [0, 10, 23, 24, 31, 40, 55, 70, 200])
def test_injection_is_what_can_be_written(spark, budget):
    schema = "query_id string, section int, rank int, id string, text string, attribution_type string, speaker string, head string, cited int"
    sections = [(f"HEAD {s}\nof two lines", [(f"{s}-{r}", "- " + "t" * ((s * 37 + r * 23) % 61 + 1)) for r in range(4)]) for s in range(4)]
    rows = [("q", s, r, name, line[2:], "self", None, head, 1) for s, (head, lines) in enumerate(sections) for r, (name, line) in enumerate(lines)]
    got = retrieval.injected(spark.createDataFrame(rows, schema), budget, 20).orderBy("at").collect()
    assert [r.id for r in got] == fitting(sections, budget, "b" * 12, "a" * 8)
    assert all(r.trimmed == (len(got) < 16) for r in got)


def test_many_queries_meet_a_cut_guild(spark, monkeypatch):
    v = spark.createDataFrame([("g", str(i), None, [1.0, i / 7]) for i in range(50)], "guild_id string, id string, subject_id string, embedding array<double>")
    q = spark.createDataFrame([("g", f"q{i}", None, [i / 3, 1.0]) for i in range(5)], "guild_id string, query_id string, subjects array<string>, embedding array<double>")
    few = sorted(map(tuple, retrieval.vector_search(v, q, 7).collect()))
    monkeypatch.setattr(retrieval, "QUERIES", 4)
    assert sorted(map(tuple, retrieval.vector_search(v, q, 7).collect())) == few and len(few) == 35


def test_governance(spark):
    c = spark.createDataFrame([("g", "a", False, 2), ("g", "b", True, 0)], "guild_id string, user_id string, opted_out boolean, generation long")
    sch = "guild_id string, id string, subject_id string, attribution struct<speaker_id:string,actor_id:string>, related_user_ids array<string>, citations array<struct<author_id:string,channel_id:string,guild_id:string>>, governance map<string,bigint>"
    f = spark.createDataFrame([("g", "1", "a", None, None, [("a", "c1", "g")], {"a": 2}), ("g", "2", "a", None, None, [("a", "c2", "g")], {}), ("g", "3", None, None, ["b"], [], {}), ("g", "4", "x", None, None, [("x", None, "g")], {})], sch)
    assert {r.id for r in governance.fenced(f, c).collect()} == {"1", "3", "4"}
    assert {r.id for r in governance.consented(f, c.where("opted_out")).collect()} == {"1", "2", "4"}
    assert {r.id for r in governance.visible(f, F.array(F.lit("c1"))).collect()} == {"1"}
    assert governance.audience_status(f, F.array(F.lit("c1"))).first().status == "restricted"
    users = spark.createDataFrame([("g", "a"), ("g", "new")], "guild_id string, user_id string")
    assert {(r.user_id, r.generation) for r in governance.bumped(c, users).collect()} == {("a", 3), ("b", 0), ("new", 1)}
    links = spark.createDataFrame([("g", "1", "user", "a", "subject_of"), ("g", "4", "entity", "tea", "about_entity")], "guild_id string, memory_id string, node_type string, node_id string, kind string")
    left = governance.purged(f, links, some_edges(spark), users)
    assert {r.id for r in left[0].collect()} == {"3", "4"} and left[1].count() == 1 and all("a" not in (r.src_id, r.dst_id) for r in left[2].collect())


def test_queue_and_meter(spark):
    rows = [("g", "k", f"m{i:02d}", T(1) + dt.timedelta(seconds=i), "pending" if i else "dead", 10) for i in range(12)] + [("g", "late", "z", T(1), "pending", 5)]
    m = spark.createDataFrame(rows, "guild_id string, subject_key string, message_id string, created_at timestamp, status string, prompt_tokens long")
    assert [r.subject_key for r in metering.due_batches(m, F.lit(T(1) + dt.timedelta(seconds=100))).collect()] == ["k"]
    assert [r.subject_key for r in metering.due_batches(m, F.lit(T(2))).collect()] == ["late", "k"]
    assert metering.claimed(m, 3).where("subject_key = 'k'").count() == 3
    u = metering.budget_steps(metering.token_usage(m.withColumnRenamed("created_at", "at")), 125, 1000)
    assert {(r.period_key, r.prompt_tokens, r.step) for r in u.collect()} == {("2024-01-01", 125, "skip_extraction"), ("2024-01", 125, "none")}
    cur = spark.createDataFrame([("g", T(1) + dt.timedelta(seconds=5), "m05")], "guild_id string, at timestamp, message_id string")
    w = metering.window_after(m, cur, batch=3).first()
    assert (w.n, w.message_id) == (6, "m11")


def test_attribution(spark):
    r = spark.createDataFrame([("r", "Tea is nice. Golf is fun!\nOk. Bye…")], "reply_id string, text string")
    claims = attribution.segments(r)
    assert [(c.start, c.end, c.claim) for c in claims.orderBy("claim_at").collect()] == [(0, 12, "Tea is nice."), (13, 25, "Golf is fun!"), (30, 34, "Bye…")]
    s = attribution.registry(spark.createDataFrame([("r", 0, "https://x/1", "tea is nice"), ("r", 1, "bad url", "golf is fun"), ("r", 2, "https://x/1", "again"), ("r", 3, "https://x/2", "GOLF  is fun")], "reply_id string, pos int, url string, excerpt string"))
    cited = attribution.exact(claims, s)
    assert {(c.claim_at, c.number) for c in cited.collect()} == {(1, 1), (2, 2)}
    assert attribution.woven(r, claims, cited, s).first().text == "Tea is nice. [[1]](<https://x/1>) Golf is fun! [[2]](<https://x/2>)\nOk. Bye…"
    f = spark.createDataFrame([("l", 0, "one", ["u1", "u2"]), ("l", 1, "two", ["u2"]), ("l", 2, "three", [])], "list_id string, pos int, text string, urls array<string>")
    assert [x.line for x in attribution.fact_list(f).orderBy("pos").collect()] == ["- one [[1]](<u1>) [[2]](<u2>)", "- two [[2]](<u2>)", "- three"]


@pytest.mark.parametrize("undirected, want", [(False, 0), (True, 2)])
def test_hops_from_an_entity(spark, undirected, want):
    seeds = spark.createDataFrame([("g", "entity", "golf")], "guild_id string, node_type string, node_id string")
    assert graph.hops(some_edges(spark), seeds, depth=1, undirected=undirected).count() == want


def test_price_lists_of_any_length(spark):
    from quillmere.operators import metering

    calls = spark.createDataFrame([("chat", "Vendor/Model-1401x", 1_000_000, 0, None)], "purpose string, model string, prompt_tokens long, completion_tokens long, cost_usd double")
    prices = spark.createDataFrame([(f"model-{i}x", 2.0 if i == 1401 else 1.0, 1.0, i) for i in range(1500)], "pattern string, prompt_usd double, completion_usd double, place int")
    assert metering.meter(calls, prices).first().cost_usd == 2.0
    assert metering.meter(calls, prices.limit(0)).first().cost_usd == 0.0


def test_leases_run_out_and_belong_to_their_owner(spark):
    import datetime as dt

    from quillmere.streaming import ingest

    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    schema = "guild_id string, subject_key string, message_id string, created_at timestamp, status string, lease_owner string, lease_until timestamp"
    queue = spark.createDataFrame([("g", "k", f"m{i}", at(i), "pending", None, None) for i in range(3)], schema)
    now = lambda s: F.lit(at(s))
    held = ingest.leased(queue, "a", now(5), seconds=10, limit=2)
    state = lambda df: {r.message_id: (r.status, r.lease_owner) for r in df.collect()}
    assert state(held) == {"m0": ("claimed", "a"), "m1": ("claimed", "a"), "m2": ("pending", None)}
    assert state(ingest.leased(held, "b", now(6))) == state(held)
    assert state(ingest.reclaimed(ingest.extended(held, "a", now(10), seconds=10), now(16))) == state(held)
    assert {s for s, _ in state(ingest.reclaimed(held, now(16))).values()} == {"pending"}
    done = spark.createDataFrame([("g", "m0", "processed"), ("g", "m2", "dead")], "guild_id string, message_id string, status string")
    assert state(ingest.finished(held, "b", done)) == state(held)
    assert state(ingest.finished(held, "a", done)) == {**state(held), "m0": ("processed", "a")}
