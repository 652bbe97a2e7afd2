import hashlib
import math
import random
import re
from collections import defaultdict

from quillmere.llm.pii import protected_spans, query, sanitised

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        odd = digits[::-1][1::2]
        return 14 <= len(digits) <= 19 and (sum(digits[::-1][::2]) + sum(d * 2 - 9 * (d > 4) for d in odd)) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    found = [(m.start(), i, m.end(), k, m[0]) for i, (k, p) in enumerate(KINDS.items()) for m in re.finditer(p, text or "") if valid(k, m[0])]
    return sorted(found)


def gaps(text, kind):
    at, out = 0, []
    for m in re.finditer(KINDS[kind], text):
        out.append((at, m.start(), m))
        at = m.end()
    return [(m, b, a, (out[i + 1][1] if i + 1 < len(out) else len(text))) for i, (a, b, m) in enumerate(out)]


def terms(rows):
    """Words by the module's definition, for texts whose words are ASCII and gaps are short."""
    word = re.compile(r"[A-Za-z]{4,}")
    near = defaultdict(list)
    for i, text in rows:
        for k in KINDS:
            for m, start, left, right in gaps(text, k):
                if valid(k, m[0]):
                    for a, b in ((left, start), (m.end(), right)):
                        near[i] += [(f"{k}:{m[0].lower()}", w[0].lower(), a + w.start(), a + w.end()) for w in word.finditer(text[a:b])]
    both, with_entity, with_word = defaultdict(set), defaultdict(set), defaultdict(set)
    for i, text in rows:
        for w in word.findall(text.lower()):
            with_word[w].add(i)
        for e, w, *_ in near[i]:
            both[e, w].add(i)
            with_entity[e].add(i)
    n, out = len(rows), {}
    for i, text in rows:
        hits = set()
        for e, w, a, b in near[i]:
            c = len(both[e, w])
            if c >= 3 and math.log(c * n / len(with_word[w]) / len(with_entity[e])) / math.log(n / len(with_entity[e])) >= 0.8:
                if not any(s < b and a < t for s, _, t, *_ in base(text)):
                    hits.add((a, b))
        out[i] = sorted(hits)
    return out


def test_base_spans_match_brute_force(spark):
    rng = random.Random(6)
    bits = ["a@b.c", "x.y_z@d-e.fr.", "@", "_q@r.s", "1.2.3.4", "256.1.1.1", "00001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+44", "é", "\U0001f600", " ", "\n", "12", ".", "-", "%", "abc", "+", "0" * 15]
    texts = [None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "\U0001f600a@b.c", "5 5  5", "+1----------2", "x" * 30000 + "@", "1" * 30000, "1 " * 9000, "+(" * 9000, "4111 1111 1111 1111" * 3]
    texts += ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, base int")
    for r in protected_spans(df, support=10**6).collect():
        assert [(b["start"], b["rank"], b["end"], b["kind"]) for b in r.base] == [x[:4] for x in base(texts[r.doc_id])], texts[r.doc_id]
        assert r.terms == []


def corpus():
    rng = random.Random(9)
    common = ["about", "there", "would", "which", "their"]
    rows = []
    for i in range(120):
        text = " ".join(rng.choices(common, k=8))
        if i % 10 == 0:
            text += " Zorblax of kappa mail zed@corp.org soon "
        if i % 15 == 0:
            text += " call +1 555 010 9999 please kappa"
        rows.append((i, text))
    return rows


def test_terms_match_brute_force(spark, tmp_path):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = terms(rows)
    got = {r.doc_id: [(t.start, t.end) for t in r.terms] for r in protected_spans(df).collect()}
    assert got == want
    assert sum(map(len, want.values())) >= 12
    df.write.parquet(str(tmp_path / "documents.parquet"))
    for r in query(spark, str(tmp_path)).collect():
        own = base(dict(rows)[r.doc_id])
        line = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, b, k, *_ in spans)
        assert r.base_sha256 == hashlib.sha256(line(own).encode()).hexdigest()
        assert r.spans == line(sorted([*(x[:4] for x in own), *((a, 4, b, "term") for a, b in want[r.doc_id])]))
        assert (r.n_email, r.n_phone, r.n_ip, r.n_card) == tuple(sum(x[3] == k for x in own) for k in ("email", "phone", "ip", "card"))
    clean = {r.doc_id: r.sanitised for r in sanitised(df).collect()}
    assert "[EMAIL]" in clean[0] and "Zorblax" not in clean[0] and "zed@" not in clean[0] and clean[1] == rows[1][1]


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a@b.c"), (1, "a@b.c"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, len(r.base)) for r in protected_spans(df).collect()) == [(0, 0), (1, 1), (1, 1)]
    assert protected_spans(df.limit(0)).count() == 0


def test_words_disclose_at_any_distance_and_with_rare_entities(spark):
    rng = random.Random(10)
    filler = lambda n: " ".join(rng.choices(["about", "there", "would", "which", "their"], k=n))
    rows = [(i, filler(30)) for i in range(400)]
    rows[7] = (7, f"Quorvex {filler(90)} mail one@first.org {filler(90)} quorvex")
    for i in (20, 21, 22):
        rows[i] = (i, f"{filler(60)} write u{i}@shared.net {filler(60)} Brimtal")
    got = {r.doc_id: [(rows[r.doc_id][1][t.start : t.end].lower(), t.share) for t in r.terms] for r in protected_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [w for w, _ in got[7]] == ["quorvex", "mail", "quorvex"]
    assert all([w for w, _ in got[i]] == ["write", "brimtal"] for i in (20, 21, 22))
    assert got[20][1][1] > got[7][0][1] >= 0.8
    assert all(not t for i, t in got.items() if i not in (7, 20, 21, 22))


def test_equal_rows_count_once_in_the_statistics(spark):
    rows = [(i, f"Zeppelin Marchbank writes from anna{i}@mail{i}.example often") for i in range(3)] + [(i, "plain words without names") for i in range(10, 60)]
    rows += [(99, "Orphan lives at kim@solo.example nowadays")]
    schema = "doc_id long, text string"
    once = protected_spans(spark.createDataFrame(rows, schema)).where("doc_id = 99").collect()[0]
    many = protected_spans(spark.createDataFrame(rows + [rows[-1]] * 300, schema)).where("doc_id = 99").collect()
    assert len(many) == 301 and {tuple(r.terms) for r in many} == {tuple(once.terms)} and once.terms
