import math
import random
import zlib

import numpy as np

from quillmere.llm.langid import clustered, identified, learned, recognised, trigrams, unit

WORDS = {
    "en": "the and of with that this from have which would there their about other".split(),
    "de": "der die und nicht mit eine auch sich werden über können für durch schön".split(),
    "fr": "le les des une dans qui pour avec être très après elle nous été".split(),
}


def corpus(n=240):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(WORDS[lang], k=rng.randint(1, 40))) + ".", lang) for i in range(n) for lang in [rng.choice(list(WORDS))]]
    return rows + [(n, None, "en"), (n + 1, "", "de"), (n + 2, "12 !? 34", "fr"), (n + 3, "und der", None), (None, "the of", "en"), (n + 4, "the with that " * 9000, "en")]


def test_held_out_accuracy(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, lang string, score double, source string")
    got = identified(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        r = by[i]
        assert r.held_out == (zlib.crc32(str(i if i is not None else "").encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.lang_pred in {*WORDS, "und"}
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
    tested = [(lang, by[i].lang_pred) for i, _, lang in rows if lang and by[i].held_out and by[i].lang_pred != "und"]
    assert sum(a == b for a, b in tested) >= 0.95 * len(tested) and len(tested) > 30
    kept = recognised(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3


def test_labels_of_held_out_documents_are_not_learned(spark):
    rows = [(i, t, lang if zlib.crc32(str(i).encode()) % 4 != 2 else "xx") for i, t, lang in corpus() if i is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert "xx" not in learned(df).langs
    again = df.orderBy("text").repartition(3)
    assert np.array_equal(learned(df).centroids, learned(again).centroids)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in identified(df).collect()} == {("und", 0.0)}
    assert identified(df.limit(0)).count() == 0


def test_parts():
    assert trigrams("ab").sum() == 2 and trigrams("a").sum() == 1
    assert np.array_equal(trigrams("A1b"), trigrams("a b"))
    rows = unit(np.random.default_rng(1).random((50, 8)).astype(np.float32))
    assert len(clustered(rows, 4)) <= 4 and len(clustered(rows[:2], 4)) <= 2


SCHEMA = "doc_id long, text string, lang string"


def test_marks_that_are_no_letters(spark):
    rows = [(i, t, lang) for i, t, lang in corpus(60) if i is not None] + [(900, "²", None), (901, "① ½", None), (902, "Ⅷ", None), (903, "ª ŉ", None)]
    got = {r.doc_id: r.lang_pred for r in identified(spark.createDataFrame(rows, SCHEMA)).where("doc_id >= 900").collect()}
    assert {got[i] for i in (900, 901, 902)} == {"und"} and got[903] != "und"


def test_a_language_of_one_repeated_text_is_learned(spark):
    for doc_id in (7000001, 7000002, 7000003, 7000005):
        rows = [(i, f"the of and {i}", "en") for i in range(40)] + [(doc_id, "und der die das nicht", "de")] * 2000
        docs = spark.createDataFrame(rows, SCHEMA)
        assert ("de" in learned(docs).langs) == (zlib.crc32(str(doc_id).encode()) % 4 != 2)


def test_as_many_languages_as_there_are(spark):
    rows = [(i, f"{chr(97 + i % 26) * 3} {chr(97 + i // 26 % 26) * 4} {i % 1300}", f"l{i % 1300}") for i in range(3900)]
    model = learned(spark.createDataFrame(rows, SCHEMA), sample=2, k=1)
    want = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    assert set(model.langs) == want


def test_texts_in_unlearned_scripts_and_languages_are_rejected(spark):
    rng = random.Random(2)
    known = [(i, " ".join(rng.choices(WORDS[lang], k=rng.randint(30, 90))), lang) for i, lang in enumerate(rng.choices(list(WORDS), k=400))]
    other = [
        "это предложение написано на языке которого никто здесь не учил и поэтому оно должно быть отвергнуто",
        "αυτή η πρόταση είναι γραμμένη σε μια γλώσσα που κανείς εδώ δεν έχει μάθει ποτέ",
        "这个句子是用这里没有人学过的语言写的因此应该被拒绝而不是被归入任何一种语言",
        "tämä lause on kirjoitettu kielellä jota kukaan täällä ei ole oppinut joten sen pitäisi tulla hylätyksi",
        "ez a mondat olyan nyelven íródott amelyet itt senki sem tanult ezért vissza kell utasítani",
    ]
    rows = known + [(1000 + i, t, None) for i, t in enumerate(other)]
    got = {r.doc_id: r.rejected for r in identified(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[1000 + i] for i in range(len(other)))
    assert not any(got[i] for i in range(len(known)))


def test_matches_brute_force(spark):
    """Vectors and cosines anew, text by text, from the model's centroids."""
    docs = spark.createDataFrame(corpus(80), SCHEMA)
    model = learned(docs)

    def vector(text):
        counts = {}
        spaced = " " + "".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower()) + " "
        raw = spaced.encode()
        for a, b, c in zip(raw, raw[1:], raw[2:]):
            if b != 32 or (a != 32 and c != 32):
                at = ((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> 20
                counts[at] = counts.get(at, 0) + 1
        v = {at: math.log1p(n) * float(model.idf[at]) for at, n in counts.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {at: x / size for at, x in v.items()}

    seen = {at for _, t, lang in corpus(80) for at in (vector(t) if t and any(c.isalpha() for c in t) else ())}
    assert seen
    for r in identified(docs, model=model).join(docs.select("doc_id", "text"), "doc_id").collect():
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        v = vector(r.text)
        near = [sum(x * float(c[at]) for at, x in v.items()) for c in model.centroids]
        assert abs(r.score - max(near)) < 1e-4
        assert max(s for s, lang in zip(near, model.langs) if lang == r.lang_pred) > max(near) - 1e-4
