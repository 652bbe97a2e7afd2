import hashlib
import random

from quillmere.llm.line_dedup import chunks, query, without_repeated_chunks


def brute(rows):
    seen, out = set(), []
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for doc_id, text in order:
        body = (text or "").encode()
        parts, kept, gone = chunks(body), [], []
        for a, b, n in parts:
            if n >= 2 and body[a:b] in seen:
                gone.append(n)
            else:
                kept.append(body[a:b])
                if n >= 2:
                    seen.add(body[a:b])
        kept = b"".join(kept)
        out.append((doc_id, sum(n for *_, n in parts), len(parts), sum(gone), len(gone), len(kept), hashlib.sha256(kept).hexdigest()))
    return {r[0]: r for r in out}


def corpus():
    rng = random.Random(4)
    line = lambda: " ".join(rng.choice(["ab", "cé", "d"]) + str(rng.randrange(99)) for _ in range(rng.randint(1, 6)))
    passages = [[line() for _ in range(14)] for _ in range(3)]
    rows = [(None, "a\nb"), (1, None), (2, ""), (3, "\n"), (4, "x"), (5, "x\n" * 50), (6, "x\n" * 50 + "y"), (7, "a\n\n\nb\n")]
    for i in range(8, 60):
        text = [line() for _ in range(rng.randint(0, 9))] + rng.choice([[], *passages]) + [line() for _ in range(rng.randint(0, 5))]
        rows.append((i, "\n".join(text) + rng.choice(["", "\n"])))
    return [*rows, (60, rows[20][1]), (61, rows[20][1] * 2)]


def test_chunks_are_whole_and_shift_resistant():
    lines = [f"line {i * i % 97} {i}" for i in range(200)]
    body = "\n".join(lines).encode()
    parts = chunks(body)
    assert b"".join(body[a:b] for a, b, _ in parts) == body and sum(n for *_, n in parts) == 200
    moved = ("new\nlines\n" + "\n".join(lines)).encode()
    assert len({body[a:b] for a, b, _ in parts} & {moved[a:b] for a, b, _ in chunks(moved)}) >= len(parts) - 3
    assert chunks(b"") == [] and chunks(b"a") == [(0, 1, 1)] and chunks(b"\n") == [(0, 1, 1)]


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, at int")
    got = {r.doc_id: tuple(r) for r in without_repeated_chunks(df).collect()}
    assert got == brute(rows)
    assert sum(r[4] for r in got.values()) > 20
    kept = {r.doc_id: r.kept for r in without_repeated_chunks(df, whole=True).collect()}
    assert all(hashlib.sha256(kept[i]).hexdigest() == got[i][6] for i in got)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed_lines) for r in without_repeated_chunks(df).collect())
    assert got[:2] == [(1, 0), (1, 0)] and got[2][1] >= 2
    assert without_repeated_chunks(df.limit(0)).count() == 0


def test_passages_over_fifty_words_go_whatever_their_lines(spark, tmp_path):
    rng = random.Random(7)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = {10: [line(60)], 20: [line(30), line(25)], 30: [line(20), line(20), line(20)], 40: [line(9) for _ in range(9)]}
    rows = []
    for i, passage in passages.items():
        rows += [(i + k, "\n".join([line(30), line(7), *passage, *([line(12), line(31)] if k < 2 else [])])) for k in range(3)]
    rows += [(90, "one line of six words here\n" * 181), (91, f"{line(30)}\n{line(20)}"), (92, rows[0][1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in query(spark, str(tmp_path)).collect()}
    for i, passage in passages.items():
        assert [got[i + k].n_removed_lines for k in range(3)] == [0, len(passage), len(passage)]
    assert got[90].n_lines - got[90].n_removed_lines == 9 and got[91].n_removed_lines == 0
    assert got[92].kept_bytes == 0 and got[92].n_removed_chunks == got[92].n_chunks
