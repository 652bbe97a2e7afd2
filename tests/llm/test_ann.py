import numpy as np
import pytest

from quillmere.llm.ann import nearest_neighbours
from quillmere.llm.hilbert import hilbert_index

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, x, k=20):
    out = {}
    for i, q in zip(ids, x):
        if i % 20 == 0:
            s = (x.astype(float) * q.astype(float)).sum(1)
            order = sorted((-b, int(a)) for a, b in zip(ids, s) if a != i)
            out[int(i)] = [(a, -b) for b, a in order[:k]]
    return out


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_steps_of_one(dims, bits):
    side = np.arange(1 << bits)
    cells = np.stack(np.meshgrid(*[side] * dims, indexing="ij"), -1).reshape(-1, dims)
    at = hilbert_index(cells, bits)
    assert sorted(at.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_and_scores(spark, scaled):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if scaled:
        x *= rng.lognormal(0, 0.3, size=(3000, 1))
    x = x.astype(np.float32)
    got = {}
    for r in nearest_neighbours(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = brute(range(3000), x)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        assert sorted(found) == list(range(1, 21))
        rows = [found[i] for i in range(1, 21)]
        assert rows == sorted(rows, key=lambda t: (-t[1], t[0])) and q not in dict(rows)
        assert all(abs(s - float((x[q].astype(float) * x[i]).sum())) < 1e-12 for i, s in rows)
        hits += len(dict(rows).keys() & dict(want[q]).keys())
    assert hits >= 0.9 * 20 * len(want)


def test_small_table_is_exact_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, size=(60, 4)).astype(np.float32)
    x[10:40] = x[0] if x[0].any() else 1
    x[5] = 0
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(100, None, 0), (120, [None, 1.0, 1.0, 1.0], 0), (140, [float("nan"), 1.0, 1.0, 1.0], 0), (160, [float("inf"), 0.0, 0.0, 0.0], 0), (180, [], 0), (None, [1.0] * 4, 0), rows[20]]
    ok = [i for i in range(60) if x[i].any()]
    want = brute(ok, x[ok])
    got = {}
    for r in sorted(nearest_neighbours(spark.createDataFrame(rows, SCHEMA), ranges=1).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0)], SCHEMA)
    assert [tuple(r) for r in nearest_neighbours(few).collect()] == [(0, 1, 1, 0.5)]
    assert nearest_neighbours(few.limit(0)).count() == 0


@pytest.mark.parametrize("n", [5, 21, 100])
def test_small_tables_are_exact_with_the_query_s_settings(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 64)).astype(np.float32)
    ids = [20 * i for i in range(n)]
    got = {}
    for r in sorted(nearest_neighbours(spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, x)], SCHEMA)).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [a for a, _ in rows] for q, rows in brute(ids, x).items()}


def test_shorter_vectors_and_repeated_ids_take_part(spark):
    rows = [(0, [1.0, 2.0, 0.0], 0), (0, [0.0, 1.0, 0.0], 0), (1, [3.0], 0), (2, [0.0, 0.0, 1.0], 0)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest_neighbours(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 1, 0, 2.0), (0, 1, 1, 3.0), (0, 2, 0, 2.0), (0, 2, 1, 0.0), (0, 3, 2, 0.0), (0, 3, 2, 0.0)]


def test_queries_meet_fewer_rows_than_an_exact_search():
    from quillmere.llm.ann import CURVES, PLANES, RANGES, SEED, SHARE, Curves

    x = np.random.default_rng(9).normal(size=(4000, 64))
    fitted = Curves(x, CURVES, PLANES, RANGES, SEED)
    met = [fitted.sizes[w].sum() for w in fitted.windows(x[::20], SHARE)]
    assert max(met) <= SHARE + fitted.sizes.max() < 1
