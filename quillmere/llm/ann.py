"""Approximate nearest neighbours by shifted Hilbert curves.

Each of several curves runs through a few random projections of the vectors,
shifted at random, and so puts them in an order of its own. An order is cut into
ranges of about equal size, windows of keys that neighbour each other. A query
looks at those windows of all curves whose mean has the largest product with it;
what they hold is merged and ranked anew by the exact measure. Projections,
edges of the ranges and means are fitted on a bounded sample; every vector is
indexed.

Equal vectors are one class, searched once; classes are spelled out only in the
answers. Vectors shorter than the longest are filled up with zeros, so a product
runs over the components that both have.

Windows are shares of the rows, not numbers of them. Where vectors have no
structure at all, as many independent directions as dimensions, only a large
share reaches a given recall, and the defaults are set for such data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.llm.common import table, written
from quillmere.llm.hilbert import hilbert_index

CURVES = 4
#: Projections that a curve runs through, and bits of each.
PLANES = 8
BITS = 7
#: Ranges of an order; a table with fewer classes than would fill them with the number looked for is searched exactly.
RANGES = 128
#: Rows that a query meets, repeats on several curves included, as a share of all.
SHARE = 0.72
EVERY = 20
NEAREST = 20
SEED = 11
#: Vectors that the curves are fitted on.
SAMPLE = 10_000
#: Rows of either side that meet in one task at a time, and rows placed at a time.
MEET = 20_000
STEP = 1024
#: Products are exact to far less than this.
SLACK = 1e-9


def valid(vectors: DataFrame) -> DataFrame:
    """Rows that take part: id and components (double) of vectors that are whole, finite and not zero, all of the longest one's length."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vec")).where("vec_id is not null and vec is not null")
    rows = rows.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))
    longest = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    whole = F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("vec")))
    return rows.withColumn("vec", F.transform(whole, lambda x: x + F.lit(0.0))).distinct()


def classes(rows: DataFrame, every: int, nearest: int) -> DataFrame:
    """A row for each different vector: first (smallest id), h, vec, ids (the smallest), asked (whether any is a query)."""
    named = rows.withColumn("h", F.xxhash64("vec"))
    whole = named.groupBy("h", "vec").agg(F.min("vec_id").alias("first"), F.max(F.col("vec_id") % every == 0).alias("asked"))
    few = named.withColumn("n", F.row_number().over(Window.partitionBy("h", "vec").orderBy("vec_id"))).where(F.col("n") <= nearest + 1)
    few = few.groupBy("h", "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return whole.join(few, ["h", "vec"])


class Curves:
    """Projections, shifts and ranges of all curves, fitted on a sample; picklable."""

    def __init__(self, sample: np.ndarray, curves: int, planes: int, ranges: int, seed: int):
        rng = np.random.default_rng(seed)
        dims = sample.shape[1]
        need, blocks = curves * planes, []
        while need > 0:
            q, _ = np.linalg.qr(rng.normal(size=(dims, dims)))
            blocks.append(q[:, :need])
            need -= dims
        self.planes = np.concatenate(blocks, axis=1)
        seen = sample @ self.planes
        self.middle, self.spread = seen.mean(0), np.maximum(seen.std(0), 1e-12)
        self.shift = rng.random(self.planes.shape[1]) * 0.5
        self.curves, self.each = curves, min(planes, self.planes.shape[1])
        keys = self.keys(sample)
        self.edges = [np.unique(np.quantile(k, np.arange(1, ranges) / ranges, method="nearest")) if ranges > 1 else k[:0] for k in keys]
        of = self.places(sample)
        found = [(i, r, (of[i] == r).sum(), sample[of[i] == r].mean(0)) for i in range(curves) for r in np.unique(of[i]).tolist()]
        self.where = np.array([(i, r) for i, r, *_ in found], np.int32)
        self.sizes = np.array([n for _, _, n, _ in found]) / len(sample)
        self.means = np.stack([m for *_, m in found])

    def keys(self, points: np.ndarray) -> np.ndarray:
        """Key of each point on each curve."""
        at = (points @ self.planes - self.middle) / self.spread / 8 + 0.25 + self.shift
        cells = (np.clip(at, 0, 1 - 2.0**-BITS) * 2**BITS).astype(np.int64)
        return np.stack([hilbert_index(cells[:, i * self.each : (i + 1) * self.each], BITS) for i in range(self.curves)])

    def places(self, points: np.ndarray) -> np.ndarray:
        """Range of each point on each curve."""
        return np.stack([np.searchsorted(e, k, side="right") for e, k in zip(self.edges, self.keys(points), strict=True)])

    def windows(self, points: np.ndarray, share: float) -> list[np.ndarray]:
        """For each query the windows it looks at, by the products with their means, until they hold the share of all rows: places in `where`."""
        order = np.argsort(-(points @ self.means.T), axis=1, kind="stable")
        held = np.cumsum(self.sizes[order], axis=1)
        return [o[: np.searchsorted(h, share - 1e-9) + 1] for o, h in zip(order, held, strict=True)]


_INDEX = "curve int, range int, first long, h long, vec binary"


def _index_rows(curves: Curves, share: float | None):
    """Each row at its place on every curve, or with a share each query at the windows it looks at."""
    schema = pa.schema([("curve", pa.int32()), ("range", pa.int32()), ("first", pa.int64()), ("h", pa.int64()), ("vec", pa.binary())])

    def rows(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                x = np.array(batch.column("vec").to_pylist())
                if share is None:
                    own = np.tile(np.arange(len(x)), curves.curves)
                    where = np.column_stack([np.repeat(np.arange(curves.curves), len(x)), curves.places(x).ravel()])
                else:
                    seen = curves.windows(x, share)
                    own, where = np.repeat(np.arange(len(x)), [len(w) for w in seen]), curves.where[np.concatenate(seen)]
                raw = pa.array([v.tobytes() for v in x], pa.binary())
                names = [pa.array(where[:, 0], pa.int32()), pa.array(where[:, 1], pa.int32())]
                yield pa.RecordBatch.from_arrays([*names, *(batch.column(c).take(pa.array(own)) for c in ("first", "h")), raw.take(pa.array(own))], schema=schema)

    return rows


def _near(nearest: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({c: [] for c in ("q_first", "q_h", "first", "h", "score")})
        q, x = (np.frombuffer(b"".join(d["vec"]), float).reshape(len(d), -1) for d in (queries, rows))
        firsts, hs, out = rows["first"].to_numpy(), rows["h"].to_numpy(), []
        for at in range(0, len(q), 256):
            scores = q[at : at + 256] @ x.T
            if len(x) > nearest:
                least = np.partition(scores, len(x) - nearest, axis=1)[:, len(x) - nearest]
            else:
                least = np.full(len(scores), -np.inf)
            a, b = np.nonzero(scores >= (least - SLACK * (1 + np.abs(least)))[:, None])
            exact = (q[at + a] * x[b]).sum(1)
            order = np.lexsort((hs[b], firsts[b], -exact, a))
            a, b, exact = a[order], b[order], exact[order]
            begin = np.searchsorted(a, np.arange(len(scores)))
            keep = np.arange(len(a)) - begin[a] < nearest
            out.append((at + a[keep], b[keep], exact[keep]))
        a, b, exact = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"q_first": queries["first"].to_numpy()[a], "q_h": queries["h"].to_numpy()[a], "first": firsts[b], "h": hs[b], "score": exact})

    return run


def nearest_neighbours(vectors: DataFrame, every: int = EVERY, nearest: int = NEAREST, curves: int = CURVES, planes: int = PLANES, ranges: int = RANGES, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """For each row whose vec_id is divisible by `every`, the rows with the largest inner products that its windows hold.

    vectors has vec_id (long) and embedding (array); other columns are left out.
    Vectors null, zero or with null or non-finite components take no part, nor do
    rows without an id; equal rows count once. A query's own row is no answer to
    it, another row with its id is. Ties go to the smaller vec_id. Vectors of any
    length are held some thousand at a time. An empty table gives an empty result.

    Returns query_id, rank (from 1), vec_id, score (double).
    """
    spark = vectors.sparkSession
    rows = valid(vectors)
    found = written(classes(rows, every, nearest), "classes")
    stats = found.agg(F.count("*").alias("n"), F.count_if("asked").alias("asked")).first()
    if not stats["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.array([r.vec for r in found.select("vec", "h", "first").orderBy(F.xxhash64("h"), "first").limit(SAMPLE).select("vec").toLocalIterator()])
    ranges = ranges if stats["n"] >= ranges * (nearest + 1) else 1
    curves = curves if ranges > 1 else 1
    share = min(float(curves), max(share if ranges > 1 else 1.0, curves * (nearest + 1) / stats["n"]))
    fitted = Curves(sample, curves, planes, ranges, seed)

    # Large ranges meet in parts: every part of the queries with every part of the rows.
    q_parts = max(1, -(-stats["asked"] // MEET))
    parts = max(1, -(-stats["n"] // ranges // MEET))
    split = lambda n: F.pmod(F.xxhash64("h", "first"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = found.select("first", "h", "vec").mapInArrow(_index_rows(fitted, None), _INDEX).select("curve", "range", split(parts).alias("part"), all_of(q_parts).alias("q_part"), "first", "h", "vec")
    asks = found.where("asked").select("first", "h", "vec").mapInArrow(_index_rows(fitted, share), _INDEX)
    asks = asks.select("curve", "range", split(q_parts).alias("q_part"), all_of(parts).alias("part"), "first", "h", "vec")
    keys = ["curve", "range", "part", "q_part"]
    near = asks.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(_near(nearest + 1), "q_first long, q_h long, first long, h long, score double")
    order = Window.partitionBy("q_first", "q_h").orderBy(F.desc("score"), "first", "h")
    near = near.withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= nearest + 1).select("q_first", "q_h", "first", "h", "score").distinct()

    listed = near.join(found.select("first", "h", "ids"), ["first", "h"]).select("q_first", "q_h", "first", "h", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("q_first", "q_h").orderBy(F.desc("score"), "vec_id", "first", "h")
    listed = listed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= nearest + 1)
    tops = listed.groupBy("q_first", "q_h").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score", "first", "h"))).alias("tops"))
    members = rows.where(F.col("vec_id") % every == 0).select("vec_id", F.xxhash64("vec").alias("h"), "vec")
    members = members.join(found.select("h", "vec", "first"), ["h", "vec"]).select(F.col("vec_id").alias("query_id"), F.col("first").alias("q_first"), F.col("h").alias("q_h"))
    own = lambda t: (t["vec_id"] == F.col("query_id")) & (t["first"] == F.col("q_first")) & (t["h"] == F.col("q_h"))
    answer = F.slice(F.filter("tops", lambda t: ~own(t)), 1, nearest)
    answers = members.join(tops, ["q_first", "q_h"]).select("query_id", F.posexplode(answer).alias("at", "t"))
    return answers.select("query_id", (F.col("at") + 1).alias("rank"), "t.vec_id", "t.score")


def query(spark, sf_dir):
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))
