"""Mixing sources to target weights by cube-method balanced sampling.

A document of a source whose target is r times its size is due r copies: the
whole part of r is taken outright, the rest is its inclusion probability. The
flight phase moves these probabilities, three documents at a time, along the
null space of the two balancing totals (documents and words), until one of the
three is decided; both totals stay as they are. Blocks of a source fly apart
from each other, and what each leaves open, two documents and a few of all
sizes held back, flies again with the rest of its source, level by level. The
landing decides the last few by trying every choice and taking the one whose
totals are nearest.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.llm.common import row_key, table, written

#: Weights of the sources in code point order, repeating; a source is taken this many times at most.
WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 7
#: Documents that fly together, and documents that land together.
BLOCK = 4096
LANDING = 16
EPS = 1e-9
#: Equal rows that are listed at a time.
COPIES = 10_000
#: Sources whose numbers of blocks are broadcast, 16 bytes each; more are joined by shuffles. Tasks that fly blocks, at most.
BROADCAST_SOURCES = 1_000_000
TASKS = 4096

_SPACE = r"[\\x20\\x09-\\x0D]+"


def words(text: str = "text"):
    """Number of words between ASCII white space; null has none."""
    trimmed = f"regexp_replace({text}, '^{_SPACE}|{_SPACE}\\\\z', '')"
    return F.expr(f"coalesce(if({trimmed} = '', 0, size(split({trimmed}, '{_SPACE}'))), 0)").cast("long")


def flight(sizes: list[float], chances: list[float], rng: random.Random) -> list[float]:
    """Moves chances until two documents at most are undecided; sums of chances and of chances times sizes stay."""
    chances = list(chances)
    live: list[int] = []
    coming = iter(range(len(sizes)))
    while True:
        while len(live) < 3:
            if (i := next(coming, None)) is None:
                return chances
            if EPS < chances[i] < 1 - EPS:
                live.append(i)
            else:
                chances[i] = round(chances[i])
        a, b, c = (sizes[i] for i in live)
        move = (c - b, a - c, b - a) if not a == b == c else (1, -1, 0)
        up = down = float("inf")
        for i, d in zip(live, move, strict=True):
            if d > 0:
                up, down = min(up, (1 - chances[i]) / d), min(down, chances[i] / d)
            elif d < 0:
                up, down = min(up, chances[i] / -d), min(down, (1 - chances[i]) / -d)
        step = up if rng.random() * (up + down) < down else -down
        for i, d in zip(live, move, strict=True):
            chances[i] += step * d
            if not EPS < chances[i] < 1 - EPS:
                chances[i] = round(chances[i])
        live = [i for i in live if 0 < chances[i] < 1]


def landing(sizes: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Of all choices for a few documents the one nearest to the totals of words, then of documents."""
    n = len(sizes)
    picks = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    off = picks - chances
    cost = np.abs(off @ sizes) + np.abs(off.sum(1)) * 1e-3
    return picks[np.argmin(cost)]


def reserve(sizes: np.ndarray) -> np.ndarray:
    """Places of the documents that land together: of about half the largest size, a quarter and so on, and the smallest."""
    held: list[int] = []
    want = sizes.max(initial=0) / 2
    while len(held) < min(LANDING - 2, len(sizes)):
        far = np.abs(sizes - want)
        far[held] = np.inf
        held.append(int(np.argmin(far)))
        want = want / 2 if want >= 1 else 0
    return np.array(held, int)


def decided(sizes: np.ndarray, chances: np.ndarray, seed, last: bool) -> np.ndarray:
    """Chances of a block after its flight, in which the reserve has no part, and if it is the last one after the landing."""
    out = np.array(chances, float)
    flies = np.ones(len(out), bool)
    flies[reserve(sizes)] = False
    out[flies] = flight(sizes[flies].tolist(), out[flies].tolist(), random.Random(seed))
    if last:
        left = np.flatnonzero((out > EPS) & (out < 1 - EPS))
        out[left] = landing(sizes[left], out[left])
        out = out.round()
    return out


def targets(sizes: DataFrame) -> DataFrame:
    """Words to take of each source (source, source_size), by filling up to the limit.

    A level is raised until weights times level, cut off at the limits, make up
    the total; with sources in the order in which they reach their limits, it is
    the largest of the levels that the sources before leave for the rest.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    rated = sizes.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("double"))
    rated = rated.withColumn("most", F.col("source_size") * float(MOST))
    before = Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    used, weight = (F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in ("most", "weight"))
    total = F.sum("source_size").over(whole)
    level = (total - used) / (F.sum("weight").over(whole) - weight)
    filled = rated.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    return filled.select("source", "source_size", "rank", F.least("most", F.col("weight") * F.col("level")).alias("target"))


_UNIT = "rank long, block long, r1 long, r2 long, size long, chance double"


def _fly(seed: int, level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "r1", "r2"], ascending=[False, True, True])
        key = f"{seed}:{level}:{pdf['rank'].iloc[0]}:{pdf['block'].iloc[0]}"
        return pdf.assign(chance=decided(pdf["size"].to_numpy(float), pdf["chance"].to_numpy(float), key, last))

    return run


def copies(docs: DataFrame, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """Copies to take of each distinct row: r1, r2, doc_id, source, size, rows, total, source_size, target.

    `rows` counts equal rows (doc_id, text and source), which share `total` copies.
    """
    sized = docs.select("doc_id", "source", words().alias("size"), *row_key("doc_id", "text", "source"))
    units = written(sized.groupBy("r1", "r2", "doc_id", "source", "size").agg(F.count("*").alias("rows")), "units")
    sources = targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")))
    sources = sources.withColumn("due", F.when(F.col("source_size") > 0, F.least(F.try_divide("target", "source_size"), F.lit(float(MOST)))).otherwise(0.0))
    sources = written(sources.withColumnRenamed("source", "src"), "sources")

    due = F.col("due") * F.col("rows")
    whole = F.floor(due + EPS).cast("long")
    units = units.join(sources, F.col("source").eqNullSafe(F.col("src"))).drop("src")
    units = units.withColumn("whole", whole).withColumn("chance", F.greatest(F.lit(0.0), due - F.col("whole")))
    open_ = written(units.where(F.col("chance") > EPS).select("rank", "r1", "r2", "size", "chance"), "open")
    done, level = None, 0
    while True:
        counts = written(open_.groupBy("rank").agg(F.ceil(F.count("*") / block).alias("blocks")), "counts")
        sizes = counts.agg(F.count("*").alias("n"), F.max("blocks").alias("most"), F.sum("blocks").alias("all")).first()
        last = (sizes["most"] or 1) <= 1
        few = F.broadcast(counts) if sizes["n"] <= BROADCAST_SOURCES else counts
        blocks = open_.join(few, "rank").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "r1", "r2"), F.col("blocks")).cast("long"))
        # A join by source may have dealt rows by source; blocks are dealt apart, and by a fixed number, for the rows are small and the flights long.
        blocks = blocks.select("rank", "block", "r1", "r2", "size", "chance").repartition(max(1, min(TASKS, sizes["all"] or 1)), "rank", "block")
        flown = written(blocks.groupBy("rank", "block").applyInPandas(_fly(seed, level, last), _UNIT), "flown")
        taken = flown.where("chance = 1").select("r1", "r2")
        done = taken if done is None else done.unionByName(taken)
        if last:
            break
        open_ = flown.where("chance > 0 and chance < 1").drop("block")
        level += 1
    extra = done.withColumn("extra", F.lit(1))
    out = units.join(extra, ["r1", "r2"], "left")
    return out.select("r1", "r2", "doc_id", "source", "size", "rows", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("total"), "source_size", "target")


def mixed_sizes(docs: DataFrame, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """Per document the words that the mix takes of it: whole copies, from none to three.

    docs has doc_id, text and source; other columns are left out. A null text has
    no words and takes none; null is a source of its own, last in order. Equal
    rows share copies as evenly as they can. Ties and reruns agree, since all
    order and chance comes from hashes of the rows. Texts of any length count
    whole. An empty table gives an empty result.

    Returns doc_id, size, source_size, target, taken.
    """
    found = copies(docs, seed, block)
    parts = found.withColumn("part", F.explode(F.expr(f"sequence(0L, (rows - 1) div {COPIES})")))
    listed = parts.withColumn("at", F.explode(F.expr(f"sequence(part * {COPIES}, least(rows, (part + 1) * {COPIES}) - 1)")))
    taken = F.expr("size * (total div rows + if(at < total % rows, 1, 0))").cast("long")
    return listed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """The mix itself: each document, all columns, as many times as it is taken.

    Rows equal in doc_id, text and source count as repeats of one of them, which
    stands for all. Null and empty texts have no words and are not taken; a null
    source is a source. Texts of any length are taken whole, and ties are settled
    by hashes of the rows. Columns may have any names but those that begin with
    `_qm_`. An empty table stays empty.
    """
    found = copies(docs, seed, block).where("total > 0").select(F.col("r1").alias("_qm_r1"), F.col("r2").alias("_qm_r2"), F.col("total").alias("_qm_n"))
    keys = [k.alias(f"_qm_r{i}") for i, k in enumerate(row_key("doc_id", "text", "source"), 1)]
    rows = docs.select("*", *keys).join(found, ["_qm_r1", "_qm_r2"]).dropDuplicates(["_qm_r1", "_qm_r2"])
    rows = rows.withColumn("_qm_part", F.explode(F.expr(f"sequence(0L, (_qm_n - 1) div {COPIES})")))
    rows = rows.withColumn("_qm_at", F.explode(F.expr(f"sequence(_qm_part * {COPIES}, least(_qm_n, (_qm_part + 1) * {COPIES}) - 1)")))
    return rows.select(*docs.columns)


def query(spark, sf_dir):
    return mixed_sizes(table(spark, sf_dir, "documents"))
