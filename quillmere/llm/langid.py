"""Language identification by nearest centroids.

Texts become TF-IDF vectors of hashed letter trigrams, of length one; in how many
documents a trigram occurs is counted over all that may be learned from. For each
language a bounded sample is clustered into a few centroids; a text gets the
language of the centroid with the largest cosine. One without letters has none.

A text is rejected if its nearest centroid is much farther away than that
language's own texts are of theirs. Short texts lie farther off than long ones, so
the sample's documents are measured whole and in runs of few words as well, and
each language has a least cosine for each power of two of trigrams in a text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.llm.common import row_key, table, written

DIMS = 4096
#: Documents of each language that the model may be fitted on, and centroids of each.
SAMPLE = 300
CENTROIDS = 4
ROUNDS = 10
#: Rows of the sample's keys that may be broadcast, 30 bytes or so each; more are joined by a shuffle.
BROADCAST_SAMPLE = 300_000
#: Parts of a language's hashes that are ranked apart.
PARTS = 16
#: Words of the runs that are measured, and the measurements of a size that say something about it, at least.
RUNS = (1, 2, 4, 8, 16, 32, 64)
ENOUGH = 20
#: Of the cosines that a language's own texts of a size reach, the hundredth that lies lowest is taken, and this share of it is the least.
LEAST = 0.3
LOW = 0.01
SIZES = 13
SEED = 5
UNKNOWN = "und"
HELD_OUT = 2

_LETTER = regex.compile(r"\p{L}")
#: Bytes that stand in no letter count as a space.
_CLASS = np.array([i if i >= 128 or chr(i).isalpha() else 32 for i in range(256)], np.uint32)
#: Bytes counted, and texts compared with the centroids, at a time.
STEP = 1 << 20
PART = 64


def trigrams(text: str) -> np.ndarray:
    """Counts of hashed letter trigrams, words set off by spaces."""
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    out = np.zeros(DIMS, np.float32)
    for at in range(0, len(raw) - 2, STEP):
        b = _CLASS[raw[at : at + STEP + 2]]
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        code = code[(b[1:-1] != 32) | ((b[:-2] != 32) & (b[2:] != 32))]
        out += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMS)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=-1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit(np.log1p(counts) * idf)


def clustered(rows: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, begun with rows far from each other; without empty clusters."""
    centres = unit(rows.mean(0, keepdims=True))
    chosen = [int(np.argmax(rows @ centres[0]))]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int(np.argmin((rows @ rows[chosen].T).max(1))))
    centres = rows[chosen]
    for _ in range(ROUNDS):
        own = np.argmax(rows @ centres.T, axis=1)
        used = np.unique(own)
        centres = unit(np.stack([rows[own == i].mean(0) for i in used]))
    return centres


def size_of(counts: np.ndarray) -> np.ndarray:
    """Power of two of the different trigrams in each row."""
    return np.minimum(SIZES - 1, np.log2(np.maximum(1, (counts > 0).sum(-1))).astype(int))


def least_cosines(sizes: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """For each size the cosine below which a text is too far; where too little was measured, that of the next smaller size."""
    out = np.zeros(SIZES, np.float32)
    for i in range(SIZES):
        own = cosines[sizes == i]
        out[i] = LEAST * np.quantile(own, LOW) if len(own) >= ENOUGH else out[i - 1] if i else 0.0
    return out


class Model:
    """Centroids with their languages and least cosines, and the weights of the trigrams."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, least: np.ndarray, langs: list[str]):
        self.idf, self.centroids, self.least, self.langs = idf, centroids, least, langs

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, cosine and whether the text is rejected, for each text; of equally near centroids the first, by language."""
        out: list = [(UNKNOWN, 0.0, True)] * len(texts)
        some = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.langs else []
        for at in range(0, len(some), PART):
            part = some[at : at + PART]
            counts = np.stack([trigrams(texts[i]) for i in part])
            near = vectors(counts, self.idf) @ self.centroids.T
            best = near.argmax(1)
            far = near[np.arange(len(part)), best] < self.least[best, size_of(counts)]
            for i, j, s, x in zip(part, best.tolist(), near[np.arange(len(part)), best].tolist(), far.tolist(), strict=True):
                out[i] = (self.langs[j], min(1.0, max(0.0, s)), x)
        return out


def held_out() -> F.Column:
    """Whether a document has no part in learning: the CRC of its id, modulo four, is two."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == HELD_OUT


def _frequency_rows(batches):
    """In how many of a task's texts each trigram occurs; -1 counts the texts."""
    seen, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for t in batch.column("text"):
            seen += trigrams(t.as_py()) > 0
            n += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, at), pa.int32()), pa.array(np.append(n, seen[at]), pa.int64())], names=["at", "n"])


def _sample_rows(batches):
    """Trigram counts of each text, whole (run 0) and in a run of each length, begun at a place that its hash names."""
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("run", pa.int32()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.float32()))])
    for batch in batches:
        for lang, h, t in zip(*(batch.column(c) for c in ("lang", "h", "text")), strict=True):
            text, h = t.as_py(), h.as_py()
            words = text.split()
            cut = [(n, at) for n in RUNS if n < len(words) for at in [h % (len(words) - n + 1)]]
            found = [(0, trigrams(text)), *((n, trigrams(" ".join(words[at : at + n]))) for n, at in cut)]
            at = [np.flatnonzero(c) for _, c in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang.as_py()] * len(found)), pa.array([h] * len(found)), pa.array([n for n, _ in found], pa.int32()), pa.array(at, schema.field("at").type), pa.array([c[i] for i, (_, c) in zip(at, found)], schema.field("n").type)],
                schema=schema,
            )


def _fit(idf: np.ndarray, k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "run"])
        counts = np.zeros((len(pdf), DIMS), np.float32)
        for row, at, n in zip(counts, pdf["at"], pdf["n"], strict=True):
            row[at] = n
        rows = vectors(counts, idf)
        centres = clustered(rows[(pdf["run"] == 0).to_numpy()], k).astype(np.float32)
        some = counts.any(1)
        least = least_cosines(size_of(counts[some]), (rows[some] @ centres.T).max(1))
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * len(centres), "place": range(len(centres)), "centre": [c.tobytes() for c in centres], "least": [least.tobytes()] * len(centres)})

    return run


def learned(docs: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> Model:
    """Fits the model: document frequencies over all documents, centroids on at most `sample` different texts of each language.

    Only documents with a language, with letters in their text, and not held out
    take part. Of a language's different texts those with the smallest hashes are
    its sample; nothing but texts and languages has a bearing on it. Each language
    is clustered in a task of its own; the model has 64 kB for each of them.
    """
    known = docs.where(F.col("lang").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64(F.lit(SEED), "text").alias("h"))
    counted = known.select("text").mapInArrow(_frequency_rows, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(DIMS + 1, np.int64)
    for r in counted:
        seen[r["at"]] = r["n"]
    idf = (np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1).astype(np.float32)

    # First of each of a few parts of a language's hashes, then of what is left, a bounded number.
    picked = known.select("lang", "h").distinct().withColumn("part", F.pmod("h", F.lit(PARTS)))
    for part in (["lang", "part"], ["lang"]):
        picked = picked.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy("h"))).where(F.col("rank") <= sample).drop("rank")
    picked = written(picked.drop("part"), "sample")
    few = F.broadcast(picked) if picked.count() <= BROADCAST_SAMPLE else picked
    texts = known.join(few, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    rows = texts.mapInArrow(_sample_rows, "lang string, h long, run int, at array<int>, n array<float>")
    found = rows.groupBy("lang").applyInPandas(_fit(idf, k), "lang string, place int, centre binary, least binary").collect()
    found.sort(key=lambda r: (r["lang"], r["place"]))
    centres, least = (np.array([np.frombuffer(r[c], np.float32) for r in found]) for c in ("centre", "least"))
    return Model(idf, centres, least, [r["lang"] for r in found])


def _predict_rows(model):
    """model: a broadcast Model."""

    def rows(batches):
        for batch in batches:
            texts = batch.column("text")
            found = [x for at in range(0, len(texts), PART) for x in model.value.predict(texts.slice(at, PART).to_pylist())]
            cols = list(zip(*found, strict=True)) or [()] * 3
            others = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            kinds = (pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*others, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[*names, "lang_pred", "score", "rejected"])

    return rows


def identified(docs: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS, model: Model | None = None) -> DataFrame:
    """Per document its predicted language.

    docs has doc_id, text and lang; other columns are left out, and lang is read
    for learning alone. A null text or one without letters is `und` with score 0,
    and so is every text if nothing was learned. Of equally near centroids that of
    the first language in code point order counts. Texts of any length are counted
    whole, a megabyte at a time. Repeated rows stay; an empty table gives an empty
    result.

    Returns doc_id, held_out, lang_pred, score (cosine, 0 to 1), rejected.
    """
    model = docs.sparkSession.sparkContext.broadcast(model or learned(docs, sample, k))
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_predict_rows(model), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def recognised(docs: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> DataFrame:
    """The documents, all columns, whose text is near a learned language.

    Null texts and texts without letters go, and all do if nothing was learned.
    Repeated rows stay or go together, and texts of any length are judged whole.
    Of equally near centroids the first decides, as in `identified`. Columns may
    have any names but those that begin with `_qm_`. An empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(learned(docs, sample, k))
    keyed = docs.select(*row_key("doc_id", "text"), "text")
    bad = keyed.mapInArrow(_predict_rows(model), "r1 long, r2 long, lang_pred string, score double, rejected boolean").where("rejected")
    bad = written(bad.select(F.col("r1").alias("_qm_r1"), F.col("r2").alias("_qm_r2")).distinct(), "rejected")
    keys = [c.alias(f"_qm_r{i}") for i, c in enumerate(row_key("doc_id", "text"), 1)]
    return docs.select("*", *keys).join(bad, ["_qm_r1", "_qm_r2"], "left_anti").select(*docs.columns)


def query(spark, sf_dir):
    return identified(table(spark, sf_dir, "documents"))
