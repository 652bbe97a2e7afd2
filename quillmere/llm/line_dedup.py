"""Line dedup over content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines marks a boundary where it
is smaller than on either side, so boundaries depend on the lines around them
alone and stand at the same lines wherever a passage is copied to. Chunks of two
lines and more that occur again anywhere, by digest and then by their bytes, are
removed but for the first.

Chunks that reach over the ends of a repeated passage are not found again. So from
each line on, and back from each line, the fewest whole lines of more than a given
number of words are compared as well, by 128-bit digests; their union is the whole
passage, whatever its number of lines.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import dropped, released, row_key, table, written

#: Lines that the rolling hash takes in, and lines of a chunk that may be removed, at least.
ROLL = 2
LINES = 2
#: Words that a repeated passage of lines must exceed in the query.
WORDS = 50
_MIX = 0x9E3779B97F4A7C15


def chunks(body: bytes, roll: int = ROLL) -> list[tuple[int, int, int]]:
    """Chunks of a text as (first byte, end, lines); they make up the whole text."""
    if not body:
        return []
    lines = body.split(b"\n")
    ends = np.cumsum([len(x) + 1 for x in lines])
    ends[-1] -= 1
    if not lines[-1]:
        lines, ends = lines[:-1], ends[:-1]
    h = np.array([xxhash.xxh64_intdigest(x) for x in lines], np.uint64)
    rolled = h.copy()
    for k in range(1, min(roll, len(h))):
        rolled[k:] += h[:-k] * np.uint64(pow(_MIX, k, 1 << 64))
    rolled ^= rolled >> np.uint64(31)
    cut = np.zeros(len(h), bool)
    cut[1:-1] = (rolled[1:-1] < rolled[:-2]) & (rolled[1:-1] <= rolled[2:])
    cut[-1] = True
    at = np.flatnonzero(cut)
    first = np.concatenate(([-1], at[:-1]))
    begins = np.where(first < 0, 0, ends[first])
    return list(zip(begins.tolist(), ends[at].tolist(), (at - first).tolist(), strict=True))


_CHUNKS = pa.schema([(c, pa.int64()) for c in ("r1", "r2", "doc_id", "d1", "d2")] + [(c, pa.int32()) for c in ("at", "begin", "end")])
_CHUNKS_SQL = "r1 long, r2 long, doc_id long, d1 long, d2 long, at int, begin int, end int"


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def windows(body: bytes, words: int) -> list[tuple[int, int]]:
    """From each line on, and back from each, the fewest lines of more than `words` words: (first byte, end), each once."""
    lines = body.split(b"\n")
    if not lines[-1]:
        lines = lines[:-1]
    ends = np.cumsum([0] + [len(x) + 1 for x in lines])
    ends[-1] = min(ends[-1], len(body))
    total = np.cumsum([0] + [len(x.split()) for x in lines])
    n = len(lines)
    to = np.searchsorted(total, total[:-1] + words, side="right")
    back = np.searchsorted(total, total[1:] - words, side="left") - 1
    whole = [(i, j) for i, j in enumerate(to.tolist()) if j <= n] + [(i, j) for j, i in enumerate(back.tolist(), 1) if i >= 0]
    return [(int(ends[i]), int(ends[j])) for i, j in sorted(set(whole))]


_WINDOWS_SQL = "r1 long, r2 long, doc_id long, d1 long, d2 long, begin int, end int"


def _window_rows(words: int):
    kinds = [pa.int64()] * 5 + [pa.int32()] * 2

    def rows(batches):
        for batch in batches:
            out = []
            for r1, r2, doc_id, body in zip(*(batch.column(c).to_pylist() for c in ("r1", "r2", "doc_id", "body")), strict=True):
                for a, b in windows(body, words):
                    # The last line of a text may lack its line feed.
                    d = xxhash.xxh128_intdigest(body[a:b].removesuffix(b"\n"))
                    out.append((r1, r2, doc_id, _signed(d >> 64), _signed(d & (2**64 - 1)), a, b))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 7, kinds, strict=True)], names=["r1", "r2", "doc_id", "d1", "d2", "begin", "end"])

    return rows


def _repeated_windows(rows: DataFrame, words: int) -> DataFrame:
    """Windows that occurred before, but for those that overlap the first in its own text: r1, r2, spans."""
    places = written(rows.select("r1", "r2", "doc_id", "body").mapInArrow(_window_rows(words), _WINDOWS_SQL), "windows")
    place = F.struct("doc_id", "r1", "r2", "begin", "end")
    firsts = places.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    own = (F.col("first.r1") == F.col("r1")) & (F.col("first.r2") == F.col("r2"))
    later = places.join(firsts, ["d1", "d2"]).where(~own | (F.col("begin") >= F.col("first.end")))
    found = written(later.groupBy("r1", "r2").agg(F.collect_set(F.struct("begin", "end")).alias("spans")), "spans")
    dropped(places)
    released(rows.sparkSession)
    return found


def _chunk_rows(least: int):
    def rows(batches):
        for batch in batches:
            out = []
            for r1, r2, doc_id, body in zip(*(batch.column(c).to_pylist() for c in ("r1", "r2", "doc_id", "body")), strict=True):
                for at, (a, b, n) in enumerate(chunks(body)):
                    if n >= least:
                        d = xxhash.xxh128_intdigest(body[a:b])
                        out.append((r1, r2, doc_id, _signed(d >> 64), _signed(d & (2**64 - 1)), at, a, b))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 8, _CHUNKS.types, strict=True)], schema=_CHUNKS)

    return rows


def _byte_rows(batches):
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
    for batch in batches:
        out = []
        for r1, r2, doc_id, body, places in zip(*(batch.column(c).to_pylist() for c in ("r1", "r2", "doc_id", "body", "places")), strict=True):
            out += [(r1, r2, doc_id, p["d1"], p["d2"], p["at"], body[p["begin"] : p["end"]]) for p in places]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 7, kinds, strict=True)], names=["r1", "r2", "doc_id", "d1", "d2", "at", "bytes"])


def _kept_rows(whole: bool):
    def rows(batches):
        for batch in batches:
            out = []
            for doc_id, body, gone, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "body", "gone", "spans")), strict=True):
                parts = chunks(body)
                ends = np.flatnonzero(np.frombuffer(body, np.uint8) == 10) + 1
                if not len(ends) or ends[-1] < len(body):
                    ends = np.append(ends, len(body))
                begins = np.append(0, ends[:-1])[: len(ends) if body else 0]
                out_of = np.zeros(len(begins) + 1, np.int64)
                for a, b in [parts[i][:2] for i in gone or ()] + [(x["begin"], x["end"]) for x in spans or ()]:
                    out_of[np.searchsorted(begins, a)] += 1
                    out_of[np.searchsorted(begins, b)] -= 1
                cut = np.cumsum(out_of)[:-1] > 0
                kept = b"".join(body[a:b] for a, b, x in zip(begins.tolist(), ends.tolist(), cut.tolist()) if not x)
                n_gone = sum(cut[np.searchsorted(begins, a) : np.searchsorted(begins, b)].all() for a, b, _ in parts)
                row = (doc_id, len(begins), len(parts), int(cut.sum()), int(n_gone), len(kept), hashlib.sha256(kept).hexdigest())
                out.append(row + ((kept,) if whole else ()))
            names = ["doc_id", "n_lines", "n_chunks", "n_removed_lines", "n_removed_chunks", "kept_bytes", "kept_sha256", *["kept"] * whole]
            kinds = [pa.int64()] * 6 + [pa.string(), *[pa.binary()] * whole]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * len(names), kinds, strict=True)], names=names)

    return rows


def without_repeated_chunks(docs: DataFrame, least: int = LINES, whole: bool = False, words: int | None = None) -> DataFrame:
    """Per document what remains without chunks of `least` lines and more that occurred before.

    docs has doc_id (long) and text; other columns are left out. Chunks count in
    the order of doc_id, null first, then of place in the text; the first of
    equal ones stays. A chunk that repeats inside one text is removed there too.
    Equal rows count as one and come out alike. Null and empty texts have no
    lines. An empty table gives an empty result. Texts of any length are whole;
    a task holds some of them and the places of their chunks. With `words`, passages of whole
    lines of more than so many words go as well, however chunks are cut; a chunk
    counts as removed if all its lines are.

    Returns doc_id, n_lines, n_chunks, n_removed_lines, n_removed_chunks,
    kept_bytes, kept_sha256, and with `whole` the kept bytes.
    """
    # Joins with the texts shuffle them at every size, so that small runs foretell large ones.
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.col("text").cast("binary").alias("body"), *row_key("doc_id", "text"))
    places = written(rows.select("r1", "r2", "doc_id", "body").mapInArrow(_chunk_rows(least), _CHUNKS_SQL).distinct(), "chunks")
    again = places.groupBy("d1", "d2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    chosen = places.join(again, ["d1", "d2"]).groupBy("r1", "r2").agg(F.collect_list(F.struct("d1", "d2", "at", "begin", "end")).alias("places"))
    found = rows.join(chosen.hint("merge"), ["r1", "r2"]).dropDuplicates(["r1", "r2"]).select("r1", "r2", "doc_id", "body", "places")
    found = written(found.mapInArrow(_byte_rows, "r1 long, r2 long, doc_id long, d1 long, d2 long, at int, bytes binary"), "bytes")
    dropped(places)
    released(spark)

    place = F.struct("doc_id", "r1", "r2", "at")
    firsts = found.groupBy("d1", "d2", "bytes").agg(F.min(place).alias("first"))
    later = found.join(firsts, ["d1", "d2", "bytes"]).where(~F.struct("doc_id", "r1", "r2", "at").eqNullSafe(F.col("first")))
    gone = written(later.groupBy("r1", "r2").agg(F.collect_set("at").alias("gone")), "gone")
    dropped(found)
    released(spark)

    rest = rows.join(gone.hint("merge"), ["r1", "r2"], "left")
    if words is None:
        rest = rest.withColumn("spans", F.lit(None).cast("array<struct<begin:int,end:int>>"))
    else:
        rest = rest.join(_repeated_windows(rows, words).hint("merge"), ["r1", "r2"], "left")
    kind = "doc_id long, n_lines long, n_chunks long, n_removed_lines long, n_removed_chunks long, kept_bytes long, kept_sha256 string" + ", kept binary" * whole
    return rest.select("doc_id", "body", "gone", "spans").mapInArrow(_kept_rows(whole), kind)


def query(spark, sf_dir):
    return without_repeated_chunks(table(spark, sf_dir, "documents"), words=WORDS)
