"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere.

The corpus is far larger than one suffix array, so equal windows are first
brought together. Every window of `window` bytes names the smallest hash among
its `gram`-byte substrings (its anchor); equal windows name equal anchors at
equal offsets. Anchors seen once end here. The stretch of text around each
other anchor goes to the task of its hash, where a two-stage suffix sort runs:
only suffixes smaller than their successors are sorted directly, the rest are
induced by scanning the buckets of first bytes in order; the common prefixes of
neighbours then tell which windows are repeated.

Anchors with more than `hot_rows` places are dealt out again by the bytes that
all windows of a narrow block have in common, after equal pieces are counted. A
block with many different pieces is cut into narrower ones, in the end of a
single window each, whose pieces are all equal. So no task gets more than a
bounded number of different pieces of one key, however often a passage occurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import dropped, released, row_key, written

WINDOW = 200
GRAM = 32
HOT_ROWS = 256
#: Starts in a block of a hot anchor, and in the blocks that it is cut into where it has too many different pieces.
HOT_STEPS = (32, 8, 1)
#: Places of one stretch that get its ranges together, and stretches with more whose digests are broadcast (24 bytes each).
PLACES = 1024
BROADCAST_STRETCHES = 200_000
#: Different pieces of a block that are sorted together, at most.
HOT_PIECES = 512
#: Window starts hashed at a time; the low bits of a packed hash hold the place in the block.
BLOCK_BITS = 17
#: Bytes of text in one suffix array, unless a single group has more.
CHUNK = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(42).integers(1, 2**63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _gram_hashes(data: np.ndarray, gram: int, inverse: np.ndarray, power: np.ndarray) -> np.ndarray:
    """64-bit rolling hashes of all gram-byte substrings."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * inverse[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * power[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, bounds: np.ndarray, window: int, gram: int):
    """Runs of window starts with one anchor: arrays of hash, text number, first, last start and anchor.

    data holds the texts one after another, bounds their offsets. Places are
    counted from the beginning of the data.
    """
    out = []
    size = (1 << BLOCK_BITS) - window
    inverse = _powers(pow(int(_BASE), -1, 1 << 64), size + window)
    power = _powers(int(_BASE), size + window)
    low = np.uint64((1 << BLOCK_BITS) - 1)
    for at in range(0, max(0, len(data) - window + 1), size):
        part = data[at : at + size + window - 1]
        h = _gram_hashes(part, gram, inverse, power)
        packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        place = (_sliding_min(packed, window - gram + 1) & low).astype(np.int64)
        start = np.arange(at, at + len(place))
        text = np.searchsorted(bounds, start, side="right") - 1
        ok = start + window <= bounds[text + 1]
        cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(text) != 0) | (np.diff(ok) != 0)) + 1
        first = np.concatenate(([0], cut))
        last = np.concatenate((cut, [len(place)])) - 1
        keep = ok[first]
        first, last = first[keep], last[keep]
        out.append((h[place[first]].view(np.int64), text[first], first + at, last + at, place[first] + at))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The data and offsets of a binary column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - (offsets[0] if len(offsets) else 0)


def two_stage_order(text: np.ndarray, joined: bytes, ends: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Places in `wanted` in the order of their suffixes, compared over `depth` bytes.

    text: bytes plus one, each piece ended by a zero; joined: the same bytes;
    ends: for each place, where its piece ends; wanted: mask that holds, with a
    place whose suffix is larger than its successor, that successor too.
    """
    n = len(text)
    differs = np.append(text[:-1] != text[1:], True)
    following = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    smaller = text == 0
    inner = following < n - 1
    smaller[inner] |= text[following[inner]] < text[following[inner] + 1]
    larger = wanted & ~smaller

    direct = np.flatnonzero(wanted & smaller)
    keys = [joined[a:b] for a, b in zip(direct.tolist(), np.minimum(direct + depth, ends[direct]).tolist(), strict=True)]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)]
    edges = np.searchsorted(text[direct], np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    for c in range(257):
        bucket = waiting[c]
        fresh = np.concatenate(bucket) if bucket else np.zeros(0, np.int64)
        bucket = [fresh]
        while len(fresh):
            before = fresh - 1
            fresh = before[larger[before] & (text[before] == c)]
            bucket.append(fresh)
        bucket.append(direct[edges[c] : edges[c + 1]])
        whole = np.concatenate(bucket)
        if not len(whole):
            continue
        out.append(whole)
        before = whole - 1
        before = before[larger[before] & (text[before] > c)]
        if len(before):
            chars = text[before]
            order = np.argsort(chars, kind="stable")
            before, chars = before[order], chars[order]
            cuts = np.flatnonzero(np.diff(chars)) + 1
            for x in np.split(before, cuts):
                waiting[text[x[0]]].append(x)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(joined: bytes, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix in the order and the next one, up to depth."""
    pairs = max(0, len(order) - 1)
    lcp = np.zeros(pairs, np.int64)
    buffer = np.frombuffer(joined + bytes(8), np.uint8)
    words = np.ndarray(len(joined) + 1, ">u8", buffer, strides=(1,))
    live = np.arange(pairs)
    a, b = order[:-1], order[1:]
    for k in range(0, depth - 7, 8):
        same = words[a[live] + k] == words[b[live] + k]
        rest = live[~same]
        for j in range(8):
            rest = rest[buffer[a[rest] + k + j] == buffer[b[rest] + k + j]]
            lcp[rest] += 1
        live = live[same]
        lcp[live] += 8
        if not len(live):
            return lcp
    for k in range(depth - depth % 8, depth):
        live = live[buffer[a[live] + k] == buffer[b[live] + k]]
        lcp[live] += 1
    return lcp


def repeated_starts(pieces: list[bytes], weights: list[int], window: int) -> list[np.ndarray]:
    """For each piece a mask of the starts whose window is repeated.

    A piece of n bytes has n - window + 1 starts. A weight over one says that
    the piece itself stands for more than one place.
    """
    joined = b"\0".join(pieces) + b"\0"
    sizes = np.array([len(p) for p in pieces])
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    number = np.repeat(np.arange(len(pieces)), sizes + 1)
    ends = (begin + sizes)[number]
    place = np.arange(len(joined)) - begin[number]
    text = np.frombuffer(joined, np.uint8).astype(np.int16) + 1
    text[begin + sizes] = 0
    start = place <= (sizes - window)[number]
    # A start larger than its successor needs the places up to the next that isn't.
    n = len(text)
    differs = np.append(text[:-1] != text[1:], True)
    following = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    nxt = np.minimum(following + 1, n - 1)
    smaller = (text == 0) | (text[np.minimum(following, n - 1)] < text[nxt])
    until = np.minimum.accumulate(np.where(smaller, np.arange(n), n)[::-1])[::-1]
    wanted = place <= (until[begin + sizes - window] - begin)[number]
    order = two_stage_order(text, joined, ends, wanted, window)
    order = order[start[order]]
    same = common_prefixes(joined, order, window) >= window
    hit = (np.array(weights) > 1)[number]
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    return [hit[b : b + s - window + 1] for b, s in zip(begin.tolist(), sizes.tolist(), strict=True)]


def _runs(mask: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by the ranges (end exclusive)."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _anchor_rows(window: int, gram: int):
    def rows(batches):
        for batch in batches:
            data, bounds = _bytes_of(batch.column("body"))
            h, text, lo, hi, at = anchors(data, bounds, window, gram)
            own = bounds[text]
            r1, r2 = (batch.column(c).to_numpy(zero_copy_only=False)[text] for c in ("r1", "r2"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(r1), pa.array(r2), *(pa.array((x - own).astype(np.int32)) for x in (lo, hi, at))],
                names=["h", "r1", "r2", "lo", "hi", "at"],
            )

    return rows


def _piece_rows(window: int):
    def rows(batches):
        for batch in batches:
            out = []
            for body, r1, r2, places in zip(*(batch.column(c).to_pylist() for c in ("body", "r1", "r2", "places")), strict=True):
                out += [(p["h"], p["hot"], r1, r2, p["lo"], p["at"] - p["lo"], body[p["lo"] : p["hi"] + window]) for p in places]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 7, _PIECES.types, strict=True)], schema=_PIECES)

    return rows


_PIECES = pa.schema([("k", pa.int64()), ("hot", pa.bool_()), ("r1", pa.int64()), ("r2", pa.int64()), ("lo", pa.int32()), ("turn", pa.int32()), ("piece", pa.binary())])
_PIECES_SQL = "k long, hot boolean, r1 long, r2 long, lo int, turn int, piece binary"


def _block_rows(window: int, step: int):
    """Cuts pieces around an anchor into blocks of `step` starts, each dealt by what all its windows have in common."""
    schema = pa.schema([("k", pa.int64()), ("turn", pa.int32()), ("piece", pa.binary()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("off", pa.int32())])

    def rows(batches):
        for batch in batches:
            out = []
            for h, body, turn, n, c1, c2 in zip(*(batch.column(c).to_pylist() for c in ("k", "piece", "turn", "n", "c1", "c2")), strict=True):
                last = len(body) - window
                for j in range((turn - last) // step, turn // step + 1):
                    high = turn - j * step
                    a, b = max(0, high - step + 1), min(last, high)
                    key = xxhash.xxh64_intdigest(body[high : high - step + 1 + window], seed=(h + j) & (2**64 - 1))
                    out.append((key - 2**64 if key >= 2**63 else key, turn - a, body[a : b + window], n, c1, c2, a))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 7, schema.types, strict=True)], schema=schema)

    return rows


def _sorted_rows(window: int, names: list[str]):
    """Suffix arrays over whole groups of k, which arrive in order; repeated ranges by row.

    Ranges are counted from the piece's first byte, plus `lo` where rows have one.
    """
    kinds = [pa.int64()] * len(names) + [pa.int32()] * 2

    def finish(rows):
        index: dict[bytes, int] = {}
        of = [index.setdefault(r[0], len(index)) for r in rows]
        weights = [0] * len(index)
        for i, r in zip(of, rows, strict=True):
            weights[i] += r[1]
        runs = [list(_runs(m)) for m in repeated_starts(list(index), weights, window)]
        found = [(*r[3], a + r[2], b - 1 + window + r[2]) for i, r in zip(of, rows, strict=True) for a, b in runs[i]]
        cols = list(zip(*found, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[*names, "s", "e"])

    def rows(batches):
        held, size, last = [], 0, None  # rows of whole groups, their bytes
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            n = len(cols["k"])
            more = zip(cols["k"], cols["piece"], cols.get("n", [1] * n), cols.get("lo", [0] * n), zip(*(cols[c] for c in names), strict=True), strict=True)
            for k, *r in more:
                if size > CHUNK and k != last:
                    yield finish(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[0])
                last = k
        if held:
            yield finish(held)

    return rows


def _kept_rows(whole: bool):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), *[pa.binary()] * whole]
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *["kept"] * whole]

    def rows(batches):
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for body, ranges in zip(batch.column("body").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                spans = merged([(r["s"], r["e"]) for r in ranges or ()])
                view, cuts = memoryview(body), [0, *(x for s in spans for x in s), len(body)]
                parts = [view[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
                digest = hashlib.sha256()
                for part in parts:
                    digest.update(part)
                row = (len(body), sum(b - a for a, b in spans), len(spans), digest.hexdigest(), [{"start": a, "end": b} for a, b in spans], b"".join(parts))
                for c, v in zip(out, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], names=["doc_id", *names])

    return rows


def _digests(prefix: str):
    return [F.xxhash64("k", "turn", "piece").alias(f"{prefix}1"), F.xxhash64(F.lit(1), "piece", "turn", "k").alias(f"{prefix}2")]


def _block_ranges(pieces: DataFrame, window: int, steps: tuple[int, ...], most: int) -> DataFrame:
    """Repeated ranges of different pieces (k, turn, piece, n) that share an anchor: c1, c2, ranges.

    Pieces of a block are counted before they are sorted; a block that still has
    more than `most` of them is cut by the next step.
    """
    spark = pieces.sparkSession
    blocks = pieces.select("k", "turn", "piece", "n", *_digests("c")).mapInArrow(_block_rows(window, steps[0]), "k long, turn int, piece binary, n long, c1 long, c2 long, off int")
    blocks = written(blocks.select("k", "turn", "piece", "n", "c1", "c2", "off", *_digests("d")), "blocks")
    distinct = blocks.groupBy("k", "turn", "piece").agg(F.sum("n").alias("n"))
    ranges, large = None, None
    if len(steps) > 1:
        distinct = written(distinct, "distinct")
        large = written(distinct.groupBy("k").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("k"), "large")
        if large.isEmpty():
            large = None
        else:
            ranges = _block_ranges(distinct.join(large, "k"), window, steps[1:], most)
            ranges = ranges.select(F.col("c1").alias("d1"), F.col("c2").alias("d2"), F.explode("ranges").alias("x")).select("d1", "d2", "x.s", "x.e")
            distinct = distinct.join(large, "k", "left_anti")
    found = (
        distinct.select("k", "piece", "n", *_digests("d"))
        .repartition("k")
        .sortWithinPartitions("k")
        .mapInArrow(_sorted_rows(window, ["d1", "d2"]), "d1 long, d2 long, s int, e int")
    )
    found = found if ranges is None else found.unionByName(ranges)
    out = (
        blocks.select("d1", "d2", "c1", "c2", "off")
        .join(found, ["d1", "d2"])
        .groupBy("c1", "c2")
        .agg(F.collect_set(F.struct((F.col("off") + F.col("s")).alias("s"), (F.col("off") + F.col("e")).alias("e"))).alias("ranges"))
    )
    out = written(out, "ranges")
    dropped(blocks)
    released(spark)
    return out


def _hot_ranges(pieces: DataFrame, window: int, most: int) -> DataFrame:
    """Repeated ranges of the stretches around hot anchors: r1, r2, s, e.

    Equal stretches are counted and only one goes on. What is found returns from
    blocks to stretches, and from these to all their places.
    """
    stretches = pieces.groupBy("k", "turn", "piece").agg(F.count("*").alias("n"))
    ranges = _block_ranges(stretches, window, HOT_STEPS, most)
    places = pieces.select(*_digests("c"), "r1", "r2", "lo")
    many = places.groupBy("c1", "c2").agg(F.ceil(F.count("*") / PLACES).alias("parts")).where("parts > 1")
    many = written(many, "many")
    # A stretch with many places has its ranges several times, so that its places can be dealt apart.
    few = F.broadcast(many) if many.count() <= BROADCAST_STRETCHES else many
    part = F.pmod(F.xxhash64("r1", "r2", "lo"), F.coalesce("parts", F.lit(1))).alias("part")
    places = places.join(few, ["c1", "c2"], "left").select("c1", "c2", part, "r1", "r2", "lo")
    ranges = ranges.join(few, ["c1", "c2"], "left").select("c1", "c2", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "ranges")
    places = places.join(ranges, ["c1", "c2", "part"]).select("r1", "r2", "lo", F.explode("ranges").alias("x"))
    return places.select("r1", "r2", (F.col("lo") + F.col("x.s")).alias("s"), (F.col("lo") + F.col("x.e")).alias("e"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_rows: int = HOT_ROWS, hot_pieces: int = HOT_PIECES, whole: bool = False) -> DataFrame:
    """Per document the byte spans covered by `window`-byte strings that also start elsewhere.

    docs has doc_id (long) and text; other columns are left out. A null text is
    empty; texts shorter than the window have no spans. Repeated rows repeat each
    other, so each of two equal rows loses all its bytes if long enough, and each
    row comes back. An empty table gives an empty result. A null doc_id is kept.
    Texts of any length are whole; anchors are sought in blocks of 131,072 bytes
    that overlap by a window.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end in
    bytes) and, with `whole`, kept (the remaining bytes).
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.col("text").cast("binary").alias("body"), *row_key("doc_id", "text"))

    places = written(
        rows.where(F.length("body") >= window)
        .select("r1", "r2", "body")
        .mapInArrow(_anchor_rows(window, gram), "h long, r1 long, r2 long, lo int, hi int, at int"),
        "anchors",
    )
    seen = written(places.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "seen")
    chosen = written(
        places.join(seen, "h")
        .groupBy("r1", "r2")
        .agg(F.collect_set(F.struct("h", "lo", "hi", "at", (F.col("n") > hot_rows).alias("hot"))).alias("places")),
        "chosen",
    )
    dropped(places)
    dropped(seen)
    released(spark)
    pieces = written(rows.select("r1", "r2", "body").join(chosen, ["r1", "r2"]).mapInArrow(_piece_rows(window), _PIECES_SQL), "pieces")
    dropped(chosen)
    released(spark)

    plain = (
        pieces.where("not hot")
        .select("k", "piece", "lo", "r1", "r2")
        .repartition("k")
        .sortWithinPartitions("k")
        .mapInArrow(_sorted_rows(window, ["r1", "r2"]), "r1 long, r2 long, s int, e int")
    )
    found = written(plain.unionByName(_hot_ranges(pieces.where("hot"), window, hot_pieces)), "repeats")
    dropped(pieces)
    released(spark)

    ranges = found.distinct().groupBy("r1", "r2").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>" + ", kept binary" * whole
    return rows.join(ranges, ["r1", "r2"], "left").select("doc_id", "body", "ranges").mapInArrow(_kept_rows(whole), kinds)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document the bytes that remain: doc_id, kept (binary).

    Each row comes back once, repeated rows, null doc_ids and null texts (no bytes)
    included; an empty table gives an empty result. Texts of any length are whole.
    """
    return repeated_spans(docs, window, whole=True).select("doc_id", "kept")


def query(spark, sf_dir):
    from quillmere.llm.common import table

    return repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


#: The contract in DuckDB's words, window by window; texts as hex digits, since blobs have no substrings there.
ORACLE = """
with d as (select row_number() over (order by doc_id) as r, doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
w as (select r, i, md5(substr(h, 2 * i + 1, 400)) as g from (select r, h, unnest(range(0, n - 199)) as i from d where n >= 200)),
s as (select r, i from (select r, i, count(*) over (partition by g) as c from w) where c > 1),
isl as (select r, i, sum(case when i - prev <= 200 then 0 else 1 end) over (partition by r order by i) as k from (select r, i, lag(i) over (partition by r order by i) as prev from s)),
sp as (select r, k, min(i) as a, max(i) + 200 as b from isl group by r, k),
parts as (select r, coalesce(lag(b) over (partition by r order by a), 0) as x, a as y from sp union all select d.r, coalesce(t.b, 0), d.n from d left join (select r, max(b) as b from sp group by r) t on t.r = d.r),
kept as (select parts.r, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' order by x) as k from parts join d on d.r = parts.r group by parts.r),
sums as (select r, sum(b - a) as n_removed, count(*) as n_spans from sp group by r)
select doc_id, n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(k)) as kept_sha256 from d join kept using (r) left join sums using (r)
"""
