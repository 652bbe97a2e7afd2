"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints of equal texts are equal, so the index holds each fingerprint
once. Two fingerprints at most `bits` apart agree in at least three of five
stretches when bits is two, so each is sent once for every three stretches; all
that agree there meet, and that shared masked pattern is the top node of a
small tree. Below it, fingerprints stand in the order of their Gray rank and
are cut into groups; each node keeps the bits that all below it share, less
those its parent has. A search adds up differences going down and leaves a
whole group out as soon as there are too many. Tasks report a spanning forest
of the links they find, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.llm.common import dropped, row_key, table, written
from quillmere.llm.components import components

SHINGLE = 3
BITS = 2
#: Stretches in which fingerprints that are to meet agree.
AGREE = 3
#: To find near copies: words of a fingerprint's shingles, bits, stretches; words of the shingles compared, and their likeness.
NEAR = {"shingle": 2, "bits": 7, "agree": 2}
WORDS = 5
LIKE = 0.8
#: Children of a node, and fingerprints of a lowest group.
FAN = 8
#: Shingles hashed at a time, and searches that go down a tree at a time.
STEP = 1 << 16
FRONT = 1 << 18
#: Fingerprints of a group that needs no tree.
LEAF = 32
#: Texts of a group, and their shingles, that are compared with each other at a time; Spark cuts ranks of up to 1000 on arrival.
HEADS = 1000
HELD = 1 << 20
#: Texts that are compared with all that stay at a time, and shingles of theirs looked up at a time.
BLOCK = 64
LOOKED = 1 << 13


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, repeats included; no words: zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingle = min(shingle, len(words))
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    first, last = begins[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), STEP):
        h = np.array([digest(flat[a:b], 42) for a, b in zip(first[at : at + STEP], last[at : at + STEP], strict=True)], ">u8")
        ones += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(first)).tobytes())


def _fingerprint_rows(shingle: int):
    def rows(batches):
        for batch in batches:
            # One text at a time is a Python string; a batch may hold many long ones.
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(fp.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])

    return rows


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Tree over distinct fingerprints in Gray order; see the module's text.

    levels: from the top, for each node its own shared bits, their values, and
    where its children begin; a lowest node's children are fingerprints.
    """

    def __init__(self, fps: np.ndarray, fan: int = FAN):
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        full = np.uint64(2**64 - 1)
        ones = zeros = self.fps  # bits that are one in all below, and in any below
        begins, levels = np.arange(0, len(fps), fan), []
        while True:
            ones, zeros = np.bitwise_and.reduceat(ones, begins), np.bitwise_or.reduceat(zeros, begins)
            levels.append([full ^ (ones ^ zeros), ones, begins])
            if len(begins) == 1:
                break
            begins = np.arange(0, len(begins), fan)
        self.levels = levels[::-1]
        self.fan = fan
        for parent, child in zip(self.levels[-2::-1], self.levels[:0:-1], strict=True):
            above = np.repeat(parent[0], fan)[: len(child[0])]
            child[0] = child[0] & ~above

    def near(self, bits: int):
        """Pairs of places in fps at most `bits` apart, some at a time; each pair once."""
        for at in range(0, len(self.fps), STEP):
            q = np.arange(at, min(len(self.fps), at + STEP))
            yield from self._down(0, q, np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), bits)

    def _down(self, level: int, q: np.ndarray, node: np.ndarray, apart: np.ndarray, bits: int):
        if len(q) > FRONT:
            for at in range(0, len(q), FRONT):
                yield from self._down(level, q[at : at + FRONT], node[at : at + FRONT], apart[at : at + FRONT], bits)
            return
        mask, ones, _ = self.levels[level]
        apart = apart + np.bitwise_count((self.fps[q] ^ ones[node]) & mask[node])
        keep = apart <= bits
        q, node, apart = q[keep], node[keep], apart[keep]
        lowest = level == len(self.levels) - 1
        size = len(self.fps) if lowest else len(self.levels[level + 1][0])
        child = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
        q, apart = np.repeat(q, self.fan), np.repeat(apart, self.fan)
        ok = child < size
        q, child, apart = q[ok], child[ok], apart[ok]
        if not lowest:
            if len(q):
                yield from self._down(level + 1, q, child, apart, bits)
            return
        hit = (q < child) & (np.bitwise_count(self.fps[q] ^ self.fps[child]) <= bits)
        if hit.any():
            yield q[hit], child[hit]


def _united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after linking a and b, place by place; a root is the smallest place of its tree."""
    while True:
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        if (ra == rb).all():
            return root
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while (root != root[root]).any():
            root = root[root]


def spanning_links(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the pairs at most `bits` apart join: at most one for each fingerprint."""
    index = GrayIndex(fps)
    root = np.arange(len(fps))
    for a, b in index.near(bits):
        root = _united(root, a, b)
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return index.fps[moved], index.fps[root[moved]]


def leaf_links(fps: np.ndarray, group: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for many groups so small that each is one lowest group of the tree; equal group numbers are neighbours."""
    root = np.arange(len(fps))
    for d in range(1, len(fps)):
        a = np.flatnonzero(group[d:] == group[:-d])
        if not len(a):
            break
        a = a[np.bitwise_count(fps[a] ^ fps[a + d]) <= bits]
        root = _united(root, a, a + d)
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return fps[moved], fps[root[moved]]


def _link_rows(bits: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def linked(fps, sizes):
        """Links of whole groups, one after another."""
        group = np.repeat(np.arange(len(sizes)), sizes)
        small = np.repeat(sizes <= LEAF, sizes)
        found = [leaf_links(fps[small], group[small], bits)]
        begin = np.cumsum(sizes) - sizes
        found += [spanning_links(fps[b : b + n], bits) for b, n in zip(begin.tolist(), sizes.tolist(), strict=True) if n > LEAF]
        u, v = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=schema)

    def rows(batches):
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate((h, batch.column(c).to_numpy(zero_copy_only=False))) for h, c in zip(held, ("combo", "key", "fp"), strict=True)]
            combo, key, fp = held
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(combo) != 0)) + 1
            if len(cuts):  # the last group may go on in the next batch
                yield linked(fp[: cuts[-1]].view(np.uint64), np.diff(cuts, prepend=0))
                held = [h[cuts[-1] :] for h in held]
        if len(held[2]):
            yield linked(held[2].view(np.uint64), np.array([len(held[2])]))

    return rows


def link_forest(prints: DataFrame, bits: int = BITS, agree: int = AGREE) -> DataFrame:
    """Links (u, v) that connect distinct fingerprints (fp: long) as their pairs at most `bits` apart do.

    Of bits + agree stretches any two such fingerprints share `agree`, so each
    fingerprint is dealt out once for each choice of so many stretches.
    """
    parts = bits + agree
    cuts = [64 * i // parts for i in range(parts + 1)]
    masks = [sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen) for chosen in combinations(range(parts), agree)]
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("combo"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed))))
    dealt = prints.select("fp", keys.alias("k")).select("k.combo", "k.key", "fp")
    return dealt.repartition("combo", "key").sortWithinPartitions("combo", "key").mapInArrow(_link_rows(bits), "u long, v long")


def classes(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """Per row r1, r2 (which name it by contents), doc_id, fp and the component_id; see near_duplicates."""
    prints = written(
        docs.select(*row_key("doc_id", "text"), "doc_id", "text").mapInArrow(_fingerprint_rows(shingle), "r1 long, r2 long, doc_id long, fp long"),
        "fingerprints",
    )
    found = components(link_forest(prints.select("fp").distinct(), bits))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = least.join(found, least["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(smallest, "root").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """Per document its SimHash and the smallest doc_id that its links reach.

    docs has doc_id (long) and text; other columns are left out. Null and empty
    texts have the fingerprint zero and are linked like any other. Fewer words
    than a shingle make one shingle. A bit set in exactly half the hashes is not
    set. Texts of any length are whole, hashed 65,536 shingles at a time. Repeated
    rows stay. A null doc_id counts only where a component has no other. An empty
    table gives an empty result.

    Returns doc_id, fingerprint (16 hex digits), component_id.
    """
    return classes(docs, shingle, bits).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _shingle_rows(words: int):
    """Different hashes of each text's shingles, in order."""
    schema = pa.schema([("r1", pa.int64()), ("r2", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def rows(batches):
        for batch in batches:
            for r1, r2, text in zip(*(batch.column(c) for c in ("r1", "r2", "text")), strict=True):
                own = (text.as_py() or "").encode().lower().split()
                n = min(words, len(own))
                found = np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(own[i : i + n])) for i in range(len(own) - n + 1)), np.uint64)) if n else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array([r1.as_py()]), pa.array([r2.as_py()]), pa.array([found.view(np.int64)], schema.field("shingles").type)], schema=schema)

    return rows


_FIRST = ("none", "doc_id", "r1", "r2")
_OPEN = ("root", *_FIRST, "size", "shingles")


class Sets:
    """Sets of hashes of which many are compared: frequent hashes by a matrix product, all others by their owners."""

    def __init__(self, sets: pa.ChunkedArray):
        self.sizes = np.concatenate([np.zeros(0, np.int64), *(pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in sets.chunks)])
        flat = np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy() for c in sets.chunks)])
        n = len(self.sizes)
        _, ids, counts = np.unique(flat, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(n), self.sizes)
        often = counts > max(16, n // 8)
        dense, column = often[ids], np.cumsum(often) - 1
        self.dense = np.zeros((n, int(often.sum())), np.float32)
        self.dense[owner[dense], column[ids[dense]]] = 1
        rare = ~dense & (counts > 1)[ids]
        self.owner, self.ids = owner[rare], ids[rare]
        self.begin = np.searchsorted(self.owner, np.arange(n + 1))
        order = np.argsort(self.ids, kind="stable")
        self.owners, self.first = self.owner[order], np.searchsorted(self.ids[order], np.arange(len(counts) + 1))

    def alike(self, a: int, b: int, cols: np.ndarray, like: float) -> np.ndarray:
        """For sets a to b and each of cols, whether their Jaccard likeness is `like` or more; two empty sets are like each other."""
        shared = (self.dense[a:b] @ self.dense[cols].T).astype(np.int64)
        place = np.full(len(self.sizes), -1)
        place[cols] = np.arange(len(cols))
        for at in range(self.begin[a], self.begin[b], LOOKED):
            to = min(at + LOOKED, self.begin[b])
            first = self.first[self.ids[at:to]]
            many = self.first[self.ids[at:to] + 1] - first
            ends = np.cumsum(many)
            other = place[self.owners[np.arange(ends[-1]) + np.repeat(first - ends + many, many)]]
            pair = np.repeat(self.owner[at:to] - a, many) * len(cols) + other
            shared += np.bincount(pair[other >= 0], minlength=shared.size).reshape(shared.shape)
        return shared >= like * (self.sizes[a:b, None] + self.sizes[cols] - shared)


def _unlike(like: float):
    """Of a group's first texts, in order, those that are like none before that stays."""

    def run(texts: pa.Table) -> pa.Table:
        texts = texts.sort_by("n")
        sets, kept = Sets(texts["shingles"]), np.zeros(0, np.int64)
        for a in range(0, len(texts), BLOCK):
            own = np.arange(a, min(a + BLOCK, len(texts)))
            near = sets.alike(a, a + len(own), np.concatenate((kept, own)), like)
            gone, near, stays = near[:, : len(kept)].any(1), near[:, len(kept) :], []
            for i in range(len(own)):
                if not gone[i] and not near[i, stays].any():
                    stays.append(i)
            kept = np.concatenate((kept, own[stays]))
        return texts.take(pa.array(kept)).select(["root", "r1", "r2", "shingles"])

    return run


def _like_none(like: float):
    """Of some later texts of a group, those that are like none of its leaders."""

    def run(texts: pa.Table, leaders: pa.Table) -> pa.Table:
        sets = Sets(pa.chunked_array([*leaders["shingles"].chunks, *texts["shingles"].chunks], texts.schema.field("shingles").type))
        n, leads = len(leaders), np.arange(len(leaders))
        stays = [np.zeros(0, bool)]
        for a in range(n, n + len(texts), BLOCK):
            stays.append(~sets.alike(a, min(a + BLOCK, n + len(texts)), leads, like).any(1))
        return texts.filter(pa.array(np.concatenate(stays))).select(list(_OPEN))

    return run


def one_of_each(docs: DataFrame, words: int = WORDS, like: float = LIKE) -> DataFrame:
    """The documents, all columns, without those that are near copies of one that stays.

    Candidates are groups linked by fingerprints of two-word shingles at most seven
    bits apart. In each, the text with the smallest doc_id stays, and those go whose
    word shingles are like its own (Jaccard of the different ones, `like` or more);
    what is left of the group goes on with its smallest doc_id, until nothing is.
    So no text goes but for one that stays and is like it. A bounded number of texts
    and shingles is compared in one task, and all others of the group, cut into
    pieces, with those that stay of them; a group takes a round for each thousand of
    its unlike texts (or million of their shingles).

    Of equal texts, null and empty ones being equal, one row stays, that with the
    smallest doc_id, a null doc_id last, then by a hash of the row. Fewer words than
    a shingle make one. Texts of any length are whole; a text's shingles are held
    at a time. Columns may have any names but those that begin with `_qm_`. An empty
    table stays empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = row_key("doc_id", text)
    prints = docs.select(*keys, "doc_id", F.xxhash64(text).alias("t"), "text").mapInArrow(_fingerprint_rows(NEAR["shingle"]), "r1 long, r2 long, doc_id long, t long, fp long")
    prints = written(prints, "fingerprints")
    found = components(link_forest(prints.select("fp").distinct(), NEAR["bits"], NEAR["agree"]))
    rooted = prints.join(found, prints["fp"] == found["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2")).alias("first")
    kinds = written(rooted.groupBy("root", "fp", "t").agg(first).select("root", "first"), "kinds")
    several = written(kinds.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root"), "several")
    stay = kinds.join(several, "root", "left_anti").select("first.r1", "first.r2")
    open_ = kinds.join(several, "root", "left_semi").select("root", "first.*")
    texts = docs.select(*keys, "text").join(open_.select("r1", "r2"), ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"])
    shingled = texts.mapInArrow(_shingle_rows(words), "r1 long, r2 long, shingles array<long>")
    open_ = written(open_.join(shingled, ["r1", "r2"]).withColumn("size", F.size("shingles")).select(*_OPEN), "open")
    first, order = F.struct(*_FIRST), Window.partitionBy("root").orderBy(*_FIRST)
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    types = "root long, none boolean, doc_id long, r1 long, r2 long, size int, shingles array<long>"
    while not open_.isEmpty():
        heads = open_.withColumn("n", F.row_number().over(order)).where(F.col("n") <= HEADS).withColumn("before", before).where(F.col("before") < HELD)
        heads = written(heads.select(*_OPEN, "n"), "heads")
        leads = heads.select("root", "n", "r1", "r2", "shingles").groupBy("root").applyInArrow(_unlike(like), "root long, r1 long, r2 long, shingles array<long>")
        leads = written(leads, "leaders")
        stay = stay.unionByName(leads.select("r1", "r2"))
        later = open_.join(heads.groupBy("root").agg(F.max(first).alias("upto")), "root").where(first > F.col("upto"))
        cuts = later.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / HEADS, F.sum("size") / HELD)).alias("pieces"))
        cuts = written(cuts, "cuts")
        texts = later.join(cuts, "root").withColumn("piece", F.pmod("r1", "pieces"))
        led = leads.join(cuts, "root").select("root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), "shingles")
        pairs = texts.select("piece", *_OPEN).groupBy("root", "piece").cogroup(led.groupBy("root", "piece"))
        rest = written(pairs.applyInArrow(_like_none(like), types), "open")
        dropped(heads)
        dropped(open_)
        open_ = rest
    held = stay.select(F.col("r1").alias("_qm_r1"), F.col("r2").alias("_qm_r2"))
    named = [k.alias(f"_qm_r{i}") for i, k in enumerate(keys, 1)]
    return docs.select("*", *named).join(held, ["_qm_r1", "_qm_r2"], "left_semi").dropDuplicates(["_qm_r1", "_qm_r2"]).select(*docs.columns)


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
