"""SimHash near-dedup: fingerprints, shards of vantage-point trees, exact pairs, connected components.

Two fingerprints within ``RADIUS`` = 3 bits are within 1 bit on one of the two
32-bit halves. For each half a tree of vantage points splits the fingerprints
by their Hamming distance to the vantage point on that half. A fingerprint is
stored in one leaf; as a query it goes, by the triangle bound, also to every
leaf beyond a boundary that is at most one bit away. In a leaf a local tree
prunes on, and what is left is compared on all 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.common import settle, slices, text_bytes, whole

RADIUS = 3
HALF_RADIUS = RADIUS // 2
SAMPLE = 16_384  # fingerprints on the driver to place the vantage points, or PER_LEAF for each leaf
PER_LEAF = 4
LEAF = 4_096  # stored fingerprints per shard that the tree aims at
DEEPEST = 20  # levels of the tree over all shards, for 4e9 fingerprints; local trees split on
BLOCK = 32_768  # rows of a leaf that one task compares with one block of queries
SMALL = 128
SEED = 42
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, width: int = 3, seed: int = SEED) -> int:
    """SimHash of the word shingles of a text, as unsigned 64 bits; 0 without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-width]]).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[a : a + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``text_hash`` and ``fp`` (long, the fingerprint's bits) of every whole text; null counts as empty."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", 8 << 20):
                data, at = text_bytes(part.column("__text"))
                blob = data.tobytes()
                fp = np.array([fingerprint(blob[a:b]) for a, b in zip(at[:-1], at[1:])], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), part.column("text_hash"), pa.array(fp.view(np.int64))], [key, "text_hash", "fp"]
                )

    rows = docs.select(key, whole(text).alias("__text")).withColumn("text_hash", F.xxhash64("__text"))
    return rows.mapInArrow(run, f"`{key}` {kind}, text_hash long, fp long")


def half(fp: np.ndarray, view: int) -> np.ndarray:
    return (fp.view(np.uint64) >> np.uint64(32 * view)).astype(np.uint32)


class Tree:
    """Vantage points of one half: complete to ``depth``, leaf numbers in level order."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.point = np.zeros(1 << depth, np.uint32)
        self.cut = np.full(1 << depth, 16, np.int16)
        node = np.ones(len(sample), np.int64)
        for level in range(depth):
            order = np.argsort(node, kind="stable")
            sample, node = sample[order], node[order]
            own, first, many = np.unique(node, return_index=True, return_counts=True)
            group = np.repeat(np.arange(len(own)), many)
            # The vantage point that spreads distances most, of a few candidates.
            best, far, spread = np.zeros(len(own), np.uint32), np.zeros(len(sample), np.int16), np.full(len(own), -1.0)
            for k in range(8):
                tried = sample[first + k * many // 8]
                d = np.bitwise_count(sample ^ tried[group]).astype(np.int16)
                mean = np.bincount(group, d) / many
                width = np.bincount(group, d.astype(np.int64) ** 2) / many - mean**2
                better = width > spread
                best[better], spread[better] = tried[better], width[better]
                far = np.where(better[group], d, far)
            ranked = np.lexsort((far, group))
            self.point[own], self.cut[own] = best, far[ranked[first + (many - 1) // 2]]
            node = 2 * node + (far > self.cut[node])

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf in which each value is stored."""
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (np.bitwise_count(x ^ self.point[node]) > self.cut[node])
        return node

    def reached(self, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that can hold a value within ``radius``: the triangle bound."""
        row, node = np.arange(len(x)), np.ones(len(x), np.int64)
        for _ in range(self.depth):
            d = np.bitwise_count(x[row] ^ self.point[node]).astype(np.int16)
            left, right = d - radius <= self.cut[node], d + radius > self.cut[node]
            row = np.concatenate([row[left], row[right]])
            node = np.concatenate([2 * node[left], 2 * node[right] + 1])
        return row, node


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that keep the components of (a, b): each value with the smallest of its component."""
    ids, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(nxt := new[new], new):
            new = nxt
        if np.array_equal(new, root):
            break
        root = new
    keep = root != np.arange(len(ids))
    return ids[keep], ids[root[keep]]


def pairs_within(stored: np.ndarray, asked: np.ndarray, view: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links between asked and stored fingerprints, as a forest: a local vantage-point tree on one half."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def add(a, b):
        nonlocal count, held
        held.append((a, b))
        count += len(a)
        if count > 1 << 20:
            held = [forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))]
            count = len(held[0][0])

    todo = [(stored, asked)]
    while todo:
        s, q = todo.pop()
        if not len(s) or not len(q):
            continue
        if len(s) > SMALL:
            hs, hq = half(s, view), half(q, view)
            tries = hs[:: max(1, len(hs) // 6)][:6]
            far = [np.bitwise_count(hs ^ v) for v in tries]
            best = max(range(len(tries)), key=lambda i: far[i].std())
            cut = int(np.median(far[best]))
            near = far[best] <= cut
            if near.any() and not near.all():
                d = np.bitwise_count(hq ^ tries[best]).astype(np.int16)
                to_near, to_far = d - HALF_RADIUS <= cut, d + HALF_RADIUS > cut
                work = near.sum() * to_near.sum() + (~near).sum() * to_far.sum()
                if work < 0.9 * len(s) * len(q):
                    todo += [(s[near], q[to_near]), (s[~near], q[to_far])]
                    continue
        step = max(1, (1 << 21) // len(s))
        for i in range(0, len(q), step):
            part = q[i : i + step]
            r, c = np.nonzero(np.bitwise_count(part.view(np.uint64)[:, None] ^ s.view(np.uint64)[None, :]) <= radius)
            other = part[r] != s[c]
            if other.any():
                add(part[r[other]], s[c[other]])
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that keep the components of all pairs of distinct ``fp`` within ``radius`` bits.

    ``fps`` has one row per distinct fingerprint. A bounded sample places the
    vantage points; all fingerprints go through the shards. Leaves above
    ``BLOCK`` rows are compared block by block, each in a task of its own.
    """
    if radius > RADIUS:
        raise ValueError(f"halves are searched within {HALF_RADIUS} bit, enough for {RADIUS} in all")
    n = fps.count()
    depth = min(DEEPEST, max(0, math.ceil(math.log2(max(n, 1) / LEAF))))
    wanted = max(SAMPLE, PER_LEAF << depth)
    share = min(1.0, wanted / max(n, 1))
    drawn = fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * wanted).toPandas()
    sample = np.sort(drawn["fp"].to_numpy(np.int64))
    np.random.default_rng(SEED).shuffle(sample)
    trees = fps.sparkSession.sparkContext.broadcast([Tree(half(sample, v), depth) for v in (0, 1)])

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fp = frame["fp"].to_numpy(np.int64)
            for v, tree in enumerate(trees.value):
                at = tree.leaf(half(fp, v))
                yield pd.DataFrame({"view": v, "leaf": at, "asks": False, "fp": fp})
                row, at = tree.reached(half(fp, v), HALF_RADIUS)
                yield pd.DataFrame({"view": v, "leaf": at, "asks": True, "fp": fp[row]})

    placed = settle(fps.select("fp").mapInPandas(place, "view int, leaf long, asks boolean, fp long"))
    sizes = placed.groupBy("view", "leaf").agg(
        F.ceil(F.count(F.when(~F.col("asks"), 1)) / BLOCK).cast("int").alias("stored"),
        F.ceil(F.count(F.when(F.col("asks"), 1)) / (4 * BLOCK)).cast("int").alias("asked"),
    )
    # Two rows a leaf: broadcast while they are few.
    cut = placed.join(F.broadcast(sizes) if depth <= 14 else sizes, ["view", "leaf"])
    own = lambda n: F.array(F.pmod(F.xxhash64("fp"), F.greatest(F.col(n), F.lit(1))).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1)
    spread = cut.select(
        "view", "leaf", "asks", "fp",
        F.when(F.col("asks"), every("stored")).otherwise(own("stored")).alias("s"),
        F.when(F.col("asks"), own("asked")).otherwise(every("asked")).alias("q"),
    ).withColumn("s", F.explode("s")).withColumn("q", F.explode("q"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        fp, asks = frame["fp"].to_numpy(np.int64), frame["asks"].to_numpy(bool)
        a, b = pairs_within(fp[~asks], fp[asks], int(frame["view"].iloc[0]), radius)
        return pd.DataFrame({"a": a, "b": b})

    return spread.groupBy("view", "leaf", "s", "q").applyInPandas(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of undirected links (a, b).

    Alternating large and small stars: every node sends its larger, then its
    smaller neighbours to the smallest one. Each round is written to the shared folder.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = settle(e)
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settle(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            joined.select("u", F.col("m").alias("v"))
        ).where("u <> v").distinct()
        e = settle(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def rooted(fps: DataFrame, key: str) -> DataFrame:
    """(fp, low, root): every distinct fingerprint, its smallest key and the name of its component."""
    classes = settle(fps.groupBy("fp").agg(F.min(key).alias("low")))
    linked = components(links(classes))
    return classes.join(linked, classes["fp"] == linked["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest key reachable over links of at most 3
    differing bits. Texts without words share fingerprint zero. Equal
    fingerprints are one class before the search, so copies never meet each
    other as pairs. A null key never names a component unless all its keys are null.
    """
    fps = settle(fingerprints(docs, key, text))
    named = rooted(fps, key)
    best = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_class = named.join(best, "root").select(F.col("fp").alias("__fp"), "component_id")
    return fps.join(by_class, F.col("fp") == F.col("__fp")).select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The input rows that stay, with all their columns: one per component, that of the smallest key.

    Null keys come last; rows that share key and text leave one of them.
    """
    fps = settle(fingerprints(docs, key, text))
    named = rooted(fps, key).select(F.col("fp").alias("__fp"), "root")
    order = F.struct(F.col(key).isNull(), F.col(key).alias("k"), F.col("text_hash").alias("h"))
    first = fps.join(named, F.col("fp") == F.col("__fp")).groupBy("root").agg(F.min(order).alias("o"))
    keep = settle(first.select(F.col("o.k").alias("__key"), F.col("o.h").alias("__keep")))
    rows = docs.withColumn("__hash", F.xxhash64(whole(text)))
    met = rows.join(keep, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__hash") == F.col("__keep")))
    nth = F.row_number().over(Window.partitionBy(key, "__hash").orderBy(F.lit(0)))
    return met.withColumn("__nth", nth).where("__nth = 1").select(*docs.columns)
