"""Benchmark decontamination by greedy string tiling of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import settle, slices, whole
from tandem.llm.words import Hasher, grams

LEAST = 5  # words of the shortest tile
COVERAGE = 0.8
FILTER_BITS = 24
START = 20  # first search length


def windows(h: np.ndarray, free: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hashes of the windows without a marked word, and where they start."""
    if len(h) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    taken = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(taken[width:] == taken[:-width])
    return grams(h, width)[at], at


def matches(a: np.ndarray, b: np.ndarray, fa: np.ndarray, fb: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(length, i, j) of the maximal unmarked common runs of ``width`` words or more."""
    ha, ia = windows(a, fa, width)
    hb, ib = windows(b, fb, width)
    order = np.argsort(hb, kind="stable")
    low, high = np.searchsorted(hb[order], ha, "left"), np.searchsorted(hb[order], ha, "right")
    found = []
    for k in np.flatnonzero(high > low):
        i = int(ia[k])
        js = ib[order[low[k] : high[k]]]
        if i:
            before = js > 0
            same = before & (b[js - 1] == a[i - 1]) & fb[js - 1] & fa[i - 1]
            js = js[~same]
        for j in js.tolist():
            n = min(len(a) - i, len(b) - j)
            stop = (a[i : i + n] != b[j : j + n]) | ~fa[i : i + n] | ~fb[j : j + n]
            n = int(stop.argmax()) if stop.any() else n
            if n >= width:
                found.append((n, i, j))
    return found


def tiles(item: np.ndarray, text: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(item word, text word, length) of the tiles: longest first, none overlapping another on either side."""
    least = max(1, min(least, len(item)))
    free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool)
    out: list[tuple[int, int, int]] = []
    width = max(least, min(START, len(item)))
    while True:
        found = matches(item, text, free_i, free_t, width)
        longest = max((n for n, _, _ in found), default=0)
        if longest > 2 * width:
            width = longest
            continue
        queue: dict[int, list[tuple[int, int]]] = {}
        for n, i, j in found:
            queue.setdefault(n, []).append((i, j))
        for n in range(longest, width - 1, -1):
            for i, j in sorted(queue.pop(n, [])):
                clear = free_i[i : i + n] & free_t[j : j + n]
                if clear.all():
                    free_i[i : i + n] = free_t[j : j + n] = False
                    out.append((i, j, n))
                    continue
                # Taken in part by a longer tile: what is left goes back to the queue.
                edges = np.flatnonzero(np.diff(np.concatenate([[0], clear.view(np.int8), [0]])))
                for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    if width <= e - s < n:
                        queue.setdefault(e - s, []).append((i + s, j + s))
        if width == least:
            return out
        width = max(least, width // 2) if width > 2 * least else least


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(item, words, seeds): word hashes and the hashes of all runs of LEAST words (of all words, where there are fewer)."""
    kind = dict(benchmark.dtypes)[item]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for part in slices(batch, "__text"):
                h, row, _, _ = hasher.words(part.column("__text"))
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                words = [h[a:b] for a, b in zip(ends[:-1], ends[1:])]
                seeds = [grams(w, max(1, min(LEAST, len(w)))) for w in words]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(item), pa.array([w.view(np.int64) for w in words], pa.list_(pa.int64())),
                        pa.array([s.view(np.int64) for s in seeds], pa.list_(pa.int64())),
                        pa.array([min(LEAST, len(w)) for w in words], pa.int32()),
                    ],
                    [item, "words", "seeds", "width"],
                )

    return benchmark.select(item, whole(text).alias("__text")).mapInArrow(
        run, f"`{item}` {kind}, words array<long>, seeds array<long>, width int"
    )


def overlaps(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", least: float = 0.0
) -> DataFrame:
    """One row per document and benchmark item that share a run of five words, and may reach a coverage of ``least``.

    Columns: ``key``, ``text_hash``, ``item``, ``coverage`` (share of the item's
    words under tiles), ``n_tiles`` and ``tiles``, an array of (item_word,
    doc_word, length). Words are runs of letters and digits, lower case, in
    whole texts; a null or empty text has none and meets nothing. An item of
    fewer than five words must occur whole.

    Two bit maps of fixed size let only likely seeds leave the scan, with the
    words of their document; seeds are then joined with the items' seeds. A tile
    consists of shared seeds, so the item's words under them bound the coverage:
    pairs that cannot reach ``least`` go before any words are joined, the others are tiled.
    """
    items = settle(_items(benchmark, item, text))
    seeds = items.select(item, "width", F.size("words").alias("size"), F.posexplode("seeds").alias("at", "seed"))
    mask = (1 << FILTER_BITS) - 1
    bits = np.zeros((2, 1 << FILTER_BITS), bool)  # as large for any benchmark
    for k, side in enumerate((F.col("seed"), F.shiftrightunsigned("seed", 32))):
        marks = seeds.select(side.bitwiseAND(F.lit(mask)).alias("m")).distinct()
        bits[k, [r.m for r in marks.toLocalIterator()]] = True
    widths = sorted(r.width for r in items.where("width > 0").select("width").distinct().collect())  # LEAST at most
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits, axis=1))
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, full = Hasher(), np.unpackbits(shared.value, axis=1).astype(bool)
        for batch in batches:
            for part in slices(batch, "__text"):
                h, row, _, _ = hasher.words(part.column("__text"))
                rows, marks = [], []
                for width in widths:
                    g = grams(h, width)
                    hit = np.flatnonzero(full[0, (g & np.uint64(mask)).astype(np.int64)])
                    hit = hit[full[1, (g[hit] >> np.uint64(32) & np.uint64(mask)).astype(np.int64)]]
                    hit = hit[row[hit] == row[hit + width - 1]]
                    rows.append(row[hit])
                    marks.append(g[hit])
                if not widths or not sum(map(len, rows)):
                    continue
                r, g = np.concatenate(rows), np.concatenate(marks)
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                have = np.unique(r)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(key).take(pa.array(have)), part.column("text_hash").take(pa.array(have)),
                        pa.array([h[ends[k] : ends[k + 1]].view(np.int64) for k in have], pa.list_(pa.int64())),
                        pa.array([np.unique(g[r == k]).view(np.int64) for k in have], pa.list_(pa.int64())),
                    ],
                    [key, "text_hash", "doc_words", "seeds"],
                )

    likely = docs.select(key, whole(text).alias("__text")).withColumn("text_hash", F.xxhash64("__text")).mapInArrow(
        run, f"`{key}` {kind}, text_hash long, doc_words array<long>, seeds array<long>"
    )
    likely = settle(likely)
    texts = likely.dropDuplicates(["text_hash"]).select("text_hash", "doc_words", "seeds")
    # Words of the item under shared seeds: each seed adds its width, or the gap to the next one.
    at = F.array_sort(F.collect_set("at")).alias("at")
    gaps = F.zip_with(F.slice("at", 2, F.size("at")), F.col("at"), lambda b, a: F.least(b - a, F.col("width")))
    under = F.aggregate(F.filter(gaps, lambda g: g.isNotNull()), F.col("width"), lambda x, g: x + g)
    met = (
        texts.select("text_hash", F.explode("seeds").alias("seed")).join(seeds, "seed")
        .groupBy("text_hash", item).agg(F.first("width").alias("width"), F.first("size").alias("size"), at)
        .where(under >= F.col("size") * F.lit(least) - 1e-9).select("text_hash", item)
    )
    sides = met.join(texts.select("text_hash", "doc_words"), "text_hash").join(items.select(item, "words"), item)
    item_kind = dict(benchmark.dtypes)[item]

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for words, own in zip(batch.column("doc_words"), batch.column("words")):
                a = own.values.to_numpy().view(np.uint64)
                b = words.values.to_numpy().view(np.uint64)
                found = tiles(a, b)
                out.append((sum(n for _, _, n in found) / max(1, len(a)), found))
            kind = pa.list_(pa.struct([("item_word", pa.int32()), ("doc_word", pa.int32()), ("length", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("text_hash"), batch.column(item), pa.array([c for c, _ in out], pa.float64()),
                    pa.array([len(f) for _, f in out], pa.int32()),
                    pa.array([[dict(item_word=i, doc_word=j, length=n) for i, j, n in sorted(f)] for _, f in out], kind),
                ],
                ["text_hash", item, "coverage", "n_tiles", "tiles"],
            )

    tiled = sides.select("text_hash", item, "doc_words", "words").mapInArrow(
        tile,
        f"text_hash long, `{item}` {item_kind}, coverage double, n_tiles int, "
        "tiles array<struct<item_word:int,doc_word:int,length:int>>",
    )
    return likely.select(key, "text_hash").join(tiled, "text_hash").select(key, "text_hash", item, "coverage", "n_tiles", "tiles")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", least: float = COVERAGE) -> DataFrame:
    """The ``overlaps`` whose tiles cover at least ``least`` of the item, in any order."""
    return overlaps(docs, benchmark, key, text, least=least).where(F.col("coverage") >= least)


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", least: float = COVERAGE) -> DataFrame:
    """The documents without a contaminated passage, all columns kept."""
    bad = contaminated(docs, benchmark, key, text, least).select(F.col(key).alias("__key"), F.col("text_hash").alias("__h")).distinct()
    return docs.join(bad, docs[key].eqNullSafe(F.col("__key")) & (F.xxhash64(whole(text)) == F.col("__h")), "left_anti")
