"""Suffix-array dedup: every byte under a string of 200 bytes that also starts elsewhere in the corpus is removed.

Equal strings have equal contents, so what a string itself says can bring it
together with its copies: each string of ``WINDOW`` bytes is filed under the
smallest hash of its runs of ``RUN`` bytes (its anchor). Neighbouring strings
share anchors, so a text is a chain of segments. Anchors that occur once in
the corpus end there. Equal segments of an anchor are one entry with a count;
where an anchor has several different ones, one of each goes into a suffix
array, which shows the strings that occur again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import settle, slices, text_bytes, whole
from tandem.llm.suffixes import repeated
from tandem.llm.words import mixed, powers

WINDOW = 200
RUN = 32
STEP = 1 << 18  # text bytes handled at once
PIECE = 1 << 22  # starts handled at once; positions take 24 bits
LANE_SEGMENTS = 16  # different segments of one anchor that go into one suffix array
BUCKET_BYTES = 4 << 20
SEEN = 1 << 16  # texts a task remembers at once to drop their copies
MAP_BITS = 26  # of the bit maps that keep rows out of a shuffle; their size is the same for any input


class Anchors:
    """Segments of byte strings: runs of window starts with one anchor."""

    def __init__(self, window: int = WINDOW, run: int = RUN):
        self.window, self.run, self.span = window, run, window - run + 1
        self.up, self.down = powers(1)

    def smallest(self, x: np.ndarray) -> np.ndarray:
        """Minimum of every ``span`` values in a row."""
        w, n = self.span, len(x) - self.span + 1
        rows = np.full(-(-len(x) // w) * w, np.uint64(2**64 - 1))
        rows[: len(x)] = x
        rows = rows.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, 1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])

    def segments(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor hash, first start, number of starts) over the texts of a buffer with offsets ``at``."""
        found = []
        limit = np.repeat(at[1:], np.diff(at))  # where the text of each byte ends
        for a in range(0, max(0, len(data) - self.window + 1), PIECE):
            part = data[a : a + PIECE + self.window - 1]
            if len(part) >= len(self.up):
                self.up, self.down = powers(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * self.up[: len(part)], dtype=np.uint64, out=total[1:])
            n = len(part) - self.run + 1
            h = mixed((total[self.run :] - total[:-self.run]) * self.down[:n])
            low = self.smallest((h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64))
            starts = np.arange(a, a + len(low))
            good = limit[a : a + len(low)] - starts >= self.window
            anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)
            new = good.copy()
            new[1:] &= ~good[:-1] | (anchor[1:] != anchor[:-1])
            first = np.flatnonzero(new)
            ends = np.flatnonzero(good & np.concatenate([~good[1:] | new[1:], [True]]))
            found.append((h[anchor[first]].view(np.int64), starts[first], ends - first + 1))
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*found))


def digest(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def bit_map(rows: DataFrame, column: str) -> np.ndarray:
    """A map of fixed size with the bits that the values of a long column point at."""
    spot = F.col(column).bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    words = rows.groupBy(F.shiftright(spot, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(%s & 63 as int))" % column)).alias("b"))
    got = words.toPandas()  # at most 2^(MAP_BITS - 6) rows
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64)
    return out


def in_map(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    spot = values & ((1 << MAP_BITS) - 1)
    return (bits[spot >> 6] >> (spot & 63) & 1).astype(bool)


def _hashed(docs: DataFrame, text: str) -> DataFrame:
    """Whole texts and their hash ``t1``, made by the JVM."""
    return docs.select(whole(text).alias("__text"), F.xxhash64(whole(text)).alias("t1"))


def _packed(docs: DataFrame, text: str, bits) -> DataFrame:
    """The hash and the compressed bytes of the texts whose hash is in a bit map; a task leaves out the copies of texts it remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        seen: set[bytes] = set()

        def new(text: bytes) -> bool:
            d = hashlib.sha256(text).digest()
            if d in seen:
                return False
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(d)
            return True

        for batch in batches:
            batch = batch.filter(pa.array(in_map(bits.value, batch.column("t1").to_numpy())))
            for part in slices(batch, "__text", STEP):
                t1, packed = [], []
                for k, text in zip(part.column("t1").to_pylist(), part.column("__text")):
                    raw = text.as_buffer().to_pybytes()
                    if new(raw):
                        t1.append(k)
                        packed.append(pack.compress(raw))
                yield pa.RecordBatch.from_arrays([pa.array(t1, pa.int64()), pa.array(packed, pa.binary())], ["t1", "packed"])

    return _hashed(docs, text).mapInArrow(run, "t1 long, packed binary")


def _anchors(docs: DataFrame, text: str, window: int) -> DataFrame:
    """The anchor hash of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors(window)
        for batch in batches:
            for part in slices(batch, "__text", STEP):
                yield pa.RecordBatch.from_arrays([pa.array(find.segments(*text_bytes(part.column("__text")))[0])], ["anchor"])

    return docs.select(whole(text).alias("__text")).mapInArrow(run, "anchor long")


def _segments(docs: DataFrame, text: str, window: int) -> DataFrame:
    """(anchor, s1, t1, at) of every segment: anchor hash, digest of its bytes, hash of its text, 256 x first start + starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors(window)
        for batch in batches:
            for part in slices(batch, "__text", STEP):
                data, at = text_bytes(part.column("__text"))
                anchor, first, count = find.segments(data, at)
                blob = data.tobytes()
                of = np.searchsorted(at, first, "right") - 1
                s1 = [digest(blob[a:b]) for a, b in zip(first.tolist(), (first + count + window - 1).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(s1, pa.int64()), part.column("t1").take(pa.array(of)), pa.array((first - at[of]) * 256 + count)],
                    ["anchor", "s1", "t1", "at"],
                )

    return _hashed(docs, text).mapInArrow(run, "anchor long, s1 long, t1 long, at long")


ENTRY = "anchor long, s1 long, again boolean, content binary"
HITS = "anchor long, s1 long, runs array<int>"


def _contents(asked: DataFrame, window: int) -> DataFrame:
    """The bytes of the wanted segments of the texts (t1, packed, wanted); a text that only shares the digest gives none.

    Rows of one t1 come one after another; of equal texts only the first is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        last, done = None, set()
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                rows = []
                part = batch.slice(i, 200)
                for t1, packed, wanted in zip(*(part.column(c) for c in ("t1", "packed", "wanted"))):
                    t1, packed = t1.as_py(), packed.as_py()
                    if t1 != last:
                        last, done = t1, set()
                    if packed in done:
                        continue
                    done.add(packed)
                    raw, wanted = unpack.decompress(packed), wanted.as_py()
                    for w in wanted:
                        content = raw[w["at"] // 256 : w["at"] // 256 + w["at"] % 256 + window - 1]
                        if digest(content) == w["s1"]:
                            rows.append((w["anchor"], w["s1"], w["again"], content))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["anchor", "s1", "again", "content"]
                    )

    return asked.mapInArrow(run, ENTRY)


def runs_of(mask: np.ndarray) -> np.ndarray:
    """Begin and end of each run of true values, one after another."""
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).astype(np.int32)


def _lanes(table: pa.Table, window: int) -> pa.Table:
    """The starts that repeat among the different segments of each anchor of a bucket, by suffix arrays."""
    anchor, s1 = (table.column(c).to_numpy() for c in ("anchor", "s1"))
    again = table.column("again").to_numpy(zero_copy_only=False)
    order = np.lexsort((s1, anchor))
    new = np.ones(len(order), bool)
    # Texts with one digest may both have answered for a segment; one is enough.
    new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (s1[order][1:] != s1[order][:-1])
    rows = order[new]
    content = table.column("content").combine_chunks()
    masks = repeated([content[i].as_py() for i in rows.tolist()], anchor[rows], window, again[rows])
    out = [(i, runs_of(m)) for i, m in zip(rows.tolist(), masks) if not again[i] and m.any()]
    keep = np.array([i for i, _ in out], np.int64)
    return pa.table(
        {"anchor": anchor[keep], "s1": s1[keep], "runs": pa.array([r for _, r in out], pa.list_(pa.int32()))}
    )


def _crowded(rows: DataFrame, window: int) -> DataFrame:
    """The same for anchors with more different segments than one suffix array takes: by window digests, combined."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(c).to_pylist() for c in ("anchor", "s1", "again", "content")]
            for a in range(0, batch.num_rows, 200):
                out = []
                for h, s, again, text in zip(*(c[a : a + 200] for c in keys)):
                    for k in range(len(text) - window + 1):
                        d = xxhash.xxh3_128_intdigest(text[k : k + window])
                        out.append((h, s, again, k, (d >> 64) - (1 << 63), (d & (2**64 - 1)) - (1 << 63)))
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["anchor", "s1", "again", "start", "d1", "d2"]
                )

    each = settle(rows.mapInArrow(cut, "anchor long, s1 long, again boolean, start int, d1 long, d2 long"))
    twice = each.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d1", "d2")
    starts = each.where("not again").join(twice, ["d1", "d2"]).groupBy("anchor", "s1").agg(F.collect_set("start").alias("starts"))
    return starts.select("anchor", "s1", F.flatten(F.transform("starts", lambda k: F.array(k, k + 1))).alias("runs"))


def _found(docs: DataFrame, text: str, window: int) -> DataFrame:
    """(t1, s1, at, runs): the segments of each text that hold repeated strings, and which of their starts repeat."""
    share = docs.sparkSession.sparkContext.broadcast
    often = _anchors(docs, text, window).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = settle(_segments(docs, text, window).join(often, "anchor"))
    entries = settle(
        met.groupBy("anchor", "s1").agg(
            F.count(F.lit(1)).alias("c"), F.max("n").alias("n"), F.min(F.struct("t1", "at")).alias("first")
        )
    )
    mixed_up = entries.where("c < n")  # anchors with different segments
    crowded = mixed_up.groupBy("anchor").count().where(F.col("count") > LANE_SEGMENTS)
    hot = share(bit_map(crowded, "anchor"))
    asked = mixed_up.select(F.col("first.t1").alias("t1"), "anchor", "s1", F.col("first.at").alias("at"), (F.col("c") > 1).alias("again"))
    wanted = asked.groupBy("t1").agg(F.collect_list(F.struct("anchor", "s1", "at", "again")).alias("wanted"))
    texts = _packed(docs, text, share(bit_map(asked, "t1")))
    # Merged, never broadcast: copies of a text from all tasks follow one another and give their segments once.
    held = settle(_contents(texts.join(wanted.hint("merge"), "t1").select("t1", "packed", "wanted"), window))

    def part(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(in_map(hot.value, batch.column("anchor").to_numpy()) == inside))

        return held.mapInArrow(run, ENTRY)

    # An anchor that only shares a bit with a crowded one may go either way: both are exact.
    buckets = max(1, held.count() * 300 // BUCKET_BYTES)
    by_lane = (
        part(False).withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
        .groupBy("bucket").applyInArrow(lambda t: _lanes(t, window), HITS)
    )
    whole_runs = F.array(F.lit(0), F.lit(256))
    hits = entries.where("c > 1").select("anchor", "s1", whole_runs.alias("runs")).unionByName(by_lane).unionByName(_crowded(part(True), window))
    return settle(met.select("anchor", "s1", "t1", "at").join(hits, ["anchor", "s1"]).select("t1", "s1", "at", "runs").distinct())


CUT = "text_sha256 string, spans array<struct<start:long,length:long>>, n_removed long, kept_sha256 string"


def removals(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per distinct text that loses something: its SHA-256, the removed ``spans``, their length and the SHA-256 of the rest."""
    found = _found(docs, text, window)
    hits = F.collect_list(F.struct("s1", "at", "runs")).alias("hits")
    spans = settle(
        found.groupBy("t1").agg(hits).select(
            "t1", *(F.col(f"hits.{c}").alias(c) for c in ("s1", "at")),
            F.transform("hits.runs", lambda r: F.size(r)).alias("sizes"), F.flatten("hits.runs").alias("runs"),
        )
    )
    bits = docs.sparkSession.sparkContext.broadcast(bit_map(spans, "t1"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        last, done = None, set()
        for batch in batches:
            for i in range(0, batch.num_rows, 50):
                out = []
                for row in range(i, min(i + 50, batch.num_rows)):
                    t1, packed = (batch.column(c)[row].as_py() for c in ("t1", "packed"))
                    if t1 != last:
                        last, done = t1, set()
                    if packed in done:  # a copy of the text from another task
                        continue
                    done.add(packed)
                    s1, at, sizes, runs = (batch.column(c)[row].values.to_numpy() for c in ("s1", "at", "sizes", "runs"))
                    raw = unpack.decompress(packed)
                    first, n = at // 256, at % 256
                    ends = (first + n + window - 1).tolist()
                    # Hits of another text with the same hash do not have its bytes.
                    own = np.array([digest(raw[a:b]) == s for a, b, s in zip(first.tolist(), ends, s1.tolist())], bool)
                    per = np.repeat(np.arange(len(s1)), sizes // 2)
                    per, begin, end = (x[own[per]] for x in (per, runs[::2], runs[1::2]))
                    edge = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(edge, first[per] + begin, 1)
                    np.add.at(edge, np.minimum(first[per] + np.minimum(end, n[per]) + window - 1, len(raw)), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    if not gone.any():
                        continue
                    flips = runs_of(gone).tolist()
                    kept = np.frombuffer(raw, np.uint8)[~gone]
                    out.append((
                        hashlib.sha256(raw).hexdigest(), [dict(start=a, length=b - a) for a, b in zip(flips[::2], flips[1::2])],
                        len(raw) - len(kept), hashlib.sha256(kept).hexdigest(),
                    ))
                if out:
                    kinds = (pa.string(), span, pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["text_sha256", "spans", "n_removed", "kept_sha256"]
                    )

    texts = _packed(docs, text, bits)
    # A hot text may still meet its spans in several tasks: one answer of each stays.
    made = settle(texts.join(spans.hint("merge"), "t1").select("t1", "packed", "s1", "at", "sizes", "runs").mapInArrow(cut, CUT))
    return made.dropDuplicates(["text_sha256"])


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: ``key``, ``n_bytes``, ``spans`` and ``kept``.

    ``spans`` are the removed runs as (start, length) in UTF-8 bytes, ``kept``
    (binary) the other bytes in order. A byte goes if any string of ``window``
    bytes over it also starts at another place of any text, its own included;
    all judged on the input. Null counts as empty; texts shorter than
    ``window`` lose nothing; rows repeated with the same text lose it all.
    """
    gone = removals(docs, text, window).select("text_sha256", "spans")
    raw = F.encode(whole(text), "UTF-8")
    rows = docs.select(F.col(key).alias("key"), raw.alias("raw")).withColumn("text_sha256", F.sha2("raw", 256))
    met = rows.join(gone, "text_sha256", "left").withColumn("n_bytes", F.length("raw").cast("long"))
    spans = F.coalesce("spans", F.expr("cast(array() as array<struct<start:long,length:long>>)"))
    # What is left lies between the end of one span and the start of the next.
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["start"] + s["length"]))
    ends = F.concat(F.col("spans.start"), F.array("n_bytes"))
    pieces = F.zip_with(starts, ends, lambda a, b: F.hex(F.substring(F.col("raw"), (a + 1).cast("int"), (b - a).cast("int"))))
    kept = F.when(F.col("spans").isNull(), F.col("raw")).otherwise(F.unhex(F.array_join(pieces, "")))
    return met.select(F.col("key").alias(key), "n_bytes", spans.alias("spans"), kept.alias("kept"))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of every row; texts that lose nothing stay in the JVM."""
    gone = removals(docs, text)
    raw = whole(text)
    rows = docs.select(F.col(key).alias("key"), F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("text_sha256"))
    none = F.lit(0).cast("long")
    return rows.join(gone, "text_sha256", "left").select(
        F.col("key").alias(key), "n_bytes", F.coalesce("n_removed", none).alias("n_removed"),
        F.when(F.col("spans").isNull(), none).otherwise(F.size("spans").cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "text_sha256").alias("kept_sha256"),
    )
