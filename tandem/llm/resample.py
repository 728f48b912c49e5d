"""Importance resampling towards a target corpus, on hashed runs of words.

The distinct words of a piece of text, bounded by delimiters, are the keys of
an Aho-Corasick automaton; a key carries the CRC of its word and its length.
One scan of the piece emits the payloads in order. CRCs of neighbours compose
(the first is carried over as many zero bytes as the second is long), so runs
of words get their buckets without being written out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm.common import settle, slices, text_bytes, whole

STEP = 1 << 20  # text bytes that share a dictionary
LONG = 64  # bytes of a word that the automaton spells; longer ones go by a number

#: Lower case of A to Z; every byte outside words becomes a space.
FOLD = np.full(256, 32, np.uint8)
FOLD[48:58], FOLD[97:123], FOLD[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
FOLD[65:91] = np.arange(97, 123)


class Carry:
    """CRC values carried over any number of zero bytes, by tables of the linear map."""

    def __init__(self):
        one = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
        one ^= zlib.crc32(b"\0")  # without the start and end values of the CRC, but for those of the first row
        step = lambda c: one[c & 255] ^ (c >> np.uint32(8))
        made = [np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)]
        for _ in range(LONG):
            made.append(step(made[-1]))
        self.short = np.stack(made)  # by length, byte of the value, the byte's value
        self.doubled = [self.short[LONG]]

    @staticmethod
    def _by(table: np.ndarray, c: np.ndarray) -> np.ndarray:
        return table[0][c & 255] ^ table[1][c >> 8 & 255] ^ table[2][c >> 16 & 255] ^ table[3][c >> 24]

    def over(self, c: np.ndarray, length: np.ndarray) -> np.ndarray:
        part = length % LONG
        out = self.short[part, 0, c & 255] ^ self.short[part, 1, c >> 8 & 255]
        out ^= self.short[part, 2, c >> 16 & 255] ^ self.short[part, 3, c >> 24]
        left, k = length // LONG, 0
        while left.any():
            if k == len(self.doubled):
                self.doubled.append(self._by(self.doubled[-1], self.doubled[-1]))
            odd = left & 1 == 1
            out[odd] = self._by(self.doubled[k], out[odd])
            left, k = left >> 1, k + 1
        return out


def scan(piece: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC, CRC after a space, length) of every word of a folded piece that begins and ends with a space."""
    blob = piece.tobytes()
    spelled = {}
    if len(big := np.flatnonzero(end - first > LONG)):
        # A long word stands in the scanned text as its number after a byte that no folded text has.
        parts, at, numbers = [], 0, {}
        for a, b in zip(first[big].tolist(), end[big].tolist()):
            name = b"\1%d" % numbers.setdefault(blob[a:b], len(numbers))
            parts += [blob[at:a], name]
            at = b
        spelled = {b"\1%d" % k: word for word, k in numbers.items()}
        blob = b"".join([*parts, blob[at:]])
    keys = list(set(blob.split()))
    dictionary = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, key in enumerate(keys):
        dictionary.add_word(f" {key.decode('latin-1')} ", k)
    dictionary.make_automaton()
    words = [spelled.get(key, key) for key in keys] if spelled else keys
    crc = np.array([zlib.crc32(w) for w in words], np.uint32)
    spaced = np.array([zlib.crc32(b" " + w) for w in words], np.uint32)
    size = np.array([len(w) for w in words], np.int64)
    got = np.fromiter(map(itemgetter(1), dictionary.iter(blob.decode("latin-1"))), np.int64, len(first))
    return crc[got], spaced[got], size[got]


class Features:
    """Buckets of all runs of 1 to ``grams`` neighbouring words of a batch of texts."""

    def __init__(self, grams: int, buckets: int):
        self.grams, self.buckets, self.carry = grams, buckets, Carry()

    def __call__(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each piece: text number of every word, then text number and bucket of every feature that ends in it."""
        data, at = text_bytes(texts)
        docs = len(at) - 1
        # A space before every text and one at the end: words never cross texts.
        joined = np.full(len(data) + docs + 1, 32, np.uint8)
        joined[np.arange(len(data)) + np.repeat(np.arange(docs), np.diff(at)) + 1] = FOLD[data]
        opens = at + np.arange(docs + 1)
        kept = [np.zeros(0, t) for t in (np.uint32, np.uint32, np.int64, np.int64)]
        a = 0
        while a < len(joined) - 1:
            b = min(a + STEP, len(joined) - 1)
            while joined[b] != 32:  # up to the next space
                gap = np.flatnonzero(joined[b : b + STEP] == 32)
                b = b + int(gap[0]) if len(gap) else b + STEP
            piece = joined[a : b + 1]
            inside = piece != 32
            first, end = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1, np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
            if len(first):
                doc = np.searchsorted(opens, first + a, "right") - 1
                old = len(kept[0])
                crc, spaced, size, doc = (np.concatenate([k, x]) for k, x in zip(kept, (*scan(piece, first, end), doc)))
                run, owners, found = crc, [doc[old:]], [crc[old:] % self.buckets]
                for g in range(2, self.grams + 1):
                    last = slice(g - 1, None)
                    run = self.carry.over(run[:-1], size[last] + 1) ^ spaced[last]
                    new = (doc[last] == doc[: len(run)]) & (np.arange(g - 1, len(doc)) >= old)
                    owners.append(doc[last][new])
                    found.append(run[new] % self.buckets)
                keep = max(0, len(doc) - self.grams + 1)
                kept = [x[keep:] for x in (crc, spaced, size, doc)]
                yield doc[old:], np.concatenate(owners), np.concatenate(found).astype(np.int64)
            a = b


def counts(docs: DataFrame, text: str, grams: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; tasks add up first and send at most ``buckets`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(grams, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "__text", STEP):
                for _, _, found in features(part.column("__text")):
                    total += np.bincount(found, minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "c": pa.array(total[full])})

    rows = docs.select(whole(text).alias("__text")).mapInArrow(run, "bucket int, c long")
    got = rows.groupBy("bucket").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].to_numpy(np.int64)] = got["c"].to_numpy(np.int64)
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of every bucket's share in the target to its share in the corpus, one added to each."""
    b, s, t = float(len(own)), float(own.sum()), float(target.sum())
    return np.array([
        math.floor(1000 * math.log((float(y) + 1.0) * (s + b) / ((float(x) + 1.0) * (t + b)))) for x, y in zip(own, target)
    ], np.int64)


def weights(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    grams: int = 2, buckets: int = 10_000,
) -> DataFrame:
    """``key``, ``n_words``, ``n_features`` and ``weight``: the floored mean gain of a text's features, 0 without any."""
    gain = docs.sparkSession.sparkContext.broadcast(
        gains(counts(docs, text, grams, buckets), counts(target, target_text, grams, buckets))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(grams, buckets)
        for batch in batches:
            for part in slices(batch, "__text", STEP):
                rows = part.num_rows
                words, n, total = (np.zeros(rows, np.int64) for _ in range(3))
                for of_word, of_feature, found in features(part.column("__text")):
                    words += np.bincount(of_word, minlength=rows)
                    n += np.bincount(of_feature, minlength=rows)
                    # Whole numbers far below 2^53: the doubles add up exactly.
                    total += np.bincount(of_feature, gain.value[found], rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))],
                    [key, "n_words", "n_features", "weight"],
                )

    fields = [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]
    return docs.select(key, whole(text).alias("__text")).mapInArrow(run, T.StructType([docs.schema[key], *fields]))


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    percent: int = 25, least_words: int = 20, grams: int = 2, buckets: int = 10_000, seed: int = 7,
) -> DataFrame:
    """One row per row: ``key``, ``n_features``, ``weight``, ``score`` and ``rank`` (null where not drawn), all long but the key.

    Of the rows with at least ``least_words`` words, ``percent`` in a hundred
    (rounded down) are drawn without replacement, with odds by weight: the
    highest scores, a score being the weight plus a Gumbel value in thousandths that
    hangs on ``seed`` and the key alone. Ties go to the smaller key, null keys last;
    rows of one key and score in any order, each with a rank of its own. A null
    text has no words, a null key counts as the empty text. Empty tables give no rows
    (an empty target: all its counts are 0). Other columns are not read.

    Rows are ranked by ranges of (score, key, row), so no tie meets in one task;
    only the row count of each range is gathered.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), whole(key)), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = settle(
        weights(docs, target, key, text, target_text, grams, buckets)
        .withColumn("score", (F.col("weight") + gumbel).cast("long"))
        .withColumn("__seq", F.monotonically_increasing_id())
    )
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.asc_nulls_last(key), F.asc("__seq")]
    ranked = settle(
        scored.where(able).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        .withColumn("__at", F.monotonically_increasing_id())
    )
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    first, rows = {}, 0
    for r in ranked.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c")).orderBy("p").collect():
        first[r["p"]] = rows
        rows += r["c"]
    offset = F.element_at(F.from_json(F.lit("{" + ",".join(f'"{p}":{n}' for p, n in first.items()) + "}"), "map<string,long>"), part.cast("string"))
    rank = offset + place + 1
    out = [key, "n_features", "weight", "score"]
    return ranked.select(*out, F.when(rank <= drawn, rank).alias("rank")).unionByName(
        scored.where(~able).select(*out, F.lit(None).cast("long").alias("rank"))
    )
