"""Byte-level BPE encoding and decoding with a given public vocabulary.

Every short word holds a contiguous array of parts and the ranks of adjacent
parts. The smallest rank is found by a scan, its boundary is deleted and the
two neighbouring ranks are refreshed, until no pair of the word has a rank.
Many words take that step together, as rows of one matrix.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm.common import ranges, slices, strings, text_bytes, whole

# Fixed value: the split of the byte-level pre-tokenizer that the vocabulary was made with.
# White space is spelled out: the regex module counts four control characters more.
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
SHORT = 64
NONE = np.int32(2**31 - 1)
KEPT_WORDS = 200_000


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes: printable Latin-1 as itself, the rest from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_rules(path: str) -> dict:
    """What tasks need of the vocabulary file; its size is the vocabulary's, not the data's."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, letters = spec["model"], byte_letters()
    vocab = model["vocab"]
    size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
    raw: list[bytes] = [b""] * size
    for word, i in vocab.items():
        raw[i] = bytes(letters[c] for c in word)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    for word, i in special.items():
        raw[i] = word.encode()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    left = np.array([vocab[a] for a, _ in pairs], np.int64)
    right = np.array([vocab[b] for _, b in pairs], np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], np.int32)
    keys, first = np.unique(left << 32 | right, return_index=True)
    first_ids = np.zeros(256, np.int32)
    for c, b in letters.items():
        first_ids[b] = vocab[c]
    sizes = np.array([len(b) for b in raw], np.int64)
    return {
        "keys": keys, "rank": first.astype(np.int32), "made": made[first], "made_at": made, "first": first_ids,
        "special": special, "raw": np.frombuffer(b"".join(raw), np.uint8), "sizes": sizes,
        "starts": np.cumsum(sizes) - sizes,
    }


class Encoder:
    """Encodes words, each distinct one once; the store is emptied when it is full."""

    def __init__(self, rules: dict):
        self.keys, self.rank, self.made_at = rules["keys"], rules["rank"], rules["made_at"]
        self.first, self.special = rules["first"], rules["special"]
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(WORDS)
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {w: n for n, w in enumerate(self.special)}
        self.flat = np.array(list(self.special.values()), np.int32)
        self.lens = np.ones(len(self.special), np.int64)
        self.starts = np.arange(len(self.special), dtype=np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank[at], NONE)

    def short(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of a matrix of parts, padded with -1: (flat ids, lengths)."""
        rows, width = parts.shape
        if width == 1:
            return parts[:, 0].astype(np.int32), np.ones(rows, np.int64)
        done = np.full((rows, width), -1, np.int32)
        live = np.arange(rows)
        ranks = self.ranks_of(parts[:, :-1], parts[:, 1:])
        cols = np.arange(width)
        while True:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(live)), at]
            go = best < NONE
            if not go.all():
                done[live[~go]] = parts[~go]
                live, parts, ranks, at, best = live[go], parts[go], ranks[go], at[go], best[go]
            if not len(live):
                break
            n = np.arange(len(live))
            src = cols[None, :] + (cols[None, :] > at[:, None])
            parts = np.take_along_axis(np.pad(parts, ((0, 0), (0, 1)), constant_values=-1), src, 1)
            parts[n, at] = self.made_at[best]
            ranks = np.take_along_axis(np.pad(ranks, ((0, 0), (0, 1)), constant_values=NONE), src[:, : width - 1], 1)
            after = np.where(at + 1 < width, parts[n, np.minimum(at + 1, width - 1)], -1)
            right = self.ranks_of(parts[n, at], after)
            inside = at < width - 1
            ranks[n[inside], at[inside]] = right[inside]
            inside = at > 0
            ranks[n[inside], at[inside] - 1] = self.ranks_of(parts[n, at - 1], parts[n, at])[inside]
        keep = done >= 0
        return done[keep], keep.sum(1)

    def long(self, word: bytes) -> list[int]:
        """The same merges for a word of any length: a heap in place of the scan."""
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        prev, after = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        ranks = self.ranks_of(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r < NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = int(self.made_at[r]), -1, after[j]
            if after[j] >= 0:
                prev[after[j]] = i
            for x in (prev[i], i):
                y = after[x] if x >= 0 else -1
                if y >= 0:
                    s = int(self.ranks_of(np.array([ids[x]]), np.array([ids[y]]))[0])
                    if s < NONE:
                        heapq.heappush(heap, (s, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def learn(self, new: list[str]) -> None:
        raw = [w.encode("utf-8", "replace") for w in new]
        size = np.array([len(b) for b in raw])
        order = np.argsort(size, kind="stable")
        blob = np.frombuffer(b"".join(raw[i] for i in order), np.uint8)
        size = size[order]
        ends = np.cumsum(size)
        flats, lens, base = [], [], 0
        bounds = [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, SHORT]
        for low, high in zip(bounds[:-1], bounds[1:]):
            a, b = np.searchsorted(size, low, "right"), np.searchsorted(size, high, "right")
            for c in range(a, b, 20_000):
                d = min(b, c + 20_000)
                part = np.full((d - c, high), -1, np.int32)
                ids = self.first[blob[ends[c] - size[c] : ends[d - 1]]]
                part[np.repeat(np.arange(d - c), size[c:d]), ranges(np.zeros(d - c, np.int64), size[c:d])] = ids
                f, n = self.short(part)
                flats.append(f)
                lens.append(n)
        base = np.searchsorted(size, SHORT, "right")
        for k in range(base, len(size)):
            ids = self.long(blob[ends[k] - size[k] : ends[k]].tobytes())
            flats.append(np.array(ids, np.int32))
            lens.append(np.array([len(ids)]))
        n = np.concatenate(lens)
        first = len(self.slot)
        for k, i in enumerate(order):
            self.slot[new[i]] = first + k
        starts = len(self.flat) + np.cumsum(n) - n
        self.flat = np.concatenate([self.flat, *flats])
        self.lens = np.concatenate([self.lens, n])
        self.starts = np.concatenate([self.starts, starts])

    def cut(self, text: str) -> list[str]:
        if self.split is None:
            return self.words.findall(text)
        out: list[str] = []
        for part in self.split.split(text):
            out.extend([part] if part in self.special else self.words.findall(part))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each text)."""
        cut = [self.cut(t) if t else [] for t in texts]
        if len(self.slot) > KEPT_WORDS:
            self.clear()
        flat = [w for words in cut for w in words]
        if new := list(set(flat).difference(self.slot)):
            self.learn(new)
        at = np.fromiter(map(self.slot.__getitem__, flat), np.int64, len(flat))
        n = self.lens[at]
        ids = self.flat[ranges(self.starts[at], n)]
        total = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum([len(words) for words in cut]).astype(np.int64)
        return ids, np.diff(total[np.concatenate([[0], ends])])


def _encoder(rules, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(rules.value)
        for batch in batches:
            for part in slices(batch, "__text", 1 << 20):
                ids, n = coder.encode(part.column("__text").to_pylist())
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
                rest = part.drop_columns(["__text"])
                yield pa.RecordBatch.from_arrays([*rest.columns, made], [*rest.schema.names, out])

    return run


def _decoder(rules, ids: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, sizes, starts = rules.value["raw"], rules.value["sizes"], rules.value["starts"]
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                lists = part.column(ids)
                counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                if len(flat) and (flat.min() < 0 or flat.max() >= len(sizes)):
                    raise ValueError("an id is outside the vocabulary")
                n = sizes[flat]
                ends = np.concatenate([[0], np.cumsum(n)])
                at = ends[np.concatenate([[0], np.cumsum(counts)])]
                made = strings(raw[ranges(starts[flat], n)], at)
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, out])

    return run


def _with(docs: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([*(f for f in docs.schema if f.name != "__text"), *fields])


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``: the token ids (array<int>) of each whole text; null counts as empty, which has no ids.

    ``path`` is a tokenizers JSON file with a byte-level BPE model; it is read on
    the driver and broadcast (its size is the vocabulary's). A present column ``out`` is replaced.
    """
    rules = docs.sparkSession.sparkContext.broadcast(load_rules(path))
    docs = docs.drop(out).withColumn("__text", whole(text))
    return docs.mapInArrow(_encoder(rules, out), _with(docs, T.StructField(out, T.ArrayType(T.IntegerType()))))


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the text of each array of ids, special tokens included; a null array gives the empty text.

    An id outside the vocabulary stops the job. A present column ``out`` is replaced.
    """
    rules = docs.sparkSession.sparkContext.broadcast(load_rules(path))
    docs = docs.drop(out)
    return docs.mapInArrow(_decoder(rules, ids, out), _with(docs, T.StructField(out, T.StringType())))


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass: both new columns from one worker a task."""
    rules = docs.sparkSession.sparkContext.broadcast(load_rules(path))
    docs = docs.drop(ids, out).withColumn("__text", whole(text))
    there, back = _encoder(rules, ids), _decoder(rules, ids, out)
    fields = T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(out, T.StringType())
    return docs.mapInArrow(lambda batches: back(there(batches)), _with(docs, *fields))


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of an encode and decode round trip."""
    coded = round_trip(docs.select(key, text), path, text)
    return coded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
