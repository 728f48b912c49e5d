"""SentencePiece BPE encoding and decoding with a given public model.

Merges by score leave one property: the pieces of a prefix are a prefix of
pieces, so every prefix has one last piece of its own. An automaton finds the
pieces that end at each character; the one that may follow the last piece of
the prefix before it is stored, and the ids are read backwards from the end.
Two pieces may be neighbours if merging them together never joins them, which
their own merges, taken in turn by score, show.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm.common import ranges, slices, strings, whole

# Fixed values of the model file: kinds of pieces, field numbers, the sign for a space.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
SPACE = "▁"
KEPT_CHUNKS, KEPT_IDS, KEPT_PAIRS = 600_000, 4_000_000, 300_000  # what a task remembers at once
SHORT = 64  # characters of a stretch that is encoded in step with others
CHARACTER = 1 << 20  # added to a character that is no piece, to number it above all ids
NEVER = float("-inf")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of every field of a message in the protobuf wire format."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}[tag & 7] if tag & 7 != 2 else number()
            yield tag >> 3, raw[at : at + size]
            at += size


def load_rules(path: str) -> dict:
    """What tasks need of the model file; its size is the vocabulary's, not the data's."""
    with open(path, "rb") as f:
        model = list(_fields(f.read()))
    pieces = [{1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(v)) for k, v in model if k == 1]
    trainer, normalizer = ({k: v for field, m in model if field == n for k, v in _fields(m)} for n in (2, 3))
    words, kinds = [p[1].decode() for p in pieces], np.array([p[3] for p in pieces], np.int8)
    if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1):
        raise ValueError("only models that leave white space and characters alone and add a first space are read")
    if trainer.get(3) != 2 or not trainer.get(35) or not set(kinds.tolist()) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("only BPE models with byte pieces and without pieces of users are read")
    normal = kinds == NORMAL
    score = {w: struct.unpack("<f", p[2])[0] for w, p, n in zip(words, pieces, normal) if n}
    long = [w for w in score if len(w) > 1]
    unknown = trainer.get(44, " ⁇ ".encode())
    raw = [
        bytes([int(w[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else unknown if k == UNKNOWN else w.replace(SPACE, " ").encode()
        for w, k in zip(words, kinds.tolist())
    ]
    merges = Merges(score)
    sizes = np.array([len(b) for b in raw], np.int64)
    bytes_at = np.zeros(256, np.int32)
    for i in np.flatnonzero(kinds == BYTE).tolist():
        bytes_at[int(words[i][3:5], 16)] = i
    return {
        "score": score, "id": {w: i for i, (w, n) in enumerate(zip(words, normal)) if n and merges.steps(w)[1]},
        # No piece goes on after these, or from a word into the space behind it: texts may be cut there.
        "alone": "".join(c for c in "\n\t\v\f" if not any(c in w for w in long)),
        "cut": not any(re.search(f"[^{SPACE}]{SPACE}", w) for w in long), "marks": _marks(long),
        "byte": bytes_at, "control": kinds == CONTROL, "opens": normal & np.array([w.startswith(SPACE) for w in words]),
        "raw": np.frombuffer(b"".join(raw), np.uint8), "sizes": sizes, "starts": np.cumsum(sizes) - sizes,
    }


def _marks(pieces: list[str]) -> str:
    """Characters that share no piece with any other character but the space: ASCII signs, and what pieces mix with them."""
    marks = set(filter(lambda c: not c.isalnum(), map(chr, range(33, 127))))
    while mixed := {c for w in pieces if marks.intersection(w) for c in w} - marks - {SPACE}:
        if any(c.isalpha() for c in mixed):
            return ""
        marks |= mixed
    return "".join(sorted(marks))


class Merges:
    """How pieces come about, and which of them can be neighbours."""

    def __init__(self, score: dict[str, float]):
        self.score, self.known = score, {}

    def steps(self, piece: str) -> tuple[list[tuple[float, str, str]], bool]:
        """((score, first part, last part) after every merge of the characters alone, whether one part is left)."""
        if piece not in self.known:
            parts, made = list(piece), []
            while len(parts) > 1:
                best, i = max((self.score.get(a + b, NEVER), -i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if best == NEVER:
                    break
                parts[-i : 2 - i] = [parts[-i] + parts[1 - i]]
                made.append((best, parts[0], parts[-1]))
            self.known[piece] = made, len(parts) == 1
        return self.known[piece]

    def fit(self, a: str, b: str) -> bool:
        """Whether the characters of ``a`` and ``b`` together merge to these two: best score first, then the left-most."""
        left, right = self.steps(a)[0], self.steps(b)[0]
        end, begin, i, j = a[-1], b[0], 0, 0
        while True:
            x = left[i][0] if i < len(left) else NEVER
            y = right[j][0] if j < len(right) else NEVER
            across = self.score.get(end + begin, NEVER)
            if across > x and across >= y:
                return False
            if x == y == NEVER:
                return True
            if x >= y:
                end, i = left[i][2], i + 1
            else:
                begin, j = right[j][1], j + 1


class Encoder:
    """Encodes stretches of text, each distinct one once; the stores are emptied when they are full."""

    def __init__(self, rules: dict):
        self.merges, self.byte = Merges(rules["score"]), rules["byte"].tolist()
        self.words = {i: w for w, i in rules["id"].items()}
        self.sizes = {i: len(w) for i, w in self.words.items()}
        self.ends = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for word, i in rules["id"].items():
            self.ends.add_word(word, i)
        if self.words:
            self.ends.make_automaton()
        alone, marks = re.escape(rules["alone"]), re.escape(rules["marks"])
        kinds = [f"[{alone}]"] * bool(alone) + [f"{SPACE}*[{marks}]+"] * bool(marks) + [f"{SPACE}*[^{SPACE}{alone}{marks}]+", f"{SPACE}+"]
        self.chunks = re.compile("|".join(kinds)).findall if rules["cut"] else lambda t: [t]
        self.split = bool(self.words) and "\n" in rules["alone"]  # whether a line feed can stand between stretches
        self.fits: dict[int, bool] = {}
        self.size_of = np.zeros(max(self.words, default=0) + 1, np.int64)
        self.size_of[list(self.sizes)] = list(self.sizes.values())
        self.pairs, self.fitting = np.zeros(0, np.int64), np.zeros(0, bool)
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat, self.lens, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def fit(self, left: int, piece: int) -> bool:
        a = chr(left - CHARACTER) if left >= CHARACTER else self.words[left]
        return self.merges.fit(a, self.words[piece])

    def ids(self, text: str) -> list[int]:
        """Ids of a stretch: the table of last pieces of all its prefixes, then backwards."""
        n, sizes, fits = len(text), self.sizes, self.fits
        last = [0] * n if n < 4096 else array("i", bytes(4 * n))
        size = bytearray(n)  # 0: no piece ends here, the character stands for itself
        for end, piece in self.ends.iter(text) if self.words else ():
            if size[end]:
                continue
            before = end - sizes[piece]
            if before >= 0:
                left = last[before] if size[before] else CHARACTER + ord(text[before])
                pair = left << 20 | piece
                fit = fits.get(pair)
                if fit is None:
                    if len(fits) > KEPT_PAIRS:
                        fits.clear()
                    fit = fits[pair] = self.fit(left, piece)
                if not fit:
                    continue
            last[end], size[end] = piece, sizes[piece]
        out, at = [], n - 1
        while at >= 0:
            if size[at]:
                out.append(last[at])
                at -= size[at]
            else:
                out.extend(self.byte[b] for b in reversed(text[at].encode("utf-8", "replace")))
                at -= 1
        out.reverse()
        return out

    def fit_all(self, pairs: np.ndarray) -> np.ndarray:
        """``fit`` of many pairs; each distinct one is tested once while it is remembered."""
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs, self.fitting = self.pairs[:0], self.fitting[:0]
        at = np.searchsorted(self.pairs, pairs)
        known = at < len(self.pairs)
        known[known] = self.pairs[at[known]] == pairs[known]
        if not known.all():
            new = np.unique(pairs[~known])
            made = np.array([self.fit(p >> 20, p & ((1 << 20) - 1)) for p in new.tolist()], bool)
            self.pairs, self.fitting = np.concatenate([self.pairs, new]), np.concatenate([self.fitting, made])
            order = np.argsort(self.pairs, kind="stable")
            self.pairs, self.fitting = self.pairs[order], self.fitting[order]
            at = np.searchsorted(self.pairs, pairs)
        return self.fitting[at]

    def many(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, lengths): the same tables for many stretches in step, one character of each at a time."""
        lens = np.array([len(c) for c in chunks], np.int64)
        begin = np.cumsum(lens + 1) - lens - 1  # the stretches stand behind one another, with a sign between that no piece has
        text = "\n".join(chunks) + "\n"
        found = np.fromiter(self.ends.iter(text), np.dtype([("end", np.int64), ("piece", np.int64)]))
        end, piece = found["end"], found["piece"]
        before = end - self.size_of[piece]
        depth = end - np.repeat(begin, lens + 1)[end]
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        last, size = CHARACTER + code, np.zeros(len(code), np.int64)
        order = np.argsort(depth, kind="stable")
        for a, b in zip(*(np.searchsorted(depth[order], np.arange(lens.max()), s) for s in ("left", "right"))):
            at = order[a:b]
            first = self.size_of[piece[at]] > depth[at]
            fit = first.copy()
            fit[~first] = self.fit_all(last[before[at[~first]]] << 20 | piece[at[~first]])
            at = at[fit]
            last[end[at]], size[end[at]] = piece[at], self.size_of[piece[at]]
        # Backwards from every end; a stretch with a character of its own is done by itself.
        at, live, steps, alone = begin + lens - 1, np.arange(len(chunks)), [], np.zeros(len(chunks), bool)
        count = np.zeros(len(chunks), np.int64)
        while len(live):
            own = size[at] == 0
            alone[live[own]] = True
            at, live = at[~own], live[~own]
            steps.append((live, last[at]))
            count[live] += 1
            at = at - size[at]
            more = at >= begin[live]
            at, live = at[more], live[more]
        single = {k: np.array(self.ids(chunks[k]), np.int32) for k in np.flatnonzero(alone).tolist()}
        count[list(single)] = [len(x) for x in single.values()]
        stop = np.cumsum(count)
        out = np.zeros(int(count.sum()), np.int32)
        for k, (who, ids) in enumerate(steps):
            good = ~alone[who]
            out[stop[who[good]] - 1 - k] = ids[good]
        for k, ids in single.items():
            out[stop[k] - count[k] : stop[k]] = ids
        return out, count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each text)."""
        cut = [self.chunks(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.slot) > KEPT_CHUNKS or len(self.flat) > KEPT_IDS:
            self.clear()
        flat = [c for chunks in cut for c in chunks]
        if new := list(set(flat).difference(self.slot)):
            short = [c for c in new if len(c) <= SHORT and "\n" not in c] if self.split else []
            made = [self.many(short)] if short else []
            if len(short) < len(new):
                rest = [c for c in new if len(c) > SHORT or "\n" in c] if self.split else new
                single = [np.array(self.ids(c), np.int32) for c in rest]
                made.append((np.concatenate(single), np.array([len(x) for x in single], np.int64)))
                new = short + rest
            lens = np.concatenate([n for _, n in made])
            self.slot.update(zip(new, range(len(self.slot), len(self.slot) + len(new))))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lens) - lens])
            self.lens = np.concatenate([self.lens, lens])
            self.flat = np.concatenate([self.flat, *(ids for ids, _ in made)])
        at = np.fromiter(map(self.slot.__getitem__, flat), np.int64, len(flat))
        n = self.lens[at]
        total = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum([len(chunks) for chunks in cut]).astype(np.int64)
        return self.flat[ranges(self.starts[at], n)], np.diff(total[np.concatenate([[0], ends])])


def _utf8(raw: bytes) -> str:
    """Bytes as text; each byte that begins no character is a replacement character."""
    out, at = [], 0
    while True:
        try:
            return "".join([*out, raw[at:].decode()])
        except UnicodeDecodeError as bad:
            out += [raw[at : at + bad.start].decode(), "�"]
            at += bad.start + 1


class Decoder:
    def __init__(self, rules: dict):
        self.rules = rules

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of rows of ids; the space that encoding put first is taken away."""
        r = self.rules
        if len(ids) and (ids.min() < 0 or ids.max() >= len(r["sizes"])):
            raise ValueError("an id is outside the vocabulary")
        ends = np.cumsum(counts)
        sizes = r["sizes"][ids]
        starts = r["starts"][ids]
        # The first id of each row that is no control sign: positions of such ids, then the next one from the row's start.
        said = np.flatnonzero(~r["control"][ids])
        at = np.searchsorted(said, ends - counts)
        has = at < np.searchsorted(said, ends)
        lead = said[at[has]]
        lead = lead[r["opens"][ids[lead]]]
        starts[lead] += 1
        sizes[lead] -= 1
        total = np.concatenate([[0], np.cumsum(sizes)])
        cut = total[np.concatenate([[0], ends]).astype(np.int64)]
        data = r["raw"][ranges(starts, sizes)]
        blob = data.tobytes()
        sound = len(said) == len(ids)
        try:
            blob.decode()
            begins = cut[:-1][cut[:-1] < len(data)]
            sound &= not ((data[begins] & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            sound = False
        if sound:
            return strings(data, cut)
        # A control sign ends a run of byte pieces, as the end of a row does.
        edges = np.union1d(cut, total[np.flatnonzero(r["control"][ids])])
        made = [_utf8(blob[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        parts = np.searchsorted(edges, cut)
        return pa.array(["".join(made[a:b]) for a, b in zip(parts[:-1], parts[1:])], pa.string())


def _encoding(rules, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Kept with the broadcast rules: the next task of this worker knows the stretches and pairs of the last one.
        if "coder" not in rules.value:
            rules.value["coder"] = Encoder(rules.value)
        coder = rules.value["coder"]
        for batch in batches:
            for part in slices(batch, "__text"):
                ids, n = coder.encode(part.column("__text").to_pylist())
                made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
                rest = part.drop_columns(["__text"])
                yield pa.RecordBatch.from_arrays([*rest.columns, made], [*rest.schema.names, out])

    return run


def _decoding(rules, ids: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Decoder(rules.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                lists = part.column(ids)
                counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*part.columns, coder.decode(flat, counts)], [*part.schema.names, out])

    return run


def _shape(docs: DataFrame, **new: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in docs.schema if f.name != "__text"), *(T.StructField(n, t) for n, t in new.items())])


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``: the ids (array<int>) of each whole text; null counts as empty, which has no ids.

    ``path`` is a sentencepiece model of kind BPE with byte pieces; it is read on
    the driver and broadcast (its size is the vocabulary's). Texts of any length,
    with or without spaces, take time in proportion. A present column ``out`` is replaced.
    """
    rules = docs.sparkSession.sparkContext.broadcast(load_rules(path))
    docs = docs.drop(out).withColumn("__text", whole(text))
    return docs.mapInArrow(_encoding(rules, out), _shape(docs, **{out: T.ArrayType(T.IntegerType())}))


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the text of each array of ids; a null array gives the empty text.

    Control signs say nothing, bytes that are no UTF-8 become replacement
    characters, an id outside the vocabulary stops the job. A present column ``out`` is replaced.
    """
    rules = docs.sparkSession.sparkContext.broadcast(load_rules(path))
    docs = docs.drop(out)
    return docs.mapInArrow(_decoding(rules, ids, out), _shape(docs, **{out: T.StringType()}))


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass: both new columns from one worker a task."""
    rules = docs.sparkSession.sparkContext.broadcast(load_rules(path))
    docs = docs.drop(ids, out).withColumn("__text", whole(text))
    there, back = _encoding(rules, ids), _decoding(rules, ids, out)
    return docs.mapInArrow(
        lambda batches: back(there(batches)), _shape(docs, **{ids: T.ArrayType(T.IntegerType()), out: T.StringType()})
    )


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of an encode and decode round trip."""
    coded = round_trip(docs.select(key, text), path, text)
    return coded.select(
        key, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
