"""Toxicity by maximum-scoring segments of token log-odds, calibrated by extreme values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm import labelled
from tandem.llm.common import slices, whole
from tandem.llm.words import Hasher, mixed

PER_CLASS = 8_000  # labelled rows of each class, at most
BITS = 20  # each of the two rows of a count sketch has 2^BITS cells
PREFIXES = (4, 5, 6, 7, 8, None)  # bytes of a word that each level of the prior sees, coarse to fine
WEIGHT = 5.0  # pseudo-counts of the level above
SHARE = 1e5  # and these, times the level's share of the corpus
DRIFT = 1.0  # taken off every token, so that chance alone does not add up
TOXIC = 0.7
FOLDS, HELD = 3, 1
STEP = 1 << 20  # text bytes handled at once
CALIBRATE = 4  # every so many-th labelled row calibrates; the rest give the counts
TOP_CLEAN, TOP_TOXIC, ALL = 0, 1, 2
EULER = 0.5772156649015329


def cells(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The two sketch cells of each hash at one level."""
    mask = np.uint64((1 << BITS) - 1)
    a = mixed(h + np.uint64(2 * level + 1))
    return (a & mask).astype(np.int64), ((a >> np.uint64(32)) & mask).astype(np.int64) + (1 << BITS)


def add_counts(table: np.ndarray, spots: np.ndarray, n: np.ndarray) -> None:
    """Add ``n`` at the given cells, without another array of the sketch's size."""
    np.add.at(table, spots, n)


def segments(x: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end) of a sequence, in one pass.

    A stack holds candidates with the running sum before and after each. A new
    candidate joins the nearest earlier one that starts lower, if it ends
    higher; else it stands alone. Only positive tokens are visited, the sums
    between them are taken from the running sum.
    """
    total = np.concatenate([[0.0], np.cumsum(x)])
    held: list[tuple[float, float, int, int]] = []
    for i in np.flatnonzero(x > 0).tolist():
        low, high, start = float(total[i]), float(total[i + 1]), i
        while True:
            j = len(held) - 1
            waiting = []
            while j >= 0 and held[j][0] >= low:
                waiting.append(held[j])
                j -= 1
            if j < 0 or held[j][1] >= high:
                held.append((low, high, start, i + 1))
                break
            low, _, start, _ = held[j]
            del held[j:]
    return [(high - low, a, b) for low, high, a, b in held]


class Model:
    """Token log-odds from a count sketch, and what their best segments mean."""

    def __init__(self, toxic: np.ndarray, clean: np.ndarray, corpus: np.ndarray):
        self.toxic, self.clean = toxic.astype(np.float32), clean.astype(np.float32)
        half = 1 << BITS
        t, c = float(toxic[:half].sum()), float(clean[:half].sum())
        self.ratio = c / t if t and c else 1.0
        self.corpus = (corpus / max(float(corpus[:half].sum()), 1.0)).astype(np.float32)
        self.lam, self.k, self.weights = 1.0, 1.0, (-1.0, 1.0)

    def log_odds(self, words: Hasher, which: np.ndarray) -> np.ndarray:
        """Each level's counts are added to the odds of the level above: Dirichlet priors, coarse to fine."""
        odds = np.ones(len(which))
        for level, size in enumerate(PREFIXES):
            a, b = cells(words.prefixes(size, which), level)
            t = np.minimum(self.toxic[a], self.toxic[b]) * self.ratio
            c = np.minimum(self.clean[a], self.clean[b])
            prior = WEIGHT + SHARE * np.minimum(self.corpus[a], self.corpus[b])
            odds = (t + prior * odds) / (c + prior)
        return np.log(odds)

    def passages(self, words: Hasher, texts: pa.Array) -> list[tuple[int, list[tuple[float, int, int]]]]:
        """(tokens, maximal segments) of every text."""
        h, row, _, _ = words.words(texts)
        ends = np.searchsorted(row, np.arange(len(texts) + 1))
        if not len(h):
            return [(0, []) for _ in range(len(texts))]
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        x = self.log_odds(words, first)[back] - DRIFT
        again = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1])) + 1
        x[again] = np.minimum(x[again], -DRIFT)  # saying a word again at once adds nothing
        return [(b - a, segments(x[a:b])) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def evidence(self, tokens: int, found: list[tuple[float, int, int]]) -> float:
        """Sum over passages of log(1 / expected number of chance passages at least as high), where above 0."""
        chance = np.log(self.k * max(tokens, 1))
        return float(sum(max(0.0, self.lam * s - chance) for s, _, _ in found))

    def calibrate(self, tokens: np.ndarray, best: np.ndarray, evidence, labels: np.ndarray) -> None:
        """Extreme-value law of the best segment of clean texts, then a logistic curve over the evidence."""
        clean = (labels == 0) & (tokens > 0)
        if clean.sum() > 10:
            s, n = best[clean], np.log(tokens[clean])
            lam = 1.0
            for _ in range(50):
                lam = float(np.clip(np.pi / (np.sqrt(6) * max(float(np.std(s - n / lam)), 1e-3)), 0.2, 5.0))
            self.lam = lam
            self.k = float(np.exp(np.clip(np.mean(lam * s - n) - EULER, -30, 5)))
        x = np.log1p(evidence(self))
        a, b = -1.0, 1.0
        if len(set(labels.tolist())) > 1:
            for _ in range(100):
                p = 1 / (1 + np.exp(-(a + b * x)))
                w = p * (1 - p)
                g = np.array([(labels - p).sum() - 0.1 * a, ((labels - p) * x).sum() - 0.1 * b])
                hess = np.array([[w.sum() + 0.1, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.1]])
                step = np.linalg.solve(hess, g)
                a, b = a + step[0], b + step[1]
                if abs(step).max() < 1e-9:
                    break
        self.weights = (float(a), float(b))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.weights[0] + self.weights[1] * np.log1p(evidence))))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Learn from at most ``per_class`` labelled rows of either class, none of them held out.

    The corpus shares of words and word beginnings are counted over all
    documents. All tables have a fixed size, whatever the input's.
    """
    keys, values = labelled.sample(labels, label, key, labelled.remainder(key, FOLDS) != HELD, per_class)
    role = np.where(np.arange(len(keys)) % CALIBRATE == 0, -1, values)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((keys, role))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Hasher()
        tables = np.zeros((3, 2 << BITS), np.int64)
        for batch in batches:
            for part in slices(batch, "__text", STEP):
                h, row, _, _ = words.words(part.column("__text"))
                at = labelled.place(labelled.numbers(part.column(key)), shared.value[0])
                kind = np.where(at >= 0, shared.value[1][at] if len(shared.value[1]) else -1, -1)[row]
                _, first, back = np.unique(h, return_index=True, return_inverse=True)
                every = np.bincount(back, minlength=len(first))
                # A labelled text teaches each of its words once, however often it says it.
                taught = np.flatnonzero(kind >= 0)
                once = taught[np.unique(row[taught] * len(first) + back[taught], return_index=True)[1]]
                of = [np.bincount(back[once][kind[once] == k], minlength=len(first)) for k in (0, 1)]
                for level, size in enumerate(PREFIXES):
                    for side in cells(words.prefixes(size, first), level):
                        for t, n in ((TOP_CLEAN, of[0]), (TOP_TOXIC, of[1]), (ALL, every)):
                            if n.any():
                                add_counts(tables[t], side, n)
        for t in range(3):
            at = np.flatnonzero(tables[t])
            for a in range(0, len(at), 1 << 18):
                part = at[a : a + (1 << 18)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), t, np.int32)), pa.array(part.astype(np.int32)), pa.array(tables[t][part])],
                    ["kind", "cell", "n"],
                )

    rows = docs.select(key, whole(text).alias("__text"))
    sums = rows.mapInArrow(count, "kind int, cell int, n long").groupBy("kind", "cell").agg(F.sum("n").cast("double").alias("n"))
    got = sums.toArrow()  # at most 3 x 2^(BITS + 1) rows
    tables = np.zeros((3, 2 << BITS))
    tables[got.column("kind").to_numpy(), got.column("cell").to_numpy()] = got.column("n").to_numpy()
    model = Model(tables[TOP_TOXIC], tables[TOP_CLEAN], tables[ALL])
    told = context.broadcast(model)
    tested = keys[role < 0]
    wanted = context.broadcast(tested)

    def try_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Hasher()
        for batch in batches:
            at = labelled.place(labelled.numbers(batch.column(key)), wanted.value)
            own = batch.filter(pa.array(at >= 0))
            at = at[at >= 0]
            done = 0
            for part in slices(own, "__text", STEP):
                found = told.value.passages(words, part.column("__text"))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(at[done : done + part.num_rows]), pa.array([n for n, _ in found], pa.int64()),
                        pa.array([[s for s, _, _ in f] for _, f in found], pa.list_(pa.float64())),
                    ],
                    ["row", "tokens", "found"],
                )
                done += part.num_rows

    seen = rows.mapInArrow(try_out, "row long, tokens long, found array<double>").dropDuplicates(["row"]).orderBy("row").toPandas()
    tokens = seen.tokens.to_numpy(np.float64)
    best = np.array([max(f, default=0.0) for f in seen.found])
    lists = [[(s, 0, 0) for s in f] for f in seen.found]
    evidence = lambda m: np.array([m.evidence(n, f) for n, f in zip(tokens, lists)])
    model.calibrate(tokens, best, evidence, values[role < 0][seen.row.to_numpy(np.int64)].astype(float))
    return model


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``score`` (0 to 1, higher: more likely toxic) and ``passages`` of every whole text.

    ``passages`` are the maximal segments above what chance gives, as
    (word, words, evidence). Null counts as empty; an empty text has no
    passage and the score of no evidence.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[key]
    passage = pa.list_(pa.struct([("word", pa.int32()), ("words", pa.int32()), ("evidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, m = Hasher(), told.value
        for batch in batches:
            for part in slices(batch, "__text", STEP):
                found = m.passages(words, part.column("__text"))
                score = m.score(np.array([m.evidence(n, f) for n, f in found]))
                spans = [
                    [dict(word=a, words=b - a, evidence=e) for s, a, b in f if (e := m.evidence(n, [(s, a, b)])) > 0] for n, f in found
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array(score), pa.array(spans, passage)], [key, "score", "passages"]
                )

    return docs.select(key, whole(text).alias("__text")).mapInArrow(
        run, f"`{key}` {kind}, score double, passages array<struct<word:int,words:int,evidence:double>>"
    )


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``score``, ``predicted`` (score >= TOXIC) and ``n_passages`` of every document."""
    return scores(docs, fit(docs, labels, key, text), key, text).select(
        key, (labelled.remainder(key, FOLDS) == HELD).alias("held_out"), "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"),
    )
