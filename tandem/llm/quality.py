"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm import labelled
from tandem.llm.common import slices, whole
from tandem.llm.words import Hasher, mixed

PER_CLASS = 2_000  # labelled rows of each class, at most
TERMS = 4_096  # buckets of terms
RANK = 32
NEIGHBOURS = 25
BLOCK = 1_024
KEEP = 0.3
FOLDS, HELD = 5, 0

SPACES = np.ones(256, bool)
SPACES[[32, *range(9, 14)]] = False
#: Letters of either case, digits and bytes outside ASCII are one class each; every mark is its own.
CLASS = np.arange(256, dtype=np.uint64)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 97, 65, 48, 97


class Shapes:
    """Sparse term counts of texts. A term is the shape of a word or of two in a row, with what it repeats.

    A shape is the sequence of character classes without doublings: ``Aa`` for
    a name, ``a.`` for a last word, ``A!`` for shouting. A word that equals the
    one before it has the same shape in another term.
    """

    def __init__(self, terms: int = TERMS):
        self.words, self.terms = Hasher(SPACES, lower=False), terms

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count), sorted by text and term."""
        h, row, first, size = self.words.words(texts)
        if not len(h):
            none = np.zeros(0, np.int64)
            return none, none, none
        data = self.words.data
        kind = CLASS[data]
        starts = np.zeros(len(data) + 1, bool)
        starts[1:-1] = kind[1:] != kind[:-1]
        starts[first] = True
        rank = np.concatenate([[0], np.cumsum(starts[:-1])])
        at = np.flatnonzero(starts[:-1])
        total = np.concatenate([[np.uint64(0)], np.cumsum(kind[at] * self.words.up[: len(at)], dtype=np.uint64)])
        a, b = rank[first], rank[first + size]
        shape = mixed((total[b] - total[a]) * self.words.down[a] + (b - a).astype(np.uint64))
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        one = mixed(shape + again.astype(np.uint64))
        pair = mixed(one[1:] + mixed(shape[:-1]) * np.uint64(3))
        same = row[1:] == row[:-1]
        term = np.concatenate([one, pair[same]]) % np.uint64(self.terms)
        of = np.concatenate([row, row[1:][same]])
        key, n = np.unique(of * self.terms + term.astype(np.int64), return_counts=True)
        return key // self.terms, key % self.terms, n


class Model:
    """Latent vectors of labelled texts; exact blocked cosines and similarity-weighted votes."""

    def __init__(self, texts: np.ndarray, terms: np.ndarray, counts: np.ndarray, labels: np.ndarray, idf: np.ndarray):
        self.idf, self.labels = idf, labels.astype(np.float32)
        self.base = float(self.labels.mean()) if len(labels) else 0.5
        x = np.zeros((len(labels), len(idf)), np.float32)
        x[texts, terms] = np.log1p(counts) * idf[terms]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        # Right singular vectors from the smaller of the two Gram matrices.
        used = np.flatnonzero(x.any(0))
        self.basis = np.zeros((len(idf), RANK), np.float32)
        if len(used):
            x = x[:, used].astype(np.float64)
            if len(x) < len(used):
                w, u = np.linalg.eigh(x @ x.T)
                keep = np.flatnonzero(w > 1e-9)[::-1][:RANK]
                v = x.T @ u[:, keep] / np.sqrt(w[keep])
            else:
                w, v = np.linalg.eigh(x.T @ x)
                v = v[:, np.flatnonzero(w > 1e-9)[::-1][:RANK]]
            self.basis[used[:, None], np.arange(v.shape[1])] = v
        self.vectors = self.project(texts, terms, counts, len(labels))

    def project(self, texts: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        weight = (np.log1p(counts) * self.idf[terms]).astype(np.float32)
        out = np.zeros((n, RANK), np.float32)
        ends = np.searchsorted(texts, np.arange(n + 1))
        for a in range(0, n, 256):
            b = min(n, a + 256)
            dense = np.zeros((b - a, len(self.idf)), np.float32)
            part = slice(ends[a], ends[b])
            dense[texts[part] - a, terms[part]] = weight[part]
            out[a:b] = dense @ self.basis
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def votes(self, vectors: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by cosine; the base rate without any."""
        score = np.full(len(vectors), self.base)
        k = min(NEIGHBOURS, len(self.labels))
        if not k:
            return score
        for a in range(0, len(vectors), BLOCK):
            cos = vectors[a : a + BLOCK] @ self.vectors.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cos, near, 1), 0.0).astype(np.float64) ** 4
            total = w.sum(1)
            share = (w * self.labels[near]).sum(1) / np.maximum(total, 1e-12)
            score[a : a + BLOCK] = np.where(total > 1e-9, share, self.base)
        return np.clip(score, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Learn from at most ``per_class`` labelled rows of either class, none of them held out.

    How many documents have a term is counted over all documents.
    """
    keys, values = labelled.sample(labels, label, key, labelled.remainder(key, FOLDS) != HELD, per_class)
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, seen, n = Shapes(), np.zeros(TERMS, np.int64), 0
        row = lambda k, i, t, c: pa.RecordBatch.from_arrays(
            [pa.array(np.asarray(x, np.int64)) for x in (np.full(len(t), k), i, t, c)], ["kind", "row", "term", "n"]
        )
        for batch in batches:
            for part in slices(batch, "__text"):
                texts, terms, counts = shapes.counts(part.column("__text"))
                seen += np.bincount(terms, minlength=TERMS)
                n += part.num_rows
                at = labelled.place(labelled.numbers(part.column(key)), shared.value)[texts]
                taught = at >= 0
                if taught.any():
                    yield row(1, at[taught], terms[taught], counts[taught])
        used = np.flatnonzero(seen)
        yield row(0, np.zeros(len(used)), used, seen[used])
        yield row(2, [0], [0], [n])

    cells = docs.select(key, whole(text).alias("__text")).mapInArrow(run, "kind long, row long, term long, n long")
    # At most TERMS x (2 x per_class + 1) + 1 cells. A repeated key adds up.
    got = cells.groupBy("kind", "row", "term").agg(F.sum("n").alias("n")).orderBy("kind", "row", "term").toPandas()
    df = np.zeros(TERMS)
    own = got[got.kind == 0]
    df[own.term.to_numpy(np.int64)] = own.n.to_numpy()
    total = float(got[got.kind == 2].n.sum())
    taught = got[got.kind == 1]
    return Model(
        taught.row.to_numpy(np.int64), taught.term.to_numpy(np.int64), taught.n.to_numpy(np.float64), values,
        np.log((1.0 + total) / (1.0 + df)).astype(np.float32) + 1.0,
    )


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``out``, 0 to 1: how likely label 1 is for the whole text.

    A null or empty text gets the base rate of the labels; so does every text
    if there are no labels at all (0.5). A present column ``out`` is replaced.
    """
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema, T.StructField(out, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            for part in slices(batch, "__text"):
                found = shapes.counts(part.column("__text"))
                score = shared.value.votes(shared.value.project(*found, part.num_rows))
                rest = part.drop_columns(["__text"])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(score)], [*rest.schema.names, out])

    return docs.withColumn("__text", whole(text)).mapInArrow(run, schema)


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` (score >= KEEP) of every document."""
    model = fit(docs, labels, key, text)
    return scores(docs.select(key, F.col(text)), model, key, text).select(
        key, (labelled.remainder(key, FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with a score of KEEP or more, columns as given."""
    scored = scores(docs, fit(docs, labels, key, text), key, text, "__score")
    return scored.where(F.col("__score") >= KEEP).select(*docs.columns)
