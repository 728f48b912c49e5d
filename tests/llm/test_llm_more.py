"""Whitening, importance resampling and pieces against brute force or the library, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tandem.llm import pieces, resample, whitening
from tandem.llm.queries import QUERIES, tokenizer_file

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"


# 11 whitening


def lattice(vectors):
    return np.array([np.floor(64 * np.asarray(v, np.float32).astype(np.float64)).astype(np.int64) + 1_000_000 for v in vectors])


def check_whitened(rows, x, ids, components):
    n, total = len(x), x.sum(0)
    centred = (n * x - total) / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    want = centred @ (vectors / np.sqrt(values))
    assert len(rows) == n * len(values)
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r["whitened"])
        assert r["n"] == n and r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(covariance), rel=1e-9)
        assert r["identity_error"] < 1e-9
    sign = np.sign([got[ids[0]][c + 1][0] / want[0, c] for c in range(len(values))])
    for i, w in zip(ids, want * sign):
        assert any(np.allclose([got[i][c + 1][k] for c in range(len(values))], w, atol=1e-8) for k in range(len(got[i][1])))
    deviation = ((n * x - total) ** 2).sum(1)
    assert Counter((r["vec_id"], r["deviation"]) for r in rows if r["component"] == 1) == Counter(zip(ids, deviation.tolist()))


def test_whitening_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 16)
    monkeypatch.setattr(whitening, "COLUMNS", 2)
    rnd = np.random.default_rng(5)
    sound = [(int(i), [float(c) for c in v], 0) for i, v in enumerate(rnd.normal(size=(90, 5)) @ rnd.normal(size=(5, 5)))]
    sound += [sound[3], (None, sound[4][1], None)]
    odd = [(900, None, 1), (901, [], 1), (902, [1.0, 2.0], 1), (903, [1.0, None, 3.0, 4.0, 5.0], 1),
           (904, [float("nan")] * 5, 1), (905, [1.0, 2.0, float("inf"), 4.0, 5.0], 1)]
    table = spark.createDataFrame([*sound[:40], *odd, *sound[40:]], VECTORS).repartition(5)
    table = table.withColumn("n", F.lit("n")).withColumn("index", F.lit(1)).withColumn("v", F.lit(2)).withColumn("x", F.lit(3))
    rows = whitening.by_component(table, components=4).collect()
    check_whitened(rows, lattice([v for _, v, _ in sound]), [i for i, _, _ in sound], 4)


def test_whitening_without_variance(spark):
    assert whitening.by_component(spark.createDataFrame([], VECTORS)).collect() == []
    assert whitening.by_component(spark.createDataFrame([(1, None, 0), (2, [], 0)], VECTORS)).collect() == []
    one = whitening.by_component(spark.createDataFrame([(1, [1.0, 2.0], 0)], VECTORS)).collect()
    assert [(r["component"], r["whitened"], r["explained"], r["deviation"]) for r in one] == [(1, None, None, 0), (2, None, None, 0)]
    flat = spark.createDataFrame([(i, [float(i), 7.0], 0) for i in range(10)], VECTORS)
    rows = whitening.by_component(flat).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) and r["identity_error"] < 1e-9 for r in rows)


def test_whitening_of_a_table(spark):
    given = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    rows = QUERIES["op11_embedding_whitening"](spark, SF).collect()
    sound = [(i, v) for i, v in zip(given["vec_id"], given["embedding"]) if v is not None and np.isfinite(np.asarray(v, float)).all()]
    check_whitened(rows, lattice([v for _, v in sound]), [int(i) for i, _ in sound], 32)


def test_deviations_beyond_a_long_stop_the_job(spark):
    far = spark.createDataFrame([(i, [float(3e7 * (i % 2))], 0) for i in range(200)], VECTORS)
    with pytest.raises(Exception, match="does not fit a long"):
        whitening.whiten(far)


# 12 importance resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text, grams=2):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    runs = [" ".join(words[i : i + g]) for g in range(1, grams + 1) for i in range(len(words) - g + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def brute_resample(docs, target, percent=25, least=20):
    own = [(i, *brute_features(t)) for i, t in docs]
    s, t = (Counter(b for _, buckets in part for b in buckets) for part in ([x[1:] for x in own], [brute_features(x) for x in target]))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (total_s + 10_000.0) / ((s[b] + 1.0) * (total_t + 10_000.0))))
    out, able = [], []
    for k, (i, n, buckets) in enumerate(own):
        weight = sum(map(gain, buckets)) // len(buckets) if buckets else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(buckets), weight, score, None])
        if n >= least:
            able.append((-score, i is None, i or 0, k))
    for rank, (*_, k) in enumerate(sorted(able)[: percent * len(able) // 100]):
        out[k][4] = rank + 1
    return Counter(map(tuple, out))


def test_resampling_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(resample, "STEP", 400)  # words and texts over many pieces
    rnd = random.Random(3)
    vocabulary = ["the", "Of", "AND", "é", "漢字", "x1", "12", "z" * 70, "y" * 5000, "İ", " ", "\u0085"] + ["w%d" % i for i in range(60)]
    prose = lambda n: "".join(rnd.choice(vocabulary) + rnd.choice([" ", "\n", "--", "\x01", "\x00", "_", "\x7f"]) for _ in range(n))
    rows = [(i, prose(rnd.randint(0, 60))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "  \n"), (203, "one"), (204, prose(3000)), rows[5], rows[5], (None, rows[6][1]), (None, None)]
    target = [prose(30) for _ in range(10)] + [None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.withColumn("n_words", F.lit("a")).withColumn("score", F.lit("b")).withColumn("rank", F.lit("c")).withColumn("bucket", F.lit(0))
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(docs, bench).collect()
    assert Counter(tuple(r) for r in got) == brute_resample(rows, target)
    assert resample.resample(docs.limit(0), bench).collect() == []
    alone = resample.resample(docs, bench.limit(0)).collect()
    assert Counter(tuple(r) for r in alone) == brute_resample(rows, [])


def test_resampling_of_a_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    got = QUERIES["op12_importance_resampling"](spark, SF)
    assert {t for _, t in got.dtypes} == {"bigint"}
    assert Counter(tuple(r) for r in got.collect()) == brute_resample(docs, target)


@pytest.mark.parametrize("grams", [1, 2, 4])
def test_crcs_compose(grams, monkeypatch):
    monkeypatch.setattr(resample, "STEP", 50)
    import pyarrow as pa

    texts = ["a bb ccc " + "q" * 9000 + " dddd", "", "one", "x " * 100]
    found = Counter()
    for _, owners, buckets in resample.Features(grams, 10_000)(pa.array(texts)):
        found.update(zip(owners.tolist(), buckets.tolist()))
    assert found == Counter((k, b) for k, t in enumerate(texts) for b in brute_features(t, grams)[1])


# 13 pieces


@pytest.fixture(scope="module")
def model():
    return tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_file=model)


def test_pieces_match_the_library(spark, model, library):
    rnd = random.Random(11)
    known = [library.id_to_piece(i) for i in range(259, 32_000)]
    letters = "ab ▁  \n\t\r;{}()éü漢字ゼ\U0001f600\x00 ee the in er 12.,'"
    texts = [None, "", " ", "▁", "a" * 3000, "ab" * 9000, " " * 500, "=" * 700, "\U0001f600" * 50]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    texts += ["".join(rnd.choice("abcdeinrst ") for _ in range(200)) for _ in range(100)]
    texts += ["".join(rnd.choice(known) for _ in range(30)) for _ in range(200)]
    rows = list(enumerate(texts)) + [(None, "repeated"), (None, "repeated"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("ids", F.lit("i")).withColumn("decoded", F.lit(1))
    got = pieces.round_trip(docs, model).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    for r in got:
        want = library.encode(r["text"] or "")
        assert r["ids"] == want and r["decoded"] == library.decode(want)
    assert pieces.digests(docs.limit(0), model).collect() == []


def test_any_ids_decode_as_in_the_library(spark, model, library):
    rnd = random.Random(2)
    rows = [([rnd.randrange(300) for _ in range(rnd.randint(0, 20))],) for _ in range(1500)] + [([1, 1, 260, 2, 260],), ([],), (None,)]
    got = pieces.decode(spark.createDataFrame(rows, "ids array<int>"), model).collect()
    for r in got:
        assert r["decoded"] == (library.decode(r["ids"]) if r["ids"] else "")
    with pytest.raises(Exception, match="outside the vocabulary"):
        pieces.decode(spark.createDataFrame([([32_000],)], "ids array<int>"), model).collect()


def test_forgotten_chunks_and_pairs_change_nothing(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_CHUNKS", 3)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 2)
    coder = pieces.Encoder(pieces.load_rules(model))
    for text in ["one two three four five", "six one", "two seven  eight\nnine"] * 2:
        assert coder.encode([text])[0].tolist() == library.encode(text)


def test_pieces_of_a_table(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["op13_piece_round_trip"](spark, SF).collect():
        ids = library.encode(docs[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()
        )


def test_counting_into_a_sketch_takes_no_second_sketch():
    import tracemalloc

    import numpy as np

    from tandem.llm import toxicity

    table, spots, n = np.zeros(2 << toxicity.BITS, np.int64), np.array([3, 9, 3, 2_000_000]), np.array([1, 2, 5, 7])
    tracemalloc.start()
    toxicity.add_counts(table, spots, n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 20 and table[[3, 9, 2_000_000]].tolist() == [6, 2, 7] and table.sum() == 15
