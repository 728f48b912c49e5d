"""Joins and refusals, predictors with a planted signal, reports, and SQL twins."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.catalog import QUERIES, SQL
from tandem.checks import CheckFailed
from tandem.columns import gain
from tandem.functions import arrays
from tandem.operators import joins, labels, predict, splits
from tandem.plans import compare, experiment
from tandem.sources import captures, sinks

FOLDER = "/root/testdata/sf0.001"


def test_alignment_refusals(spark):
    lab = spark.createDataFrame([("a", True, False), ("b", False, True)], "sample_id string, correct_off boolean, correct_on boolean")
    meta = spark.createDataFrame([("b", 1), ("a", 2), ("z", 3)], "sample_id string, n int")
    assert {r.sample_id: r.n for r in joins.align_labels(lab, meta).collect()} == {"a": 2, "b": 1}
    with pytest.raises(Exception, match="no matching capture row"):
        joins.align_labels(lab, meta.where("sample_id <> 'a'")).collect()
    with pytest.raises(CheckFailed, match="duplicate"):
        joins.align_labels(lab, meta.union(meta))


def test_confidence_sources(spark):
    meta = spark.createDataFrame([("a",), ("b",)], "sample_id string").withColumn(
        "confidence_off", F.struct(F.lit(-1.0).alias("mean_logprob")))
    side = meta.withColumn("confidence_off", F.struct(F.lit(-2.0).alias("mean_logprob"))).withColumn(
        "confidence_version", F.lit(2)).withColumn("flags", F.array().cast("array<string>"))
    assert joins.resolve_confidence(meta, None).first().confidence_version == 1
    assert joins.resolve_confidence(meta, side).first().confidence_off.mean_logprob == -2.0
    assert joins.resolve_confidence(meta, side, "stored").first().confidence_off.mean_logprob == -1.0
    with pytest.raises(CheckFailed):
        joins.resolve_confidence(meta, None, "v2")
    with pytest.raises(CheckFailed):
        joins.resolve_confidence(meta, None, "newest")
    with pytest.raises(Exception, match="incomplete"):
        joins.resolve_confidence(meta, side.where("sample_id = 'a'")).collect()


def test_grid_and_templates(spark):
    got = joins.parameter_grid(spark, {"seed": [1, 2]}, {"task": ["g", "l"], "split": ["test", "test"]}, [{"task": "l", "seed": 2}])
    assert sorted((r.seed, r.task) for r in got.collect()) == [(1, "g"), (1, "l"), (2, "g")]
    for bad in (({"a": []}, None), (None, {"a": [1], "b": [1, 2]})):
        with pytest.raises(CheckFailed):
            joins.parameter_grid(spark, *bad)
    with pytest.raises(CheckFailed, match="unknown variable"):
        joins.substitute("x/{nope}", ["seed"])


def test_pool_and_promote_refusals(spark):
    a = spark.createDataFrame([([1.0, 2.0],)], "vec array<double>")
    b = spark.createDataFrame([([1.0],)], "vec array<double>")
    with pytest.raises(CheckFailed, match="widths"):
        joins.pool({"a": a, "b": b}, vector="vec")
    old = spark.createDataFrame([("x", 1.0)], "k string, v double")
    new = spark.createDataFrame([("x", 2.0), ("y", 1.0)], "k string, v double")
    with pytest.raises(CheckFailed, match="would change"):
        joins.promote(old, new, ["k"], ["v"])
    assert {r.k: r.v for r in joins.promote(old, new, ["k"], ["v"], force=True).collect()} == {"x": 2.0, "y": 1.0}


def test_size_gates_and_unknown_target(spark):
    df = spark.range(50).select((F.col("id") < 30).alias("correct_off"), F.lit(True).alias("correct_on"))
    with pytest.raises(CheckFailed, match="only 20 rows"):
        labels.require_enough(df, "rescued")
    with pytest.raises(CheckFailed):
        labels.target(df, "nope")


def test_baseline_choice(spark):
    rows = [("a", .6, .9), ("b", .7, .5)]
    df = spark.createDataFrame(rows, "name string, test_auroc double, val_auroc double").withColumn("t", F.lit(1))
    assert tuple(compare.best_baseline(df, ["t"]).first()[c] for c in ("name", "selected_on")) == ("a", "val")
    none = df.withColumn("val_auroc", F.lit(None).cast("double"))
    assert tuple(compare.best_baseline(none, ["t"]).first()[c] for c in ("name", "selected_on")) == ("b", "test")


def test_option_scoring(spark):
    lp = np.log(np.full(10, 1e-6))
    lp[3], lp[4], lp[7] = np.log([.30, .10, .20])
    df = spark.createDataFrame([(lp.tolist(), {"A": [3], "B": [4, 7]}, ["A", "B"])],
                               "lp array<double>, ids map<string, array<int>>, options array<string>")
    got = arrays.score_options(df, "lp", "ids", "options").first()
    assert got.probs == pytest.approx([.5, .5]) and got.option_mass == pytest.approx(.6)
    assert [r[0] for r in spark.range(1).select(arrays.default_layers(F.lit(36))).collect()] == [[9, 18, 27, 33, 34, 35, 36]]
    with pytest.raises(CheckFailed):
        arrays.resolve_layers([9], 4)


def planted(spark, n=600, d=8, strength=2.0, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = rng.random(n) < 1 / (1 + np.exp(-strength * x[:, 0]))
    rows = [(i, f"t-g{i % 3}-{i}", [float(v) for v in x[i]], bool(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, sample_id string, vec array<double>, y boolean"), x, y


def test_logistic_fit_is_the_optimum(spark):
    df, x, y = planted(spark)
    beta = predict.fit_logistic_groups(df.withColumn("seed", F.lit(1)), "seed", "vec", "y")[1]
    z = np.column_stack([x, np.ones(len(x))]) @ beta
    grad = np.column_stack([x, np.ones(len(x))]).T @ (1 / (1 + np.exp(-z)) - y) + np.r_[beta[:-1], 0]
    assert np.abs(grad).max() < 1e-5
    model = predict.fit_logistic(df.withColumn("f", predict.array_to_vector("vec")), "f", "y", max_iter=300)
    assert np.allclose(np.r_[np.array(model.coefficients), model.intercept], beta, atol=2e-3)


def test_probe_recovers_signal_and_transfers_unchanged(spark):
    df, _, _ = planted(spark)
    df = df.withColumn("correct_off", ~F.col("y")).withColumn("correct_on", F.lit(True))
    metrics, _, points = experiment.run_probe(df, "vec", "y", "id", [1, 2])
    test = [r for r in metrics.collect() if r.split == "test"]
    assert len(test) == 2 and all(r.auroc > .75 for r in test)
    noise, _, _ = planted(spark, strength=0.0, seed=5)
    noise = noise.withColumn("correct_off", ~F.col("y")).withColumn("correct_on", F.lit(True))
    flat = [r.auroc for r in experiment.run_probe(noise, "vec", "y", "id", [1, 2])[0].collect() if r.split == "test"]
    assert all(.3 < a < .7 for a in flat)
    probes = spark.createDataFrame(
        [("src", "needs_thinking", "off", p["seed"], 8, p["coef"], p["intercept"], p["mean"], p["sd"], p["threshold"]) for p in points],
        "source string, objective string, prefill_mode string, seed int, input_dim int, coef array<double>, intercept double, mean array<double>, sd array<double>, threshold double")
    other, x, _ = planted(spark, seed=7)
    tasks = spark.createDataFrame([("needs_thinking", "src"), ("needs_thinking", "tgt")], "objective string, task string")
    rows = other.withColumn("task", F.lit("tgt")).withColumn("correct_off", ~F.col("y")).withColumn("correct_on", F.lit(True))
    scored = compare.transfer_scores(probes, rows, tasks)
    p = points[0]
    one = scored.where(f"seed = {p['seed']} and id = 0").first().score
    z = ((x[0] - np.array(p["mean"])) / np.array(p["sd"])) @ np.array(p["coef"]) + p["intercept"]
    assert one == pytest.approx(1 / (1 + np.exp(-z)))
    got = compare.evaluate_transfer(scored, "y", "id", 20)[1].first()
    assert got.transfer_auroc > .7 and got.n_seeds == 2


def test_cross_fit_against_least_squares(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    yv = x @ [1.0, -2.0, .5] + 3 + .1 * rng.normal(size=200)
    rows = [(i, *map(float, x[i]), float(yv[i])) for i in range(200)]
    df = splits.folds(spark.createDataFrame(rows, "id bigint, a double, b double, c double, t double"), [], 5, 0, "id")
    got = predict.cross_fit(df, ["a", "b", "c"], "t").collect()
    fold = {r.id: r.fold for r in got}
    for k in range(5):
        tr = np.array([fold[i] != k for i in range(200)])
        full = np.column_stack([np.ones(200), x])
        beta = np.linalg.lstsq(full[tr], yv[tr], rcond=None)[0]
        for r in got:
            if r.fold == k:
                assert r.score == pytest.approx(full[r.id] @ beta, abs=1e-8)


def test_tfidf_by_hand(spark):
    rows = [(1, "aa bb aa", "train"), (2, "aa cc", "train"), (3, "aa bb zz", "test")]
    df = spark.createDataFrame(rows, "id bigint, text string, split string")
    w = predict.tfidf(predict.word_grams(df, ["id", "split"], "text"), df, [], "id")
    got = {(r.id, r.term): r.weight for r in w.collect()}
    # only "aa" is in two train documents; every kept vector has norm 1
    assert got == {(1, "aa"): 1.0, (2, "aa"): 1.0, (3, "aa"): 1.0}
    grams = {r.term: r.tf for r in predict.char_grams(df.where("id = 2"), ["id"], "text").collect()}
    assert grams == {" aa": 1, "aa ": 1, " aa ": 1, " cc": 1, "cc ": 1, " cc ": 1}


def test_capture_round_trip_and_refusals(spark, tmp_path):
    root = str(tmp_path / "cap")
    meta = spark.range(40).select(
        F.concat(F.lit("t-g-"), F.col("id").cast("string")).alias("sample_id"), F.floor(F.col("id") / 2).alias("dataset_index"),
        (F.col("id") % 2).cast("int").alias("shard"), (F.col("id") % 3 == 0).alias("correct_off"), F.lit(False).alias("truncated_off"))
    sinks.write_capture(meta, root)
    vec = meta.select("shard", F.col("dataset_index").alias("row_pos"), F.array_repeat(F.col("dataset_index").cast("float"), 6).alias("vec"))
    assert sinks.write_vectors(vec, root, "off", layers=3) == 40
    got = captures.read_capture(spark, root)
    assert got.count() == 120 and got.where("vec[0] <> dataset_index").count() == 0
    with pytest.raises(CheckFailed):
        captures.read_vectors(spark, root, "sideways")
    with pytest.raises(CheckFailed):
        captures.read_meta(spark, str(tmp_path / "nothing"))
    assert captures.read_sidecar(spark, root) is None
    short = str(tmp_path / "short")
    sinks.write_capture(meta, short)
    sinks.write_vectors(vec.where("row_pos > 0"), short, "off", layers=3)
    with pytest.raises(CheckFailed, match="do not match"):
        captures.read_capture(spark, short)


def test_nested_predictions(spark, tmp_path):
    doc = '{"target": "t", "source": "s", "seeds": {"1": {"test": {"sample_id": ["a", "b"], "y": [1, 0], "correct_off": [false, true], "correct_on": [true, true], "scores": {"m": [0.1, 0.2], "n": [0.3, 0.4]}}}}}'
    path = tmp_path / "x.predictions.json"
    path.write_text(doc)
    got = sorted((r.scorer, r.sample_id, r.score) for r in captures.read_predictions(spark, str(path)).collect())
    assert got == [("m", "a", .1), ("m", "b", .2), ("n", "a", .3), ("n", "b", .4)]


def test_report_cells(spark):
    df = spark.createDataFrame([(.5, .4, .6), (.5, None, None), (None, None, None)], "m double, lo double, hi double")
    got = [r[0] for r in df.select(sinks.interval_text(F.col("m"), F.col("lo"), F.col("hi"))).collect()]
    assert got == ["0.500 [0.400,0.600]", "0.500 [no boot]", "-"]


SAMPLE = [
    "a08_auroc", "a09_average_precision", "a15_reliability_quantile", "a24_tier_table", "a25_calibration_summary",
    "j08_interpolate", "k01_best_threshold", "k08_best_policy", "r05_paired_auroc_difference", "r08_shared_resample",
    "v05_split_evaluation", "v07_confidence_routing", "v09_three_tiers", "l02_tfidf_chars", "p04_regrade", "f23_many_kind_grader",
]


@pytest.mark.parametrize("name", sorted(SQL) if os.environ.get("TANDEM_ALL") else SAMPLE)
def test_sql_twins(spark, name):
    import compare as harness

    ok, text = harness.check(spark, harness.duck(FOLDER), FOLDER, name)
    assert ok, text


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 150


def test_gain_counts_missing_as_false(spark):
    df = spark.createDataFrame([(None, True), (True, None)], "correct_off boolean, correct_on boolean")
    assert [r[0] for r in df.select(gain("correct_off", "correct_on")).collect()] == [1, -1]
