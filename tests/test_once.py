"""Replicates and splits are dear: each is made once, whatever reads it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.operators import boot, rank
from tandem.operators.joins import pair_predictions
from tandem.plans import experiment


def rows(spark, n=400):
    rng = np.random.default_rng(5)
    data = [(i, f"g{i % 2}", f"f{i % 3}", bool(rng.random() < .5), bool(rng.random() < .7), float(rng.random()), float(i % 4), 1 + i % 2) for i in range(n)]
    return spark.createDataFrame(data, "id bigint, set string, level string, off boolean, on boolean, a double, few double, seed int")


def python_nodes(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas")


def test_paired_difference_of_curves_reads_replicates_once(spark):
    got = boot.paired_nauc(rows(spark), ["set"], "off", "on", {"a": "a", "few": "few"}, "a", "few", "id", 50, own=True)
    assert python_nodes(got) == 0
    cell = boot.cells(rows(spark), ["set"], ["off", "on", "a", "few"], "id")
    own = {r.set: r for r in boot.percentile_interval(boot.replicate_nauc(cell, ["set"], "off", "on", "a", 50), ["set"]).collect()}
    for r in got.collect():
        assert (r.own_lo, r.own_hi) == pytest.approx((own[r.set].ci_lo, own[r.set].ci_hi), abs=1e-12) and r.n_boot == 50


def test_few_scores_read_as_sums_give_the_same_curves(spark):
    cell = boot.cells(rows(spark), ["set"], ["off", "on", "few"], "id")
    asked = dict(ranges={"area": (0.0, 0.5)}, allowances={"one": 0.01}, fractions={"tenth": 0.1})
    read = lambda f: {(r.set, r.b): (r.area.nauc, r.one, r.tenth) for r in f(cell, ["set"], "off", "on", "few", 40, **asked).collect()}
    got, want = read(boot.few_curve_reads), read(boot.replicate_curve_reads)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_levels_read_replicates_once(spark):
    per = experiment.level_block(rows(spark), ["seed"], "level", "off", "a", "id", 50)
    assert python_nodes(experiment.aggregate_levels(per, [], "level")) == 0
    assert python_nodes(per) == 1


def test_paired_rows_are_joined_once(spark):
    df = rows(spark).withColumn("y", F.col("off").cast("int")).withColumn("score", F.col("a"))
    both = pair_predictions(df, df, ["id"], ["set", "seed"])
    assert "full" not in both._jdf.queryExecution().optimizedPlan().toString().lower().replace("fullname", "")
    assert both.where("valid").count() == 400
    got = boot.paired_auroc(df, ["set"], "off", {"x": "a", "z": "few"}, "x", "z", "id", 50)
    assert python_nodes(got) == 1


@pytest.mark.parametrize("most", [3, 1 << 12])
def test_average_precision_of_small_and_large_ties(spark, monkeypatch, most):
    monkeypatch.setattr(rank, "HOT_TIE", most)
    got = {r.set: r.auprc for r in rank.average_precision(rows(spark), ["set"], "off", "few", "id").collect()}
    pdf = rows(spark).toPandas()
    for name, own in pdf.groupby("set"):
        hit = own.sort_values(["few", "id"], ascending=[False, True])["off"].to_numpy()
        want = (np.cumsum(hit) / np.arange(1, len(hit) + 1))[hit].mean()
        assert got[name] == pytest.approx(want, abs=1e-12)
