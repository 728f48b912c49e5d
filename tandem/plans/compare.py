"""Comparing predictors: best baseline, paired differences, transfer, result tables, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checks import or_fail
from ..columns import attach, join_on
from ..functions.arrays import linear_score
from ..functions.rand import hash60
from ..operators import boot
from ..operators.joins import ordered_pairs, pair_predictions, small
from .experiment import evaluate

# Transfer verdicts.
VERDICTS = {
    "undefined": "undefined — source probe was at chance",
    "none": "no transfer — target at chance",
    "strong": "strong transfer",
    "partial": "partial transfer",
    "weak": "weak transfer — above chance but large drop",
}


def best_baseline(baselines: DataFrame, by: list[str]) -> DataFrame:
    """by..., name, ..., selected_on: highest validation AUROC, or test AUROC if any lacks one.

    Ties go to the first name.
    """
    group = Window.partitionBy(*by)
    flagged = baselines.withColumn("__val", F.min(F.col("val_auroc").isNotNull()).over(group))
    key = F.when(F.col("__val"), F.col("val_auroc")).otherwise(F.col("test_auroc"))
    place = Window.partitionBy(*by).orderBy(key.desc_nulls_last(), "name")
    return (
        flagged.withColumn("__rn", F.row_number().over(place)).where("__rn = 1")
        .withColumn("selected_on", F.when(F.col("__val"), "val").otherwise("test")).drop("__rn", "__val")
    )


def best_overall(best: DataFrame, by: list[str], kind: str = "kind") -> DataFrame:
    """Across kinds, only where all kinds were chosen on validation; ties go to the later kind."""
    ok = F.min(F.col("selected_on") == "val").over(Window.partitionBy(*by))
    place = Window.partitionBy(*by).orderBy(F.col("val_auroc").desc(), F.col(kind).desc())
    return (
        best.withColumn("__ok", ok).withColumn("__rn", F.row_number().over(place))
        .where("__ok and __rn = 1").drop("__ok", "__rn")
    )


def paired_difference(probe: DataFrame, base: DataFrame, by: list[str], n_boot: int) -> DataFrame:
    """Seed-averaged AUROC(probe) - AUROC(baseline) on identical test rows.

    by: grouping without the seed. Nothing is reported where the id sets differ.
    """
    keys = by + ["seed"]
    both = pair_predictions(probe.where("split = 'test'"), base.where("split = 'test'"), ["sample_id"], keys)
    broken = both.groupBy(*by).agg(F.min("valid").alias("__all"))
    rows = attach(both, broken, by).where("__all").withColumn("hit", F.col("y") == 1)
    rows = rows.withColumn("row_key", hash60(F.col("sample_id")))
    per = boot.paired_auroc(rows, keys, "hit", {"probe": "score_a", "base": "score_b"}, "probe", "base", "row_key", n_boot)
    return boot.seed_average(per, by)


def worst_stratum(levels: DataFrame, by: list[str]) -> DataFrame:
    """The level with the lowest AUROC; undefined levels are ignored."""
    return levels.where(F.col("auroc").isNotNull()).groupBy(*by).agg(
        F.min_by("level", F.struct("auroc", "level")).alias("worst_stratum"), F.min("auroc").alias("worst_stratum_auroc"))


# Transfer --------------------------------------------------------------------------------

def transfer_scores(probes: DataFrame, rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every source probe applied to every other task's rows, unchanged.

    probes: source, objective, prefill_mode, seed, input_dim, coef, intercept, mean, sd, threshold;
    rows: task, sample key, vec, outcome columns; tasks: (objective, task).
    Probes of one source must agree on objective and mode, and on the target's width.
    """
    pairs = ordered_pairs(tasks, "task", ["objective"])
    odd = probes.groupBy("source", "objective").agg(
        F.countDistinct("prefill_mode").alias("modes"))
    checked = join_on(probes, odd, ["source", "objective"]).withColumn(
        "coef", or_fail(F.col("modes") == 1, F.col("coef"), "probes disagree on prefill mode")).drop("modes")
    met = rows.withColumnRenamed("task", "target").join(small(checked.join(pairs, ["source", "objective"])), "target")
    met = met.withColumn("vec", or_fail(
        F.size("vec") == F.col("input_dim"), F.col("vec"), "probe width differs from the target's"))
    centred = F.zip_with(F.col("vec").cast("array<double>"), F.col("mean"), lambda x, m: x - m)
    scaled = F.zip_with(centred, F.col("sd"), lambda x, s: x / s)
    return met.withColumn("score", linear_score(scaled, F.col("coef"), F.col("intercept"))).drop("coef", "mean", "sd", "intercept")


def evaluate_transfer(scored: DataFrame, y: str, row_id: str, n_boot: int) -> tuple[DataFrame, DataFrame]:
    """(per probe, per source and target): AUROC, interval, routed accuracy.

    A target with one class only fails the job.
    """
    keys = ["source", "target", "objective", "seed"]
    per = evaluate(scored, keys, y, "score", row_id, "threshold", n_boot)
    per = per.withColumn("auroc", or_fail(F.col("auroc").isNotNull(), F.col("auroc"), "target set has one class"))
    pair = ["source", "target", "objective"]
    point = boot.mean_interval(per, pair, "auroc").select(*pair, F.col("mean").alias("transfer_auroc"), "n")
    routed = boot.mean_interval(per, pair, "routed_accuracy").select(*pair, F.col("mean").alias("transfer_routed_accuracy"))
    ci = boot.average_interval(per, pair)
    return per, join_on(join_on(point, routed, pair), ci, pair)


def verdict(source_auroc: Column, target_lo: Column, target_auroc: Column) -> Column:
    """An undefined lower bound counts as no transfer."""
    drop = 100 * (source_auroc - target_auroc)
    return (
        F.when(source_auroc < 0.55, VERDICTS["undefined"])
        .when(~F.coalesce(target_lo > 0.5, F.lit(False)), VERDICTS["none"])
        .when(drop < 5, VERDICTS["strong"]).when(drop <= 15, VERDICTS["partial"]).otherwise(VERDICTS["weak"])
    )


def transfer_interval(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The stored transfer interval, else the mean of the per-probe ones."""
    per = docs.select(*keys, F.explode("per_probe").alias("p")).select(
        *keys, F.col("p.auroc_bootstrap.ci")[0].alias("ci_lo"), F.col("p.auroc_bootstrap.ci")[1].alias("ci_hi"))
    rebuilt = boot.average_interval(per, keys).select(*keys, F.col("ci_lo").alias("__lo"), F.col("ci_hi").alias("__hi"))
    stored = F.col("transfer_auroc_bootstrap.ci")
    got = join_on(docs, rebuilt, keys, "left")
    return got.select(
        *keys, F.coalesce(stored[0], "__lo").alias("ci_lo"), F.coalesce(stored[1], "__hi").alias("ci_hi"),
        (stored.isNull() & F.col("__lo").isNotNull()).alias("rebuilt"))


# Tables ------------------------------------------------------------------------------------

def probe_rows(docs: DataFrame) -> DataFrame:
    """Flat result rows of metric documents (see schemas.METRICS)."""
    a = "aggregate"
    level = F.filter(
        F.transform(F.map_entries(f"{a}.test_auroc_by_difficulty"), lambda e: F.struct(e["value"]["mean"].alias("m"), e["key"].alias("k"))),
        lambda e: e["m"].isNotNull() & ~F.isnan(e["m"]))
    worst = F.array_min(level)
    task = F.when(F.startswith("task", F.lit("[")), F.array_join(F.from_json("task", "array<string>"), "+")).otherwise(
        F.coalesce("task", "run"))
    ci = F.col(f"{a}.test_auroc_bootstrap.ci")
    return docs.where(F.col(a).isNotNull()).select(
        "run", task.alias("task"), F.coalesce("target", F.lit("helped")).alias("target"),
        F.col("n_samples").alias("n"), F.col("base_rate_helped").alias("base_rate"),
        F.col(f"{a}.test_auroc.mean").alias("auroc"), ci[0].alias("auroc_lo"), ci[1].alias("auroc_hi"),
        F.coalesce(worst["k"], F.lit("-")).alias("worst_stratum"), worst["m"].alias("worst_stratum_auroc"),
        F.col(f"{a}.baseline_never_think.mean").alias("never"), F.col(f"{a}.baseline_always_think.mean").alias("always"),
        F.col(f"{a}.oracle.mean").alias("oracle"), F.col(f"{a}.test_routed_accuracy.mean").alias("routed"),
        (1 - F.col(f"{a}.min_routed_for_always_think_accuracy.mean")).alias("waste"))


# Pre-registered gates ------------------------------------------------------------------------

def calibration_gate(cel_deepest: Column, over_lo: Column, over_hi: Column) -> Column:
    """Collapse, confidently wrong, or inconclusive."""
    return (
        F.when((cel_deepest <= 0.10) & (over_hi <= 0.05), "collapse")
        .when((cel_deepest >= 0.25) | (over_lo >= 0.10), "confidently wrong")
        .otherwise("inconclusive")
    )


def headroom_gate(diff_lo: Column, privileged_fraction: Column, confidence_fraction: Column) -> Column:
    """Headroom exists: the difference is at least 0.03 and escalations drop by 15% or more."""
    drop = F.try_divide(confidence_fraction - privileged_fraction, confidence_fraction)
    return F.coalesce((diff_lo >= 0.03) & (drop >= 0.15), F.lit(False))

