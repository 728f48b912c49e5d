"""One predictor from labels to metrics: split, fit, threshold, evaluate, aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checks import no_nan
from ..columns import attach, join_on, truth
from ..operators import boot, curves, rank
from ..operators.predict import logistic_scores
from ..operators.splits import seed_splits, stratified_split
from ..session import settle

RANGES = {"nauc_0_50": (0.0, 0.5), "nauc_0_100": (0.0, 1.0)}


def evaluate(
    rows: DataFrame, by: list[str], y: str, score: str, row_id: str, threshold: str | None = None,
    n_boot: int = 0, off: str = "correct_off", on: str = "correct_on",
) -> DataFrame:
    """Every split metric per ``by``: counts, AUROC and interval, AUPRC, routing at a
    threshold column, references, normalised areas, smallest sufficient fraction.

    One table of score cells feeds all of it but the AUPRC, whose ties follow row order.
    """
    hit = truth(F.col(y))
    cut = F.col(threshold) if threshold else F.lit(0.5)
    is_, one = lambda c: F.when(c, 1.0).otherwise(0.0), F.lit(1.0)
    o, w = truth(F.col(off)), truth(F.col(on))
    cells = rows.groupBy(*by, no_nan(F.col(score).cast("double"), "scores").alias("score")).agg(
        F.sum(one).alias("n"), F.sum(is_(w) - is_(o)).alias("gain"), F.sum(is_(o)).alias("base"),
        F.sum(is_(w & ~o)).alias("helped"), F.sum(is_(o & ~w)).alias("hurt"),
        F.sum(is_(hit)).alias("pos"), F.sum(is_(~hit)).alias("neg"), F.max(cut).alias("threshold"),
    )
    seg = curves.segments_of(cells, by)
    total, go = F.max("rows"), F.col("score") >= F.col("threshold")
    share = lambda c: F.max(F.col(c) / F.col("rows"))
    got = curves.read_curve(
        seg, by, RANGES, {"min_routed_for_always": curves.always_on()},
        others=[
            total.cast("bigint").alias("n"), F.max("tot_pos").cast("bigint").alias("n_positive"),
            share("tot_pos").alias("base_rate"), F.max("threshold").alias("threshold"),
            ((F.max("base") + F.sum(F.when(go, F.col("gain")).otherwise(0.0))) / total).alias("routed_accuracy"),
            (F.sum(F.when(go, F.col("n")).otherwise(0.0)) / total).alias("fraction_routed"),
            share("base").alias("never"), (share("base") + share("gain_all")).alias("always"),
            (share("base") + share("helped")).alias("oracle"),
            share("helped").alias("__helped"), share("hurt").alias("__hurt"),
            curves.concordance_of_segments().alias("auroc"),
        ],
    )
    f = F.col("fraction_routed")
    got = got.select(
        *by, "n", "n_positive", "base_rate", "threshold", "routed_accuracy", "fraction_routed",
        "never", "always", "oracle",
        curves.random_accuracy_at(f, F.col("never"), F.col("always")).alias("random_at_matched_rate"),
        curves.oracle_accuracy_at(f, F.col("never"), F.col("__helped"), F.col("__hurt")).alias("oracle_at_matched_rate"),
        "auroc", *[F.col(f"{name}.nauc").alias(name) for name in RANGES], "min_routed_for_always",
    )
    parts = [got, rank.average_precision(rows, by, y, score, row_id)]
    if n_boot:
        parts.append(boot.auroc_interval(rows, by, y, score, row_id, n_boot))
    return reduce(lambda a, b: join_on(a, b, by), parts)


def level_block(rows: DataFrame, by: list[str], level: str, y: str, score: str, row_id: str, n_boot: int = 0) -> DataFrame:
    """The per-level part of an evaluation as rows: by..., level, n, base_rate, auroc and, asked for, its interval."""
    if n_boot:
        return boot.stratified_block(rows, by, level, y, score, row_id, n_boot)
    keys = by + [level]
    counts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(truth(F.col(y)).cast("double")).alias("base_rate")
    ).where("n >= 2")
    return join_on(counts, rank.auroc(rows, keys, y, score).select(*keys, "auroc"), keys)


def curve_block(rows: DataFrame, by: list[str], score: str, off: str = "correct_off", on: str = "correct_on", points: int = 21) -> DataFrame:
    """The curve part as rows: by..., kind (vertex or sample), position, fraction, accuracy, threshold."""
    seg = curves.segments(rows, by, off, on, score)
    vertex = curves.vertices(seg, by).select(*by, F.lit("vertex").alias("kind"), F.col("k").alias("position"), "fraction", "accuracy", "threshold")
    sample = curves.sampled_curve(seg, by, points).select(
        *by, F.lit("sample").alias("kind"), F.col("i").cast("bigint").alias("position"), "fraction", "accuracy",
        F.lit(None).cast("double").alias("threshold"),
    )
    return vertex.unionByName(sample)


def aggregate_levels(per_seed: DataFrame, by: list[str], level: str) -> DataFrame:
    """Means over seeds per level: by..., level, n_seeds, auroc mean with its interval and, where given, the averaged bounds."""
    keys = by + [level]
    if "ci_lo" in per_seed.columns:
        per_seed = settle(per_seed)  # a few rows, whose replicates are dear to make, read twice
    got = boot.mean_interval(per_seed, keys, "auroc").withColumnRenamed("n", "n_seeds")
    if "ci_lo" not in per_seed.columns:
        return got
    bounds = boot.average_interval(per_seed, keys).select(*keys, F.col("ci_lo").alias("boot_lo"), F.col("ci_hi").alias("boot_hi"))
    return join_on(got, bounds, keys)


def seed_auroc(rows: DataFrame, by: list[str], y: str, score: str, row_id: str, n_boot: int, seeds: str = "seed") -> DataFrame:
    """by..., AUROC over seeds: mean with its normal interval, and the mean of the seeds' bootstrap bounds as boot_lo, boot_hi."""
    keys = [*by, seeds]
    per = join_on(rank.auroc(rows, keys, y, score).select(*keys, "auroc"), boot.auroc_interval(rows, keys, y, score, row_id, n_boot), keys)
    per = settle(per)  # a row a seed, whose replicates are dear to make, read twice
    bounds = boot.average_interval(per, by).select(*by, F.col("ci_lo").alias("boot_lo"), F.col("ci_hi").alias("boot_hi"))
    return join_on(boot.mean_interval(per, by, "auroc").withColumnRenamed("n", "n_seeds"), bounds, by)


SEED_METRICS = [
    "auroc", "auprc", "routed_accuracy", "fraction_routed", "never", "always", "oracle",
    "min_routed_for_always", "random_at_matched_rate", "oracle_at_matched_rate", "nauc_0_50", "nauc_0_100",
]


def aggregate_seeds(per_seed: DataFrame, by: list[str], metrics: list[str] | None = None) -> DataFrame:
    """by..., metric, mean, ci_lo, ci_hi, sd, n over seeds; all metrics in one pass."""
    names = metrics or SEED_METRICS
    long = per_seed.select(
        *by, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names]))
    )
    return boot.mean_interval(long, by + ["metric"], "value")


def threshold_from(rows: DataFrame, by: list[str], score: str, where: Column | str,
                   off: str = "correct_off", on: str = "correct_on") -> DataFrame:
    """by..., threshold: the best cut-off on the chosen (validation) rows."""
    seg = curves.segments(rows.where(where), by, off, on, score)
    return curves.best_threshold(seg, by).select(*by, "threshold")


def run_scored(rows: DataFrame, y: str, score: str, row_id: str, n_boot: int = 0,
               keys: list[str] | None = None, only: str | None = None) -> DataFrame:
    """Evaluation of already scored rows: threshold on validation, applied to both splits or to ``only`` one."""
    by = (keys or []) + ["seed"]
    # The splits and scores are read by several branches; they are computed once.
    held = settle(rows.where("split <> 'train'"))
    cut = threshold_from(held, by, score, "split = 'val'")
    asked = held.where(F.col("split") == only) if only else held
    return evaluate(attach(asked, cut, by), by + ["split"], y, score, row_id, "threshold", n_boot)


def run_probe(
    rows: DataFrame, vec: str, y: str, row_id: str, seeds: list[int], n_boot: int = 0, balanced: bool = True
) -> tuple[DataFrame, DataFrame, list[dict]]:
    """(metrics per seed and split, predictions, checkpoints) of a logistic probe."""
    split = seed_splits(rows, seeds, y, row_id)
    scored, points = logistic_scores(split, vec, y, balanced=balanced)
    cut = threshold_from(scored, ["seed"], "score", "split = 'val'")
    metrics = run_scored(scored, y, "score", row_id, n_boot)
    chosen = {r.seed: r.threshold for r in cut.collect()}
    for p in points:
        p["threshold"] = chosen[p["seed"]]
    return metrics, scored, points


def layer_sweep(act: DataFrame, y: str, row_id: str, seed: int = 42) -> DataFrame:
    """layer, val_auroc, test_auroc, best: the layer is chosen on validation only.

    Every layer is one group of the same jobs, with the same rows in each split.
    """
    split = stratified_split(act, ["layer"], y, seed, row_id)
    scored, _ = logistic_scores(split, "vec", y, seed_col="layer", balanced=True)
    got = rank.auroc(scored, ["layer", "split"], y, "score")
    pick = lambda s: F.max(F.when(F.col("split") == s, F.col("auroc")))
    wide = got.groupBy("layer").agg(pick("val").alias("val_auroc"), pick("test").alias("test_auroc"))
    return mark_best_layer(wide)


def mark_best_layer(sweep: DataFrame) -> DataFrame:
    """Adds ``best``: highest validation AUROC, undefined as -1, the first layer on ties."""
    key = F.struct(F.coalesce("val_auroc", F.lit(-1.0)), -F.col("layer"))
    top = sweep.agg(F.max_by("layer", key).alias("__best"))
    return sweep.crossJoin(F.broadcast(top)).withColumn("best", F.col("layer") == F.col("__best")).drop("__best")


def baseline_summary(held: DataFrame, y: str, row_id: str, n_boot: int, seeds: str = "seed") -> DataFrame:
    """scorer: seed mean of test and validation AUROC and the averaged test interval.

    held: (scorer, seed, split, score, y) rows of validation and test.
    """
    keys = ["scorer", seeds]
    point = rank.auroc(held, keys + ["split"], y, "score")
    both = boot.mean_interval(point, ["scorer", "split"], "auroc")
    pick = lambda s, c: F.max(F.when(F.col("split") == s, F.col(c)))
    wide = both.groupBy("scorer").agg(
        pick("test", "mean").alias("test_auroc"), pick("test", "sd").alias("test_sd"),
        pick("val", "mean").alias("val_auroc"), pick("test", "n").alias("n_seeds"),
    )
    ci = boot.auroc_interval(held.where("split = 'test'"), keys, y, "score", row_id, n_boot)
    mean_ci = boot.average_interval(ci, ["scorer"]).select("scorer", "ci_lo", "ci_hi")
    return join_on(wide, mean_ci, ["scorer"])
