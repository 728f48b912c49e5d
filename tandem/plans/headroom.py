"""How much a better router could gain: four routers on shared resamples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import count_if, gain, join_on, ratio
from ..functions.arrays import clean_features, task_crosses
from ..operators import boot, curves
from ..operators.labels import gap_summary
from ..operators.predict import cross_fit
from ..operators.splits import folds
from ..session import settle

FEATURES = ["mean_logprob", "min_logprob", "mean_entropy", "log_tokens"]
ROUTERS = ["conf_raw", "conf_fit", "conf_family", "oracle"]
PAIRS = [("conf_fit", "oracle"), ("conf_family", "conf_fit"), ("conf_raw", "conf_fit"), ("conf_family", "oracle")]
STATS = ["nauc_0_50", "mean_routed_acc_0_50", "escalation_minus_0.01", "escalation_minus_0.005",
         "escalation_minus_0", "acc_at_0.1", "acc_at_0.2"]


def router_stats(seg: DataFrame, by: list[str]) -> DataFrame:
    """by..., stat, value: area, mean accuracy, sufficient fractions, accuracy at 10 and 20%."""
    ranges, allowances, fractions = READS
    return long_stats(curves.read_curve(seg, by, ranges, {n: curves.always_on(d) for n, d in allowances.items()}, fractions), by)


READS = (
    {"area": (0.0, 0.5)}, {f"escalation_minus_{d:g}": d for d in (0.01, 0.005, 0.0)}, {f"acc_at_{f:g}": f for f in (0.1, 0.2)},
)


def long_stats(read: DataFrame, by: list[str]) -> DataFrame:
    got = read.select("*", F.col("area.nauc").alias("nauc_0_50"), F.col("area.mean_accuracy").alias("mean_routed_acc_0_50"))
    return got.select(*by, F.inline(F.array(*[
        F.struct(F.lit(s).alias("stat"), F.col(f"`{s}`").alias("value")) for s in STATS
    ])))


def router_scores(
    rows: DataFrame, tasks: list[str], row_id: str, seed: int = 0, features: list[str] = FEATURES,
    crossed: tuple[str, ...] = ("mean_logprob", "mean_entropy"),
) -> DataFrame:
    """Adds the four router scores; the fitted ones are out of fold.

    rows: task, correct_off, correct_on and the feature columns; the family
    router also has task indicators and their products with ``crossed``.
    """
    clean = clean_features(rows, features).withColumn("__gain", gain("correct_off", "correct_on").cast("double"))
    both, extra = task_crosses(clean, tasks, crossed=crossed)
    placed = folds(both, [], 5, seed, row_id)
    fitted = cross_fit(placed, features, "__gain", out="conf_fit")
    fitted = cross_fit(fitted, features + extra, "__gain", out="conf_family")
    return fitted.withColumn("conf_raw", -F.col("mean_logprob")).withColumn("oracle", F.col("__gain")).drop("__gain", *extra)


def replicate_stats(scored: DataFrame, row_id: str, n_boot: int, seed: int = 0) -> DataFrame:
    """router, b, stat, value: every statistic of every router on the same resamples."""
    cell = boot.cells(scored, [], ["correct_off", "correct_on", *ROUTERS], row_id)
    long = boot.long_scorers(cell, ["correct_off", "correct_on", "c", "key"], {r: r for r in ROUTERS})
    got = boot.replicate_curve_reads(long, ["scorer"], "correct_off", "correct_on", "score", n_boot, seed, *READS)
    return long_stats(got, ["scorer", "b"]).withColumnRenamed("scorer", "router")


def router_points(scored: DataFrame) -> DataFrame:
    """router, stat, value on all rows."""
    long = boot.long_scorers(scored, ["correct_off", "correct_on"], {r: r for r in ROUTERS})
    seg = curves.segments(long, ["scorer"], "correct_off", "correct_on", "score")
    return router_stats(seg, ["scorer"]).withColumnRenamed("scorer", "router")


def report(scored: DataFrame, row_id: str, n_boot: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(router, stat, point, ci) and (a, b, stat, point, ci, p_le_zero)."""
    # Both tables read the replicates, so they are kept rather than drawn twice.
    reps = settle(replicate_stats(scored, row_id, n_boot, seed))
    point = router_points(scored)
    ci = boot.percentile_interval(reps, ["router", "stat"], "value")
    routers = join_on(point.withColumnRenamed("value", "point"), ci, ["router", "stat"])
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b_name")) for a, b in PAIRS]))

    def minus(df, keys):
        both = df.withColumn("p", pairs).where(F.col("router").isin(ROUTERS)).where(
            (F.col("router") == F.col("p.a")) | (F.col("router") == F.col("p.b_name")))
        side = lambda c: F.max(F.when(F.col("router") == F.col(f"p.{c}"), F.col("value")))
        return both.groupBy(*keys, "p").agg((side("a") - side("b_name")).alias("v")).select(
            *keys, F.col("p.a").alias("router_a"), F.col("p.b_name").alias("router_b"), "v")

    keys = ["router_a", "router_b", "stat"]
    drawn = minus(reps, ["stat", "b"])
    diff = join_on(minus(point, ["stat"]).withColumnRenamed("v", "point"), boot.percentile_interval(drawn, keys), keys)
    share = drawn.groupBy(*keys).agg(ratio(count_if(F.col("v") <= 0), F.count("v")).alias("p_le_zero"))
    return routers, join_on(diff, share, keys)


def task_gaps(rows: DataFrame, row_id: str, n_boot: int, seed: int = 0) -> DataFrame:
    """Per task: accuracies, gap with its interval, helped and hurt shares."""
    cell = boot.cells(rows, ["task"], ["correct_off", "correct_on"], row_id)
    sums = boot.replicate_sums(cell, ["task"], {"g": gain("correct_off", "correct_on"), "w": F.lit(1.0)}, n_boot, seed)
    reps = sums.select("task", "b", F.try_divide("g", "w").alias("v"))
    ci = boot.percentile_interval(reps, ["task"]).drop("n_boot")
    return join_on(gap_summary(rows, ["task"], "correct_off", "correct_on"), ci, ["task"])
