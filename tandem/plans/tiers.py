"""Three tiers: answer at once (s1), answer without thinking, think."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import attach, count_if, join_on, ratio, truth
from ..operators import boot, calib, curves, rank
from ..operators.labels import first_correct_tier
from ..operators.ordered import quantiles
from ..session import settle

DELTAS = {"1pp": 0.01, "3pp": 0.03}
S1, OFF, ON = "s1_correct", "correct_off", "correct_on"


def in_sets(rows: DataFrame, task: str = "task", kind: str = "kind", split_task: str = "bbh") -> DataFrame:
    """Each row once per set it belongs to: its task, the lettered or binary part, pooled."""
    part = F.when(F.col(kind) == "letter", "/lettered").otherwise("/binary")
    sets = F.array_compact(F.array(
        F.col(task),
        F.when(F.col(task) == split_task, F.concat(F.col(task), part)),
        F.lit("pooled"),
    ))
    fam = F.when(F.col("family").isNotNull(), F.concat_ws(":", task, "family"))
    out = rows.withColumn("set", F.explode(sets))
    return out.withColumn("family", F.when(F.col("set") == "pooled", fam).otherwise(F.col("family")))


def tier_table(rows: DataFrame, by: list[str], row_id: str, n_boot: int) -> DataFrame:
    """n, guess floor, three accuracies and three paired gaps with intervals.

    Rows collapse to the eight outcome cells of each group before resampling.
    """
    n = F.count(F.lit(1))
    acc = {"s1": S1, "no_think": OFF, "think": ON}
    gaps = {"think_minus_s1": ("think", "s1"), "nothink_minus_s1": ("no_think", "s1"),
            "think_minus_nothink": ("think", "no_think")}
    base = rows.groupBy(*by).agg(
        n.alias("n"), F.avg(F.try_divide(F.lit(1.0), F.col("n_options"))).alias("floor"),
        *[ratio(count_if(truth(F.col(c))), n).alias(k) for k, c in acc.items()],
    )
    cell = boot.cells(rows, by, [S1, OFF, ON], row_id)
    sums = boot.replicate_sums(
        cell, by, {**{k: truth(F.col(c)).cast("double") for k, c in acc.items()}, "w": F.lit(1.0)}, n_boot
    )
    rate = {k: F.try_divide(F.col(k), F.col("w")) for k in acc}
    stats = {**rate, **{g: rate[a] - rate[b] for g, (a, b) in gaps.items()}}
    long = sums.select(
        *by, "b", F.inline(F.array(*[F.struct(F.lit(k).alias("stat"), v.alias("v")) for k, v in stats.items()]))
    )
    ci = boot.percentile_interval(long, by + ["stat"])
    point = {**{k: F.col(k) for k in acc}, **{g: F.col(a) - F.col(b) for g, (a, b) in gaps.items()}}
    est = base.select(
        *by, "n", "floor",
        F.inline(F.array(*[F.struct(F.lit(k).alias("stat"), v.alias("estimate")) for k, v in point.items()])),
    )
    return join_on(est, ci, by + ["stat"]).drop("n_boot")


def calibration_table(rows: DataFrame, by: list[str], row_id: str, n_boot: int) -> DataFrame:
    """ECE (both binnings), MCE, mean p_max by outcome, AUROC(p_max -> right) with interval."""
    ok = truth(F.col(S1))
    base = rows.groupBy(*by).agg(
        F.avg("p_max").alias("mean_p_max"), F.avg(ok.cast("double")).alias("accuracy"),
        F.avg(F.when(ok, F.col("p_max"))).alias("mean_p_max_right"),
        F.avg(F.when(~ok, F.col("p_max"))).alias("mean_p_max_wrong"),
    ).withColumn("overconfidence", F.col("mean_p_max") - F.col("accuracy"))

    def error(strategy):
        return calib.calibration_error(calib.reliability(rows, by, "p_max", S1, strategy=strategy), by)

    parts = [
        base,
        error("uniform").select(*by, "ece", "mce"),
        error("quantile").select(*by, F.col("ece").alias("ece_quantile")),
        rank.auroc(rows, by, S1, "p_max").select(*by, "auroc"),
        boot.auroc_interval(rows, by, S1, "p_max", row_id, n_boot).drop("n_boot"),
    ]
    return reduce(lambda a, b: join_on(a, b, by), parts)


def random_fraction(a0: Column, a1: Column, target: Column) -> Column:
    """Fraction a random router needs to reach the target; 1 if it cannot."""
    return (
        F.when(a0 >= target - 1e-9, 0.0)
        .when((a1 <= a0) | (a1 < target - 1e-9), 1.0)
        .otherwise(F.try_divide(target - a0, a1 - a0))
    )


def routing_table(rows: DataFrame, by: list[str], cheap: str = S1) -> DataFrame:
    """Routing cheap -> think by low p_max: areas, accuracies at fixed rates, and what
    confidence, family-mean, oracle and random routers need to come within 1 and 3 points."""
    scored = curves.group_mean_score(rows, by, "family", cheap, ON, "__fam").withColumn("__conf", -F.col("p_max"))
    seg = curves.segments(scored, by, cheap, ON, "__conf")
    fam = curves.segments(scored.where(F.col("__fam").isNotNull()), by, cheap, ON, "__fam")
    orc = curves.oracle_segments(rows, by, cheap, ON)
    def needs(router):
        return {f"{router}_{name}": curves.always_on(d) for name, d in DELTAS.items()}

    area = {"area": (0.0, 0.5)}
    conf = curves.read_curve(seg, by, area, needs("confidence"), {f"acc_at_{int(100 * f)}": f for f in (0.1, 0.2, 0.3, 0.5)})
    family = curves.read_curve(fam, by, area, needs("family")).select(
        "*", F.col("area.nauc").alias("family_nauc"), F.col("area.mean_accuracy").alias("family_mean_accuracy")).drop("area")
    parts = [conf.select("*", "area.*").drop("area"), family, curves.read_curve(orc, by, targets=needs("oracle"))]
    a0, a1 = F.col("acc_cheap"), F.col("acc_think")
    base = curves.policy_baselines(rows, by, cheap, ON).select(*by, F.col("never").alias("acc_cheap"), F.col("always").alias("acc_think"))
    for name, delta in DELTAS.items():
        base = base.withColumn(f"random_{name}", random_fraction(a0, a1, a1 - delta))
    scored = scored.select(*by, "family", cheap, ON, "__conf")
    within = {
        "within_family_auroc_wrong": ~truth(F.col(cheap)),
        "within_family_auroc_helped": ~truth(F.col(cheap)) & truth(F.col(ON)),
    }
    for name, y in within.items():
        got = rank.within_group(scored.withColumn("__y", y), by, "family", "__y", "__conf")
        parts.append(got.select(*by, F.col("auroc").alias(name)))
    return reduce(lambda a, b: join_on(a, b, by, "left"), [base, *parts])


def routing_intervals(rows: DataFrame, by: list[str], row_id: str, n_boot: int, cheap: str = S1) -> DataFrame:
    """Interval of the confidence router's nAUC and its paired difference to the family router."""
    scored = curves.group_mean_score(rows, by, "family", cheap, ON, "__fam")
    scored = scored.where(F.col("__fam").isNotNull()).withColumn("__conf", -F.col("p_max"))
    got = boot.paired_nauc(scored, by, cheap, ON, {"conf": "__conf", "family": "__fam"}, "conf", "family", row_id, n_boot, own=True)
    return got.withColumnsRenamed({"own_lo": "nauc_lo", "own_hi": "nauc_hi"})


# Two thresholds ------------------------------------------------------------------------

GRID_SIZE = 42  # 41 quantiles and +inf


def threshold_grid(rows: DataFrame, by: list[str], p: str = "p_max", points: int = GRID_SIZE - 1,
                   weight: str | None = None) -> DataFrame:
    """by..., grid: distinct linear quantiles of p, ascending, and +inf."""
    probs = [i / (points - 1) for i in range(points)]
    q = quantiles(rows, by, p, probs, weight=weight)
    return q.groupBy(*by).agg(
        F.concat(F.array_sort(F.collect_set("value")), F.array(F.lit(float("inf")))).alias("grid")
    )


_SUMS = ["n", "a1", "a2", "a3", "t2", "t3"]


def policy_cells(rows: DataFrame, by: list[str], p: str = "p_max") -> DataFrame:
    """Rows, right answers and tokens of each tier per distinct p: all a policy choice needs."""
    val = lambda c: truth(F.col(c)).cast("bigint")
    return rows.groupBy(*by, p).agg(
        F.count(F.lit(1)).alias("n"), F.sum(val(S1)).alias("a1"), F.sum(val(OFF)).alias("a2"),
        F.sum(val(ON)).alias("a3"), F.sum("n_tokens_off").cast("bigint").alias("t2"),
        F.sum("n_tokens_on").cast("bigint").alias("t3"),
        F.count("n_tokens_off").alias("n2"), F.count("n_tokens_on").alias("n3"),
    )


def best_policies(cells: DataFrame, by: list[str], deltas: dict[str, float], p: str = "p_max") -> DataFrame:
    """by..., delta, lo, hi: the pair with the fewest mean tokens that keeps accuracy within delta.

    Cells are added up between neighbouring grid points (at most 42 sums per
    group); all pairs are then read off those sums. No row if no pair qualifies.
    """
    grid = threshold_grid(cells, by, p, weight="n")
    # One comparison per grid point stays in generated code.
    level = sum((F.coalesce((F.get("grid", F.lit(i)) <= F.col(p)).cast("int"), F.lit(0)) for i in range(1, GRID_SIZE)),
                F.when(F.get("grid", F.lit(0)) <= F.col(p), 1).otherwise(0))
    sums = join_on(cells, grid, by).groupBy(*by, level.alias("level")).agg(
        *[F.sum(c).alias(c) for c in _SUMS]
    )
    # p >= grid[i] exactly when the row's level is above i.
    met = join_on(sums, grid.select(*by, F.posexplode("grid").alias("i", "tau")), by)
    above = F.col("level") > F.col("i")
    at = met.groupBy(*by, "i", "tau").agg(
        *[F.sum(F.when(above, F.col(c)).otherwise(0)).alias(c) for c in ("a1", "a2", "a3", "t2", "t3")],
        F.sum("n").alias("n"), F.sum("a3").alias("all3"), F.sum("t3").alias("all_t3"),
    )
    hi = at.select(*by, F.col("i").alias("i_hi"), F.col("tau").alias("hi"),
                   *[F.col(c).alias(f"hi_{c}") for c in ("a1", "a2", "t2")])
    pair = join_on(at.withColumnRenamed("tau", "lo"), hi, by).where("i <= i_hi")
    n = F.col("n").cast("double")
    acc = (F.col("hi_a1") + F.col("a2") - F.col("hi_a2") + F.col("all3") - F.col("a3")) / n
    tokens = F.col("t2") - F.col("hi_t2") + F.col("all_t3") - F.col("t3")
    short = F.col("all3") / n - acc
    best = [
        F.struct(F.lit(name).alias("delta"), F.min(
            F.when(short <= d + 1e-12, F.struct(tokens.alias("tokens"), "lo", "hi"))).alias("b"))
        for name, d in deltas.items()
    ]
    return pair.groupBy(*by).agg(F.array(*best).alias("p")).select(*by, F.inline("p")).where(
        "b is not null").select(*by, "delta", "b.lo", "b.hi")


def best_policy(rows: DataFrame, by: list[str], delta: float, p: str = "p_max") -> DataFrame:
    return best_policies(policy_cells(rows, by, p), by, {"": delta}, p).drop("delta")


def policy_result(rows: DataFrame, by: list[str], lo: str = "lo", hi: str = "hi", p: str = "p_max") -> DataFrame:
    """Accuracy, mean tokens and tier shares under row-level thresholds; NULL means always think."""
    inf = F.lit(float("inf"))
    top, mid = F.coalesce(hi, inf), F.coalesce(lo, inf)
    first, second = F.col(p) >= top, (F.col(p) >= mid) & (F.col(p) < top)
    right = F.when(first, truth(F.col(S1))).when(second, truth(F.col(OFF))).otherwise(truth(F.col(ON)))
    tokens = F.when(first, 0).when(second, F.col("n_tokens_off")).otherwise(F.col("n_tokens_on"))
    n = F.count(F.lit(1))
    return rows.groupBy(*by).agg(
        ratio(count_if(right), n).alias("acc"), ratio(F.sum(tokens), n).alias("tokens"),
        ratio(count_if(first), n).alias("frac_s1"), ratio(count_if(second), n).alias("frac_nothink"),
        ratio(count_if(~(first | second)), n).alias("frac_think"),
    )


def policy_of_cells(cells: DataFrame, by: list[str], p: str = "p_max") -> DataFrame:
    """policy_result from policy_cells with their thresholds ``lo`` and ``hi``; NULL means always think."""
    inf = F.lit(float("inf"))
    top, mid = F.coalesce("hi", inf), F.coalesce("lo", inf)
    first, second = F.col(p) >= top, (F.col(p) >= mid) & (F.col(p) < top)
    right = F.when(first, F.col("a1")).when(second, F.col("a2")).otherwise(F.col("a3"))
    tokens = F.when(first, 0).when(second, F.col("t2")).otherwise(F.col("t3"))
    part = lambda c: ratio(F.sum(F.when(c, F.col("n")).otherwise(0)), F.sum("n"))
    return cells.groupBy(*by).agg(
        ratio(F.sum(right), F.sum("n")).alias("acc"), ratio(F.sum(tokens), F.sum("n")).alias("tokens"),
        part(first).alias("frac_s1"), part(second).alias("frac_nothink"), part(~(first | second)).alias("frac_think"),
    )


def three_tier(rows: DataFrame, by: list[str], fold: str = "fold", folds: int = 5) -> DataFrame:
    """by..., policy, acc, tokens, shares: always-policies and both fits of each delta.

    Cross-fitted thresholds come from the other folds; a row's own fold is
    scored, so the mean over all rows is the fold-size weighted mean. Rows are
    read once: everything else is asked of their cells (fold, p).
    """
    folded = settle(policy_cells(rows, by + [fold]))
    whole = folded.groupBy(*by, "p_max").agg(*[F.sum(c).alias(c) for c in _SUMS])
    always = folded.groupBy(*by).agg(F.array(*[
        F.struct(F.lit(name).alias("policy"), ratio(F.sum(c), F.sum("n")).alias("acc"), t.alias("tokens"))
        for name, c, t in (
            ("always s1", "a1", F.lit(0.0)),
            ("always no_think", "a2", ratio(F.sum("t2"), F.sum("n2"))),
            ("always think", "a3", ratio(F.sum("t3"), F.sum("n3"))),
        )
    ]).alias("a")).select(*by, F.inline("a"))
    shares = [F.lit(None).cast("double").alias(c) for c in ("frac_s1", "frac_nothink", "frac_think")]
    out = always.select(*by, "policy", "acc", "tokens", *shares)
    held = F.explode(F.array(*[F.lit(k) for k in range(folds)]))
    others = folded.withColumn("__held", held).where(F.col(fold) != F.col("__held")).groupBy(
        *by, "__held", "p_max").agg(*[F.sum(c).alias(c) for c in _SUMS])
    both = whole.select(*by, F.lit(-1).alias("__held"), "p_max", *_SUMS).unionByName(others)
    # All fits in one pass: held-out fold -1 holds nothing out.
    cut = settle(best_policies(both, by + ["__held"], DELTAS))
    names = F.explode(F.array(*[F.lit(d) for d in DELTAS]))
    # Without a feasible pair there is no in-sample policy, and a cross-fitted one always thinks.
    own = attach(whole, cut.where("__held = -1").drop("__held"), by)
    crossed = attach(folded.withColumn("delta", names), cut.where("__held >= 0").withColumnRenamed("__held", fold), by + [fold, "delta"], "left")
    for name, got in (("in_sample", own), ("cross_fitted", crossed)):
        res = policy_of_cells(got, by + ["delta"])
        out = out.unionByName(res.withColumn("policy", F.concat("delta", F.lit(f" {name}"))).drop("delta"))
    return out


def oracle_split(rows: DataFrame, by: list[str]) -> DataFrame:
    return first_correct_tier(rows, by, S1, OFF, ON)
