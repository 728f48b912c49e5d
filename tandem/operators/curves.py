"""Routed-accuracy curves and everything read off them.

Rows are escalated from the highest score down. A distinct score is one
straight segment of the curve, so the curve is a table of segments and no
result depends on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checks import no_nan, require
from ..columns import attach, count_if, gain, join_on, ratio, truth
from ..session import settle
from .ordered import running


def gain_cells(
    df: DataFrame, by: list[str], off: str, on: str, score: str, weight: str | None = None
) -> DataFrame:
    """One row per (by, score): rows ``n``, ``gain``, ``base`` (off right), ``helped``, ``hurt``."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    g = gain(off, on)
    return df.groupBy(
        *by, no_nan(F.col(score).cast("double"), "router scores").alias("score")
    ).agg(
        F.sum(w).alias("n"),
        F.sum(w * g).alias("gain"),
        F.sum(F.when(truth(F.col(off)), w).otherwise(0.0)).alias("base"),
        F.sum(F.when(g == 1, w).otherwise(0.0)).alias("helped"),
        F.sum(F.when(g == -1, w).otherwise(0.0)).alias("hurt"),
    )


_CELL = ["n", "gain", "base", "helped", "hurt"]


def segments_of(cells: DataFrame, by: list[str], few: bool = False) -> DataFrame:
    """Cells with a positive weight, ordered into segments from ``k0`` to ``k1`` escalations.

    Other columns of the cells are carried along; of ``pos`` and ``neg`` (class
    counts) the negatives below each segment and the totals are added.
    """
    extra = [c for c in cells.columns if c not in (*by, "score", *_CELL)]
    classes = ["pos", "neg"] if "neg" in extra else []
    ran = running(cells.where("n > 0"), by, "score", _CELL + classes, descending=True, few=few)
    below = [(F.col("tot_neg") - F.col("cum_neg")).alias("neg_below"), "tot_pos", "tot_neg"] if classes else []
    return ran.select(
        *by,
        *extra,
        *below,
        "score",
        "n",
        "gain",
        (F.col("cum_n") - F.col("n")).alias("k0"),
        F.col("cum_n").alias("k1"),
        (F.col("cum_gain") - F.col("gain")).alias("g0"),
        F.col("cum_gain").alias("g1"),
        F.col("tot_n").alias("rows"),
        F.col("tot_base").alias("base"),
        F.col("tot_gain").alias("gain_all"),
        F.col("tot_helped").alias("helped"),
        F.col("tot_hurt").alias("hurt"),
    )


def segments(
    df: DataFrame,
    by: list[str],
    off: str,
    on: str,
    score: str,
    weight: str | None = None,
    few: bool = False,
) -> DataFrame:
    return segments_of(gain_cells(df, by, off, on, score, weight), by, few)


def _accuracy_at(k: Column) -> Column:
    """Accuracy after ``k`` escalations, for a k inside the segment."""
    step = F.col("gain") / F.col("n")
    return (F.col("base") + F.col("g0") + step * (k - F.col("k0"))) / F.col("rows")


def vertices(seg: DataFrame, by: list[str]) -> DataFrame:
    """by..., k, fraction, accuracy, threshold: the start point (+inf) and one per score."""
    def point(k, g, threshold):
        return F.struct(
            k.cast("bigint").alias("k"),
            (k / F.col("rows")).alias("fraction"),
            ((F.col("base") + g) / F.col("rows")).alias("accuracy"),
            threshold.alias("threshold"),
        )

    here = point(F.col("k1"), F.col("g1"), F.col("score"))
    start = point(F.lit(0.0), F.lit(0.0), F.lit(float("inf")))
    both = F.when(F.col("k0") == 0, F.array(start, here)).otherwise(F.array(here))
    return seg.select(*by, F.inline(both))


def at_fractions(seg: DataFrame, by: list[str], fractions: list[float]) -> DataFrame:
    """by..., fraction, accuracy at a few fixed escalation fractions.

    Each segment answers for the fractions it covers, so nothing is joined.
    """
    asked = F.explode(F.array(*[F.lit(float(f)) for f in fractions]))
    k = F.col("fraction") * F.col("rows")
    inside = (k > F.col("k0")) & (k <= F.col("k1"))
    first = (F.col("fraction") <= 0) & (F.col("k0") == 0)
    last = (F.col("fraction") > 1) & (F.col("k1") == F.col("rows"))
    clipped = F.greatest(F.col("k0"), F.least(k, F.col("k1")))
    return (
        seg.withColumn("fraction", asked)
        .where(inside | first | last)
        .select(*by, "fraction", _accuracy_at(clipped).alias("accuracy"))
    )


BUCKETS, PER_SALT = 4096, 1 << 20  # parts of [0, 1]; points of one part in one window


def interpolate(points: DataFrame, seg: DataFrame, by: list[str], fraction: str) -> DataFrame:
    """Accuracy of a curve at every row's ``fraction`` (clamped to [0, 1]; rows without one are left out).

    Points and segments stand in one order; each point takes the last segment
    that begins at or before it. The order is cut into parts of [0, 1], and a
    small table says with which segment each part begins. A part with many
    points is dealt to several windows, so a popular fraction is no hot key.
    """
    own = settle(seg)
    x = F.least(F.greatest(F.col(fraction).cast("double"), F.lit(0.0)), F.lit(1.0))
    needed = ["k0", "k1", "g0", "gain", "n", "rows", "base"]
    kept = [c for c in points.columns if c not in by]
    row = F.struct(*[F.col(c) for c in kept]).alias("__row")
    asked = points.where(F.col(fraction).isNotNull()).select(*by, x.alias("__x"), row)
    starts = own.select(*by, (F.col("k0") / F.col("rows")).alias("__x"), F.struct(*needed).alias("__seg"))
    both = asked.unionByName(starts, allowMissingColumns=True).withColumn("__part", F.floor(F.col("__x") * BUCKETS).cast("int"))
    last = F.max_by("__seg", F.when(F.col("__seg").isNotNull(), F.col("__x")))
    parts = both.groupBy(*by, "__part").agg(last.alias("__last"), count_if(F.col("__seg").isNull()).alias("__points"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    info = parts.select(
        *by, "__part", F.last("__last", ignorenulls=True).over(before).alias("__carry"),
        F.greatest(F.ceil(F.col("__points") / PER_SALT), F.lit(1)).cast("int").alias("__salts"),
    )
    told = attach(both, info, [*by, "__part"])
    every = F.sequence(F.lit(0), F.col("__salts") - 1)
    one = F.array(F.pmod(F.monotonically_increasing_id(), F.col("__salts")).cast("int"))
    dealt = told.withColumn("__salt", F.explode(F.when(F.col("__seg").isNull(), one).otherwise(every)))
    upto = Window.partitionBy(*by, "__part", "__salt").orderBy("__x", F.col("__seg").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("__s", F.coalesce(F.last("__seg", ignorenulls=True).over(upto), F.col("__carry")))
    found = found.where(F.col("__seg").isNull() & F.col("__s").isNotNull()).select(*by, "__x", "__row", *[F.col(f"__s.{c}").alias(f"__{c}") for c in needed])
    k = F.greatest(F.col("__k0"), F.least(F.col("__x") * F.col("__rows"), F.col("__k1")))
    accuracy = (F.col("__base") + F.col("__g0") + F.col("__gain") / F.col("__n") * (k - F.col("__k0"))) / F.col("__rows")
    return found.select(*[F.col(c) if c in by else F.col(f"__row.{c}").alias(c) for c in points.columns], accuracy.alias("accuracy"))


def _clipped_area(lo: float, hi: float) -> Column:
    a = F.greatest(F.col("k0") / F.col("rows"), F.lit(lo))
    b = F.least(F.col("k1") / F.col("rows"), F.lit(hi))
    height = (_accuracy_at(a * F.col("rows")) + _accuracy_at(b * F.col("rows"))) / 2
    return F.when(b > a, (b - a) * height).otherwise(0.0)


def _check_range(lo: float, hi: float) -> None:
    require(0.0 <= lo < hi <= 1.0, f"bad escalation range [{lo}, {hi}]")


def area(seg: DataFrame, by: list[str], lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Exact area under the curve on [lo, hi]."""
    _check_range(lo, hi)
    return seg.groupBy(*by).agg(F.sum(_clipped_area(lo, hi)).alias("area"))


def _ramp(start: Column, lo: float, hi: float) -> Column:
    """Integral of max(0, x - start) on [lo, hi]."""
    def half_square(x):
        d = F.greatest(F.lit(0.0), F.lit(x) - start)
        return d * d / 2

    return half_square(hi) - half_square(lo)


def _nauc_struct(lo: float, hi: float) -> Column:
    """Aggregate: the normalised area on [lo, hi] and the three mean accuracies.

    The oracle curve rises with the helped rows, stays flat, and falls with the
    hurt rows, so its area is closed-form in the two counts.
    """
    _check_range(lo, hi)
    share = lambda c: F.max(F.col(c) / F.col("rows"))
    return normalised(F.sum(_clipped_area(lo, hi)), *map(share, ("base", "gain_all", "helped", "hurt")), lo, hi)


def normalised(routed_area: Column, base: Column, gain_all: Column, helped: Column, hurt: Column, lo: float, hi: float) -> Column:
    """The struct of ``nauc`` from an area on [lo, hi] and the shares of rows of a curve."""
    width = hi - lo
    rise = F.lit((hi * hi - lo * lo) / 2) - _ramp(helped, lo, hi)
    fall = _ramp(1.0 - hurt, lo, hi)
    oracle = base * width + rise - fall
    rand = (base + gain_all * ((lo + hi) / 2)) * width
    return F.struct(
        F.when(oracle - rand > 1e-12, (routed_area - rand) / (oracle - rand)).alias("nauc"),
        (routed_area / width).alias("mean_accuracy"),
        (rand / width).alias("random_mean_accuracy"),
        (oracle / width).alias("oracle_mean_accuracy"),
    )


def nauc(seg: DataFrame, by: list[str], lo: float = 0.0, hi: float = 0.5) -> DataFrame:
    """(area - random) / (oracle - random) on [lo, hi]; NULL where there is nothing to route for."""
    got = seg.groupBy(*by).agg(_nauc_struct(lo, hi).alias("__s"))
    return got.select(*by, "__s.*")


def _min_fraction(target: Column, tol: float = 1e-9) -> Column:
    """Aggregate: smallest k / n (k whole) whose accuracy reaches the target; 1.0 if none does."""
    need = (target - tol) * F.col("rows") - (F.col("base") + F.col("g0"))
    step = F.try_divide("gain", "n")
    k = F.ceil(F.col("k0") + need / F.when(step > 0, step)).cast("double")
    first = F.when(need <= 0, F.col("k0")).when(k <= F.col("k1"), k)
    return F.coalesce(F.min(first / F.col("rows")), F.lit(1.0))


def _at_fraction(fraction: float) -> Column:
    """Aggregate: accuracy at one escalation fraction, clamped to [0, 1]."""
    f = min(max(fraction, 0.0), 1.0)
    k = F.lit(f) * F.col("rows")
    inside = (k > F.col("k0")) & (k <= F.col("k1")) if f > 0 else F.col("k0") == 0
    return F.max(F.when(inside, _accuracy_at(k)))


def concordance_of_segments() -> Column:
    """Aggregate: AUROC of the score for the classes carried by the segments."""
    u = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return F.try_divide(u, F.max(F.col("tot_pos") * F.col("tot_neg")))


def read_curve(
    seg: DataFrame, by: list[str], ranges: dict[str, tuple[float, float]] | None = None,
    targets: dict[str, Column] | None = None, fractions: dict[str, float] | None = None,
    others: list[Column] | None = None,
) -> DataFrame:
    """Everything wanted from a curve in one aggregation: areas (structs), sufficient
    fractions, accuracies at fixed fractions, and further aggregates of the segments."""
    return seg.groupBy(*by).agg(
        *[_nauc_struct(lo, hi).alias(n) for n, (lo, hi) in (ranges or {}).items()],
        *[_min_fraction(t).alias(n) for n, t in (targets or {}).items()],
        *[_at_fraction(f).alias(n) for n, f in (fractions or {}).items()],
        *(others or []),
    )


def oracle_segments(df: DataFrame, by: list[str], off: str, on: str) -> DataFrame:
    """The curve of the best possible router: score = gain, three segments."""
    return segments(df.withColumn("__gain", gain(off, on)), by, off, on, "__gain", few=True)


def oracle_accuracy_at(fraction: Column, base: Column, helped: Column, hurt: Column) -> Column:
    """Oracle accuracy at an escalation fraction; the arguments are shares of rows."""
    return base + F.least(fraction, helped) - F.greatest(F.lit(0.0), fraction - (1.0 - hurt))


def random_accuracy_at(fraction: Column, acc_off: Column, acc_on: Column) -> Column:
    return acc_off + fraction * (acc_on - acc_off)


def best_threshold(seg: DataFrame, by: list[str]) -> DataFrame:
    """The cut-off (escalate score >= t) with the best accuracy among scores, 0 and 1.

    Ties go to the lowest cut-off.
    """
    def pick(t, g):
        return F.struct(g.alias("g"), (-t).alias("nt"))

    def beyond(t):
        return F.sum(F.when(F.col("score") >= t, F.col("gain")).otherwise(0.0))

    got = seg.groupBy(*by).agg(
        F.max(pick(F.col("score"), F.col("g1"))).alias("s"),
        beyond(0.0).alias("g_zero"),
        beyond(1.0).alias("g_one"),
        F.max("base").alias("base"),
        F.max("rows").alias("rows"),
    )
    best = F.greatest(
        F.col("s"), pick(F.lit(0.0), F.col("g_zero")), pick(F.lit(1.0), F.col("g_one"))
    )
    return got.select(
        *by,
        (F.lit(0.0) - best["nt"]).alias("threshold"),
        ((F.col("base") + best["g"]) / F.col("rows")).alias("accuracy"),
    )


def min_fraction(seg: DataFrame, by: list[str], target: Column, tol: float = 1e-9) -> DataFrame:
    """Smallest sufficient escalation fraction for a target accuracy.

    ``target`` may use the segment columns (base, gain_all, rows).
    """
    return seg.groupBy(*by).agg(_min_fraction(target, tol).alias("fraction"))


def always_on(seg_minus: float = 0.0) -> Column:
    """Accuracy of escalating everything, minus an allowance; a target for min_fraction."""
    return (F.col("base") + F.col("gain_all")) / F.col("rows") - F.lit(seg_minus)


def sampled_curve(seg: DataFrame, by: list[str], points: int = 21) -> DataFrame:
    """by..., i, fraction, accuracy at k = round_half_even(i * n / (points - 1))."""
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    k = F.bround(F.col("i") * F.col("rows") / (points - 1))
    inside = (k > F.col("k0")) & (k <= F.col("k1"))
    return (
        seg.withColumn("i", i)
        .where(inside | ((k == 0) & (F.col("k0") == 0)))
        .select(*by, "i", (k / F.col("rows")).alias("fraction"), _accuracy_at(k).alias("accuracy"))
    )


def counts_curve(seg: DataFrame, by: list[str]) -> DataFrame:
    """by..., k, fraction, accuracy at every whole escalation count."""
    start = F.when(F.col("k0") == 0, F.lit(0)).otherwise(F.col("k0") + 1).cast("bigint")
    k = F.explode(F.sequence(start, F.col("k1").cast("bigint")))
    return seg.withColumn("k", k).select(
        *by, "k", (F.col("k") / F.col("rows")).alias("fraction"), _accuracy_at(F.col("k")).alias("accuracy")
    )


def routed(df: DataFrame, by: list[str], off: str, on: str, score: str, threshold: Column) -> DataFrame:
    """Accuracy and routed fraction when score >= threshold takes the expensive policy."""
    go = F.col(score) >= threshold
    right = F.when(go, truth(F.col(on))).otherwise(truth(F.col(off)))
    return df.groupBy(*by).agg(
        ratio(count_if(right), F.count(F.lit(1))).alias("routed_accuracy"),
        ratio(count_if(go), F.count(F.lit(1))).alias("fraction_routed"),
    )


def matched_references(
    df: DataFrame, by: list[str], off: str, on: str, score: str, threshold: Column
) -> DataFrame:
    """routed() plus what random and oracle routing give at the same routed fraction."""
    g = gain(off, on)
    n = F.count(F.lit(1))
    shares = df.groupBy(*by).agg(
        ratio(count_if(truth(F.col(off))), n).alias("acc_off"),
        ratio(count_if(truth(F.col(on))), n).alias("acc_on"),
        ratio(count_if(g == 1), n).alias("helped"),
        ratio(count_if(g == -1), n).alias("hurt"),
    )
    f = F.col("fraction_routed")
    return join_on(routed(df, by, off, on, score, threshold), shares, by).select(
        *by,
        "routed_accuracy",
        "fraction_routed",
        random_accuracy_at(f, F.col("acc_off"), F.col("acc_on")).alias("random_at_matched_rate"),
        oracle_accuracy_at(f, F.col("acc_off"), F.col("helped"), F.col("hurt")).alias(
            "oracle_at_matched_rate"
        ),
    )


def policy_baselines(df: DataFrame, by: list[str], off: str, on: str) -> DataFrame:
    """never / always / oracle accuracy."""
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        ratio(count_if(truth(F.col(off))), n).alias("never"),
        ratio(count_if(truth(F.col(on))), n).alias("always"),
        ratio(count_if(truth(F.col(off)) | truth(F.col(on))), n).alias("oracle"),
    )


def group_mean_score(
    df: DataFrame, by: list[str], group: str, off: str, on: str, out: str = "group_score"
) -> DataFrame:
    """Each row scored by its group's mean gain; NULL everywhere if a group is missing."""
    means = df.groupBy(*by, group).agg(F.avg(gain(off, on).cast("double")).alias(out))
    gaps = df.groupBy(*by).agg(F.max(F.col(group).isNull()).alias("__gap"))
    scored = attach(df, join_on(means, gaps, by), by + [group])
    return scored.withColumn(out, F.when(~F.col("__gap"), F.col(out))).drop("__gap")
