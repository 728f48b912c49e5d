"""Known values, brute-force checks and invariants of the statistics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.checks import CheckFailed
from tandem.catalog.boot import MEDIAN
from tandem.functions import rand
from tandem.functions.rand import multinomial_weights, poisson_table, poisson_weights
from tandem.operators import boot, calib, curves, ordered, rank, splits


def frame(spark, schema, *cols):
    rows = [tuple(v.item() if hasattr(v, "item") else v for v in r) for r in zip(*cols)]
    return spark.createDataFrame(rows, schema).repartition(4)


def pair_auroc(y, s):
    pos, neg = s[y], s[~y]
    if not len(pos) or not len(neg):
        return None
    d = pos[:, None] - neg[None, :]
    return ((d > 0).sum() + 0.5 * (d == 0).sum()) / d.size


@pytest.mark.parametrize("s, want", [
    ([.1, .2, .8, .9], 1.0), ([.9, .8, .2, .1], 0.0), ([.5] * 4, 0.5)])
def test_auroc_known_values(spark, s, want):
    df = frame(spark, "y boolean, s double", [False, False, True, True], s)
    assert rank.auroc(df, [], "y", "s").first().auroc == want


def test_auroc_one_class_is_null(spark):
    df = frame(spark, "y boolean, s double", [True, True], [.1, .2])
    assert rank.auroc(df, [], "y", "s").first().auroc is None


@pytest.mark.parametrize("kind", ["ties", "continuous", "negative", "integers"])
def test_ranks_against_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    n = 600
    s = {"ties": rng.integers(0, 7, n).astype(float), "continuous": rng.random(n),
         "negative": rng.normal(0, 1e-3, n), "integers": rng.integers(-10**6, 10**6, n).astype(float)}[kind]
    y = rng.random(n) < 0.3
    g = rng.integers(0, 3, n)
    df = frame(spark, "y boolean, s double, g int, id int", y, s, g, np.arange(n))
    got = {r.g: r.auroc for r in rank.auroc(df, ["g"], "y", "s").collect()}
    for k in range(3):
        assert got[k] == pytest.approx(pair_auroc(y[g == k], s[g == k]), abs=1e-12)
    ranks = {r.id: r.rank for r in rank.average_ranks(df, [], "s").collect()}
    want = np.array([(s < v).sum() + ((s == v).sum() + 1) / 2 for v in s])
    assert np.allclose([ranks[i] for i in range(n)], want)
    text = df.withColumn("name", F.concat(F.lit("sample-"), F.col("id").cast("string")))
    for ident, order in (("id", np.arange(n)), ("name", np.argsort(np.argsort([f"sample-{i}" for i in range(n)])))):
        ap = rank.average_precision(text, [], "y", "s", ident).first().auprc
        o = np.lexsort((order, -s))
        tp = np.cumsum(y[o])
        assert ap == pytest.approx(((tp / np.arange(1, n + 1)) * y[o]).sum() / y.sum())


def test_order_key_keeps_the_order_of_doubles(spark):
    rng = np.random.default_rng(0)
    v = np.unique(np.r_[rng.normal(size=300), 10.0 ** rng.uniform(-300, 300, 300), -(10.0 ** rng.uniform(-300, 300, 300)),
                        0.0, 1.0, np.nextafter(1.0, 0), 5e-324, -5e-324, 2.0**0.5, 2.0**52, 1e308])
    df = frame(spark, "v double", v)
    got = [r.k for r in df.withColumn("k", ordered.order_key(F.col("v"))).orderBy("v").collect()]
    bits = v.view(np.int64)
    assert got == [int(b) if b >= 0 else -(int(b) & (2**63 - 1)) for b in bits]


def test_numbered_and_quantiles(spark):
    rng = np.random.default_rng(5)
    n = 500
    x = np.round(rng.random(n), 2)
    df = frame(spark, "id bigint, g int, x double", np.arange(n), rng.integers(0, 2, n), x)
    a = {r.id: (r.g, r.rn, r.tot_rn) for r in ordered.numbered(df, ["g"], 1, "id").collect()}
    for k in (0, 1):
        mine = sorted(v[1:] for v in a.values() if v[0] == k)
        assert mine == [(i + 1, len(mine)) for i in range(len(mine))]
    probs = [0.0, 0.025, 0.3, 0.5, 0.975, 1.0]
    got = {r.i: r.value for r in ordered.quantiles(df, [], "x", probs).collect()}
    assert np.allclose([got[i] for i in range(6)], np.quantile(x, probs), atol=1e-12)


def outcomes(n, seed=0, p_off=0.6):
    rng = np.random.default_rng(seed)
    off = rng.random(n) < p_off
    on = np.where(off, rng.random(n) < 0.95, rng.random(n) < 0.5)
    return off, on, rng


def brute_curve(off, on, s):
    """Accuracy at every whole k, ties averaged."""
    n, out = len(s), [off.mean()]
    gain = on.astype(float) - off
    cum = 0.0
    for v in sorted(set(s), reverse=True):
        m = s == v
        for _ in range(m.sum()):
            cum += gain[m].mean()
            out.append((off.sum() + cum) / n)
    return np.array(out)


def brute_nauc(off, on, s, lo, hi):
    n = len(off)
    def area(acc):
        xs = np.unique(np.r_[lo, hi, (np.arange(n + 1) / n)[(np.arange(n + 1) / n > lo) & (np.arange(n + 1) / n < hi)]])
        ys = np.interp(xs, np.arange(n + 1) / n, acc)
        return ((xs[1:] - xs[:-1]) * (ys[1:] + ys[:-1]) / 2).sum()
    a = area(brute_curve(off, on, s))
    o = area(brute_curve(off, on, on.astype(float) - off))
    r = (off.mean() + (lo + hi) / 2 * (on.mean() - off.mean())) * (hi - lo)
    return (a - r) / (o - r)


@pytest.mark.parametrize("levels", [None, 4, 1])
def test_curves_against_brute_force(spark, levels):
    off, on, rng = outcomes(211, 1)
    s = rng.random(211) if levels is None else rng.integers(0, levels, 211).astype(float)
    df = frame(spark, "off boolean, on boolean, s double", off, on, s)
    acc = brute_curve(off, on, s)
    seg = curves.segments(df, [], "off", "on", "s")
    got = [r.accuracy for r in curves.counts_curve(seg, []).orderBy("k").collect()]
    assert np.allclose(got, acc)
    for lo, hi in ((0.0, 0.5), (0.2, 0.9)):
        assert curves.nauc(seg, [], lo, hi).first().nauc == pytest.approx(brute_nauc(off, on, s, lo, hi), abs=1e-9)
    want = next(k for k, a in enumerate(acc) if a >= on.mean() - 1e-9) / 211
    assert curves.min_fraction(seg, [], curves.always_on()).first().fraction == pytest.approx(want)
    cut = curves.best_threshold(seg, []).first()
    cands = sorted({0.0, 1.0, *s})
    accs = [np.where(s >= t, on, off).mean() for t in cands]
    assert cut.threshold == cands[int(np.argmax(accs))] and cut.accuracy == pytest.approx(max(accs))


def test_interpolation_of_many_points_at_one_fraction(spark):
    off, on, rng = outcomes(150, 4)
    s = rng.integers(0, 9, 150).astype(float)
    seg = curves.segments(frame(spark, "off boolean, on boolean, s double", off, on, s), [], "off", "on", "s")
    at = np.r_[np.full(500, 0.37), rng.random(60), 0.0, 1.0, -2.0, 3.0, np.arange(151) / 150]
    points = frame(spark, "id int, f double", np.arange(len(at)), at)
    got = {r.id: r.accuracy for r in curves.interpolate(points, seg, [], "f").collect()}
    acc = brute_curve(off, on, s)
    assert np.allclose([got[i] for i in range(len(at))], np.interp(np.clip(at, 0, 1), np.arange(151) / 150, acc))


def test_perfect_and_reversed_routers(spark):
    off, on, _ = outcomes(400)
    g = on.astype(float) - off
    df = frame(spark, "off boolean, on boolean, a double, b double", off, on, g, -g)
    assert curves.nauc(curves.segments(df, [], "off", "on", "a"), []).first().nauc == pytest.approx(1.0)
    assert curves.nauc(curves.segments(df, [], "off", "on", "b"), []).first().nauc < 0
    flat = frame(spark, "off boolean, on boolean, s double", [True, False], [True, False], [.1, .2])
    assert curves.nauc(curves.segments(flat, [], "off", "on", "s"), []).first().nauc is None


def test_min_fraction_is_read_off_the_exact_curve(spark):
    off = np.array([False] * 7 + [True] * 93)
    on = np.array([True] * 5 + [False] * 2 + [False] * 2 + [True] * 91)
    df = frame(spark, "off boolean, on boolean, s double", off, on, on.astype(float) - off)
    seg = curves.segments(df, [], "off", "on", "s")
    assert curves.min_fraction(seg, [], curves.always_on()).first().fraction == pytest.approx(0.03)


def test_nan_scores_and_bad_ranges_are_refused(spark):
    df = frame(spark, "off boolean, on boolean, s double", [True], [True], [math.nan])
    with pytest.raises(Exception, match="NaN"):
        curves.segments(df, [], "off", "on", "s").collect()
    with pytest.raises(CheckFailed):
        curves.nauc(df, [], 0.5, 0.5)


def test_wilson_known_values(spark):
    df = frame(spark, "k int, n int", [5, 0, 0], [10, 20, 0])
    lo, hi = calib.wilson(F.col("k"), F.col("n"))
    got = {r.n: (r.lo, r.hi) for r in df.select("n", lo.alias("lo"), hi.alias("hi")).collect()}
    assert got[10] == pytest.approx((0.2366, 0.7634), abs=1e-4) and got[0] == (None, None)
    assert got[20][0] == pytest.approx(0.0, abs=1e-12)


def test_precision_threshold(spark):
    df = frame(spark, "c double, ok boolean", [.9, .8, .7, .6], [True, True, False, True])
    for target, tau, cov in ((.95, .8, .5), (.75, .6, 1.0)):
        got = calib.precision_threshold(df, [], "c", "ok", target).first()
        assert (got.tau, got.coverage) == (tau, cov)
    wrong = frame(spark, "c double, ok boolean", [.9], [False])
    got = calib.precision_threshold(wrong, [], "c", "ok").first()
    assert got.tau == math.inf and got.coverage == 0.0 and got.precision is None


def test_confident_errors(spark):
    df = frame(spark, "c double, ok boolean, d int", [.99, .97, .6, .98, .5, .4],
               [True, False, False, False, False, True], [1, 1, 1, 3, 3, 3])
    got = {r.d: r for r in calib.confident_errors(df, "d", "c", "ok", .95).collect()}
    assert (got[None].n_leaked, got[None].n_wrong) == (2, 4) and got[1].cel == got[3].cel == 0.5


def test_reliability_edges_and_strategy(spark):
    df = frame(spark, "c double, ok boolean", [1.0, 0.0, 0.7], [True, False, True])
    four = {r.bin: r.n for r in calib.reliability(df, [], "c", "ok", 4).collect()}
    assert four == {0: 1, 1: 0, 2: 1, 3: 1}
    ten = {r.bin: r.n for r in calib.reliability(df, [], "c", "ok", 10).collect()}
    assert ten[6] == 1 and ten[7] == 0
    with pytest.raises(CheckFailed):
        calib.reliability(df, [], "c", "ok", strategy="nope")


def test_within_group_and_gate(spark):
    rng = np.random.default_rng(2)
    g = np.repeat(np.arange(10), 60)
    y = rng.random(600) < (g + 1) / 11
    df = frame(spark, "y boolean, s double, g int, one int", y, (g + 1) / 11.0, g, np.zeros(600, int))
    assert rank.within_group(df, [], "g", "y", "s").first().auroc == 0.5
    assert rank.auroc(df, [], "y", "s").first().auroc > 0.6
    same = rank.within_group(df, [], "one", "y", "s").first()
    assert same.auroc == pytest.approx(rank.auroc(df, [], "y", "s").first().auroc) and same.n_groups == 1
    with pytest.raises(CheckFailed):
        calib.require_informative(df, "one", "y")


def test_interpolation_at_one_popular_fraction(spark, monkeypatch):
    """All points at one fraction go to several windows; ends, gaps, null and odd fractions; groups with a null key."""
    monkeypatch.setattr(curves, "PER_SALT", 64)
    rng = np.random.default_rng(2)
    n = 400
    df = frame(spark, "id int, g string, off boolean, on boolean, s double", np.arange(n), [None if i % 2 else "a" for i in range(n)],
               rng.random(n) < .5, rng.random(n) < .8, rng.integers(0, 60, n) / 1.0)
    seg = curves.segments(df, ["g"], "off", "on", "s")
    fractions = [0.25] * 900 + [0.0, 1.0, -3.0, 7.0, 0.2499999, 0.5000001, 1e-9, None] + rng.random(60).tolist()
    rows = [(i, g, f) for i, f in enumerate(fractions) for g in ("a", None)]
    got = curves.interpolate(spark.createDataFrame(rows, "i int, g string, f double").repartition(5), seg, ["g"], "f").collect()
    assert len(got) == 2 * (len(fractions) - 1)
    knots = {}
    for r in seg.orderBy("g", "k0").collect():
        xs, ys = knots.setdefault(r.g, ([0.0], [r.base / r.rows]))
        xs.append(r.k1 / r.rows)
        ys.append((r.base + r.g1) / r.rows)
    for r in got:
        assert r.accuracy == pytest.approx(np.interp(min(max(fractions[r.i], 0), 1), *knots[r.g]))


def test_text_ids_are_cut_by_splitters(spark, monkeypatch):
    """Pooled ids of two tasks and one score for all rows: no block holds more than a fixed share, and the order is kept."""
    monkeypatch.setattr(ordered, "PER_BLOCK", 50)
    n = 4000
    ids = [f"{'gsm8k' if i % 2 else 'math500'}-test-{i:06d}" for i in range(n)]
    y = np.arange(n) % 7 == 0
    df = frame(spark, "id string, y boolean, s double", ids, y, np.full(n, 0.5))
    blocks = df.groupBy(ordered.text_key(df, "id").alias("k")).count().collect()
    assert len(blocks) > 40 and max(r["count"] for r in blocks) < 8 * 50
    got = rank.average_precision(df, [], "y", "s", "id").first().auprc
    hits = y[np.argsort(ids)]
    assert got == pytest.approx((np.cumsum(hits) / np.arange(1, n + 1))[hits].mean())
    odd = frame(spark, "id string, one int", ["", "é", "z", "\U0001f600", "\uffff", "a"], [1] * 6)
    ran = {r.id: r.cum_one for r in ordered.running(odd, [], "id", ["one"]).collect()}
    assert ran == {"": 1, "a": 2, "z": 3, "é": 4, "\uffff": 5, "\U0001f600": 6}


# Bootstrap -------------------------------------------------------------------------------

def test_stratified_cells_keep_their_sizes(spark):
    df = frame(spark, "id int, g string, a boolean", np.arange(300), [None if i % 4 == 0 else f"g{i % 4}" for i in range(300)], np.arange(300) % 7 == 0)
    cell = boot.cells(df, [], ["g", "a"], "id")
    own = {f"n{k}": F.coalesce(F.col("g"), F.lit("g0")).eqNullSafe(f"g{k}").cast("int") for k in range(4)}
    sums = boot.exact_sums(cell, [], ["g"], {**own, "a": F.col("a").cast("int"), "w": F.lit(1.0)}, 400).collect()
    assert len(sums) == 400 and all((r.n0, r.n1, r.n2, r.n3, r.w) == (75, 75, 75, 75, 300) for r in sums)
    p = [(np.arange(k, 300, 4) % 7 == 0).mean() for k in range(4)]
    assert np.std([r.a for r in sums]) == pytest.approx(math.sqrt(sum(75 * x * (1 - x) for x in p)), rel=.12)


def test_strata_keep_their_sizes(spark):
    df = frame(spark, "id int, y boolean", np.arange(55), [False] * 50 + [True] * 5)
    got = boot.exact_weights(df, ["y"], "id", 30).groupBy("b").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y").cast("int")).alias("p")).collect()
    assert len(got) == 30 and all((r.n, r.p) == (55, 5) for r in got)


def test_poisson_weights_have_the_right_moments():
    assert poisson_table(0)[0] == 0 and poisson_table(0)[1][0] == pytest.approx(math.exp(-1))
    for c in (31, 32, 33, 34, 1000):  # no size at which another law is drawn: mean, variance and skewness are a Poisson's
        w = poisson_weights([str(i) for i in range(500)], [c] * 500, 400, 1)
        assert abs(w.mean() - c) < 0.02 * math.sqrt(c) and abs(w.var() / c - 1) < 0.02
        assert abs(((w - c) ** 3).mean() / c**1.5 - 1 / math.sqrt(c)) < 0.03
    w = poisson_weights([str(i) for i in range(400)], [1] * 400, 400, 0)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05
    big = poisson_weights([str(i) for i in range(100)], [900] * 100, 100, 0)
    assert abs(big.mean() - 900) < 2 and abs(big.var() - 900) < 60


def test_replicate_auroc_matches_weighted_brute_force(spark):
    """Hot ties spread over partitions, several groups, both sides of the block edges."""
    rng = np.random.default_rng(9)
    n, b = 700, 12
    s = np.where(rng.random(n) < 0.4, 0.5, np.round(rng.random(n), 3))
    y, g = rng.random(n) < 0.4, rng.integers(0, 2, n)
    df = frame(spark, "id int, y boolean, s double, g int", np.arange(n), y, s, g).withColumn("extra", F.col("id") % 97)
    cells = boot.cells(df, ["g"], ["s", "y", "extra"], "id")
    got = {(r.g, r.b): r.v for r in boot.replicate_auroc(cells, ["g"], "y", "s", b).collect()}
    rows = cells.collect()
    w = poisson_weights([str(r.key) for r in rows], [r.c for r in rows], b, 0)
    cs, cy, cg = (np.array([r[k] for r in rows]) for k in ("s", "y", "g"))
    for k in range(2):
        for j in range(b):
            at = cg == k
            p, q = np.where(cy, w[:, j], 0)[at], np.where(cy, 0, w[:, j])[at]
            d = cs[at][:, None] - cs[at][None, :]
            want = (p[:, None] * q[None, :] * ((d > 0) + 0.5 * (d == 0))).sum() / (p.sum() * q.sum())
            assert got[(k, j)] == pytest.approx(want, abs=1e-10)


def test_identical_scorers_differ_by_exactly_zero(spark):
    rng = np.random.default_rng(4)
    s = rng.random(200)
    df = frame(spark, "id int, y boolean, a double, b double", np.arange(200), rng.random(200) < .5, s, s)
    got = boot.paired_auroc(df, [], "y", {"a": "a", "b": "b"}, "a", "b", "id", 40).first()
    assert (got.estimate, got.ci_lo, got.ci_hi, got.p_le_zero) == (0.0, 0.0, 0.0, 1.0)


def test_paired_interval_is_narrower_than_the_marginals_and_covers(spark):
    rng = np.random.default_rng(6)
    n = 2000
    y = rng.random(n) < .5
    shared = y + rng.normal(size=n)
    a, b = shared + .3 * rng.normal(size=n), shared + .9 * rng.normal(size=n)
    df = frame(spark, "id int, y boolean, a double, b double", np.arange(n), y, a, b)
    pair = boot.paired_auroc(df, [], "y", {"a": "a", "b": "b"}, "a", "b", "id", 200).first()
    one = boot.auroc_interval(df, [], "y", "a", "id", 200).first()
    truth = pair_auroc(y, a) - pair_auroc(y, b)
    assert pair.estimate == pytest.approx(truth) and pair.ci_lo < truth < pair.ci_hi and pair.ci_lo > 0
    assert pair.ci_hi - pair.ci_lo < one.ci_hi - one.ci_lo
    # The Poisson interval of the mean agrees with the exact resample.
    sums = boot.replicate_sums(boot.cells(df, [], ["y"], "id"), [], {"y": F.col("y").cast("int"), "w": F.lit(1.0)}, 400)
    width = sums.agg(F.stddev_samp(F.try_divide("y", "w"))).first()[0]
    assert width == pytest.approx(math.sqrt(.25 / n), rel=.15)


def test_user_statistic(spark):
    """A mean and a median as folds; one task or many give the same numbers, whatever the table's size."""
    df = frame(spark, "id int, s double", np.arange(61), np.arange(61.0))
    mean = (
        lambda n: (np.zeros(n), np.zeros(n)), lambda st, rows, w: (st[0] + w.T @ rows["s"].to_numpy(), st[1] + w.sum(0)),
        lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda st: st[0] / st[1],
    )
    got = {r.b: r.v for r in boot.user_statistic(df.repartition(5), ["s"], *mean, "id", 230).collect()}
    assert len(got) == 230 and got == {r.b: r.v for r in boot.user_statistic(df.coalesce(1), ["s"], *mean, "id", 230).collect()}
    rows = boot.exact_weights(df, [], "id", 230)
    want = {r.b: r.v for r in rows.groupBy("b").agg((F.sum(F.col("w") * F.col("s")) / F.sum("w")).alias("v")).collect()}
    assert got == pytest.approx(want)
    own = df.select("id", F.col("s").alias("score"))
    medians = boot.user_statistic(own, ["score"], *MEDIAN, "id", 40).collect()
    drawn = rows.where("b < 40").toPandas()
    assert {r.b: r.v for r in medians} == {b: np.median(np.repeat(g["s"], g["w"])) for b, g in drawn.groupby("b")}
    assert boot.user_statistic(own.limit(0), ["score"], *MEDIAN, "id", 5).collect() == []


def test_tree_draws_are_multinomial():
    """Moments of single rows and of pairs, one tree for any cut into cells, and strata of one or no row."""
    n, reps = 300, 4000
    each = multinomial_weights("s", n, np.arange(n), np.arange(1, n + 1), reps, 3)
    assert (each.sum(0) == n).all()
    assert each.mean() == 1 and each.var() == pytest.approx(1 - 1 / n, abs=.01)
    assert (each == 0).mean() == pytest.approx((1 - 1 / n) ** n, abs=.002)
    among = np.cov(each[:40])
    assert among[~np.eye(40, dtype=bool)].mean() == pytest.approx(-1 / n, abs=.002)
    cuts = np.array([0, 1, 7, 64, 128, 200, 299, 300])
    cells = multinomial_weights("s", n, cuts[:-1], cuts[1:], reps, 3)
    assert (cells == np.add.reduceat(each, cuts[:-1], 0)).all()
    assert (multinomial_weights("s", 1, np.array([0]), np.array([1]), 5, 3) == 1).all()
    big = multinomial_weights("s", 10**9, np.array([0, 3 * 10**8]), np.array([3 * 10**8, 10**9]), 500, 3)
    assert (big.sum(0) == 10**9).all() and big[0].std() == pytest.approx(math.sqrt(10**9 * .3 * .7), rel=.12)


def test_one_score_for_all_rows(spark):
    """A tie of the whole table is spread over tasks and read as one segment."""
    n = 900
    off, on = np.arange(n) % 3 == 0, np.arange(n) % 2 == 0
    df = frame(spark, "id int, off boolean, on boolean, s double, t double, k int", np.arange(n), off, on, np.zeros(n), np.arange(n) % 2 / 1.0, np.arange(n))
    cell = boot.cells(df, [], ["off", "on", "s", "t", "k"], "id")  # k keeps every row a cell
    long = boot.long_scorers(cell, ["off", "on", "c", "key"], {"flat": "s", "two": "t"})
    got = boot.replicate_curve_reads(long, ["scorer"], "off", "on", "score", 25, 0, {"area": (0.0, 0.5)}, {"m": 0.01}, {"f": 0.2})
    got = {(r.scorer, r.b): r for r in got.collect()}
    w = poisson_weights([str(i) for i in range(n)], np.ones(n), 25, 0)
    for scorer, score in (("flat", np.zeros(n)), ("two", np.arange(n) % 2)):
        for b in range(25):
            rows = np.repeat(np.arange(n), w[:, b].astype(int))
            xs, ys = [0.0], [off[rows].mean()]
            for v in sorted(set(score.tolist()), reverse=True):
                up = score[rows] >= v
                xs.append(up.mean())
                ys.append(np.where(up, on[rows], off[rows]).mean())
            r = got[scorer, b]
            assert r.f == pytest.approx(np.interp(0.2, xs, ys))
            fine = np.union1d(np.linspace(0, 0.5, 3), [x for x in xs if x < 0.5])
            assert r.area.mean_accuracy == pytest.approx(np.trapezoid(np.interp(fine, xs, ys), fine) / 0.5)


def test_mean_interval_edges(spark):
    df = frame(spark, "g int, v double", [0, 0, 1, 2], [1.0, 3.0, 5.0, math.nan])
    got = {r.g: r for r in boot.mean_interval(df, ["g"], "v").collect()}
    assert got[0].mean == 2.0 and got[0].ci_hi - 2.0 == pytest.approx(1.96 * math.sqrt(2) / math.sqrt(2))
    assert (got[1].ci_lo, got[1].ci_hi, got[1].sd) == (5.0, 5.0, None) and (got[2].mean, got[2].n) == (None, 0)


# Splits ------------------------------------------------------------------------------------

def test_split_proportions_and_folds(spark):
    df = frame(spark, "id int, y boolean", np.arange(103), np.arange(103) < 23)
    got = {(r.y, r.split): r["count"] for r in splits.stratified_split(df, [], "y", 1, "id").groupBy("y", "split").count().collect()}
    assert [got[(True, s)] for s in ("train", "val", "test")] == [14, 5, 4]
    assert [got[(False, s)] for s in ("train", "val", "test")] == [48, 16, 16]
    sizes = sorted(r["count"] for r in splits.folds(df, [], 5, 0, "id").groupBy("fold").count().collect())
    assert sizes == [20, 20, 21, 21, 21]


def test_lookup_draws_equal_inverted_uniforms_and_cost_less():
    from time import perf_counter

    rng = np.random.default_rng(5)
    keys, n_boot = [str(k) for k in rng.integers(0, 10**9, 600)], 500
    for counts in (np.ones(600, int), rng.integers(0, 40, 600), rng.integers(0, 500_000, 600)):
        words, want = rand.key_words(keys, 3), np.zeros((600, n_boot))
        started = perf_counter()
        for power in range(int(counts.max()).bit_length()):
            at = np.flatnonzero(counts >> power & 1)
            first, steps = rand.poisson_table(power)
            u = rand.uniforms((words[0][at], words[1][at]), n_boot, power)
            want[at] += first + np.searchsorted(steps, u, side="right")
        by_table = perf_counter() - started
        assert np.array_equal(rand.poisson_weights(keys, counts, n_boot, 3), want)
        if counts.max() == 1:
            took = []
            for _ in range(5):
                started = perf_counter()
                rand.poisson_weights(keys, counts, n_boot, 3)
                took.append(perf_counter() - started)
            assert min(took) < by_table / 2


def test_segments_read_together_equal_segments_read_alone():
    rng = np.random.default_rng(6)
    reads = boot.CurveReads({"a": (0.0, 0.5), "b": (0.2, 1.0)}, {"m": 0.01, "z": 0.0}, {"f": 0.3, "g": 0.0})
    n, gain = rng.integers(0, 4, (400, 30)).astype(float), np.zeros((400, 30))
    gain += np.where(n > 0, rng.integers(-1, 2, (400, 30)), 0)
    whole = n.sum(0), gain.sum(0), n.sum(0) * 0.6
    k0, g0 = np.cumsum(n, 0) - n, np.cumsum(gain, 0) - gain
    got = {x: np.full(30, reads.fold(x)[3]) for x in reads.names}
    for a in range(0, 400, 37):
        z = slice(a, a + 37)
        reads.add(got, n[z], gain[z], k0[a], g0[a], *whole)
    for name, value in reads(n, gain, k0, g0, *whole):
        assert np.allclose(got[name], reads.fold(name)[0](value, axis=0), rtol=0, atol=1e-12), name


def test_strata_above_the_leaves_of_the_sql_tree_keep_their_size():
    size = 300_000  # the SQL twins stop at 2^17
    edges = np.linspace(0, size, 41).astype(np.int64)
    w = multinomial_weights("t0", size, edges[:-1], edges[1:], 20, 0)
    assert (w.sum(0) == size).all() and abs(w.mean() - size / 40) < 1e-9
    assert (abs(w - size / 40) < 6 * math.sqrt(size / 40)).all()


def test_user_statistic_holds_the_state_of_one_block(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 50).cast("double").alias("score"))
    whole = multinomial_weights("", 3000, np.arange(3000), np.arange(1, 3001), 250, 0)
    assert np.array_equal(multinomial_weights("", 3000, np.arange(3000), np.arange(1, 3001), 50, 0, 200), whole[:, 200:])
    fold = (
        lambda n: [n, np.zeros(n)],
        lambda state, rows, w: [state[0], state[1] + w.T @ rows["score"].to_numpy()],
        lambda a, b: [a[0], a[1] + b[1]],
        lambda state: state[1] / 3000,
    )
    got = boot.user_statistic(df, ["score"], *fold, "id", 250).orderBy("b").collect()
    assert [r.b for r in got] == list(range(250)) and abs(np.mean([r.v for r in got]) - 24.5) < 0.2
    cells = df.select(F.col("id").alias("key"), "score", F.lit(1).alias("c"))
    want = {r.b: r.s / 3000 for r in boot.exact_sums(cells, [], [], {"s": F.col("score")}, 250).collect()}
    assert all(r.v == pytest.approx(want[r.b], abs=1e-12) for r in got)
