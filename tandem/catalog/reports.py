"""Queries for evaluation blocks, tier and headroom reports, transfer and gates."""

from pyspark.sql import functions as F

from ..columns import count_if, join_on, ratio
from ..operators import boot, curves, predict, rank, splits
from ..operators.joins import ordered_pairs
from ..plans import compare, experiment, headroom, tiers
from ..session import settle, small_table
from .base import EVT, RDO, auroc_sql, draws, logistic_sql, nauc_sql, query, segments_sql
from .rank import _min_fraction_sql, _split_sql

OFF, ON = "correct_off", "correct_on"
S = 2000  # replicates

_BASE_AGG = """count(*) as n, count(*) filter (where y) as n_positive, avg(y::int::double) as base_rate,
 avg(case when s >= thr then correct_on else correct_off end::int::double) as routed_accuracy, avg((s >= thr)::int::double) as fraction_routed,
 avg(correct_off::int::double) as never, avg(correct_on::int::double) as always, avg((correct_off or correct_on)::int::double) as oracle"""


def _evaluate_sql(keys: str) -> str:
    """CTEs m (base), a (auroc), p (auprc), n1, n2, k over cur(keys, y, s, thr, event_id, off, on)."""
    seg = segments_sql("cur", keys, "s")
    return f"""m as (select {keys}, max(thr) as threshold, {_BASE_AGG}, avg((correct_on and not correct_off)::int::double) as h,
  avg((correct_off and not correct_on)::int::double) as u0 from cur group by {keys}),
 a as (select {keys}, u/nullif(p*n,0) as auroc from {auroc_sql('cur', keys, 'y', 's')}),
 p as (select {keys}, sum(case when y then tp::double/rk end)/nullif(count(*) filter (where y),0) as auprc from (select *, row_number() over w as rk,
  sum(y::int) over (partition by {keys} order by s desc, event_id rows unbounded preceding) as tp from cur window w as (partition by {keys} order by s desc, event_id)) group by {keys}),
 seg as {seg}, n1 as (select {keys}, nauc as nauc_0_50 from {nauc_sql('seg', keys)}), n2 as (select {keys}, nauc as nauc_0_100 from {nauc_sql('seg', keys, 0.0, 1.0)}),
 k as (select {keys}, fraction as min_routed_for_always from {_min_fraction_sql('seg', keys, '(base+gall)/cnt')})"""


_EV_COLS = """n, n_positive, base_rate, threshold, routed_accuracy, fraction_routed, never, always, oracle,
 never + fraction_routed*(always-never) as random_at_matched_rate, never + least(fraction_routed, h) - greatest(0.0, fraction_routed - (1.0 - u0)) as oracle_at_matched_rate,
 auroc, auprc, nauc_0_50, nauc_0_100, min_routed_for_always"""
_EV_DBL = "base_rate threshold routed_accuracy fraction_routed never always oracle random_at_matched_rate oracle_at_matched_rate auroc auprc nauc_0_50 nauc_0_100 min_routed_for_always"

_SEEDED = f"""f as (select *, not correct_off as y, score_a as s, sd as seed from evt, (values (42), (1), (2), (3), (4)) z(sd)), sp as {_split_sql('f', 'seed', 'seed::varchar', 'event_id', 'y')},
 held as (select * from sp where split <> 'train'), vseg as {segments_sql("(select * from held where split = 'val')", 'seed', 's')},
 cand as (select seed, s as t, g1 as g from vseg union all select seed, 0.0, coalesce(sum(gain) filter (where s >= 0.0), 0) from vseg group by seed
  union all select seed, 1.0, coalesce(sum(gain) filter (where s >= 1.0), 0) from vseg group by seed),
 thr as (select seed, t as thr from (select *, row_number() over (partition by seed order by g desc, t) as rn from cand) where rn = 1),
 cur as (select h.*, thr from held h join thr on h.seed = thr.seed)"""


def _seed_rows(t):
    e = t.evt().withColumn("y", ~F.col(OFF))
    return splits.seed_splits(e, [42, 1, 2, 3, 4], "y", "event_id")


@query("v05_split_evaluation", f"with {EVT}, {_SEEDED}, {_evaluate_sql('seed, split')} select seed, split, {_EV_COLS} from m join a using (seed, split) join p using (seed, split) "
       "join n1 using (seed, split) join n2 using (seed, split) join k using (seed, split)", _EV_DBL, "seed")
def v05(t):
    return experiment.run_scored(_seed_rows(t), "y", "score_a", "event_id")


_RD = "round_even(i*cnt/20.0::double, 0)"


@query("v05_split_levels", f"""with {EVT}, {_SEEDED}, g as (select seed, split, family, count(*) as n, avg(y::int::double) as base_rate from cur group by all having count(*) >= 2)
 select seed, split, family, g.n, base_rate, u/nullif(a.p*a.n, 0) as auroc from g join {auroc_sql('cur', 'seed, split, family', 'y', 's')} a using (seed, split, family)""",
       "base_rate auroc", "seed")
def v05_levels(t):
    """The per-level block of every seed and split."""
    held = _seed_rows(t).where("split <> 'train'")
    return experiment.level_block(held, ["seed", "split"], "family", "y", "score_a", "event_id")


@query("v05_split_curve", f"""with {EVT}, {_SEEDED}, cs as {segments_sql('cur', 'seed, split', 's')},
 v as (select seed, split, 'vertex' as kind, k1::bigint as position, k1/cnt as fraction, (base + g1)/cnt as accuracy, s::double as threshold from cs
  union all select seed, split, 'vertex', 0, 0.0::double, base/cnt, 'infinity'::double from cs where k0 = 0),
 w as (select seed, split, 'sample' as kind, i as position, {_RD}/cnt as fraction, (base + g0 + gain/n*({_RD} - k0))/cnt as accuracy, null::double as threshold
  from cs, range(21) r(i) where ({_RD} > k0 and {_RD} <= k1) or (i = 0 and k0 = 0))
 select * replace (case when threshold = 'infinity'::double then 1e9 else threshold end as threshold) from (select * from v union all select * from w)""",
       "fraction accuracy threshold", "seed position")
def v05_curve(t):
    """Vertices and 21 points of every seed's curve; the start's threshold, +inf, is shown as 1e9."""
    held = _seed_rows(t).where("split <> 'train'")
    got = experiment.curve_block(held, ["seed", "split"], "score_a")
    return got.withColumn("threshold", F.when(F.col("threshold") == float("inf"), 1e9).otherwise(F.col("threshold")))


@query("v05_split_interval", f"""with {EVT}, {_SEEDED}, cells as (select seed, family, s, y, count(*) as c, min(event_id) as key from cur where split = 'test' and seed = 42 group by all),
 {draws('cells', 'seed, family, s, y', 2000)}, reps as (select seed, family, b, u/nullif(p*n,0) as v from {auroc_sql('drawn', 'seed, family, b', 'y', 's', 'w')})
 select family, quantile_cont(v, 0.025::double) as boot_lo, quantile_cont(v, 0.975::double) as boot_hi, count(v) as n_boot from reps group by family""", "boot_lo boot_hi")
def v05_interval(t):
    """Per-level intervals of one seed's test rows, 2,000 replicates."""
    held = _seed_rows(t).where("split = 'test' and seed = 42")
    got = experiment.level_block(held, ["seed"], "family", "y", "score_a", "event_id", 2000)
    return got.select("family", F.col("ci_lo").alias("boot_lo"), F.col("ci_hi").alias("boot_hi"), "n_boot")


@query("a07_seed_levels", f"""with {EVT}, {_SEEDED}, a as (select seed, family, u/nullif(p*n,0) as v from {auroc_sql("(select * from cur where split = 'test')", 'seed, family', 'y', 's')})
 select family, avg(v) as mean, avg(v) - coalesce(1.96::double*stddev_samp(v)/sqrt(count(v)), 0) as ci_lo,
  avg(v) + coalesce(1.96::double*stddev_samp(v)/sqrt(count(v)), 0) as ci_hi, stddev_samp(v) as sd, count(v) as n_seeds from a group by family""", "mean ci_lo ci_hi sd")
def a07_levels(t):
    """Level means over five seeds."""
    held = _seed_rows(t).where("split = 'test'")
    return experiment.aggregate_levels(experiment.level_block(held, ["seed"], "family", "y", "score_a", "event_id"), [], "family")


def _seed_auroc_sql(keys: str) -> str:
    """Test AUROC of every seed with its bootstrap bounds, averaged over the seeds of each key."""
    k = f"{keys}, " if keys else ""
    test = "(select * from cur where split = 'test')"
    return f"""with {EVT}, {_SEEDED}, cells as (select seed, {k}s, y, count(*) as c, min(event_id) as key from {test} group by all), {draws('cells', f'seed, {k}s, y', S)},
 reps as (select seed, {k}b, u/nullif(p*n,0) as v from {auroc_sql('drawn', f'seed, {k}b', 'y', 's', 'w')}),
 ci as (select seed, {k}quantile_cont(v, 0.025::double) as lo, quantile_cont(v, 0.975::double) as hi from reps group by all),
 a as (select seed, {k}u/nullif(p*n,0) as v from {auroc_sql(test, f'seed{", " + keys if keys else ""}', 'y', 's')})
 select {k}avg(v) as mean, avg(v) - coalesce(1.96::double*stddev_samp(v)/sqrt(count(v)), 0) as ci_lo, avg(v) + coalesce(1.96::double*stddev_samp(v)/sqrt(count(v)), 0) as ci_hi,
  stddev_samp(v) as sd, count(v) as n_seeds, avg(lo) as boot_lo, avg(hi) as boot_hi from a join ci using (seed{", " + keys if keys else ""}) {"group by " + keys if keys else ""}"""


@query("a07_seed_intervals", _seed_auroc_sql(""), "mean ci_lo ci_hi sd boot_lo boot_hi")
def a07_intervals(t):
    """Test AUROC over five seeds, with the averaged bootstrap bounds."""
    return experiment.seed_auroc(_seed_rows(t).where("split = 'test'"), [], "y", "score_a", "event_id", S)


@query("a07_level_intervals", _seed_auroc_sql("family"), "mean ci_lo ci_hi sd boot_lo boot_hi")
def a07_level_intervals(t):
    """The same per level."""
    held = _seed_rows(t).where("split = 'test'")
    return experiment.aggregate_levels(experiment.level_block(held, ["seed"], "family", "y", "score_a", "event_id", S), [], "family")


@query("a07_seed_aggregate", f"with {EVT}, {_SEEDED}, {_evaluate_sql('seed, split')}, r as (select seed, split, {_EV_COLS} from m join a using (seed, split) join p using (seed, split) "
       "join n1 using (seed, split) join n2 using (seed, split) join k using (seed, split)), long as (unpivot (select * from r where split = 'test') on "
       + ", ".join(experiment.SEED_METRICS) + " into name metric value v) select metric, avg(v) as mean, avg(v) - coalesce(1.96::double*stddev_samp(v)/sqrt(count(v)), 0) as ci_lo, "
       "avg(v) + coalesce(1.96::double*stddev_samp(v)/sqrt(count(v)), 0) as ci_hi, stddev_samp(v) as sd, count(v) as n from long group by metric", "mean ci_lo ci_hi sd")
def a07(t):
    per = experiment.run_scored(_seed_rows(t), "y", "score_a", "event_id", only="test")
    return experiment.aggregate_seeds(per, [])


# Routers --------------------------------------------------------------------------------

_ROUTERS = """long as (select 'a' as scorer, score_a as s, correct_off, correct_on from evt union all select 'b', score_b, correct_off, correct_on from evt)"""


def _router_sql(seg: str, keys: str) -> str:
    acc = "(base + g0 + gain/n*(f*cnt - k0))/cnt"
    frac = " union all ".join(
        f"select {keys}, 'escalation_minus_{d:g}' as stat, fraction as value from {_min_fraction_sql(seg, keys, f'((base+gall)/cnt - {d}::double)')}" for d in (0.01, 0.005, 0.0))
    return f"""(select {keys}, 'nauc_0_50' as stat, nauc as value from {nauc_sql(seg, keys)} union all select {keys}, 'mean_routed_acc_0_50', mean_accuracy from {nauc_sql(seg, keys)}
 union all {frac} union all select {keys}, case when f = 0.1 then 'acc_at_0.1' else 'acc_at_0.2' end, {acc} from {seg}, (values (0.1::double), (0.2)) v(f) where f*cnt > k0 and f*cnt <= k1)"""


@query("v06_router_statistics", f"with {EVT}, {_ROUTERS}, seg as {segments_sql('long', 'scorer', 's')} select scorer, stat, value from {_router_sql('seg', 'scorer')}", "value")
def v06(t):
    long = boot.long_scorers(t.evt(), [OFF, ON], {"a": "score_a", "b": "score_b"})
    return headroom.router_stats(curves.segments(long, ["scorer"], OFF, ON, "score"), ["scorer"])


def _head_rows(t):
    c = F.col("conf")
    return t.evt().select(
        "event_id", "task", OFF, ON, (-c).alias("mean_logprob"), F.greatest(-2 * c, F.lit(-50.0)).alias("min_logprob"),
        (c * c).alias("mean_entropy"), F.log1p(F.col("n_tokens_off").cast("double")).alias("log_tokens"))


@query("v10_headroom_report")
def v10(t):
    """Four routers with intervals on shared resamples (fitted scores: rows-only)."""
    scored = headroom.router_scores(_head_rows(t), ["t0", "t1", "t2", "t3"], "event_id")
    return headroom.report(scored, "event_id", 1000)[0]


@query("v10_headroom_differences")
def v10_diff(t):
    scored = headroom.router_scores(_head_rows(t), ["t0", "t1", "t2", "t3"], "event_id")
    return headroom.report(scored, "event_id", 1000)[1]


_HEAD_FOLDS = """f as (select *, (correct_on::int - correct_off::int)::double as g, -conf as x, case when pos < (n % 5) * (n // 5 + 1) then pos // (n // 5 + 1)
 else (n % 5) + (pos - (n % 5) * (n // 5 + 1)) // (n // 5) end as fold from (select *, row_number() over (order by ('0x'||substr(md5(concat('0:', cast(event_id as varchar))),1,8))::bigint, event_id) - 1 as pos, count(*) over () as n from evt))"""
_HEAD = f"""{EVT}, {_HEAD_FOLDS}, c1 as (select k as fold, regr_slope(g, x) as b1, regr_intercept(g, x) as a1 from f, range(5) r(k) where fold <> k group by k),
 c2 as (select k as fold, task, regr_slope(g, x) as b2, regr_intercept(g, x) as a2 from f, range(5) r(k) where fold <> k group by k, task),
 routers as (select event_id, correct_off, correct_on, g as oracle, -x as conf_raw, a1 + b1*x as conf_fit, a2 + b2*x as conf_family from f join c1 using (fold) join c2 using (fold, task)),
 cells as (select correct_off, correct_on, conf_raw, conf_fit, conf_family, oracle, count(*) as c, min(event_id) as key from routers group by all),
 long as ({" union all ".join(f"select '{r}' as scorer, {r} as s, correct_off, correct_on, c, key from cells" for r in headroom.ROUTERS)}),
 {draws('long', 'scorer, s, correct_off, correct_on', 1000)}, seg as {segments_sql('drawn', 'scorer, b', 's', 'w')}, reps as (select * from {_router_sql('seg', 'scorer, b')}),
 pseg as {segments_sql('long', 'scorer', 's', 'c::double')}, pts as (select * from {_router_sql('pseg', 'scorer')})"""


def _head_scores(t):
    """One feature: the pooled fit is a line, the family fit a line per task."""
    return headroom.router_scores(_head_rows(t), ["t0", "t1", "t2", "t3"], "event_id", 0, ["mean_logprob"], ("mean_logprob",))


@query("v10_one_feature", f"""with {_HEAD} select scorer as router, stat, max(p.value) as point, quantile_cont(r.value, 0.025) as ci_lo, quantile_cont(r.value, 0.975) as ci_hi,
 count(r.value) as n_boot from reps r join pts p using (scorer, stat) group by scorer, stat""", "point ci_lo ci_hi")
def v10_one(t):
    return headroom.report(_head_scores(t), "event_id", 1000)[0]


@query("v10_one_feature_differences", f"""with {_HEAD}, pairs as (select * from (values {", ".join(f"('{a}', '{b}')" for a, b in headroom.PAIRS)}) v(router_a, router_b)),
 d as (select router_a, router_b, stat, b, x.value - y.value as v from pairs join reps x on x.scorer = router_a join reps y using (stat, b) where y.scorer = router_b),
 pt as (select router_a, router_b, stat, x.value - y.value as point from pairs join pts x on x.scorer = router_a join pts y using (stat) where y.scorer = router_b)
 select router_a, router_b, stat, max(point) as point, quantile_cont(v, 0.025) as ci_lo, quantile_cont(v, 0.975) as ci_hi, count(v) as n_boot, avg((v <= 0)::int::double) as p_le_zero
 from d join pt using (router_a, router_b, stat) group by router_a, router_b, stat""", "point ci_lo ci_hi p_le_zero")
def v10_one_diff(t):
    return headroom.report(_head_scores(t), "event_id", 1000)[1]


_R08_CELLS = "cells as (select score_a, score_b, correct_off, correct_on, count(*) as c, min(event_id) as key from evt group by all)"
_R08_LONG = """long as (select 'a' as scorer, score_a as s, correct_off, correct_on, c, key from cells union all select 'b', score_b, correct_off, correct_on, c, key from cells)"""


@query("r08_shared_resample", f"""with {EVT}, {_R08_CELLS}, {_R08_LONG}, {draws('long', 'scorer, s, correct_off, correct_on', 1000)}, seg as {segments_sql('drawn', 'scorer, b', 's', 'w')},
 v as (select * from {_router_sql('seg', 'scorer, b')}) select scorer, stat, quantile_cont(value, 0.025) as ci_lo, quantile_cont(value, 0.975) as ci_hi, count(value) as n_boot from v group by scorer, stat""", "ci_lo ci_hi")
def r08(t):
    """All statistics of two routers on one set of resamples."""
    cell = boot.cells(t.evt(), [], [OFF, ON, "score_a", "score_b"], "event_id")
    long = boot.long_scorers(cell, [OFF, ON, "c", "key"], {"a": "score_a", "b": "score_b"})
    got = boot.replicate_curve_reads(long, ["scorer"], OFF, ON, "score", 1000, 0, *headroom.READS)
    return boot.percentile_interval(headroom.long_stats(got, ["scorer", "b"]), ["scorer", "stat"], "value")


@query("a23_task_gap_interval", f"""with {EVT}, cells as (select task, correct_off, correct_on, count(*) as c, min(event_id) as key from evt group by all), {draws('cells', 'task, correct_off, correct_on', 2000)},
 reps as (select task, b, sum(w*(correct_on::int - correct_off::int))/nullif(sum(w),0) as v from drawn group by all), ci as (select task, quantile_cont(v, 0.025) as ci_lo, quantile_cont(v, 0.975) as ci_hi from reps group by task)
 select e.task, count(*) as n, avg(correct_off::int::double) as acc_off, avg(correct_on::int::double) as acc_on, avg((correct_on::int-correct_off::int)::double) as gap_on_minus_off,
 avg((correct_on and not correct_off)::int::double) as helped, avg((correct_off and not correct_on)::int::double) as hurt, max(ci_lo) as ci_lo, max(ci_hi) as ci_hi from evt e join ci on e.task = ci.task group by e.task""",
       "acc_off acc_on gap_on_minus_off helped hurt ci_lo ci_hi")
def a23_ci(t):
    return headroom.task_gaps(t.evt(), "event_id", 2000)


# Tiers ----------------------------------------------------------------------------------

_SETS = f"""{RDO}, sets as (select unnest(list_filter([task, case when task = 'bbh' then concat('bbh/', case when kind = 'letter' then 'lettered' else 'binary' end) end, 'pooled'],
 lambda x: x is not null)) as set, * replace (family as family) from rdo where covered),
 st as (select * replace (case when set = 'pooled' then concat(task, ':', family) else family end as family) from sets)"""


def _sets(t):
    return tiers.in_sets(t.rdo().where("covered"))


_TIER_LONG = "unpivot ({}) on s1, no_think, think, think_minus_s1, nothink_minus_s1, think_minus_nothink into name stat value {}"


@query("a24_tier_table", f"""with {_SETS}, base as (select set, count(*) as n, avg(1.0::double/n_options) as floor, avg(s1_correct::int::double) as s1, avg(correct_off::int::double) as no_think,
 avg(correct_on::int::double) as think, think - s1 as think_minus_s1, no_think - s1 as nothink_minus_s1, think - no_think as think_minus_nothink from st group by set),
 est as ({_TIER_LONG.format('select * from base', 'estimate')}),
 cells as (select set, s1_correct, correct_off, correct_on, count(*) as c, min(event_id) as key from st group by all), {draws('cells', 'set, s1_correct, correct_off, correct_on', S)},
 r as (select set, b, sum(w*s1_correct::int)/nullif(sum(w),0) as s1, sum(w*correct_off::int)/nullif(sum(w),0) as no_think, sum(w*correct_on::int)/nullif(sum(w),0) as think,
  think - s1 as think_minus_s1, no_think - s1 as nothink_minus_s1, think - no_think as think_minus_nothink from drawn group by set, b),
 rl as ({_TIER_LONG.format('select * from r', 'v')}), ci as (select set, stat, quantile_cont(v, 0.025) as ci_lo, quantile_cont(v, 0.975) as ci_hi from rl group by set, stat)
 select e.set, n, floor, e.stat, estimate, ci_lo, ci_hi from est e join ci on e.set = ci.set and e.stat = ci.stat""", "floor estimate ci_lo ci_hi")
def a24(t):
    return tiers.tier_table(_sets(t), ["set"], "event_id", S)


@query("a24_tier_table_families", f"""with {_SETS} select set, family, count(*) as n, avg(1.0::double/n_options) as floor, avg(correct_on::int::double) - avg(s1_correct::int::double) as estimate
 from st group by set, family""", "floor estimate")
def a24_family(t):
    got = tiers.tier_table(_sets(t), ["set", "family"], "event_id", S)
    return got.where("stat = 'think_minus_s1'").select("set", "family", "n", "floor", "estimate")


def _bins(src: str, edges: str) -> str:
    return f"""(select x.set, greatest(0, least(9, len(list_filter(e.edges, lambda z: z <= p_max)) - 1)) as bin, count(*) as n, avg(p_max) - avg(s1_correct::int::double) as gap
 from {src} x join ({edges}) e on x.set = e.set group by all)"""


_U = "[" + ", ".join(f"{i * 0.1!r}::double" for i in range(10)) + ", 1.0::double]"
_QP = "[" + ", ".join(f"{i * 0.1!r}" for i in range(10)) + ", 1.0]"
_Q = f"select set, list_concat(list_concat([least(q[1], 0.0)], q[2:10]), [greatest(q[11], 1.0)]) as edges from (select set, quantile_cont(p_max, {_QP}) as q from st group by set)"


@query("a25_calibration_summary", f"""with {_SETS}, base as (select set, avg(p_max) as mean_p_max, avg(s1_correct::int::double) as accuracy, avg(p_max) filter (where s1_correct) as mean_p_max_right,
 avg(p_max) filter (where not s1_correct) as mean_p_max_wrong, avg(p_max) - avg(s1_correct::int::double) as overconfidence from st group by set),
 u as (select set, sum(n*abs(gap))/sum(n) as ece, max(abs(gap)) as mce from {_bins('st', f'select distinct set, {_U} as edges from st')} group by set),
 q as (select set, sum(n*abs(gap))/sum(n) as ece_quantile from {_bins('st', _Q)} group by set),
 a as (select set, u/nullif(p*n,0) as auroc from {auroc_sql('st', 'set', 's1_correct', 'p_max')}),
 cells as (select set, p_max, s1_correct, count(*) as c, min(event_id) as key from st group by all), {draws('cells', 'set, p_max, s1_correct', S)},
 reps as (select set, b, u/nullif(p*n,0) as v from {auroc_sql('drawn', 'set, b', 's1_correct', 'p_max', 'w')}), ci as (select set, quantile_cont(v, 0.025) as ci_lo, quantile_cont(v, 0.975) as ci_hi from reps group by set)
 select * from base join u using (set) join q using (set) join a using (set) join ci using (set)""",
       "mean_p_max accuracy mean_p_max_right mean_p_max_wrong overconfidence ece mce ece_quantile auroc ci_lo ci_hi")
def a25(t):
    return tiers.calibration_table(_sets(t), ["set"], "event_id", S)


_V07 = f"""{_SETS}, fam as (select set, family, avg((correct_on::int - s1_correct::int)::double) as fs from st group by set, family), sc as (select st.*, fs from st join fam using (set, family)),
 seg as {segments_sql('sc', 'set', '-p_max', off='s1_correct')}, fseg as {segments_sql('sc', 'set', 'fs', off='s1_correct')},
 oseg as {segments_sql('sc', 'set', '(correct_on::int - s1_correct::int)::double', off='s1_correct')}"""
_T = "((base+gall)/cnt - {}::double)"
_ESC = " ".join(
    f"join (select set, fraction as {r}_{n} from {_min_fraction_sql(s, 'set', _T.format(d))}) using (set)"
    for n, d in (("1pp", 0.01), ("3pp", 0.03)) for r, s in (("confidence", "seg"), ("family", "fseg"), ("oracle", "oseg")))
_RND = ", ".join(
    f"case when acc_cheap >= acc_think - {d}::double - 1e-9 then 0.0 when acc_think <= acc_cheap or acc_think < acc_think - {d}::double - 1e-9 then 1.0 else (acc_think - {d}::double - acc_cheap)/(acc_think - acc_cheap) end as random_{n}"
    for n, d in (("1pp", 0.01), ("3pp", 0.03)))
_AT = ", ".join(f"max(case when f = {f} then (base + g0 + gain/n*(f*cnt - k0))/cnt end) as acc_at_{int(100 * f)}" for f in (0.1, 0.2, 0.3, 0.5))


@query("v07_confidence_routing", f"""with {_V07}, base as (select set, avg(s1_correct::int::double) as acc_cheap, avg(correct_on::int::double) as acc_think from st group by set),
 rnd as (select *, {_RND} from base), acc as (select set, {_AT} from seg, (values (0.1::double), (0.2), (0.3), (0.5)) v(f) where f*cnt > k0 and f*cnt <= k1 group by set)
 select * from rnd join {nauc_sql('seg', 'set')} using (set) join (select set, nauc as family_nauc, mean_accuracy as family_mean_accuracy from {nauc_sql('fseg', 'set')}) using (set)
 join acc using (set) {_ESC} join (select set, sum(u)/nullif(sum(p*n),0) as within_family_auroc_wrong from {auroc_sql('sc', 'set, family', '(not s1_correct)', '-p_max')} group by set) using (set)
 join (select set, sum(u)/nullif(sum(p*n),0) as within_family_auroc_helped from {auroc_sql('sc', 'set, family', '(not s1_correct and correct_on)', '-p_max')} group by set) using (set)""",
       "acc_cheap acc_think random_1pp random_3pp nauc mean_accuracy random_mean_accuracy oracle_mean_accuracy family_nauc family_mean_accuracy acc_at_10 acc_at_20 acc_at_30 acc_at_50 "
       "confidence_1pp family_1pp oracle_1pp confidence_3pp family_3pp oracle_3pp within_family_auroc_wrong within_family_auroc_helped")
def v07(t):
    return tiers.routing_table(_sets(t), ["set"])


@query("v07_routing_intervals", f"""with {_V07}, cells as (select set, s1_correct, correct_on, p_max, fs, count(*) as c, min(event_id) as key from sc group by all),
 long as (select set, 'conf' as scorer, -p_max as s, s1_correct, correct_on, c, key from cells union all select set, 'family', fs, s1_correct, correct_on, c, key from cells),
 {draws('long', 'set, scorer, s, s1_correct, correct_on', S)},
 v as (select set, scorer, b, nauc as v from {nauc_sql(segments_sql('drawn', 'set, scorer, b', 's', 'w', off='s1_correct'), 'set, scorer, b')}),
 d as (select set, b, max(v) filter (where scorer = 'conf') as own, max(v) filter (where scorer = 'conf') - max(v) filter (where scorer = 'family') as v from v group by set, b),
 pt as (select set, scorer, nauc as v from {nauc_sql(segments_sql('long', 'set, scorer', 's', 'c::double', off='s1_correct'), 'set, scorer')}),
 est as (select set, max(v) filter (where scorer = 'conf') - max(v) filter (where scorer = 'family') as estimate from pt group by set)
 select set, quantile_cont(own, 0.025) as nauc_lo, quantile_cont(own, 0.975) as nauc_hi, max(estimate) as estimate, quantile_cont(v, 0.025) as ci_lo, quantile_cont(v, 0.975) as ci_hi,
 count(v) as n_boot, stddev_samp(v) as se, avg((v <= 0)::int::double) as p_le_zero from d join est using (set) group by set""",
       "nauc_lo nauc_hi estimate ci_lo ci_hi se p_le_zero")
def v07_ci(t):
    """nAUC interval of the confidence router and its paired difference to the family router."""
    return tiers.routing_intervals(_sets(t), ["set"], "event_id", S)


_GRID = """(select {k}, list_concat(list_sort(list_distinct(q)), ['infinity'::double]) as grid from (select {k}, quantile_cont(p_max, [""" + \
    ", ".join(f"{i / 40!r}" for i in range(41)) + """]) as q from {s} group by {k}))"""


def _policy_sql(src: str, keys: str, delta: float) -> str:
    """Best pair per group, from rows by brute force over all pairs of grid points."""
    on = " and ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    ak = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""(with g as {_GRID.format(k=keys, s=src)}, pt as (select {keys}, unnest(grid) as tau from g),
  cut as (select {ak}, tau, count(*) as n, sum(s1_correct::int) filter (where p_max >= tau) as a1, sum(correct_off::int) filter (where p_max >= tau) as a2,
   sum(correct_on::int) filter (where p_max < tau) as b3, sum(n_tokens_off) filter (where p_max >= tau) as t2, sum(n_tokens_on) filter (where p_max < tau) as u3,
   sum(correct_on::int) as all3 from pt a join {src} b on {on} group by {ak}, tau),
  pr as (select {ak}, a.tau as lo, b.tau as hi, (coalesce(b.a1,0) + coalesce(a.a2,0) - coalesce(b.a2,0) + coalesce(a.b3,0))/a.n::double as acc,
   coalesce(a.t2,0) - coalesce(b.t2,0) + coalesce(a.u3,0) as tokens, a.all3/a.n::double as always from cut a join cut b on {on} and a.tau <= b.tau)
  select {keys}, lo, hi from (select *, row_number() over (partition by {keys} order by tokens, lo, hi) as rn from pr where acc >= always - {delta} - 1e-12) where rn = 1)"""


_RESULT = """avg(case when p_max >= hi then s1_correct when p_max >= lo then correct_off else correct_on end::int::double) as acc,
 avg(case when p_max >= hi then 0 when p_max >= lo then n_tokens_off else n_tokens_on end::double) as tokens, avg((p_max >= hi)::int::double) as frac_s1,
 avg((p_max >= lo and p_max < hi)::int::double) as frac_nothink, avg((p_max < lo)::int::double) as frac_think"""


@query("k08_best_policy", f"with {_SETS} select set, lo, hi from {_policy_sql('st', 'set', 0.03)}", "lo hi")
def k08(t):
    return tiers.best_policy(_sets(t), ["set"], 0.03)


@query("k09_threshold_grid", f"with {_SETS} select set, i, grid[i+1] as tau from {_GRID.format(k='set', s='st')}, range(60) r(i) where i < len(grid)", "")
def k09(t):
    return tiers.threshold_grid(_sets(t), ["set"]).select("set", F.posexplode("grid").alias("i", "tau"))


@query("j12_threshold_pairs", f"with {_SETS}, g as {_GRID.format(k='set', s='st')}, p as (select set, unnest(grid) as tau from g) select a.set, count(*) as pairs, count(distinct a.tau) as points "
       "from p a join p b on a.set = b.set and a.tau <= b.tau group by a.set")
def j12(t):
    grid = tiers.threshold_grid(_sets(t), ["set"]).select("set", F.explode("grid").alias("tau"))
    other = grid.select(F.col("set").alias("s2"), F.col("tau").alias("hi"))
    pairs = grid.join(other, (F.col("set") == F.col("s2")) & (F.col("tau") <= F.col("hi")))
    return pairs.groupBy("set").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("tau").alias("points"))


@query("v08_policy_evaluation", f"with {_SETS}, x as (select *, 0.3::double as lo, 0.5::double as hi from st) select set, {_RESULT} from x group by set", "acc tokens frac_s1 frac_nothink frac_think")
def v08(t):
    rows = _sets(t).withColumn("lo", F.lit(0.3)).withColumn("hi", F.lit(0.5))
    return tiers.policy_result(rows, ["set"])


_V09 = " union all ".join(
    f"""select set, {_RESULT}, '{n} in_sample' as policy from st join {_policy_sql('st', 'set', d)} using (set) group by set
 union all select x.set, {_RESULT}, '{n} cross_fitted' as policy from (select st.* , coalesce(lo, 'infinity'::double) as lo, coalesce(hi, 'infinity'::double) as hi from st left join
 {_policy_sql('oth', 'set, fold', d)} c on st.set = c.set and st.event_id % 5 = c.fold) x group by x.set""" for n, d in tiers.DELTAS.items())


@query("v09_three_tiers", f"""with {_SETS}, oth as (select st.* , f as fold from st, range(5) r(f) where event_id % 5 <> f), u as (select set, avg(s1_correct::int::double) as acc, 0.0 as tokens,
 null::double as frac_s1, null::double as frac_nothink, null::double as frac_think, 'always s1' as policy from st group by set
 union all select set, avg(correct_off::int::double), avg(n_tokens_off), null, null, null, 'always no_think' from st group by set
 union all select set, avg(correct_on::int::double), avg(n_tokens_on), null, null, null, 'always think' from st group by set union all {_V09}) select * from u""",
       "acc tokens frac_s1 frac_nothink frac_think")
def v09(t):
    rows = _sets(t).withColumn("fold", (F.col("event_id") % 5).cast("int"))
    return tiers.three_tier(rows, ["set"])


# Comparison and transfer ------------------------------------------------------------------

def _transfer(t, e):
    e = e.withColumn("task", F.concat(F.lit("s"), (F.col("vec_id") % 2).cast("string")))
    rows = splits.stratified_split(e, ["task"], "y", 42, "vec_id")
    _, points = predict.logistic_scores(rows, "vec", "y", seed_col="task", balanced=True)
    probes = small_table(t.spark, points, "task: string, coef: array<double>, intercept: double, mean: array<double>, sd: array<double>")
    probes = probes.withColumnRenamed("task", "source").withColumns({
        "objective": F.lit("needs_thinking"), "prefill_mode": F.lit("off"), "seed": F.lit(42),
        "input_dim": F.size("coef"), "threshold": F.lit(0.5)})
    tasks = e.select("task").distinct().withColumn("objective", F.lit("needs_thinking"))
    return compare.evaluate_transfer(compare.transfer_scores(probes, e, tasks), "y", "vec_id", S)[1]


@query("l10_transfer")
def l10(t):
    """Probes fitted on one slice of the vectors, applied unchanged to every other slice."""
    e = t.embeddings.select("vec_id", F.col("embedding").alias("vec"), (F.col("label") >= 5).alias("y"))
    return _transfer(t, e.withColumn(OFF, ~F.col("y")).withColumn(ON, F.col("vec_id") % 4 != 0))


_VEC = "select vec_id, vec_id as event_id, label >= 5 as y, label < 5 as correct_off, vec_id % 4 <> 0 as correct_on, embedding[1]::double as x1, embedding[2]::double as x2 from embeddings"


def _vectors(t):
    e = t.embeddings.select("vec_id", F.slice("embedding", 1, 2).alias("vec"), (F.col("label") >= 5).alias("y"))
    return e.withColumn(OFF, ~F.col("y")).withColumn(ON, F.col("vec_id") % 4 != 0)


@query("l08_two_columns", f"""with recursive f as (select e.*, k as seed from ({_VEC}) e, (values (42), (1), (2), (3), (4)) v(k)), sp as {_split_sql('f', 'seed', 'seed::varchar', 'vec_id', 'y')},
 {logistic_sql('sp', 'seed')}, held as materialized (select * from scored where split <> 'train'), vseg as {segments_sql("(select * from held where split = 'val')", 'seed', 's')},
 cand as (select seed, s as t, g1 as g from vseg union all select seed, 0.0, coalesce(sum(gain) filter (where s >= 0.0), 0) from vseg group by seed
  union all select seed, 1.0, coalesce(sum(gain) filter (where s >= 1.0), 0) from vseg group by seed),
 thr as (select seed, t as thr from (select *, row_number() over (partition by seed order by g desc, t) as rn from cand) where rn = 1),
 cur as (select h.*, thr from held h join thr on h.seed = thr.seed), {_evaluate_sql('seed, split')} select seed, split, {_EV_COLS} from m join a using (seed, split) join p using (seed, split)
 join n1 using (seed, split) join n2 using (seed, split) join k using (seed, split)""", _EV_DBL, "seed")
def l08_two(t):
    """The whole seed run on two columns: split, scale, fit, threshold, every metric."""
    return experiment.run_probe(_vectors(t), "vec", "y", "vec_id", [42, 1, 2, 3, 4])[0]


@query("l10_two_columns", f"""with recursive f as (select *, concat('s', vec_id % 2) as task from ({_VEC})), sp as {_split_sql('f', 'task', "'42'", 'vec_id', 'y')}, {logistic_sql('sp', 'task')},
 met as materialized (select st.task as source, f.task as target, vec_id, y, correct_off, correct_on, 1/(1 + exp(-(w1*(x1 - m1)/d1 + w2*(x2 - m2)/d2 + b))) as s
  from f join st on st.task <> f.task join fits on fits.task = st.task),
 pt as (select source, target, u/nullif(p*n, 0) as auroc from {auroc_sql('met', 'source, target', 'y', 's')}),
 ro as (select source, target, avg(case when s >= 0.5 then correct_on else correct_off end::int::double) as routed from met group by source, target),
 cells as (select source, target, s, y, count(*) as c, min(vec_id) as key from met group by all), {draws('cells', 'source, target, s, y', S)},
 reps as (select source, target, b, u/nullif(p*n, 0) as v from {auroc_sql('drawn', 'source, target, b', 'y', 's', 'w')}),
 ci as (select source, target, quantile_cont(v, 0.025) as ci_lo, quantile_cont(v, 0.975) as ci_hi from reps group by source, target)
 select source, target, 'needs_thinking' as objective, auroc as transfer_auroc, 1 as n, routed as transfer_routed_accuracy, ci_lo, ci_hi, 1 as n_seeds
 from pt join ro using (source, target) join ci using (source, target)""", "transfer_auroc transfer_routed_accuracy ci_lo ci_hi", "n n_seeds")
def l10_two(t):
    """Transfer of probes on two columns, with intervals."""
    return _transfer(t, _vectors(t))


_PAIRS = f"""a as (select family as objective, task, u/nullif(p*n,0) as auroc from {auroc_sql('evt', 'family, task', '(not correct_off)', '-conf')})"""


@query("l11_transfer_verdict", f"""with {EVT}, {_PAIRS} select s.objective, s.task as source, t.task as target, case when s.auroc < 0.55 then 'undefined — source probe was at chance'
 when t.task = 't3' or not (t.auroc - 0.06 > 0.5) then 'no transfer — target at chance' when 100*(s.auroc - t.auroc) < 5 then 'strong transfer'
 when 100*(s.auroc - t.auroc) <= 15 then 'partial transfer' else 'weak transfer — above chance but large drop' end as verdict
 from a s join a t on s.objective = t.objective and s.task <> t.task""")
def l11(t):
    """Target t3 has no lower bound, which counts as no transfer."""
    e = t.evt().withColumn("y", ~F.col(OFF)).withColumn("neg", -F.col("conf"))
    a = rank.auroc(e, ["family", "task"], "y", "neg").select(F.col("family").alias("objective"), "task", "auroc")
    pairs = ordered_pairs(a.select("objective", "task"), "task", ["objective"])
    src = a.select("objective", F.col("task").alias("source"), F.col("auroc").alias("sa"))
    tgt = a.select("objective", F.col("task").alias("target"), F.col("auroc").alias("ta"))
    lo = F.when(F.col("target") != "t3", F.col("ta") - 0.06)
    return pairs.join(src, ["objective", "source"]).join(tgt, ["objective", "target"]).select(
        "objective", "source", "target", compare.verdict(F.col("sa"), lo, F.col("ta")).alias("verdict"))


@query("l14_gates", f"""with {EVT}, c as (select family, count(*) filter (where not correct_off and conf >= 0.1)/nullif(count(*) filter (where not correct_off),0)::double as cel,
 avg(conf) - avg(correct_off::int::double) as over from evt group by family), seg as {segments_sql('evt', 'family', 'score_a')}, fb as {segments_sql('evt', 'family', 'score_b')},
 n as (select a.family, a.nauc - b.nauc as d from {nauc_sql('seg', 'family')} a join {nauc_sql('fb', 'family')} b on a.family = b.family),
 ka as {_min_fraction_sql('seg', 'family', '((base+gall)/cnt - 0.01::double)')}, kb as {_min_fraction_sql('fb', 'family', '((base+gall)/cnt - 0.01::double)')}
 select c.family, case when cel <= 0.10 and over + 0.02 <= 0.05 then 'collapse' when cel >= 0.25 or over - 0.02 >= 0.10 then 'confidently wrong' else 'inconclusive' end as calibration,
 coalesce(d >= 0.03 and (kb.fraction - ka.fraction)/nullif(kb.fraction, 0) >= 0.15, false) as headroom from c join n on c.family = n.family join ka on c.family = ka.family join kb on c.family = kb.family""")
def l14(t):
    e = t.evt()
    wrong = ~F.col(OFF)
    c = e.groupBy("family").agg(
        ratio(count_if(wrong & (F.col("conf") >= 0.1)), count_if(wrong)).alias("cel"),
        (F.avg("conf") - F.avg(F.col(OFF).cast("double"))).alias("over"))
    parts = {}
    for s in ("score_a", "score_b"):
        seg = curves.segments(e, ["family"], OFF, ON, s)
        parts[s] = join_on(curves.nauc(seg, ["family"]).select("family", F.col("nauc").alias(f"n_{s}")),
                           curves.min_fraction(seg, ["family"], curves.always_on(0.01)).withColumnRenamed("fraction", f"k_{s}"), ["family"])
    both = join_on(join_on(c, parts["score_a"], ["family"]), parts["score_b"], ["family"])
    return both.select(
        "family", compare.calibration_gate(F.col("cel"), F.col("over") - 0.02, F.col("over") + 0.02).alias("calibration"),
        compare.headroom_gate(F.col("n_score_a") - F.col("n_score_b"), F.col("k_score_a"), F.col("k_score_b")).alias("headroom"))


@query("r09_paired_predictions", f"""with {EVT}, f as (select *, not correct_off as y, sd as seed from evt, (values (42), (1), (2), (3), (4)) z(sd)), sp as {_split_sql('f', 'seed', 'seed::varchar', 'event_id', 'y')},
 te as (select * from sp where split = 'test'), cells as (select family, seed, y, score_a, score_b, count(*) as c, min(('0x'||substr(md5(sample_id),1,15))::bigint) as key from te group by all),
 long as (select family, seed, 'a' as scorer, score_a as s, y, c, key from cells union all select family, seed, 'b', score_b, y, c, key from cells), {draws('long', 'family, seed, scorer, s, y', S)},
 v as (select family, seed, scorer, b, u/nullif(p*n,0) as v from {auroc_sql('drawn', 'family, seed, scorer, b', 'y', 's', 'w')}),
 d as (select family, seed, b, max(v) filter (where scorer = 'a') - max(v) filter (where scorer = 'b') as v from v group by family, seed, b),
 pt as (select family, seed, scorer, u/nullif(p*n,0) as v from {auroc_sql('long', 'family, seed, scorer', 'y', 's', 'c::double')}),
 est as (select family, seed, max(v) filter (where scorer = 'a') - max(v) filter (where scorer = 'b') as estimate from pt group by family, seed),
 per as (select family, seed, quantile_cont(v, 0.025) as ci_lo, quantile_cont(v, 0.975) as ci_hi, avg((v <= 0)::int::double) as p_le_zero from d group by family, seed)
 select family, avg(estimate) as mean, avg(ci_lo) as ci_lo, avg(ci_hi) as ci_hi, avg(p_le_zero) as p_le_zero, count(*) as n_seeds from per join est using (family, seed) where ci_lo is not null group by family""",
       "mean ci_lo ci_hi p_le_zero")
def r09_pred(t):
    """Probe against baseline from two prediction tables, seed-averaged, per family."""
    # Two tables of the same test rows: their splits are made once.
    rows = settle(_seed_rows(t).where("split = 'test'").select(
        "family", "seed", "split", "sample_id", F.col("y").cast("int").alias("y"), "score_a", "score_b"))
    a = rows.withColumnRenamed("score_a", "score").drop("score_b")
    b = rows.withColumnRenamed("score_b", "score").drop("score_a")
    return compare.paired_difference(a, b, ["family"], S)

