"""Queries for bootstrap intervals and seed summaries."""

import numpy as np
from pyspark.sql import functions as F

from ..columns import count_if, gain, join_on, ratio
from ..operators import boot, calib, rank
from .base import DOC, EVT, auroc_sql, draws, nauc_sql, query, segments_sql, tree_draws
from .rank import wilson_sql

OFF, ON = "correct_off", "correct_on"
B = 2000  # replicates, as many as the intervals of the reports take


def _y(t):
    return t.evt().withColumn("y", ~F.col(OFF)).withColumn("s", -F.col("conf"))


_DOC_ROWS = "cells as (select *, doc_id as key, 1 as c from doc)"
_GAIN = "(correct_on::int - correct_off::int)"


@query("r01_resample_strata", f"""with {DOC}, {_DOC_ROWS}, {tree_draws('cells', 'correct_off, correct_on', 'correct_off', B)}
 select b, sum(w)::bigint as n, sum(w*correct_off::int)::bigint as n_off, sum(w*{_GAIN})/sum(w) as mean_gain from drawn group by b""", "mean_gain")
def r01(t):
    """Exact resample that keeps the size of each outcome class."""
    cells = t.doc().withColumn("c", F.lit(1)).withColumnRenamed("doc_id", "key")
    got = boot.exact_sums(cells, [], [OFF], {"n": F.lit(1), "n_off": F.col(OFF).cast("int"), "g": gain(OFF, ON)}, B)
    return got.select("b", F.col("n").cast("bigint").alias("n"), F.col("n_off").cast("bigint").alias("n_off"), F.try_divide("g", "n").alias("mean_gain"))


@query("r01_resample_rows", f"""with {DOC}, {_DOC_ROWS}, {tree_draws('cells', 'correct_off, correct_on', '', B)},
 reps as (select b, sum(w*{_GAIN})/sum(w) as v from drawn group by b)
 select quantile_cont(v, 0.025) as ci_lo, quantile_cont(v, 0.975) as ci_hi, count(v) as n_boot from reps""", "ci_lo ci_hi")
def r01_rows(t):
    cells = t.doc().withColumn("c", F.lit(1)).withColumnRenamed("doc_id", "key")
    got = boot.exact_sums(cells, [], [], {"n": F.lit(1), "g": gain(OFF, ON)}, B)
    return boot.percentile_interval(got.select("b", F.try_divide("g", "n").alias("v")), [])


@query("r01_row_weights", f"""with {DOC}, {_DOC_ROWS}, {tree_draws('cells', 'doc_id', 'correct_off', 20)}
 select doc_id, b, w::bigint as w from drawn where w > 0""", "", "b")
def r01_weights(t):
    """The resamples themselves: every drawn row with its multiplicity."""
    return boot.exact_weights(t.doc().select("doc_id", OFF), [OFF], "doc_id", 20).select("doc_id", "b", "w")


_GAIN_CELLS = "cells as (select family, correct_off, correct_on, count(*) as c, min(event_id) as key from evt group by all)"
_CI = "quantile_cont(v, 0.025::double) as ci_lo, quantile_cont(v, 0.975::double) as ci_hi, count(v) as n_boot"


@query("r02_percentile_interval", f"""with {EVT}, {_GAIN_CELLS}, {draws('cells', 'family, correct_off, correct_on', 2000)},
 reps as (select family, b, sum(w*(correct_on::int - correct_off::int))/nullif(sum(w),0) as v from drawn group by family, b)
 select family, {_CI} from reps group by family""", "ci_lo ci_hi")
def r02(t):
    cells = boot.cells(t.evt(), ["family"], [OFF, ON], "event_id")
    sums = boot.replicate_sums(cells, ["family"], {"g": gain(OFF, ON), "w": F.lit(1.0)}, 2000)
    return boot.percentile_interval(sums.select("family", "b", F.try_divide("g", "w").alias("v")), ["family"])


_STRATA_CELLS = "cells as (select family, task, correct_off, correct_on, count(*) as c, min(event_id) as key from evt group by all)"
_STRATA_DRAWS = tree_draws("cells", "family, task, correct_off, correct_on", "family, task", 2000)


@query("r02_stratified_interval", f"""with {EVT}, {_STRATA_CELLS}, {_STRATA_DRAWS},
 per as (select family, b, task, sum(w) as n, sum(w*{_GAIN}) as g from drawn group by family, b, task),
 reps as (select family, b, sum(g)/sum(n) as v from per group by family, b), kept as (select family, max(lo = hi) as fixed from (
  select family, task, min(n) as lo, max(n) as hi from per group by family, task) group by family)
 select family, fixed, ci_lo, ci_hi, n_boot from (select family, {_CI} from reps group by family) join kept using (family)""", "ci_lo ci_hi")
def r02_strata(t):
    """Mean gain per family, tasks as strata; ``fixed``: every stratum has its size in every replicate."""
    cells = boot.cells(t.evt(), ["family"], ["task", OFF, ON], "event_id")
    names = [r[0] for r in cells.select("task").distinct().orderBy("task").collect()]
    own = {f"n_{k}": (F.col("task") == name).cast("int") for k, name in enumerate(names)}
    sums = boot.exact_sums(cells, ["family"], ["task"], {"g": gain(OFF, ON), "w": F.lit(1.0), **own}, 2000)
    ci = boot.percentile_interval(sums.select("family", "b", F.try_divide("g", "w").alias("v")), ["family"])
    same = sums.groupBy("family").agg(*[(F.min(n) == F.max(n)).alias(n) for n in own])
    return join_on(ci, same.select("family", F.array_min(F.array(*own)).alias("fixed")), ["family"])


_AUC_CELLS = "cells as (select family, conf, correct_off, count(*) as c, min(event_id) as key from evt group by all)"


@query("r03_auroc_interval", f"""with {EVT}, {_AUC_CELLS}, {draws('cells', 'family, conf, correct_off', B)},
 reps as (select family, b, u/nullif(p*n,0) as v from {auroc_sql('drawn', 'family, b', '(not correct_off)', '-conf', 'w')})
 select family, {_CI} from reps group by family""", "ci_lo ci_hi")
def r03(t):
    cells = boot.cells(_y(t), ["family"], ["s", "y"], "event_id")
    return boot.percentile_interval(boot.replicate_auroc(cells, ["family"], "y", "s", B), ["family"])


_PAIR = """estimate, ci_lo, ci_hi, n_boot, se, p_le_zero"""


def _paired_sql(reps: str, est: str, by: str) -> str:
    return f"""select e.{by}, estimate, ci_lo, ci_hi, n_boot, se, p_le_zero from ({est}) e join (
 select {by}, {_CI}, stddev_samp(v) as se, avg((v <= 0)::int::double) as p_le_zero from {reps} group by {by}) r on e.{by} = r.{by}"""


@query("r04_paired_bootstrap", f"with {EVT}, {_GAIN_CELLS}, {draws('cells', 'family, correct_off, correct_on', 2000)}, "
       "reps as (select family, b, (sum(w*correct_on::int) - sum(w*correct_off::int))/nullif(sum(w),0) as v from drawn group by family, b) "
       + _paired_sql("reps", "select family, avg(correct_on::int::double) - avg(correct_off::int::double) as estimate from evt group by family", "family"),
       "estimate ci_lo ci_hi se p_le_zero")
def r04(t):
    return boot.paired_mean(boot.cells(t.evt(), ["family"], [OFF, ON], "event_id"), ["family"], OFF, ON, 2000)


@query("r04_stratified_paired", f"with {EVT}, {_STRATA_CELLS}, {_STRATA_DRAWS}, "
       f"reps as (select family, b, sum(w*{_GAIN})/sum(w) as v from drawn group by family, b) "
       + _paired_sql("reps", "select family, avg(correct_on::int::double) - avg(correct_off::int::double) as estimate from evt group by family", "family"),
       "estimate ci_lo ci_hi se p_le_zero")
def r04_strata(t):
    """The paired difference of r04, tasks as strata."""
    cells = boot.cells(t.evt(), ["family"], ["task", OFF, ON], "event_id")
    return boot.paired_mean(cells, ["family"], OFF, ON, 2000, strata=["task"])


_TWO = """long as (select task, 'a' as scorer, score_a as s, not correct_off as y, c, key from cells
 union all select task, 'b', score_b, not correct_off, c, key from cells)"""
_TWO_CELLS = "cells as (select task, score_a, score_b, correct_off, count(*) as c, min(event_id) as key from evt group by all)"


@query("r05_paired_auroc_difference", f"""with {EVT}, {_TWO_CELLS}, {_TWO}, {draws('long', 'task, scorer, s, y', B)},
 v as (select task, scorer, b, u/nullif(p*n,0) as v from {auroc_sql('drawn', 'task, scorer, b', 'y', 's', 'w')}),
 reps as (select task, b, max(v) filter (where scorer = 'a') - max(v) filter (where scorer = 'b') as v from v group by task, b),
 pt as (select task, scorer, u/nullif(p*n,0) as v from {auroc_sql('long', 'task, scorer', 'y', 's', 'c::double')}) """
       + _paired_sql("reps", "select task, max(v) filter (where scorer='a') - max(v) filter (where scorer='b') as estimate from pt group by task", "task"),
       "estimate ci_lo ci_hi se p_le_zero")
def r05(t):
    return boot.paired_auroc(_y(t), ["task"], "y", {"a": "score_a", "b": "score_b"}, "a", "b", "event_id", B)


_CURVE_CELLS = "cells as (select score_a, score_b, correct_off, correct_on, count(*) as c, min(event_id) as key from evt group by all)"
_CURVE_LONG = """long as (select 'a' as scorer, score_a as s, correct_off, correct_on, c, key from cells
 union all select 'b', score_b, correct_off, correct_on, c, key from cells)"""


@query("r06_paired_nauc_difference", f"""with {EVT}, {_CURVE_CELLS}, {_CURVE_LONG}, {draws('long', 'scorer, s, correct_off, correct_on', B)},
 v as (select scorer, b, nauc as v from {nauc_sql(segments_sql('drawn', 'scorer, b', 's', 'w'), 'scorer, b')}),
 reps as (select b, max(v) filter (where scorer = 'a') - max(v) filter (where scorer = 'b') as v from v group by b),
 pt as (select scorer, nauc as v from {nauc_sql(segments_sql('long', 'scorer', 's', 'c::double'), 'scorer')})
 select (select max(v) filter (where scorer='a') - max(v) filter (where scorer='b') from pt) as estimate, {_CI},
  stddev_samp(v) as se, avg((v <= 0)::int::double) as p_le_zero from reps""", "estimate ci_lo ci_hi se p_le_zero")
def r06(t):
    return boot.paired_nauc(t.evt(), [], OFF, ON, {"a": "score_a", "b": "score_b"}, "a", "b", "event_id", B)


def _distinct(values: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values and the weights (values x replicates) they have in all."""
    at, place = np.unique(values, return_inverse=True)
    out = np.zeros((len(at), w.shape[1]))
    np.add.at(out, place, w)
    return at, out


def _median(state) -> np.ndarray:
    """The median of every replicate, from weights by value."""
    values, w = state
    upto = np.cumsum(w, 0)
    low, high = ((upto[-1] - 1) // 2, upto[-1] // 2)
    return (values[(upto <= low).sum(0)] + values[(upto <= high).sum(0)]) / 2


#: init, update, merge, finish; a state holds one row per distinct value.
MEDIAN = (
    lambda n: (np.zeros(0), np.zeros((0, n))),
    lambda state, rows, w: _distinct(np.r_[state[0], rows["score"]], np.vstack([state[1], w])),
    lambda a, b: _distinct(np.r_[a[0], b[0]], np.vstack([a[1], b[1]])),
    _median,
)
_MEDIAN_SQL = """stacked as (select b, score, sum(w) over (partition by b order by score) as upto, sum(w) over (partition by b) as n from (select b, score, sum(w) as w from drawn group by b, score)),
 reps as (select b, (min(score) filter (where upto > (n - 1) // 2) + min(score) filter (where upto > n // 2))/2 as v from stacked group by b)"""


@query("r07_within_group_interval", f"""with {EVT}, cells as (select task, family, conf, correct_off, count(*) as c, min(event_id) as key from evt group by all),
 {draws('cells', 'task, family, conf, correct_off', B)},
 reps as (select task, b, sum(u)/nullif(sum(p*n),0) as v from {auroc_sql('drawn', 'task, family, b', '(not correct_off)', '-conf', 'w')} group by task, b)
 select task, {_CI} from reps group by task""", "ci_lo ci_hi")
def r07(t):
    return boot.within_group_interval(_y(t), ["task"], "family", "y", "s", "event_id", B)


@query("r09_seed_averaged_difference", f"""with {EVT}, seeded as (select event_id % 3 as seed, * from evt),
 cells as (select seed, score_a, score_b, correct_off, count(*) as c, min(event_id) as key from seeded group by all),
 long as (select seed, 'a' as scorer, score_a as s, not correct_off as y, c, key from cells
 union all select seed, 'b', score_b, not correct_off, c, key from cells), {draws('long', 'seed, scorer, s, y', B)},
 v as (select seed, scorer, b, u/nullif(p*n,0) as v from {auroc_sql('drawn', 'seed, scorer, b', 'y', 's', 'w')}),
 reps as (select seed, b, max(v) filter (where scorer = 'a') - max(v) filter (where scorer = 'b') as v from v group by seed, b),
 pt as (select seed, scorer, u/nullif(p*n,0) as v from {auroc_sql('long', 'seed, scorer', 'y', 's', 'c::double')}),
 per as ({_paired_sql("reps", "select seed, max(v) filter (where scorer='a') - max(v) filter (where scorer='b') as estimate from pt group by seed", "seed")})
 select avg(estimate) as mean, avg(ci_lo) as ci_lo, avg(ci_hi) as ci_hi, avg(p_le_zero) as p_le_zero, count(*) as n_seeds
 from per where ci_lo is not null""", "mean ci_lo ci_hi p_le_zero")
def r09(t):
    d = _y(t).withColumn("seed", F.col("event_id") % 3)
    per = boot.paired_auroc(d, ["seed"], "y", {"a": "score_a", "b": "score_b"}, "a", "b", "event_id", B)
    return boot.seed_average(per, [])


@query("r10_user_statistic", f"""with {DOC}, {_DOC_ROWS}, {tree_draws('cells', 'score', '', B)}, {_MEDIAN_SQL}
 select {_CI} from reps""", "ci_lo ci_hi")
def r10(t):
    """A Python statistic that folds: the median score of the resampled rows."""
    d = t.doc().select("doc_id", "score")
    return boot.percentile_interval(boot.user_statistic(d, ["score"], *MEDIAN, "doc_id", B), [])


@query("a05_mean_interval", f"""with {EVT}, a as (select family, task, u/nullif(p*n,0) as v from {auroc_sql('evt', 'family, task', '(not correct_off)', '-conf')}),
 m as (select family, avg(v) as mean, stddev_samp(v) as sd, count(v) as n from a group by family)
 select family, mean, mean - coalesce(1.96::double*sd/sqrt(n), 0) as ci_lo, mean + coalesce(1.96::double*sd/sqrt(n), 0) as ci_hi, sd, n from m""",
       "mean ci_lo ci_hi sd")
def a05(t):
    """Spread of an AUROC over repeated runs (here: tasks) of each family."""
    return boot.mean_interval(rank.auroc(_y(t), ["family", "task"], "y", "s"), ["family"], "auroc")


@query("a06_interval_average", f"""with {EVT}, g as (select family, task, count(*) as n, sum(correct_off::int)::bigint as k from evt group by all),
 w as (select family, {wilson_sql('k', 'n')} from g) select family, avg(ci_lo) as ci_lo, avg(ci_hi) as ci_hi, count(ci_lo) as n_seeds
 from w group by family""", "ci_lo ci_hi")
def a06(t):
    g = t.evt().groupBy("family", "task").agg(F.count(F.lit(1)).alias("n"), count_if(F.col(OFF)).alias("k"))
    lo, hi = calib.wilson(F.col("k"), F.col("n"))
    return boot.average_interval(g.select("family", lo.alias("ci_lo"), hi.alias("ci_hi")), ["family"])


@query("a13_overconfidence_interval", f"""with {EVT}, cells as (select family, conf, correct_off, count(*) as c, min(event_id) as key from evt group by all),
 {draws('cells', 'family, conf, correct_off', B)},
 reps as (select family, b, (sum(w*conf) - sum(w*correct_off::int))/nullif(sum(w),0) as v from drawn group by family, b)
 select family, {_CI} from reps group by family""", "ci_lo ci_hi")
def a13_ci(t):
    cells = boot.cells(t.evt(), ["family"], ["conf", OFF], "event_id")
    sums = boot.replicate_sums(cells, ["family"], {
        "c_": F.col("conf"), "o": F.col(OFF).cast("double"), "w": F.lit(1.0)}, B)
    return boot.percentile_interval(
        sums.select("family", "b", F.try_divide(F.col("c_") - F.col("o"), F.col("w")).alias("v")), ["family"])


@query("a32_stratified_block", f"""with {DOC}, big as (select * from doc where difficulty in (select difficulty from doc group by difficulty having count(*) >= 2)),
 cells as (select difficulty, score, correct_off, count(*) as c, min(doc_id) as key from big group by all),
 {draws('cells', 'difficulty, score, correct_off', B)},
 reps as (select difficulty, b, u/nullif(p*n,0) as v from {auroc_sql('drawn', 'difficulty, b', '(not correct_off)', 'score', 'w')}),
 ci as (select difficulty, {_CI} from reps group by difficulty),
 pt as (select difficulty, u/nullif(p*n,0) as auroc from {auroc_sql('big', 'difficulty', '(not correct_off)', 'score')})
 select g.difficulty, n, base_rate, auroc, ci_lo, ci_hi, n_boot from (select difficulty, count(*) as n,
  avg((not correct_off)::int::double) as base_rate from big group by difficulty) g join pt on g.difficulty = pt.difficulty
  join ci on g.difficulty = ci.difficulty""", "base_rate auroc ci_lo ci_hi")
def a32(t):
    d = t.doc().withColumn("y", ~F.col(OFF))
    return boot.stratified_block(d, [], "difficulty", "y", "score", "doc_id", B)
