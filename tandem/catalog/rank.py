"""Queries for rank statistics, curves, thresholds and calibration."""

from pyspark.sql import functions as F

from ..columns import count_if, gain, join_on, ratio
from ..operators import calib, curves, rank, splits
from ..operators.ordered import running
from ..plans import compare
from .base import DOC, EVT, LIN, _area_sql, auroc_sql, h32, nauc_sql, query, segments_sql

OFF, ON = "correct_off", "correct_on"
SEG_EVT = segments_sql("evt", "family", "score_a")


@query("a08_auroc", f"with {DOC} select family, p::bigint as n_pos, n::bigint as n_neg, u/nullif(p*n,0) as auroc from "
       + auroc_sql("doc", "family", "(not correct_off)", "-score"), "auroc")
def a08(t):
    """How well does shortness predict low quality, per language?"""
    d = t.doc().withColumn("y", ~F.col(OFF)).withColumn("s", -F.col("score"))
    return rank.auroc(d, ["family"], "y", "s")


@query("a08_auroc_events", f"with {EVT} select family, p::bigint as n_pos, n::bigint as n_neg, u/nullif(p*n,0) as auroc from "
       + auroc_sql("evt", "family", "(not correct_off)", "-conf"), "auroc")
def a08_evt(t):
    d = t.evt().withColumn("y", ~F.col(OFF)).withColumn("s", -F.col("conf"))
    return rank.auroc(d, ["family"], "y", "s")


@query("a08_auroc_lines", f"with {LIN} select family, p::bigint as n_pos, n::bigint as n_neg, u/nullif(p*n,0) as auroc from "
       + auroc_sql("lin", "family", "(not correct_off)", "score_a"), "auroc")
def a08_lin(t):
    return rank.auroc(t.lin().withColumn("y", ~F.col(OFF)), ["family"], "y", "score_a")


@query("a09_average_precision", f"""with {EVT}, r as (select family, (not correct_off)::int as y,
 row_number() over (partition by family order by score_b desc, event_id) as rk,
 sum((not correct_off)::int) over (partition by family order by score_b desc, event_id rows unbounded preceding) as tp from evt)
 select family, sum(case when y = 1 then tp::double/rk end)/nullif(sum(y),0) as auprc from r group by family""", "auprc")
def a09(t):
    d = t.evt().withColumn("y", ~F.col(OFF))
    return rank.average_precision(d, ["family"], "y", "score_b", "event_id")


@query("a09_average_precision_text_ids", f"""with {EVT}, r as (select family, (not correct_off)::int as y,
 row_number() over (partition by family order by score_b desc, sample_id) as rk,
 sum((not correct_off)::int) over (partition by family order by score_b desc, sample_id rows unbounded preceding) as tp from evt)
 select family, sum(case when y = 1 then tp::double/rk end)/nullif(sum(y),0) as auprc from r group by family""", "auprc")
def a09_text(t):
    """Ties in the order of the text ids that captures have."""
    return rank.average_precision(t.evt().withColumn("y", ~F.col(OFF)), ["family"], "y", "score_b", "sample_id")


@query("a18_within_group", f"with {EVT} select task, sum(u)/nullif(sum(p*n),0) as auroc, count(*) as n_groups, "
       "count(*) filter (where p*n > 0) as n_informative_groups, sum(p*n)::bigint as n_pairs from "
       + auroc_sql("evt", "task, family", "(not correct_off)", "-conf") + " group by task", "auroc")
def a18(t):
    d = t.evt().withColumn("y", ~F.col(OFF)).withColumn("s", -F.col("conf"))
    return rank.within_group(d, ["task"], "family", "y", "s")


@query("a19_within_group_gate", f"""with {EVT}, g as (select family, bool_or(correct_off) and bool_or(not correct_off) as mixed
 from evt group by family) select count(*) as n_groups, count(*) filter (where mixed) as n_informative_groups,
 count(*) filter (where mixed) >= 2 as passes from g""")
def a19(t):
    """The gate's own numbers; ``calib.require_informative`` raises on them."""
    calib.require_informative(t.evt(), "family", OFF)
    g = t.evt().groupBy("family").agg(F.min(OFF).alias("lo"), F.max(OFF).alias("hi"))
    n = count_if(F.col("lo") != F.col("hi"))
    return g.agg(F.count(F.lit(1)).alias("n_groups"), n.alias("n_informative_groups"), (n >= 2).alias("passes"))


@query("a34_rank_correlation", f"""with {EVT}, r as (select family,
 rank() over (partition by family order by score_a) + (count(*) over (partition by family, score_a) - 1)/2.0 as ra,
 rank() over (partition by family order by score_b) + (count(*) over (partition by family, score_b) - 1)/2.0 as rb from evt)
 select family, corr(ra, rb) as spearman from r group by family""", "spearman")
def a34(t):
    return rank.rank_correlation(t.evt(), ["family"], "score_a", "score_b")


@query("a34_auroc_subset", f"with {EVT}, y as (select *, not correct_off as y from evt), x as (select 'all' as rows, * from y "
       "union all select 'untruncated', * from y where not truncated_off) "
       "select rows, u/nullif(p*n,0) as auroc from " + auroc_sql("x", "rows", "y", "-conf"), "auroc")
def a34_subset(t):
    """The same predictor on all rows and on the clean subset, in one pass."""
    d = t.evt().withColumn("y", ~F.col(OFF)).withColumn("s", -F.col("conf"))
    sets = F.array_compact(F.array(F.lit("all"), F.when(~F.col("truncated_off"), F.lit("untruncated"))))
    return rank.auroc(d.withColumn("rows", F.explode(sets)), ["rows"], "y", "s").select("rows", "auroc")


@query("a35_truncation_auroc", f"with {EVT} select family, u/nullif(p*n,0) as auroc from "
       + auroc_sql("evt", "family", "truncated_off", "n_tokens_off::double"), "auroc")
def a35_auroc(t):
    """Does the predictor score truncation instead of the label?"""
    d = t.evt().withColumn("s", F.col("n_tokens_off").cast("double"))
    return rank.auroc(d, ["family"], "truncated_off", "s").select("family", "auroc")


@query("w01_average_rank", f"""with {EVT} select event_id, rank() over (partition by family order by score_b)
 + (count(*) over (partition by family, score_b) - 1)/2.0::double as rank from evt""", "rank")
def w01(t):
    return rank.average_ranks(t.evt(), ["family"], "score_b").select("event_id", "rank")


@query("w02_routed_curve", f"with {EVT}, seg as {SEG_EVT} select family, k1::bigint as k, k1/cnt as fraction, "
       "(base+g1)/cnt as accuracy, s as threshold from seg union all select family, 0, 0.0, max(base/cnt), "
       "'infinity'::double from seg group by family", "fraction accuracy")
def w02(t):
    return curves.vertices(curves.segments(t.evt(), ["family"], OFF, ON, "score_a"), ["family"])


@query("w02_nauc_lines", f"with {LIN} select family, nauc, mean_accuracy from "
       + nauc_sql(segments_sql("lin", "family", "score_a"), "family"), "nauc mean_accuracy")
def w02_lin(t):
    seg = curves.segments(t.lin(), ["family"], OFF, ON, "score_a")
    return curves.nauc(seg, ["family"]).select("family", "nauc", "mean_accuracy")


@query("w03_oracle_curve", f"with {EVT}, seg as "
       + segments_sql("evt", "family", "(correct_on::int - correct_off::int)::double")
       + " select family, k1::bigint as k, k1/cnt as fraction, (base+g1)/cnt as accuracy, s as threshold from seg "
       "union all select family, 0, 0.0, max(base/cnt), 'infinity'::double from seg group by family", "fraction accuracy")
def w03(t):
    return curves.vertices(curves.oracle_segments(t.evt(), ["family"], OFF, ON), ["family"])


@query("w04_precision_threshold", f"""with {EVT}, c as (select family, conf, count(*) as n, sum(correct_off::int) as ok
 from evt group by family, conf), r as (select family, conf, sum(n) over w as cn, sum(ok) over w as co,
 sum(n) over (partition by family) as tot from c window w as (partition by family order by conf desc rows unbounded preceding)),
 b as (select family, min(conf) filter (where co/cn::double >= 0.6) as tau from r group by family)
 select b.family, coalesce(tau, 'infinity'::double) as tau, max(co/cn::double) filter (where r.conf = tau) as precision,
 coalesce(max(cn/tot::double) filter (where r.conf = tau), 0.0) as coverage, max(tot)::bigint as n
 from r join b on r.family = b.family group by b.family, tau""", "tau precision coverage")
def w04(t):
    return calib.precision_threshold(t.evt(), ["family"], "conf", OFF, 0.6)


@query("w05_curve_area", f"with {EVT}, seg as {SEG_EVT} select family, {_area_sql(0.0, 0.5)} as area_half, "
       f"{_area_sql(0.1, 0.9)} as area_inner from seg group by family", "area_half area_inner")
def w05(t):
    seg = curves.segments(t.evt(), ["family"], OFF, ON, "score_a")
    half = curves.area(seg, ["family"], 0.0, 0.5).withColumnRenamed("area", "area_half")
    inner = curves.area(seg, ["family"], 0.1, 0.9).withColumnRenamed("area", "area_inner")
    return join_on(half, inner, ["family"])


def _split_sql(src: str, by: str, seed: str, ident: str, y: str) -> str:
    part = f"partition by {by + ', ' if by else ''}{y}"
    key = f"concat({seed}, ':', cast({ident} as varchar))"
    return f"""(select *, case when rn <= round_even(tot * 0.6::double, 0) then 'train'
  when rn <= round_even(tot * 0.6::double, 0) + round_even(tot * 0.2::double, 0) then 'val' else 'test' end as split from (
  select *, row_number() over ({part} order by {h32(key)}, {ident}) as rn, count(*) over ({part}) as tot from {src}))"""


@query("w06_stratified_split", f"with {EVT}, y as (select *, not correct_off as y from evt) select event_id, y, split from "
       + _split_sql("y", "", "'42'", "event_id", "y"))
def w06(t):
    d = t.evt().withColumn("y", ~F.col(OFF))
    return splits.stratified_split(d, [], "y", 42, "event_id").select("event_id", "y", "split")


@query("w07_folds", f"""with {EVT}, r as (select event_id, row_number() over (order by {h32("concat('7:', cast(event_id as varchar))")}, event_id) - 1 as pos,
 count(*) over () as n from evt) select event_id, case when pos < (n % 5) * (n // 5 + 1) then pos // (n // 5 + 1)
 else (n % 5) + (pos - (n % 5) * (n // 5 + 1)) // (n // 5) end as fold from r""")
def w07(t):
    return splits.folds(t.evt(), [], 5, 7, "event_id").select("event_id", "fold")


@query("w08_group_head", f"""with {EVT} select event_id, family from (select *, row_number() over (partition by family
 order by event_id) as rn from evt) where rn <= 20""")
def w08(t):
    return splits.group_head(t.evt(), "family", ["event_id"], 20).select("event_id", "family")


@query("w09_group_mean_score", f"""with {EVT} select event_id, avg((correct_on::int - correct_off::int)::double)
 over (partition by task, family) as group_score from evt""", "group_score")
def w09(t):
    return curves.group_mean_score(t.evt(), ["task"], "family", OFF, ON).select("event_id", "group_score")


@query("w10_vertex_sequence", f"with {EVT}, seg as {SEG_EVT}, pts as (select family, k from (select family, max(cnt)::bigint as m "
       "from seg group by family) x, unnest(range(0, m + 1)) r(k)) select p.family, p.k, p.k/cnt as fraction, "
       "(base + g0 + gain/n*(p.k - k0))/cnt as accuracy from pts p join seg s on p.family = s.family "
       "and ((p.k > s.k0 and p.k <= s.k1) or (p.k = 0 and s.k0 = 0))", "fraction accuracy")
def w10(t):
    return curves.counts_curve(curves.segments(t.evt(), ["family"], OFF, ON, "score_a"), ["family"])


@query("w11_running_sum", f"""with {LIN}, c as (select family, score_a, count(*) as n, sum(correct_on::int - correct_off::int)::bigint as gain
 from lin group by all) select family, score_a, (sum(n) over w)::bigint as cum_n, (sum(gain) over w)::bigint as cum_gain,
 (sum(n) over (partition by family))::bigint as tot_n from c
 window w as (partition by family order by score_a rows unbounded preceding)""", "score_a")
def w11(t):
    """The distributed form, forced on, so the block path itself is checked."""
    cells = t.lin().withColumn("g", gain(OFF, ON)).groupBy("family", "score_a").agg(
        F.count(F.lit(1)).alias("n"), F.sum("g").alias("gain"))
    return running(cells, ["family"], "score_a", ["n", "gain"]).select(
        "family", "score_a", "cum_n", "cum_gain", "tot_n")


@query("k01_best_threshold", f"with {EVT}, seg as {SEG_EVT}, cand as (select family, s as thr, g1 as g, base, cnt from seg "
       "union all select family, 0.0, coalesce(sum(gain) filter (where s >= 0.0), 0), max(base), max(cnt) from seg group by family "
       "union all select family, 1.0, coalesce(sum(gain) filter (where s >= 1.0), 0), max(base), max(cnt) from seg group by family) "
       "select family, thr as threshold, (base+g)/cnt as accuracy from (select *, row_number() over (partition by family "
       "order by g desc, thr) as rn from cand) where rn = 1", "threshold accuracy")
def k01(t):
    return curves.best_threshold(curves.segments(t.evt(), ["family"], OFF, ON, "score_a"), ["family"])


def _min_fraction_sql(seg: str, by: str, target: str) -> str:
    """Brute form: the smallest whole k of each segment by counting up is replaced by its algebra."""
    keys = f"{by}, " if by else ""
    return f"""(select {keys}coalesce(min(case when need <= 0 then k0 when gain > 0
  and ceil(k0 + need/(gain/n)) <= k1 then ceil(k0 + need/(gain/n)) end/cnt), 1.0) as fraction from (
  select *, ({target} - 1e-9)*cnt - (base + g0) as need from {seg}) {'group by ' + by if by else ''})"""


@query("k04_min_fraction", f"with {EVT}, seg as {SEG_EVT}, pts as (select family, s.base, s.g0, s.gain, s.n, s.k0, s.cnt, s.gall, k from seg s, "
       "unnest(range(s.k0::bigint, s.k1::bigint + 1)) r(k)), acc as (select family, k/cnt as f, (base + g0 + gain/n*(k-k0))/cnt as a, "
       "(base+gall)/cnt as always from pts) select family, coalesce(min(f) filter (where a >= always - 1e-9), 1.0) as fraction, "
       "coalesce(min(f) filter (where a >= always - 0.01 - 1e-9), 1.0) as fraction_minus_1pp from acc group by family",
       "fraction fraction_minus_1pp")
def k04(t):
    seg = curves.segments(t.evt(), ["family"], OFF, ON, "score_a")
    full = curves.min_fraction(seg, ["family"], curves.always_on())
    near = curves.min_fraction(seg, ["family"], curves.always_on(0.01))
    return join_on(full, near.withColumnRenamed("fraction", "fraction_minus_1pp"), ["family"])


@query("k05_sampled_curve", f"with {EVT}, seg as {SEG_EVT} select family, i, round_even(i*cnt/20.0::double, 0)/cnt as fraction, "
       "(base + g0 + gain/n*(round_even(i*cnt/20.0::double, 0) - k0))/cnt as accuracy from seg, range(21) r(i) where "
       "(round_even(i*cnt/20.0::double, 0) > k0 and round_even(i*cnt/20.0::double, 0) <= k1) or (i = 0 and k0 = 0)",
       "fraction accuracy")
def k05(t):
    return curves.sampled_curve(curves.segments(t.evt(), ["family"], OFF, ON, "score_a"), ["family"])


@query("k11_numeric_group_order", f"""with {EVT}, g as (select family as g from evt union select n_tokens_off::varchar from evt)
 select g, try_cast(g as double) is null as is_text, try_cast(g as double) as number from g order by is_text, number, g""", "number")
def k11(t):
    e = t.evt()
    names = e.select(F.explode(F.array("family", F.col("n_tokens_off").cast("string"))).alias("g")).distinct()
    return calib.numeric_group_order(names, "g")


@query("j08_interpolate", f"with {EVT}, seg as {SEG_EVT} select event_id, e.family, (base + g0 + gain/n*(conf*cnt - k0))/cnt as accuracy "
       "from evt e join seg s on e.family = s.family and ((conf*cnt > k0 and conf*cnt <= k1) or (conf <= 0 and k0 = 0))", "accuracy")
def j08(t):
    """Curve value at every row's own fraction (here: its confidence)."""
    e = t.evt()
    seg = curves.segments(e, ["family"], OFF, ON, "score_a")
    return curves.interpolate(e.select("event_id", "family", "conf"), seg, ["family"], "conf").select(
        "event_id", "family", "accuracy")


@query("j08_at_fractions", f"with {EVT}, seg as {SEG_EVT} select family, f as fraction, (base + g0 + gain/n*(f*cnt - k0))/cnt as accuracy "
       "from seg, (values (0.0::double), (0.1), (0.2), (0.3), (0.5), (1.0)) v(f) where (f*cnt > k0 and f*cnt <= k1) or (f = 0 and k0 = 0)",
       "fraction accuracy")
def j08_at(t):
    seg = curves.segments(t.evt(), ["family"], OFF, ON, "score_a")
    return curves.at_fractions(seg, ["family"], [0.0, 0.1, 0.2, 0.3, 0.5, 1.0])


@query("v01_routed_accuracy", f"with {EVT} select family, avg(case when score_a >= 20.0 then correct_on else correct_off end::int::double) "
       "as routed_accuracy, avg((score_a >= 20.0)::int::double) as fraction_routed from evt group by family",
       "routed_accuracy fraction_routed")
def v01(t):
    return curves.routed(t.evt(), ["family"], OFF, ON, "score_a", F.lit(20.0))


@query("v02_random_routing", f"with {EVT}, m as (select family, avg(correct_off::int::double) as a, avg(correct_on::int::double) as b "
       "from evt group by family) select family, f as fraction, a + f*(b-a) as accuracy from m, "
       "(values (0.0::double), (0.25), (0.5), (1.0)) v(f)", "fraction accuracy")
def v02(t):
    m = curves.policy_baselines(t.evt(), ["family"], OFF, ON)
    f = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 1.0)]))
    return m.withColumn("fraction", f).select(
        "family", "fraction", curves.random_accuracy_at(F.col("fraction"), F.col("never"), F.col("always")).alias("accuracy"))


@query("v03_nauc", f"with {EVT} select * from " + nauc_sql(SEG_EVT, "family"),
       "nauc mean_accuracy random_mean_accuracy oracle_mean_accuracy")
def v03(t):
    return curves.nauc(curves.segments(t.evt(), ["family"], OFF, ON, "score_a"), ["family"])


@query("v03_nauc_inner_range", f"with {EVT} select * from " + nauc_sql(SEG_EVT, "family", 0.1, 0.9),
       "nauc mean_accuracy random_mean_accuracy oracle_mean_accuracy")
def v03_inner(t):
    return curves.nauc(curves.segments(t.evt(), ["family"], OFF, ON, "score_a"), ["family"], 0.1, 0.9)


@query("v04_matched_references", f"""with {EVT}, m as (select family, avg(correct_off::int::double) as a, avg(correct_on::int::double) as b,
 avg((correct_on and not correct_off)::int::double) as h, avg((correct_off and not correct_on)::int::double) as u,
 avg((score_a >= 20.0)::int::double) as f, avg(case when score_a >= 20.0 then correct_on else correct_off end::int::double) as r
 from evt group by family) select family, r as routed_accuracy, f as fraction_routed, a + f*(b-a) as random_at_matched_rate,
 a + least(f, h) - greatest(0.0, f - (1.0 - u)) as oracle_at_matched_rate from m""",
       "routed_accuracy fraction_routed random_at_matched_rate oracle_at_matched_rate")
def v04(t):
    return curves.matched_references(t.evt(), ["family"], OFF, ON, "score_a", F.lit(20.0))


@query("a10_policy_baselines", f"""with {EVT} select family, avg(correct_off::int::double) as never, avg(correct_on::int::double) as always,
 avg((correct_off or correct_on)::int::double) as oracle from evt group by family""", "never always oracle")
def a10(t):
    return curves.policy_baselines(t.evt(), ["family"], OFF, ON)


Z = "1.959963984540054::double"


def wilson_sql(k: str, n: str) -> str:
    p = f"({k}/nullif({n},0)::double)"
    den = f"(1 + {Z}*{Z}/{n})"
    mid = f"(({p} + {Z}*{Z}/(2*{n}))/{den})"
    half = f"({Z}*sqrt({p}*(1-{p})/{n} + {Z}*{Z}/(4.0*{n}*{n}))/{den})"
    return (f"case when {n} > 0 then greatest(0.0, {mid} - {half}) end as ci_lo, "
            f"case when {n} > 0 then least(1.0, {mid} + {half}) end as ci_hi")


@query("a11_wilson", f"with {EVT}, g as (select family, count(*) as n, sum(correct_off::int)::bigint as k from evt group by family) "
       f"select family, k, n, {wilson_sql('k', 'n')} from g", "ci_lo ci_hi")
def a11(t):
    g = t.evt().groupBy("family").agg(F.count(F.lit(1)).alias("n"), count_if(F.col(OFF)).alias("k"))
    lo, hi = calib.wilson(F.col("k"), F.col("n"))
    return g.select("family", "k", "n", lo.alias("ci_lo"), hi.alias("ci_hi"))


@query("a12_confident_errors", f"""with {EVT}, g as (select case when grouping(family) = 1 then 'overall' else 'group' end as level, family,
 count(*) as n, count(*) filter (where not correct_off) as n_wrong, count(*) filter (where not correct_off and conf >= 0.3) as n_leaked
 from evt group by grouping sets ((), (family))) select level, family, n, n_wrong, n_leaked, n_leaked/nullif(n_wrong,0)::double as cel,
 {wilson_sql('n_leaked', 'n_wrong')} from g""", "cel ci_lo ci_hi")
def a12(t):
    return calib.confident_errors(t.evt(), "family", "conf", OFF, 0.3)


@query("a13_overconfidence", f"""with {EVT} select case when grouping(family) = 1 then 'overall' else 'group' end as level, family,
 count(*) as n, avg(conf) as mean_conf, avg(correct_off::int::double) as accuracy, avg(conf) - avg(correct_off::int::double) as overconfidence
 from evt group by grouping sets ((), (family))""", "mean_conf accuracy overconfidence")
def a13(t):
    return calib.overconfidence(t.evt(), "family", "conf", OFF)


def _bins_sql(by: str, edges: str) -> str:
    keys = f"{by}, " if by else ""
    on = f"b.{by} = e.{by} and " if by else ""
    return f"""(select {('e.' + by + ', ') if by else ''}r.bin, e.edges[r.bin+1] as lo, e.edges[r.bin+2] as hi, coalesce(n, 0) as n, mean_conf, accuracy,
  mean_conf - accuracy as gap from ({edges}) e cross join range(10) r(bin) left join (
  select {keys}bin, count(*) as n, avg(conf) as mean_conf, avg(correct_off::int::double) as accuracy from (
   select x.*, greatest(0, least(9, len(list_filter(e2.edges, lambda z: z <= x.conf)) - 1)) as bin
   from evt x join ({edges}) e2 on {('x.' + by + ' = e2.' + by) if by else 'true'})
  group by {keys}bin) b on {on}b.bin = r.bin)"""


_UNI = "[" + ", ".join(f"{e!r}::double" for e in calib.uniform_edges(10)) + "]"
_UNI_EDGES = f"select family, {_UNI} as edges from evt group by family"
_QP = "[" + ", ".join(f"{e!r}" for e in calib.uniform_edges(10)) + "]"
_Q_EDGES = (f"select family, list_concat(list_concat([least(q[1], 0.0)], q[2:10]), [greatest(q[11], 1.0)]) as edges from "
            f"(select family, quantile_cont(conf, {_QP}) as q from evt group by family)")


@query("a14_reliability_uniform", f"with {EVT} select * from " + _bins_sql("family", _UNI_EDGES), "lo hi mean_conf accuracy gap")
def a14(t):
    return calib.reliability(t.evt(), ["family"], "conf", OFF)


@query("a15_reliability_quantile", f"with {EVT} select * from " + _bins_sql("family", _Q_EDGES), "lo hi mean_conf accuracy gap")
def a15(t):
    return calib.reliability(t.evt(), ["family"], "conf", OFF, strategy="quantile")


@query("a16_calibration_error", f"with {EVT} select sum(n*abs(gap))/nullif(sum(n),0) as ece, max(abs(gap)) as mce, sum(n)::bigint as n from "
       + _bins_sql("", f"select {_UNI} as edges"), "ece mce")
def a16(t):
    return calib.calibration_error(calib.reliability(t.evt(), [], "conf", OFF), [])


@query("a17_reliability_by_group", f"with {EVT} select family, sum(n*abs(gap))/nullif(sum(n),0) as ece, max(abs(gap)) as mce, "
       "sum(n)::bigint as n from " + _bins_sql("family", _UNI_EDGES) + " group by family", "ece mce")
def a17(t):
    return calib.calibration_error(calib.reliability(t.evt(), ["family"], "conf", OFF), ["family"])


@query("a20_degenerate_groups", f"""with {DOC} select task, count(*) as n, bool_and(correct_off) as value from doc group by task
 having bool_and(correct_off) = bool_or(correct_off)""")
def a20(t):
    return calib.degenerate_groups(t.doc(), "task", OFF)


@query("k07_worst_stratum", f"with {EVT}, a as (select task, family, u/nullif(p*n,0) as auroc from "
       + auroc_sql("evt", "task, family", "(not correct_off)", "-conf")
       + ") select task, arg_min(family, (auroc, family)) as worst_stratum, min(auroc) as worst_stratum_auroc from a where auroc is not null group by task", "worst_stratum_auroc")
def k07(t):
    d = t.evt().withColumn("y", ~F.col(OFF)).withColumn("s", -F.col("conf"))
    levels = rank.auroc(d, ["task", "family"], "y", "s").withColumnRenamed("family", "level")
    return compare.worst_stratum(levels, ["task"])


@query("k10_shuffled_prefix", f"""with {EVT}, r as (select event_id, row_number() over (order by {h32("concat('0:', cast(event_id as varchar))")}, event_id)
 as position from evt) select * from r where position <= 500""")
def k10(t):
    return splits.shuffled_prefix(t.evt(), 500, 0, "event_id").select("event_id", "position")
