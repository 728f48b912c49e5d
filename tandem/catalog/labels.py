"""Queries for targets, labels, reports and audits."""

from pyspark.sql import functions as F

from ..functions.rand import hash01
from ..operators import labels
from .base import DOC, EVT, GEN, RDO, h01, query

OFF, ON = "correct_off", "correct_on"


@query("p01_targets", f"""with {EVT} select 'helped' as target, event_id, (not correct_off and correct_on) as y from evt
 union all select 'needs_thinking', event_id, not correct_off from evt
 union all select 'rescued', event_id, correct_on from evt where not correct_off""")
def p01(t):
    one = lambda n: labels.target(t.evt(), n).select(F.lit(n).alias("target"), "event_id", "y")
    return one("helped").unionByName(one("needs_thinking")).unionByName(one("rescued"))


GRADED = """case when not correct_off and correct_on then 'helped' when correct_off and not correct_on then 'hurt'
 when correct_off then 'no_change_correct' else 'no_change_wrong' end"""


@query("p02_graded_label", f"with {EVT} select event_id, {GRADED} as graded_label from evt")
def p02(t):
    return t.evt().select("event_id", labels.graded_label().alias("graded_label"))


@query("p03_label_rows", f"""with {DOC} select sample_id, case when not correct_off and correct_on then 'helped' else 'not_helped' end as label,
 {GRADED} as graded_label, correct_off, correct_on, difficulty, false as truncated_on, n_tokens_off,
 null::boolean as correct_off_stored from doc""")
def p03(t):
    return labels.label_rows(t.doc()).select(
        "sample_id", "label", "graded_label", OFF, ON, "difficulty", "truncated_on", "n_tokens_off", "correct_off_stored")


@query("p05_drop_truncated", f"""with {EVT} select family, count(*) as kept, (select count(*) from evt) - (select count(*) from evt where not truncated_on)
 as dropped_in_all from evt where not truncated_on group by family""")
def p05(t):
    e = t.evt()
    dropped = e.agg(F.count_if(F.col("truncated_on")).alias("dropped_in_all"))
    return labels.drop_truncated(e).groupBy("family").agg(F.count(F.lit(1)).alias("kept")).crossJoin(dropped)


@query("p06_task_name", """with d as (select doc_id, case when doc_id % 3 = 0 then source end as task,
 concat('/x/', case doc_id % 4 when 0 then 'mmlupro' when 1 then 'gsm8k_full' when 2 then 'lsat_long' else 'bbh' end, '_thinking_m') as folder
 from documents) select doc_id, coalesce(task, case doc_id % 4 when 0 then 'mmlu_pro' when 1 then 'gsm8k' when 2 then 'lsat' else 'bbh' end) as task from d""")
def p06(t):
    m = F.col("doc_id") % 4
    prefix = F.when(m == 0, "mmlupro").when(m == 1, "gsm8k_full").when(m == 2, "lsat_long").otherwise("bbh")
    return t.documents.select("doc_id", labels.resolve_task(
        F.when(F.col("doc_id") % 3 == 0, F.col("source")), F.concat(F.lit("/x/"), prefix, F.lit("_thinking_m"))).alias("task"))


@query("p07_group_key", f"""with {EVT} select event_id, family as strict, case when event_id % 2 = 0 then family else 'plain' end as lenient from evt""")
def p07(t):
    e = t.evt()
    strict = e.select("event_id", labels.group_key(e, labels.SAMPLE_ID_MIDDLE).alias("strict"))
    mixed = e.withColumn("sample_id", F.when(F.col("event_id") % 2 == 0, F.col("sample_id")).otherwise("plain"))
    return strict.join(mixed.select(
        "event_id", labels.group_key(mixed, labels.SAMPLE_ID_MIDDLE, strict=False).alias("lenient")), "event_id")


@query("p18_size_gates", f"""with {EVT} select 'needs_thinking' as target, count(*) as n, count(*) filter (where not correct_off) as pos from evt
 union all select 'rescued', count(*), count(*) filter (where correct_on) from evt where not correct_off""")
def p18(t):
    """The figures the gates read; ``labels.require_enough`` refuses on them."""
    e = t.evt()
    labels.require_enough(e, "rescued")
    labels.require_enough(e, "needs_thinking")
    one = lambda n: labels.target(e, n).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("y").alias("pos")).select(F.lit(n).alias("target"), "n", "pos")
    return one("needs_thinking").unionByName(one("rescued"))


@query("p19_regroup", f"""with {EVT} select family as difficulty, count(*) as n, avg((not correct_off and correct_on)::int::double) as base_rate_helped,
 avg(correct_off::int::double) as accuracy_off, avg(correct_on::int::double) as accuracy_on from evt group by family""",
       "base_rate_helped accuracy_off accuracy_on")
def p19(t):
    e = t.evt()
    rows = labels.label_rows(e.withColumn("difficulty", F.lit(None).cast("string")))
    return labels.label_report_by(labels.regroup(rows, labels.group_key(rows, labels.SAMPLE_ID_MIDDLE)), ["difficulty"])


_REPORT = f"""count(*) as n, avg((not correct_off and correct_on)::int::double) as base_rate_helped,
 avg(correct_off::int::double) as accuracy_off, avg(correct_on::int::double) as accuracy_on,
 avg((correct_off or correct_on)::int::double) as oracle_accuracy"""


@query("a01_label_report", f"""with {EVT}, g as (select *, {GRADED} as g from evt) select {_REPORT},
 count(*) filter (where truncated_on) as truncated_on, count(*) filter (where truncated_off) as truncated_off,
 count(*) filter (where g = 'helped') as n_helped, count(*) filter (where g = 'hurt') as n_hurt,
 count(*) filter (where g = 'no_change_correct') as n_no_change_correct, count(*) filter (where g = 'no_change_wrong') as n_no_change_wrong,
 null::double as stored_accuracy_off, null::double as stored_accuracy_on, 0::bigint as unclosed_think_on from g""",
       "base_rate_helped accuracy_off accuracy_on oracle_accuracy")
def a01(t):
    return labels.label_report(labels.label_rows(t.evt()))


@query("a02_report_by_difficulty", f"""with {DOC} select case when grouping(difficulty) = 1 then 'overall' else 'group' end as level, difficulty, {_REPORT}
 from doc group by grouping sets ((), (difficulty))""", "base_rate_helped accuracy_off accuracy_on oracle_accuracy")
def a02(t):
    return labels.label_report_levels(labels.label_rows(t.doc()))


_STORED = f"""stored as (select *, {h01("concat(cast(event_id as varchar), ':so')")} < 0.5::double as so,
 {h01("concat(cast(event_id as varchar), ':sn')")} < 0.7::double as sn from evt)"""


def _regraded(t):
    key = F.col("event_id").cast("string")
    e = t.evt().withColumn("correct_off_stored", hash01(F.concat(key, F.lit(":so"))) < 0.5).withColumn(
        "correct_on_stored", hash01(F.concat(key, F.lit(":sn"))) < 0.7)
    rows = labels.label_rows(e, "g:1")
    return rows.withColumn("family", labels.group_key(rows, labels.SAMPLE_ID_MIDDLE))


@query("a03_regrade_flips", f"""with {EVT}, {_STORED} select count(*) filter (where not so and correct_off) as off_false_to_true,
 count(*) filter (where so and not correct_off) as off_true_to_false, count(*) filter (where not sn and correct_on) as on_false_to_true,
 count(*) filter (where sn and not correct_on) as on_true_to_false, count(*) filter (where so <> correct_off or sn <> correct_on) as rows_changed,
 count(*) filter (where (not so and sn) <> (not correct_off and correct_on)) as label_changed from stored""")
def a03(t):
    return labels.regrade_flips(_regraded(t))


@query("a33_regrade_comparison", f"""with {EVT}, {_STORED}, b as (select family, 'stored' as grading, so as o, sn as n from stored
 union all select family, 'regraded', correct_off, correct_on from stored) select family, grading, count(*) as rows,
 avg(o::int::double) as accuracy_off, avg(n::int::double) as accuracy_on, avg((not o and n)::int::double) as helped,
 avg((o and not n)::int::double) as hurt from b group by family, grading""", "accuracy_off accuracy_on helped hurt")
def a33(t):
    return labels.regrade_comparison(_regraded(t), ["family"])


@query("a04_shard_summary", f"""with {EVT} select shard, count(*) as n_samples, round(avg(correct_off::int::double), 4) as accuracy_off,
 round(avg(correct_on::int::double), 4) as accuracy_on, round(avg(truncated_off::int::double), 4) as off_truncation_rate,
 round(avg(truncated_on::int::double), 4) as on_truncation_rate, round(avg((event_id % 3 <> 0)::int::double), 4) as has_reasoning_on_rate,
 count(*) filter (where event_id % 41 = 0) as unclosed_think_on, 0::bigint as prompt_truncated,
 count(*) filter (where not correct_off and correct_on) as helped, count(*) filter (where correct_off and not correct_on) as hurt
 from evt group by shard""", "accuracy_off accuracy_on off_truncation_rate on_truncation_rate has_reasoning_on_rate")
def a04(t):
    e = t.evt().withColumns({
        "has_reasoning_on": F.col("event_id") % 3 != 0, "unclosed_think_on": F.col("event_id") % 41 == 0,
        "prompt_truncated": F.lit(False)})
    return labels.shard_summary(e)


@query("s13_quarantine", f"""with {EVT}, x as (select *, truncated_off or (shard = 3 and event_id % 16 = 3) as cut from evt),
 r as (select shard, avg(cut::int::double) as rate, count(*) filter (where cut) as k from x group by shard)
 select x.shard, max(rate) > 0.2 as quarantined, count(*) as n, round(max(rate), 4) as rate from x join r on x.shard = r.shard group by x.shard""", "rate")
def s13(t):
    e = t.evt().withColumn("truncated_off", F.col("truncated_off") | ((F.col("shard") == 3) & (F.col("event_id") % 16 == 3)))
    kept, aside, _ = labels.quarantine(e)
    rows = kept.withColumn("quarantined", F.lit(False)).unionByName(aside.withColumn("quarantined", F.lit(True)))
    return rows.groupBy("shard", "quarantined").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("truncated_off").cast("double")), 4).alias("rate"))


@query("p16_integrity_flags", """with c as (select *, case when conv_id % 5 <> 0 then 'format_prompt' end as src, length(text) as plen,
 case when turn % 4 <> 3 then length(text) // 4 end as ntok, length(text) + (conv_id % 2) as plen2, length(text) // 4 + (conv_id % 7) - 3 as ntok2
 from conversations) select conv_id, turn, case when src is not null then ntok2 - ntok end as token_delta,
 array_to_string(list_filter([case when src is null then 'prompt_hash_mismatch' end, case when src is not null and plen2 <> plen then 'prompt_len_mismatch' end,
 case when src is not null and abs(ntok2 - ntok) > 2 then 'token_count_mismatch' end], lambda x: x is not null), ',') as flags from c""")
def p16(t):
    size = F.length("text")
    c = t.conversations.select(
        "conv_id", "turn", F.when(F.col("conv_id") % 5 != 0, "format_prompt").alias("prompt_source"),
        size.alias("prompt_len_off"), F.when(F.col("turn") % 4 != 3, F.floor(size / 4)).alias("n_tokens_off"),
        (size + F.col("conv_id") % 2).alias("prompt_len_rescored"),
        (F.floor(size / 4) + F.col("conv_id") % 7 - 3).alias("n_tokens_rescored"))
    return labels.integrity(c).select("conv_id", "turn", "token_delta", F.array_join("flags", ",").alias("flags"))


@query("a21_flag_histogram", f"with {RDO} select flag, count(*) as count from (select unnest(flags) as flag from rdo) group by flag")
def a21(t):
    return labels.flag_histogram(t.rdo())


@query("a22_value_counts", """with c as (select (event_id % 9 - 4)::varchar as token_delta, case when event_id % 6 = 0 then null else 'format_prompt' end as prompt_source from events)
 select 'token_delta' as field, token_delta as value, count(*) as count from c group by all union all
 select 'prompt_source', prompt_source, count(*) from c group by all""")
def a22(t):
    c = t.events.select((F.col("event_id") % 9 - 4).alias("token_delta"),
                        F.when(F.col("event_id") % 6 != 0, "format_prompt").alias("prompt_source"))
    return labels.value_counts(c, ["token_delta", "prompt_source"])


@query("a26_version_counts", "select case when event_id % 4 = 0 then '1' else '2' end as version, count(*) as count from events group by 1")
def a26(t):
    return labels.version_counts(t.events.select(F.when(F.col("event_id") % 4 != 0, 2).alias("confidence_version")))


@query("a23_task_gaps", f"""with {EVT} select task, count(*) as n, avg(correct_off::int::double) as acc_off, avg(correct_on::int::double) as acc_on,
 avg((correct_on::int - correct_off::int)::double) as gap_on_minus_off, avg((correct_on and not correct_off)::int::double) as helped,
 avg((correct_off and not correct_on)::int::double) as hurt from evt group by task""", "acc_off acc_on gap_on_minus_off helped hurt")
def a23(t):
    return labels.gap_summary(t.evt(), ["task"], OFF, ON)


@query("a27_coverage_summary", f"""with {RDO} select task, count(*) as n_rows, count(*) filter (where covered) as n_covered, avg(covered::int::double) as coverage,
 avg(s1_correct::int::double) filter (where covered) as s1_accuracy, avg(p_max) filter (where covered) as mean_p_max,
 avg(option_mass) filter (where covered) as mean_option_mass, min(option_mass) filter (where covered) as min_option_mass from rdo group by task""",
       "coverage s1_accuracy mean_p_max mean_option_mass min_option_mass")
def a27(t):
    return labels.coverage_summary(t.rdo())


@query("a27_coverage_by_family", f"with {RDO} select task, family, avg(s1_correct::int::double) as s1_accuracy, count(*) as n from rdo where covered group by all", "s1_accuracy")
def a27_family(t):
    return labels.coverage_by_family(t.rdo())


@query("a27_exclude_reasons", f"with {RDO} select task, exclude_reason, count(*) as count from rdo where not covered group by all")
def a27_reasons(t):
    return labels.exclude_reasons(t.rdo())


@query("a28_trace_audit", f"""with {GEN} select conv_id % 5 as task, count(*) as n, count(*) filter (where contains(response_on, '<think>')) as with_think,
 count(*) filter (where not contains(response_on, '<think>')) as without_think, count(*) filter (where response_on = response_off) as identical,
 quantile_cont(length(response_on), 0.5) as median_n_tokens_on from gen group by 1""", "median_n_tokens_on")
def a28(t):
    g = t.gen().withColumn("task", F.col("conv_id") % 5).withColumn("n_tokens_on", F.length("response_on"))
    return labels.trace_audit(g, ["task"])


@query("a29_caveats", f"""with {RDO} select task, count(*) as n_rows, count(*) filter (where covered) as n_covered, round(avg(covered::int::double), 3) as coverage,
 round(100*avg(truncated_on::int::double) filter (where covered), 1) as think_truncated_pct, round(100*avg(unclosed_think_on::int::double) filter (where covered), 1) as think_unclosed_pct,
 round(100*avg(truncated_off::int::double) filter (where covered), 1) as nothink_truncated_pct, round(avg(option_mass) filter (where covered), 3) as mean_option_mass,
 round(min(option_mass) filter (where covered), 3) as min_option_mass, array_to_string(list_sort(list(distinct grader_version) filter (where covered)), ',') as graders
 from rdo group by task""", "coverage think_truncated_pct think_unclosed_pct nothink_truncated_pct mean_option_mass min_option_mass")
def a29(t):
    return labels.caveats(t.rdo(), ["task"])


@query("a30_first_correct_tier", f"""with {RDO} select task, avg(s1_correct::int::double) as s1, avg((not s1_correct and correct_off)::int::double) as no_think,
 avg((not s1_correct and not correct_off and correct_on)::int::double) as think,
 avg((not s1_correct and not correct_off and not correct_on)::int::double) as none_right from rdo where covered group by task""", "s1 no_think think none_right")
def a30(t):
    return labels.first_correct_tier(t.rdo().where("covered"), ["task"], "s1_correct", OFF, ON)


@query("a35_truncation_accuracy", f"""with {EVT} select family, avg(truncated_off::int::double) as truncation_rate,
 avg(correct_off::int::double) filter (where truncated_off) as accuracy_truncated, avg(correct_off::int::double) filter (where not truncated_off) as accuracy_complete
 from evt group by family""", "truncation_rate accuracy_truncated accuracy_complete")
def a35(t):
    return labels.truncation_accuracy(t.evt(), ["family"])


@query("p14_readout_subsets", f"""with {RDO}, s as (select unnest(list_filter([task, case when task = 'bbh' then concat('bbh/', case when kind = 'letter' then 'lettered' else 'binary' end) end, 'pooled'], lambda x: x is not null)) as set,
 family, task, s1_correct from rdo where covered) select set, case when set = 'pooled' then concat(task, ':', family) else family end as family, count(*) as n,
 avg(s1_correct::int::double) as s1 from s group by all""", "s1")
def p14(t):
    from ..plans.tiers import in_sets

    return in_sets(t.rdo().where("covered")).groupBy("set", "family").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("s1_correct").cast("double")).alias("s1"))
