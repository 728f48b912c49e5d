"""Queries for joins, set operations, grids and diffs."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import joins, labels, rank
from ..plans import compare
from .base import DOC, EVT, RDO, auroc_sql, query

OFF, ON = "correct_off", "correct_on"


@query("j01_align_labels", f"""with {DOC} select l.sample_id, l.correct_off, l.correct_on, d.source as meta_source, d.n_chars as n_chars
 from doc l join documents d on l.doc_id = d.doc_id""")
def j01(t):
    meta = t.documents.select(
        F.concat_ws("-", F.lit("doc"), "lang", F.col("doc_id").cast("string")).alias("sample_id"),
        F.col("source").alias("meta_source"), "n_chars")
    got = joins.align_labels(labels.label_rows(t.doc()), meta)
    return got.select("sample_id", OFF, ON, "meta_source", "n_chars")


def _meta(t):
    conf = F.struct((-F.col("conf")).alias("mean_logprob"), (-2 * F.col("conf")).alias("min_logprob"), F.col("conf").alias("mean_entropy"))
    return t.evt().select("event_id", "sample_id", "family", OFF, ON, "n_tokens_off", conf.alias("confidence_off"),
                          F.lit(None).cast("int").alias("confidence_version"))


def _sidecar(t):
    c = F.col("conf") * 0.5
    conf = F.struct((-c).alias("mean_logprob"), (-2 * c).alias("min_logprob"), c.alias("mean_entropy"))
    return t.evt().select("sample_id", conf.alias("confidence_off"), F.lit(2).alias("confidence_version"),
                          F.array().cast("array<string>").alias("flags"))


@query("j02_resolve_confidence", f"""with {EVT} select event_id, 'auto' as asked, -0.5*conf as mean_logprob, 2::bigint as version, 'sidecar' as source from evt
 union all select event_id, 'stored', -conf, 1, 'stored' from evt""", "mean_logprob")
def j02(t):
    def one(source):
        got = joins.resolve_confidence(_meta(t), _sidecar(t), source)
        return got.select("event_id", F.lit(source).alias("asked"), F.col("confidence_off.mean_logprob").alias("mean_logprob"),
                          F.col("confidence_version").alias("version"), F.col("confidence_source").alias("source"))

    return one("auto").unionByName(one("stored"))


def _labels_of(t):
    return t.rdo().select("sample_id", OFF, ON, "n_tokens_off", "n_tokens_on", "truncated_off", "truncated_on", "unclosed_think_on", "grader_version")


@query("j03_readout_labels", f"""with {RDO} select sample_id, family, s1_correct, correct_off, n_tokens_on from rdo where covered""")
def j03(t):
    out = t.rdo().where("covered")
    readout = out.select("sample_id", F.when(F.col("event_id") % 2 == 0, F.col("family")).alias("family"), "s1_correct")
    got = joins.readout_labels(readout, _labels_of(t), out.select("sample_id", "family"))
    return got.select("sample_id", "family", "s1_correct", OFF, "n_tokens_on")


@query("j04_rejoin_dimension", """select l_orderkey, l_linenumber, replace(p_type, ' ', '_') as strict, case when p_size > 25 then p_type end as lenient
 from lineitem join part on l_partkey = p_partkey""", big="l_linenumber")
def j04(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    part = t.part.select("p_partkey", "p_type", "p_size")
    got = joins.rejoin_dimension(rows, part, "p_partkey", "p_type", out="strict")
    got = joins.rejoin_dimension(got, part.where("p_size > 25"), "p_partkey", "p_type", strict=False, out="lenient")
    return got.drop("p_partkey")


def _preds(t, score):
    return t.evt().select("sample_id", (F.col("event_id") % 3).alias("seed"), (~F.col(OFF)).cast("int").alias("y"), F.col(score).alias("score"), "event_id")


@query("j05_pair_predictions", f"""with {EVT} select event_id % 3 as seed, count(*) as n, event_id % 3 <> 2 as valid, sum(score_a - score_b) as diff from evt
 where event_id <> 5 group by 1, 3 union all select 2, 1, false, null from evt where event_id = 5""", "diff")
def j05(t):
    """Seed 2 misses one row on one side, so its pairs are invalid."""
    a, b = _preds(t, "score_a"), _preds(t, "score_b").where("event_id <> 5")
    got = joins.pair_predictions(a, b, ["sample_id"], ["seed"])
    return got.withColumn("lost", F.col("score_b").isNull()).groupBy("seed", "valid", "lost").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("score_a") - F.col("score_b")).alias("diff")).drop("lost")


@query("j06_hash_candidates", """select item_id, case when item_id % 3 = 0 then null when item_id % 3 = 1 then 'format_prompt' else 'PROMPT_TEMPLATE_V1' end as prompt_source,
 case when item_id % 3 = 0 then 'prompt_hash_mismatch' else '' end as flags from benchmark""")
def j06(t):
    q = F.col("text")
    cands = text.prompt_templates("bbh", q)
    stored = F.when(F.col("item_id") % 3 == 0, F.sha2(q, 256)).when(
        F.col("item_id") % 3 == 1, F.sha2(cands[0][1], 256)).otherwise(F.sha2(cands[1][1], 256))
    got = joins.match_templates(t.benchmark.withColumn("prompt_hash", stored), cands)
    return got.select("item_id", "prompt_source", F.array_join("flags", ",").alias("flags"))


_KINDS = f"""k as (select family as task, task as target, 'text' as kind, 'length' as name, u/nullif(p*n,0) as mean from {auroc_sql('evt', 'family, task', '(not correct_off)', 'score_a')} where task <> 't3'
 union all select family, task, 'confidence', 'conf', u/nullif(p*n,0) from {auroc_sql('evt', 'family, task', '(not correct_off)', '-conf')} where task <> 't2')"""


@query("j07_attach_baselines", f"""with {EVT}, {_KINDS}, p as (select family as task, task as target, count(*) as n from evt group by all)
 select p.task, p.target, n, max(name) filter (where kind = 'text') as text_name, max(mean) filter (where kind = 'text') as text_mean,
 max(name) filter (where kind = 'confidence') as confidence_name, max(mean) filter (where kind = 'confidence') as confidence_mean
 from p left join k on p.task = k.task and p.target = k.target group by all""", "text_mean confidence_mean")
def j07(t):
    e = t.evt().withColumn("y", ~F.col(OFF)).withColumn("neg", -F.col("conf"))

    def kind(name, base, score, without):
        got = rank.auroc(e.where(F.col("task") != without), ["family", "task"], "y", score)
        return got.select(F.col("family").alias("task"), F.col("task").alias("target"), F.lit(name).alias("kind"),
                          F.lit(base).alias("name"), F.col("auroc").alias("mean"))

    base = kind("text", "length", "score_a", "t3").unionByName(kind("confidence", "conf", "neg", "t2"))
    probes = e.groupBy(F.col("family").alias("task"), F.col("task").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    return joins.attach_baselines(probes, base, ["task", "target"], ["text", "confidence"])


def _old_new(t):
    e = t.evt()
    old = e.groupBy("task", "family").agg(F.avg("conf").alias("mean")).where("not (task = 't0' and family = 'click')")
    new = e.groupBy("task", "family").agg(
        F.avg(F.when((F.col("task") == "t2") & (F.col("family") == "view"), F.col("conf") * 2).otherwise(F.col("conf"))).alias("mean")
    ).where("not (task = 't1' and family = 'error')")
    return old, new


_OLD_NEW = """o as (select task, family, avg(conf) as mean from evt where not (task = 't0' and family = 'click') group by all),
 w as (select task, family, avg(case when task = 't2' and family = 'view' then conf*2 else conf end) as mean from evt where not (task = 't1' and family = 'error') group by all)"""
_STATUS = "case when o.task is null then 'added' when w.task is null then 'removed' when abs(o.mean - w.mean) <= 1e-9 then 'same' else 'changed' end"


@query("j09_before_after", f"""with {EVT}, {_OLD_NEW} select coalesce(o.task, w.task) as task, coalesce(o.family, w.family) as family, {_STATUS} as status,
 o.mean as mean_old, w.mean as mean_new from o full join w on o.task = w.task and o.family = w.family""", "mean_old mean_new")
def j09(t):
    old, new = _old_new(t)
    return joins.diff_tables(old, new, ["task", "family"], ["mean"])


@query("j13_promote", f"""with {EVT}, {_OLD_NEW} select coalesce(o.task, w.task) as task, coalesce(o.family, w.family) as family, {_STATUS} as status,
 case when w.task is null then o.mean else w.mean end as mean from o full join w on o.task = w.task and o.family = w.family""", "mean")
def j13(t):
    old, new = _old_new(t)
    return joins.promote(old, new, ["task", "family"], ["mean"], force=True)


@query("j10_ordered_pairs", f"""with {EVT}, n as (select distinct family, task from evt) select a.family as objective, a.task as source, b.task as target
 from n a join n b on a.family = b.family and a.task <> b.task""")
def j10(t):
    names = t.evt().select(F.col("family").alias("objective"), "task").distinct()
    return joins.ordered_pairs(names, "task", ["objective"])


@query("j11_parameter_grid", f"""with {EVT}, g as (select seed, task, split from (values (1), (2)) s(seed), (values ('t0', 'test'), ('t1', 'test'), ('t2', 'val')) z(task, split)
 where not (task = 't1' and seed = 2)) select g.seed, g.task, g.split, count(*) as n from evt e join g on e.task = g.task and e.event_id % 2 + 1 = g.seed group by all""", big="seed")
def j11(t):
    """A grid of (seed) x lockstep (task, split) minus an exclusion, run against the rows."""
    grid = joins.parameter_grid(t.spark, {"seed": [1, 2]}, {"task": ["t0", "t1", "t2"], "split": ["test", "test", "val"]},
                                [{"task": "t1", "seed": 2}])
    e = t.evt().withColumn("seed", (F.col("event_id") % 2 + 1).cast("int"))
    return e.join(grid, ["task", "seed"]).groupBy("seed", "task", "split").agg(F.count(F.lit(1)).alias("n"))


@query("j14_scorer_inputs", f"""with {EVT}, s as (select 'even' as task, * exclude (task) from evt where event_id % 2 = 0 union all select 'odd', * exclude (task) from evt where event_id % 2 = 1)
 select task, event_id, correct_on as y, -0.5*conf as mean_logprob from s where not correct_off""", "mean_logprob")
def j14(t):
    parts = {}
    for task, rest in (("even", 0), ("odd", 1)):
        meta = _meta(t).where(F.col("event_id") % 2 == rest)
        ids = meta.select("sample_id")
        lab = labels.label_rows(meta).select("sample_id", OFF, ON)
        parts[task] = (lab, meta, _sidecar(t).join(ids, "sample_id", "left_semi"))
    return joins.scorer_inputs(parts, "rescued").select("task", "event_id", "y", F.col("confidence_off.mean_logprob").alias("mean_logprob"))


@query("u01_pool", f"""with {EVT} select task as pool_task, event_id, concat(task, ':', family) as family from evt""")
def u01(t):
    e = t.evt()
    parts = {k: e.where(F.col("task") == k).withColumn("vec", F.array("conf", "score_a")) for k in ("t0", "t1", "t2", "t3")}
    return joins.pool(parts, vector="vec", group="family").select("pool_task", "event_id", "family")


@query("u02_complement_fold", f"""with {EVT} select f as held, count(*) as n, sum(score_a) as total from evt, range(5) r(f) where event_id % 5 <> f group by f""", "total")
def u02(t):
    e = t.evt().withColumn("fold", F.col("event_id") % 5)
    parts = [joins.complement(e, "fold", k).agg(F.count(F.lit(1)).alias("n"), F.sum("score_a").alias("total"))
             .select(F.lit(k).alias("held"), "n", "total") for k in range(5)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("u03_distinct_candidates", f"""with {EVT} select distinct family, c as candidate from (select family, score_b as c from evt union all
 select family, 0.0 from evt union all select family, 1.0 from evt union all select family, 0.5 from evt)""", "candidate")
def u03(t):
    return joins.distinct_candidates(t.evt(), ["family"], "score_b", [0.0, 1.0, 0.5])


@query("u04_id_set_equality", f"""with {EVT} select count(*) filter (where b is null) as only_a, count(*) filter (where a is null) as only_b,
 count(*) filter (where b is null or a is null) = 0 as equal from (select x.event_id as a, y.event_id as b from (select event_id from evt where event_id % 10 <> 3) x
 full join (select event_id from evt where event_id % 20 <> 4) y on x.event_id = y.event_id)""")
def u04(t):
    e = t.evt()
    return joins.same_ids(e.where("event_id % 10 <> 3"), e.where("event_id % 20 <> 4"), "event_id")


@query("s14_incomplete_shards", f"""with {EVT}, a as (select shard, count(*) as n_source from evt group by shard), b as (select shard, count(*) as n_derived from evt
 where shard <> 6 and not (shard = 2 and event_id % 16 = 2) group by shard) select a.shard, n_source, n_derived from a left join b on a.shard = b.shard
 where n_derived is null or n_derived <> n_source""")
def s14(t):
    e = t.evt()
    return joins.incomplete_shards(e, e.where("shard <> 6 and not (shard = 2 and event_id % 16 = 2)"))


@query("t11_template_substitution", """select doc_id, concat('runs/', source, '/', lang, '_', cast(doc_id as varchar), '.json') as path from documents""")
def t11(t):
    return t.documents.select("doc_id", joins.substitute("runs/{source}/{lang}_{doc_id}.json", ["source", "lang", "doc_id"]).alias("path"))


@query("t12_fingerprint", """select doc_id, sha256(concat('{"doc_id":', doc_id, ',', case when doc_id % 3 = 0 then '' else concat('"lang":"', lang, '",') end, '"source":"', source, '"}')) as print,
 concat('run__doc_id-', doc_id, '_source-', source) as id from documents""")
def t12(t):
    d = t.documents.withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    return d.select("doc_id", joins.fingerprint(["source", "lang", "doc_id"]).alias("print"),
                    joins.default_id("run", ["source", "doc_id"]).alias("id"))


_BASE = f"""base as (select family, s as name, auc as test_auroc, val as val_auroc, kind from (
 select family, 'a' as s, u/nullif(p*n,0) as auc, u/nullif(p*n,0) - 0.01::double as val, 'text' as kind from {auroc_sql('evt', 'family', '(not correct_off)', 'score_a')}
 union all select family, 'b', u/nullif(p*n,0), u/nullif(p*n,0) + 0.02::double, 'text' from {auroc_sql('evt', 'family', '(not correct_off)', 'score_b')}
 union all select family, 'c', u/nullif(p*n,0), case when family = 'view' then null else u/nullif(p*n,0) end, 'confidence' from {auroc_sql('evt', 'family', '(not correct_off)', '-conf')}))"""


def _baselines(t):
    e = t.evt().withColumn("y", ~F.col(OFF)).withColumn("neg", -F.col("conf"))

    def one(name, score, shift, kind):
        got = rank.auroc(e, ["family"], "y", score)
        val = F.col("auroc") + shift
        if name == "c":
            val = F.when(F.col("family") != "view", val)
        return got.select("family", F.lit(name).alias("name"), F.col("auroc").alias("test_auroc"), val.alias("val_auroc"), F.lit(kind).alias("kind"))

    return one("a", "score_a", -0.01, "text").unionByName(one("b", "score_b", 0.02, "text")).unionByName(one("c", "neg", 0.0, "confidence"))


_BEST = """best as (select * from (select *, case when ok then 'val' else 'test' end as selected_on, row_number() over (partition by {by} order by
 case when ok then val_auroc else test_auroc end desc nulls last, name) as rn from (select *, bool_and(val_auroc is not null) over (partition by {by}) as ok from base)) where rn = 1)"""


@query("k02_best_baseline", f"with {EVT}, {_BASE}, {_BEST.format(by='family')} select family, name, test_auroc, val_auroc, selected_on from best", "test_auroc val_auroc")
def k02(t):
    return compare.best_baseline(_baselines(t), ["family"]).select("family", "name", "test_auroc", "val_auroc", "selected_on")


@query("k03_best_overall", f"""with {EVT}, {_BASE}, {_BEST.format(by='family, kind')} select family, kind, name, val_auroc from (select *, row_number() over (partition by family
 order by val_auroc desc, kind desc) as r2, bool_and(selected_on = 'val') over (partition by family) as okall from best) where okall and r2 = 1""", "val_auroc")
def k03(t):
    best = compare.best_baseline(_baselines(t), ["family", "kind"])
    return compare.best_overall(best, ["family"]).select("family", "kind", "name", "val_auroc")


