"""Queries that write the views as files and read them back.

Files go to the cluster's shared checkpoint folder, a new folder per run.
"""

import uuid

from pyspark.sql import functions as F

from .. import schemas
from ..operators import labels, rank
from ..plans import compare
from ..session import scratch
from ..sources import captures, sinks
from .base import ACT, EVT, RDO, auroc_sql, query
from .labels import GRADED

OFF, ON = "correct_off", "correct_on"


def folder(t, name: str) -> str:
    return f"{scratch(t.spark)}/{name}-{uuid.uuid4().hex}"


def _meta(t):
    """Events as META rows, numbered inside their shard."""
    e = t.evt()
    return e.select(
        "sample_id", F.floor(F.col("event_id") / 8).alias("dataset_index"), F.col("event_id").alias("dataset_index_global"),
        F.col("family").alias("category"), OFF, ON, "truncated_off", "truncated_on", "n_tokens_off", "n_tokens_on",
        F.struct((-F.col("conf")).alias("mean_logprob"), (-2 * F.col("conf")).alias("min_logprob"), F.col("conf").alias("mean_entropy")).alias("confidence_off"),
        F.col("shard").cast("int").alias("shard"))


@query("s01_meta_shards", f"with {EVT} select sample_id, shard::bigint as shard, event_id // 8 as dataset_index, correct_off, correct_on, n_tokens_on, -conf as mean_logprob from evt where shard <> 5", "mean_logprob")
def s01(t):
    """Shards written and read back; the quarantined shard 5 is not matched."""
    path = folder(t, "capture")
    meta = _meta(t).withColumn("truncated_off", F.col("shard") == 5)
    sinks.write_capture(meta, path)
    return captures.read_meta(t.spark, path).select(
        "sample_id", "shard", "dataset_index", OFF, ON, "n_tokens_on", F.col("confidence_off.mean_logprob").alias("mean_logprob"))


def _vectors(t):
    """Vectors of 4 layers x 16, a hundred rows per shard."""
    return t.embeddings.select(
        (F.col("vec_id") / 100).cast("int").alias("shard"), (F.col("vec_id") % 100).alias("row_pos"),
        F.col("embedding").alias("vec"))


@query("s02_vector_shards", f"with {ACT} select vec_id // 100 as shard, vec_id % 100 as row_pos, layer, 16::bigint as width, round(sum(v), 6) as total from (select vec_id, layer, unnest(vec)::double as v from act) group by all", "total")
def s02(t):
    """Vector archives written and read, one task per shard."""
    path = folder(t, "vectors")
    sinks.write_vectors(_vectors(t), path, "off", layers=4)
    got = captures.read_vectors(t.spark, path)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return got.select("shard", "row_pos", "layer", F.size("vec").alias("width"), F.round(total, 6).alias("total"))


@query("s03_aligned_capture", f"with {ACT} select concat('vec-x-', vec_id) as sample_id, layer::bigint as layer, label = 3 as correct_off from act")
def s03(t):
    path = folder(t, "aligned")
    sinks.write_vectors(_vectors(t), path, "off", layers=4)
    meta = t.embeddings.select(
        F.concat(F.lit("vec-x-"), F.col("vec_id").cast("string")).alias("sample_id"), (F.col("vec_id") % 100).alias("dataset_index"),
        (F.col("label") == 3).alias(OFF), (F.col("vec_id") / 100).cast("int").alias("shard"))
    sinks.write_shards(meta, path, "meta")
    return captures.read_capture(t.spark, path).select("sample_id", "layer", OFF)


@query("s04_config_override", f"with {EVT} select shard::bigint as shard, case when shard % 2 = 0 then concat('m', shard) else 'base' end as model_name, 'global' as task from (select distinct shard from evt)")
def s04(t):
    """Even shards have their own config; its missing fields come from the global one."""
    path = folder(t, "config")
    shards = t.evt().select(F.col("shard").cast("int").alias("shard")).distinct()
    t.spark.range(1).select(F.lit("base").alias("model_name"), F.lit("global").alias("task")).coalesce(1).write.json(f"{path}/config.json")
    own = shards.where("shard % 2 = 0").withColumn("model_name", F.concat(F.lit("m"), F.col("shard").cast("string")))
    sinks.write_shards(own, path, "config", suffix="json")
    return captures.read_config(t.spark, path, shards, "model_name string, task string")


@query("s05_s06_labels", f"with {EVT} select sample_id, {GRADED} as graded_label, truncated_on, n_tokens_off, 'g:1' as grader_version from evt")
def s05(t):
    path = f"{folder(t, 'labels')}/evt_labels.jsonl"
    sinks.write_labels(labels.label_rows(t.evt(), "g:1"), path)
    return captures.read_labels(t.spark, path).select("sample_id", "graded_label", "truncated_on", "n_tokens_off", "grader_version")


@query("s06_summary", f"with {EVT} select count(*) as n, avg((not correct_off and correct_on)::int::double) as base_rate_helped, avg(correct_on::int::double) as accuracy_on from evt", "base_rate_helped accuracy_on")
def s06(t):
    path = f"{folder(t, 'labels')}/evt_labels.jsonl"
    sinks.write_labels(labels.label_rows(t.evt()), path)
    return t.spark.read.schema("n bigint, base_rate_helped double, accuracy_on double").json(path.removesuffix(".jsonl") + ".summary.json")


@query("s07_sidecar", f"with {EVT} select sample_id, shard::bigint as shard, -0.5*conf as mean_logprob, 2::bigint as confidence_version from evt", "mean_logprob")
def s07(t):
    path = folder(t, "sidecar")
    side = t.evt().select(
        "sample_id", F.struct((-0.5 * F.col("conf")).alias("mean_logprob")).alias("confidence_off"), F.lit(2).alias("confidence_version"),
        F.array().cast("array<string>").alias("flags"), F.col("shard").cast("int").alias("shard"))
    sinks.write_shards(side, path, captures.SIDECAR_STEM)
    got = captures.read_sidecar(t.spark, path)
    return got.select("sample_id", "shard", F.col("confidence_off.mean_logprob").alias("mean_logprob"), "confidence_version")


@query("s08_readout", f"with {RDO} select sample_id, covered, exclude_reason, case when covered then p_max end as p_max from rdo", "p_max")
def s08(t):
    path = folder(t, "readout")
    t.rdo().select("sample_id", "task", "family", "kind", "covered", "exclude_reason", "n_options", "p_max", "option_mass", "s1_correct").write.json(f"{path}/readout.jsonl")
    inside, outside = captures.read_readout(t.spark, path)
    return inside.select("sample_id", "covered", "exclude_reason", "p_max").unionByName(
        outside.select("sample_id", "covered", "exclude_reason", F.lit(None).cast("double").alias("p_max")))


def _mean(c):
    return F.struct(c.alias("mean"))


def _metric_docs(t, path: str) -> None:
    """One metric document per (family, task), as shards ``family__task.shardNN.json`` would be: here one folder each."""
    e = t.evt().withColumn("y", ~F.col(OFF)).withColumn("neg", -F.col("conf"))
    keys = ["family", "task"]
    point = rank.auroc(e, keys, "y", "neg")
    base = e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(OFF).cast("double")).alias("never"), F.avg(F.col(ON).cast("double")).alias("always"),
        F.avg((F.col(OFF) | F.col(ON)).cast("double")).alias("oracle"), F.avg((~F.col(OFF) & F.col(ON)).cast("double")).alias("rate"))
    level = rank.auroc(e.withColumn("level", F.concat(F.lit("s"), (F.col("shard") % 3).cast("string"))), keys + ["level"], "y", "neg")
    levels = level.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("level", _mean(F.col("auroc"))))).alias("levels"))
    both = base.join(point, keys).join(levels, keys)
    ci = F.when(F.col("task") != "t3", F.struct(F.array(F.col("auroc") - 0.1, F.col("auroc") + 0.1).alias("ci")))
    doc = both.select(
        F.concat_ws("__", "family", "task").alias("run"), F.when(F.col("task") != "t1", F.col("family")).alias("task"),
        F.lit("needs_thinking").alias("target"), F.col("n").alias("n_samples"), F.col("rate").alias("base_rate_helped"),
        F.struct(
            _mean(F.col("auroc")).alias("test_auroc"), ci.alias("test_auroc_bootstrap"), F.col("levels").alias("test_auroc_by_difficulty"),
            _mean(F.col("never")).alias("baseline_never_think"), _mean(F.col("always")).alias("baseline_always_think"), _mean(F.col("oracle")).alias("oracle"),
            _mean(F.col("always")).alias("test_routed_accuracy"), _mean(F.lit(0.75)).alias("min_routed_for_always_think_accuracy")).alias("aggregate"))
    doc.write.partitionBy("run").json(f"{path}/_docs")
    jvm, conf = t.spark.sparkContext._jvm, t.spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/_docs")
    fs = root.getFileSystem(conf)
    for entry in fs.listStatus(root):
        name = entry.getPath().getName()
        if name.startswith("run="):
            fs.rename(entry.getPath(), jvm.org.apache.hadoop.fs.Path(f"{path}/{name[4:]}.json"))


_LEVELS = f"""lv as (select *, concat('s', shard % 3) as level from evt), la as (select family, task, level, u/nullif(p*n,0) as v from {auroc_sql('lv', 'family, task, level', '(not correct_off)', '-conf')}),
 a as (select family, task, u/nullif(p*n,0) as auroc from {auroc_sql('evt', 'family, task', '(not correct_off)', '-conf')}),
 w as (select family, task, arg_min(level, (v, level)) as worst_stratum, min(v) as worst_stratum_auroc from la group by all),
 b as (select family, task, count(*) as n, avg(correct_off::int::double) as never, avg(correct_on::int::double) as always from evt group by all)"""


@query("s09_l13_metric_documents", f"""with {EVT}, {_LEVELS} select concat(a.family, '__', a.task) as run, case when a.task = 't1' then concat(a.family, '__', a.task) else a.family end as task, n, auroc,
 case when a.task <> 't3' then auroc - 0.1 end as auroc_lo, worst_stratum, worst_stratum_auroc, never, always, 0.25 as waste, a.family as run_task, a.task as run_target
 from a join w using (family, task) join b using (family, task)""", "auroc auroc_lo worst_stratum_auroc never always waste")
def s09(t):
    path = folder(t, "metrics")
    _metric_docs(t, path)
    docs = captures.metric_files(t.spark, path, schemas.METRICS)
    rows = captures.named_run(compare.probe_rows(docs))
    return rows.select("run", "task", "n", "auroc", "auroc_lo", "worst_stratum", "worst_stratum_auroc", "never", "always", "waste", "run_task", "run_target")


@query("s10_predictions", f"""with {EVT}, l as (select 'needs_thinking' as target, 'probe' as source, 'a' as scorer, 1::bigint as seed, case when event_id % 2 = 0 then 'val' else 'test' end as split, sample_id,
 (not correct_off)::int::bigint as y, score_a as score from evt union all select 'rescued', 'text', 'b', 1, case when event_id % 2 = 0 then 'val' else 'test' end, sample_id, correct_on::int, score_b from evt where not correct_off)
 select * from l""", "score")
def s10(t):
    path = folder(t, "preds")
    e = t.evt().withColumn("split", F.when(F.col("event_id") % 2 == 0, "val").otherwise("test"))

    def one(df, target, source, scorer, y, score):
        return df.select(F.lit(target).alias("target"), F.lit(source).alias("source"), F.lit(scorer).alias("scorer"), F.lit(1).alias("seed"),
                         "split", "sample_id", y.cast("int").alias("y"), OFF, ON, F.col(score).alias("score"))

    preds = one(e, "needs_thinking", "probe", "a", ~F.col(OFF), "score_a").unionByName(
        one(e.where(~F.col(OFF)), "rescued", "text", "b", F.col(ON), "score_b"))
    sinks.write_predictions(preds, path)
    return t.spark.read.parquet(path).select("target", "source", "scorer", "seed", "split", "sample_id", "y", "score")


@query("s12_report_table", f"""with {EVT}, {_LEVELS} select a.family as task, a.task as target, case when a.task = 't3' then concat(printf('%.3f', round(auroc, 3)), ' [no boot]')
 else printf('%.3f [%.3f,%.3f]', round(auroc, 3), round(auroc - 0.1, 3), round(auroc + 0.1, 3)) end as auroc, printf('%.3f', round(never, 3)) as never from a join b using (family, task)""")
def s12(t):
    """A CSV table written and read back; a missing interval prints "no boot"."""
    e = t.evt().withColumn("y", ~F.col(OFF)).withColumn("neg", -F.col("conf"))
    a = rank.auroc(e, ["family", "task"], "y", "neg").join(
        e.groupBy("family", "task").agg(F.avg(F.col(OFF).cast("double")).alias("never")), ["family", "task"])
    r = lambda c: F.round(c, 3)
    lo = F.when(F.col("task") != "t3", r(F.col("auroc") - 0.1))
    table = a.select(F.col("family").alias("task"), F.col("task").alias("target"),
                     sinks.interval_text(r(F.col("auroc")), lo, r(F.col("auroc") + 0.1)).alias("auroc"), sinks.number_text(r(F.col("never"))).alias("never"))
    path = folder(t, "table")
    sinks.write_table(table, path)
    return t.spark.read.csv(path, header=True, schema="task string, target string, auroc string, never string")


@query("l12_transfer_interval", f"""with {EVT}, g as (select family, task, avg(conf) as m from evt group by all), r as (select family, avg(m - 0.1) as lo, avg(m + 0.1) as hi, max(m) as top from g group by family)
 select family as run, case when family in ('click', 'view') then top else lo end as ci_lo, case when family in ('click', 'view') then top + 1 else hi end as ci_hi, family not in ('click', 'view') as rebuilt from r""", "ci_lo ci_hi")
def l12(t):
    """Documents of some families carry an interval, the others only per-probe ones."""
    g = t.evt().groupBy("family", "task").agg(F.avg("conf").alias("m"))
    ci = lambda a, b: F.struct(F.array(a, b).alias("ci"))
    docs = g.groupBy(F.col("family").alias("run")).agg(
        F.collect_list(F.struct(ci(F.col("m") - 0.1, F.col("m") + 0.1).alias("auroc_bootstrap"))).alias("per_probe"), F.max("m").alias("top"))
    docs = docs.withColumn("transfer_auroc_bootstrap", F.when(F.col("run").isin("click", "view"), ci(F.col("top"), F.col("top") + 1)))
    return compare.transfer_interval(docs, ["run"])

