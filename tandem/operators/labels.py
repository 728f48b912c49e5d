"""From paired outcomes to labels, targets and label reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checks import CheckFailed, or_fail, require
from ..columns import count_if, cube_level, gain, ratio, truth

# Task directory prefixes that differ from the task name.
TASK_ALIASES = {
    "mmlupro": "mmlu_pro", "gsm8k_full": "gsm8k", "gsm8kfull": "gsm8k", "lsat_long": "lsat",
}
SAMPLE_ID_MIDDLE = "sample_id:middle"
OFF_TRUNCATION_LIMIT = 0.2
MIN_RESCUED_ROWS, MIN_POSITIVES = 40, 10


def is_helped(off="correct_off", on="correct_on") -> Column:
    return ~truth(F.col(off)) & truth(F.col(on))


def target(df: DataFrame, name: str, off="correct_off", on="correct_on", y="y") -> DataFrame:
    """Adds the boolean target. ``rescued`` keeps only the rows the cheap policy gets wrong."""
    if name == "helped":
        return df.withColumn(y, is_helped(off, on))
    if name == "needs_thinking":
        return df.withColumn(y, ~truth(F.col(off)))
    if name == "rescued":
        return df.where(~truth(F.col(off))).withColumn(y, truth(F.col(on)))
    raise CheckFailed(f"unknown target {name!r}")


def require_enough(df: DataFrame, name: str, off="correct_off", on="correct_on") -> None:
    """Refuse to train on too few rows or positives (one aggregate, before the job)."""
    got = target(df, name, off, on).agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("y")).alias("pos")
    ).first()
    if name == "rescued":
        require(got.n >= MIN_RESCUED_ROWS, f"only {got.n} rows with {off} = false")
    require(got.pos >= MIN_POSITIVES, f"only {got.pos} positive example(s)")


def graded_label(off="correct_off", on="correct_on") -> Column:
    g = gain(off, on)
    return (
        F.when(g == 1, "helped").when(g == -1, "hurt")
        .when(truth(F.col(off)), "no_change_correct").otherwise("no_change_wrong")
    )


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def label_rows(df: DataFrame, version: str | None = None) -> DataFrame:
    """META rows to LABEL rows. Regrade columns are NULL unless the input was regraded."""
    regraded = "correct_off_stored" in df.columns
    flag = lambda c: truth(_column(df, c, "boolean"))
    extra = ["correct_off_stored", "correct_on_stored", "unclosed_think_on", "unclosed_think_off"]
    return df.select(
        "sample_id",
        _column(df, "prompt_hash", "string").alias("prompt_hash"),
        F.when(is_helped(), "helped").otherwise("not_helped").alias("label"),
        graded_label().alias("graded_label"),
        flag("correct_off").alias("correct_off"),
        flag("correct_on").alias("correct_on"),
        _column(df, "difficulty", "string").alias("difficulty"),
        flag("truncated_on").alias("truncated_on"),
        _column(df, "n_tokens_on", "bigint").alias("n_tokens_on"),
        _column(df, "n_tokens_off", "bigint").alias("n_tokens_off"),
        flag("truncated_off").alias("truncated_off"),
        F.lit(version).cast("string").alias("grader_version"),
        *[(flag(c) if regraded else F.lit(None).cast("boolean")).alias(c) for c in extra],
    )


def drop_truncated(labels: DataFrame) -> DataFrame:
    return labels.where(~truth(F.col("truncated_on")))


def _report_columns(labels: DataFrame) -> list[Column]:
    n = F.count(F.lit(1))
    rate = lambda c: F.coalesce(ratio(count_if(c), n), F.lit(0.0))
    off, on = truth(F.col("correct_off")), truth(F.col("correct_on"))
    graded = ["helped", "hurt", "no_change_correct", "no_change_wrong"]
    cols = [
        n.alias("n"),
        rate(F.col("label") == "helped").alias("base_rate_helped"),
        rate(off).alias("accuracy_off"),
        rate(on).alias("accuracy_on"),
        rate(off | on).alias("oracle_accuracy"),
        count_if(truth(F.col("truncated_on"))).alias("truncated_on"),
        count_if(truth(F.col("truncated_off"))).alias("truncated_off"),
        *[count_if(F.col("graded_label") == g).alias(f"n_{g}") for g in graded],
    ]
    stored_off, stored_on = F.col("correct_off_stored"), F.col("correct_on_stored")
    return cols + [
        ratio(count_if(stored_off), F.count(stored_off)).alias("stored_accuracy_off"),
        ratio(count_if(stored_on), F.count(stored_on)).alias("stored_accuracy_on"),
        count_if(truth(F.col("unclosed_think_on"))).alias("unclosed_think_on"),
    ]


def label_report(labels: DataFrame) -> DataFrame:
    """One row; rates are 0.0 on empty input. Stored accuracies are NULL unless regraded."""
    return labels.agg(*_report_columns(labels))


def label_report_by(labels: DataFrame, by: list[str]) -> DataFrame:
    keep = ["n", "base_rate_helped", "accuracy_off", "accuracy_on"]
    return labels.groupBy(*by).agg(*_report_columns(labels)).select(*by, *keep)


def label_report_levels(labels: DataFrame, key: str = "difficulty") -> DataFrame:
    """Overall and per level in one pass."""
    return cube_level(labels, [key], _report_columns(labels)[:5])


def regrade_flips(labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How a regrade moved each grade, the rows and the binary label."""
    def moved(mode):
        return F.col(f"correct_{mode}_stored"), F.col(f"correct_{mode}")

    (off0, off1), (on0, on1) = moved("off"), moved("on")
    return labels.groupBy(*(by or [])).agg(
        count_if(~off0 & off1).alias("off_false_to_true"),
        count_if(off0 & ~off1).alias("off_true_to_false"),
        count_if(~on0 & on1).alias("on_false_to_true"),
        count_if(on0 & ~on1).alias("on_true_to_false"),
        count_if((off0 != off1) | (on0 != on1)).alias("rows_changed"),
        count_if((~off0 & on0) != (F.col("label") == "helped")).alias("label_changed"),
    )


def regrade_comparison(labels: DataFrame, by: list[str]) -> DataFrame:
    """Before / after accuracies and helped / hurt rates per group of regraded labels."""
    def side(name, off, on):
        return F.struct(F.lit(name).alias("grading"), truth(F.col(off)).alias("o"), truth(F.col(on)).alias("n"))

    both = F.array(
        side("stored", "correct_off_stored", "correct_on_stored"), side("regraded", "correct_off", "correct_on")
    )
    n = F.count(F.lit(1))
    return labels.select(*by, F.inline(both)).groupBy(*by, "grading").agg(
        n.alias("rows"),
        ratio(count_if(F.col("o")), n).alias("accuracy_off"),
        ratio(count_if(F.col("n")), n).alias("accuracy_on"),
        ratio(count_if(~F.col("o") & F.col("n")), n).alias("helped"),
        ratio(count_if(F.col("o") & ~F.col("n")), n).alias("hurt"),
    )


def shard_summary(meta: DataFrame) -> DataFrame:
    """Accuracies and rates per capture shard, rates to 4 places."""
    n = F.count(F.lit(1))

    def rate(c, name):
        return F.round(ratio(count_if(truth(F.col(c))), n), 4).alias(name)

    return meta.groupBy("shard").agg(
        n.alias("n_samples"),
        rate("correct_off", "accuracy_off"),
        rate("correct_on", "accuracy_on"),
        rate("truncated_off", "off_truncation_rate"),
        rate("truncated_on", "on_truncation_rate"),
        rate("has_reasoning_on", "has_reasoning_on_rate"),
        count_if(truth(F.col("unclosed_think_on"))).alias("unclosed_think_on"),
        count_if(truth(F.col("prompt_truncated"))).alias("prompt_truncated"),
        count_if(gain("correct_off", "correct_on") == 1).alias("helped"),
        count_if(gain("correct_off", "correct_on") == -1).alias("hurt"),
    )


def quarantine(meta: DataFrame, limit: float = OFF_TRUNCATION_LIMIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept rows, quarantined rows, failure records): shards truncated above the limit."""
    n = F.count(F.lit(1))
    cut = count_if(truth(F.col("truncated_off")))
    failed = (
        meta.groupBy("shard").agg(cut.alias("n_truncated"), n.alias("n_samples"))
        .where(F.col("n_truncated") / F.col("n_samples") > limit)
        .select(
            "shard", F.lit("thinking-OFF truncation above limit").alias("reason"),
            F.round(F.col("n_truncated") / F.col("n_samples"), 4).alias("off_truncation_rate"),
            F.lit(limit).alias("limit"), "n_truncated", "n_samples",
        )
    )
    keys = failed.select("shard")
    return meta.join(keys, "shard", "left_anti"), meta.join(keys, "shard", "left_semi"), failed


def resolve_task(config_task: Column, folder: Column, override: Column | None = None) -> Column:
    """Override, else the config's task, else the folder prefix through the alias table."""
    prefix = F.substring_index(F.element_at(F.split(folder, "/"), -1), "_thinking", 1)
    table = F.create_map(*[F.lit(x) for kv in TASK_ALIASES.items() for x in kv])
    named = F.coalesce(F.try_element_at(table, prefix), prefix)
    first = [override] if override is not None else []
    return F.coalesce(*[F.when(c != "", c) for c in first + [config_task]], named)


def group_key(df: DataFrame, key: str, strict: bool = True) -> Column:
    """The group of a row: the middle of its id, or a label field, else a meta field."""
    if key == SAMPLE_ID_MIDDLE:
        parts = F.split(F.col("sample_id"), "-")
        middle = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(1))), "-")
        if not strict:
            return F.when(F.size(parts) > 2, middle).otherwise(F.col("sample_id"))
        return or_fail(
            F.size(parts) > 2, middle,
            F.concat(F.lit("sample_id is not <task>-<group>-<index>: "), F.col("sample_id")),
        )
    found = [F.col(c).cast("string") for c in (key, f"meta_{key}") if c in df.columns]
    require(bool(found), f"rows have no {key!r} field")
    value = F.coalesce(*found)
    return or_fail(value.isNotNull(), value, f"a row has no {key!r}") if strict else value


def regroup(labels: DataFrame, key: Column) -> DataFrame:
    """Use another key as the stratification field."""
    return labels.withColumn("difficulty", key)


# --- integrity and audits --------------------------------------------------

TOKEN_DELTA_FLAG = 2


def integrity(df: DataFrame) -> DataFrame:
    """Flags from stored against recomputed prompt and token counts."""
    lost = F.col("prompt_source").isNull()
    delta = F.col("n_tokens_rescored") - F.col("n_tokens_off")
    delta = F.when(~lost, delta)
    flags = F.array_compact(F.array(
        F.when(lost, "prompt_hash_mismatch"),
        F.when(~lost & (F.col("prompt_len_rescored") != F.col("prompt_len_off")), "prompt_len_mismatch"),
        F.when(F.abs(delta) > TOKEN_DELTA_FLAG, "token_count_mismatch"),
    ))
    return df.withColumn("token_delta", delta).withColumn("flags", flags)


def flag_histogram(df: DataFrame, flags: str = "flags") -> DataFrame:
    return df.select(F.explode(flags).alias("flag")).groupBy("flag").count()


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Counts of each value of several columns in one pass (NULL is a value)."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in cols
    ])
    return df.select(F.inline(pairs)).groupBy("field", "value").count()


def version_counts(df: DataFrame, version: str = "confidence_version") -> DataFrame:
    """Rows per confidence version; a missing one is version 1."""
    return df.groupBy(F.coalesce(F.col(version).cast("string"), F.lit("1")).alias("version")).count()


def coverage_summary(readout: DataFrame) -> DataFrame:
    """Rows, covered share, accuracy and option mass of a readout."""
    cov = truth(F.col("covered"))
    inside = lambda c: F.when(cov, c)
    return readout.groupBy("task").agg(
        F.count(F.lit(1)).alias("n_rows"),
        count_if(cov).alias("n_covered"),
        ratio(count_if(cov), F.count(F.lit(1))).alias("coverage"),
        F.avg(inside(truth(F.col("s1_correct")).cast("double"))).alias("s1_accuracy"),
        F.avg(inside(F.col("p_max"))).alias("mean_p_max"),
        F.avg(inside(F.col("option_mass"))).alias("mean_option_mass"),
        F.min(inside(F.col("option_mass"))).alias("min_option_mass"),
    )


def coverage_by_family(readout: DataFrame) -> DataFrame:
    return readout.where(truth(F.col("covered"))).groupBy(
        "task", F.coalesce(F.col("family"), F.lit("None")).alias("family")
    ).agg(F.avg(truth(F.col("s1_correct")).cast("double")).alias("s1_accuracy"), F.count(F.lit(1)).alias("n"))


def exclude_reasons(readout: DataFrame) -> DataFrame:
    return readout.where(~truth(F.col("covered"))).groupBy(
        "task", F.coalesce(F.col("exclude_reason"), F.lit("None")).alias("exclude_reason")
    ).count()


def caveats(rows: DataFrame, by: list[str]) -> DataFrame:
    """Coverage, truncation and option-mass figures beside every result table."""
    cov = truth(F.col("covered"))
    share = lambda c: F.round(100 * F.avg(F.when(cov, truth(F.col(c)).cast("double"))), 1)
    mass = F.when(cov, F.col("option_mass"))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        count_if(cov).alias("n_covered"),
        F.round(ratio(count_if(cov), F.count(F.lit(1))), 3).alias("coverage"),
        share("truncated_on").alias("think_truncated_pct"),
        share("unclosed_think_on").alias("think_unclosed_pct"),
        share("truncated_off").alias("nothink_truncated_pct"),
        F.round(F.avg(mass), 3).alias("mean_option_mass"),
        F.round(F.min(mass), 3).alias("min_option_mass"),
        F.array_join(F.array_sort(F.collect_set(F.when(cov, F.col("grader_version")))), ",").alias("graders"),
    )


def trace_audit(meta: DataFrame, by: list[str]) -> DataFrame:
    """Rows with a think tag, rows whose two responses are equal, median tokens."""
    has = F.contains(F.col("response_on"), F.lit("<think>"))
    return meta.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        count_if(has).alias("with_think"),
        count_if(~has).alias("without_think"),
        count_if(F.col("response_on") == F.col("response_off")).alias("identical"),
        F.percentile("n_tokens_on", F.lit(0.5)).alias("median_n_tokens_on"),
    )


def truncation_accuracy(df: DataFrame, by: list[str]) -> DataFrame:
    """Truncation rate, and accuracy with and without truncation."""
    cut, ok = truth(F.col("truncated_off")), truth(F.col("correct_off"))
    return df.groupBy(*by).agg(
        ratio(count_if(cut), F.count(F.lit(1))).alias("truncation_rate"),
        ratio(count_if(cut & ok), count_if(cut)).alias("accuracy_truncated"),
        ratio(count_if(~cut & ok), count_if(~cut)).alias("accuracy_complete"),
    )


def first_correct_tier(df: DataFrame, by: list[str], s1: str, off: str, on: str) -> DataFrame:
    """Share of rows whose first right tier is s1, no_think, think, or none."""
    a, b, c = (truth(F.col(x)) for x in (s1, off, on))
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        ratio(count_if(a), n).alias("s1"),
        ratio(count_if(~a & b), n).alias("no_think"),
        ratio(count_if(~a & ~b & c), n).alias("think"),
        ratio(count_if(~a & ~b & ~c), n).alias("none_right"),
    )


def gap_summary(df: DataFrame, by: list[str], off: str, on: str) -> DataFrame:
    """n, accuracies, gap and the helped / hurt shares."""
    g, n = gain(off, on), F.count(F.lit(1))
    return df.groupBy(*by).agg(
        n.alias("n"),
        ratio(count_if(truth(F.col(off))), n).alias("acc_off"),
        ratio(count_if(truth(F.col(on))), n).alias("acc_on"),
        ratio(F.sum(g), n).alias("gap_on_minus_off"),
        ratio(count_if(g == 1), n).alias("helped"),
        ratio(count_if(g == -1), n).alias("hurt"),
    )
