"""Joins, set operations, grids and table diffs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checks import CheckFailed, or_fail, require, require_empty, require_unique
from ..columns import attach, count_if, truth
from ..session import plan_bytes, settle

BROADCAST_BYTES = 64 * 1024 * 1024


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint, given only when Catalyst's size estimate is under the limit."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


# --- alignment -------------------------------------------------------------

def align_labels(labels: DataFrame, meta: DataFrame, check: bool = True) -> DataFrame:
    """Labels joined to their meta rows by ``sample_id``.

    Duplicate meta ids are refused; a label without a meta row fails the job.
    Correctness columns come from the labels.
    """
    if check:
        require_unique(meta, ["sample_id"], "duplicate sample_id in meta")
    own = [c for c in meta.columns if c not in labels.columns]
    right = meta.select("sample_id", *own, F.lit(True).alias("__hit"))
    joined = labels.join(right, "sample_id", "left")
    ident = or_fail(
        F.col("__hit").isNotNull(), F.col("sample_id"),
        F.concat(F.lit("label has no matching capture row: "), F.col("sample_id")),
    )
    return joined.withColumn("sample_id", ident).drop("__hit")


CONFIDENCE_SOURCES = ("auto", "v2", "stored")


def resolve_confidence(meta: DataFrame, sidecar: DataFrame | None, source: str = "auto") -> DataFrame:
    """Meta rows with the confidence to use: the re-scored sidecar or the stored values.

    A sidecar that misses a meta row fails the job; versions are never mixed.
    """
    require(source in CONFIDENCE_SOURCES, f"source must be one of {CONFIDENCE_SOURCES}, got {source!r}")
    if source == "v2" and sidecar is None:
        raise CheckFailed("no confidence sidecar; rescore first or use source='stored'")
    if sidecar is None or source == "stored":
        version = F.coalesce(F.col("confidence_version"), F.lit(1)) if "confidence_version" in meta.columns else F.lit(1)
        return meta.withColumn("confidence_version", version).withColumn(
            "confidence_source", F.lit("stored")
        )
    right = sidecar.select(
        "sample_id", F.col("confidence_off").alias("__conf"),
        F.col("confidence_version").alias("__version"), F.col("flags").alias("confidence_flags"),
        F.lit(True).alias("__hit"),
    )
    joined = meta.join(right, "sample_id", "left")
    ident = or_fail(
        F.col("__hit").isNotNull(), F.col("sample_id"),
        F.concat(F.lit("row has no re-scored confidence; the rescore is incomplete: "), F.col("sample_id")),
    )
    return (
        joined.withColumn("sample_id", ident)
        .withColumn("confidence_off", F.col("__conf"))
        .withColumn("confidence_version", F.col("__version"))
        .withColumn("confidence_source", F.lit("sidecar"))
        .drop("__conf", "__version", "__hit")
    )


def readout_labels(readout: DataFrame, labels: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """Readout rows joined to regraded labels; missing versions or labels fail the job."""
    version = or_fail(
        F.col("grader_version").isNotNull(), F.col("grader_version"), "labels are not regraded"
    )
    right = labels.select(
        "sample_id", "correct_off", "correct_on", "n_tokens_off", "n_tokens_on", "truncated_off",
        "truncated_on", "unclosed_think_on", version.alias("grader_version"), F.lit(True).alias("__hit"),
    )
    joined = readout.join(right, "sample_id", "left")
    ident = or_fail(
        F.col("__hit").isNotNull(), F.col("sample_id"),
        F.concat(F.lit("readout row has no label: "), F.col("sample_id")),
    )
    out = joined.withColumn("sample_id", ident).drop("__hit")
    if families is None:
        return out
    filled = out.join(families.withColumnRenamed("family", "__fam"), "sample_id", "left")
    return filled.withColumn("family", F.coalesce("family", "__fam")).drop("__fam")


def rejoin_dimension(
    df: DataFrame, dim: DataFrame, key: str, field: str, strict: bool = True, out: str | None = None
) -> DataFrame:
    """Bring a dataset field back to rows. Strict: a miss fails, spaces become ``_``."""
    out = out or field
    right = dim.select(key, F.col(field).cast("string").alias("__f"), F.lit(True).alias("__hit"))
    joined = df.join(small(right), key, "left")
    if strict:
        value = or_fail(
            F.col("__hit").isNotNull(), F.replace("__f", F.lit(" "), F.lit("_")),
            F.concat(F.lit("row has no matching dataset row: "), F.col(key).cast("string")),
        )
    else:
        value = F.col("__f")
    return joined.withColumn(out, value).drop("__f", "__hit")


def pair_predictions(a: DataFrame, b: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Two scorers' test rows side by side; a group whose id sets differ has ``valid`` = false.

    keys: columns that identify a row inside a group, usually ["sample_id"].
    """
    left = a.select(*by, *keys, F.col("y").alias("y_a"), F.col("score").alias("score_a"))
    right = b.select(*by, *keys, F.col("score").alias("score_b"))
    # Read for the check of the ids and as rows.
    both = settle(left.join(right, by + keys, "full_outer"))
    ok = both.groupBy(*by).agg(
        F.min(F.col("score_a").isNotNull() & F.col("score_b").isNotNull()).alias("valid")
    )
    return attach(both, ok, by).withColumnRenamed("y_a", "y")


def match_templates(rows: DataFrame, templates: list[tuple[str, Column]], stored: str = "prompt_hash") -> DataFrame:
    """The first template whose rendered text hashes to the stored hash, with a flag if none.

    ``templates`` are (name, rendered Column) in priority order. The handful of
    candidates sits in one expression, so rows are not multiplied.
    """
    found = F.coalesce(*[F.when(F.sha2(text, 256) == F.col(stored), F.lit(name)) for name, text in templates])
    return rows.withColumn("prompt_source", found).withColumn(
        "flags", F.when(F.col("prompt_source").isNull(), F.array(F.lit("prompt_hash_mismatch"))).otherwise(F.array().cast("array<string>"))
    )


def attach_baselines(probes: DataFrame, baselines: DataFrame, keys: list[str], kinds: list[str]) -> DataFrame:
    """One row per probe with the name and mean of each baseline kind, when present."""
    require_unique(baselines.where(F.col("kind").isin(*kinds)), [*keys, "kind"], "several baselines of one kind")
    wide = baselines.groupBy(*keys).pivot("kind", kinds).agg(
        F.first("name").alias("name"), F.first("mean").alias("mean")
    )
    return probes.join(wide, keys, "left")


# --- diffs -----------------------------------------------------------------

def diff_tables(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], tol: float = 1e-9) -> DataFrame:
    """keys, status (added / removed / same / changed) and old / new values."""
    a = old.select(*keys, *[F.col(v).alias(f"{v}_old") for v in values], F.lit(True).alias("__a"))
    b = new.select(*keys, *[F.col(v).alias(f"{v}_new") for v in values], F.lit(True).alias("__b"))
    both = a.join(b, keys, "full_outer")

    def equal(v):
        x, y = F.col(f"{v}_old"), F.col(f"{v}_new")
        if dict(new.dtypes)[v] in ("double", "float"):
            return (F.abs(x - y) <= tol) | (x.isNull() & y.isNull()) | (x == y)
        return x.eqNullSafe(y)

    same = reduce(lambda p, q: p & q, [F.coalesce(equal(v), F.lit(False)) for v in values])
    status = (
        F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed")
        .when(same, "same").otherwise("changed")
    )
    return both.select(*keys, status.alias("status"), *[f"{v}_{s}" for v in values for s in ("old", "new")])


def promote(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], force: bool = False) -> DataFrame:
    """``old`` with new entries added. Refuses to change an existing entry unless forced."""
    diff = diff_tables(old, new, keys, values)
    if not force:
        require_empty(diff.where("status = 'changed'"), "an existing entry would change", show=keys[0])
    return diff.select(
        *keys, "status",
        *[F.when(F.col("status") == "removed", F.col(f"{v}_old")).otherwise(F.col(f"{v}_new")).alias(v) for v in values],
    )


# --- grids and pairs -------------------------------------------------------

def ordered_pairs(names: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """Every (source, target) pair of distinct names, per ``by`` (a task list, not rows)."""
    by = by or []
    left = names.select(*by, F.col(col).alias("source"))
    right = names.select(*[F.col(c).alias(f"__{c}") for c in by], F.col(col).alias("target"))
    cond = reduce(lambda p, q: p & q, [F.col(c) == F.col(f"__{c}") for c in by], F.col("source") != F.col("target"))
    return left.join(right, cond).drop(*[f"__{c}" for c in by])


def parameter_grid(
    spark: SparkSession, grid: dict[str, list] | None = None, zipped: dict[str, list] | None = None,
    exclude: list[dict] | None = None,
) -> DataFrame:
    """Cartesian product of ``grid``, crossed with lockstep ``zipped``, minus partial matches."""
    grid, zipped = grid or {}, zipped or {}
    for name, values in {**grid, **zipped}.items():
        require(isinstance(values, list) and bool(values), f"{name!r} must be a non-empty list")
    require(len({len(v) for v in zipped.values()}) <= 1, "zip lists must be the same length")
    out = spark.range(1).select()
    for name, values in grid.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    if zipped:
        rows = [
            F.struct(*[F.lit(v[i]).alias(k) for k, v in zipped.items()])
            for i in range(len(next(iter(zipped.values()))))
        ]
        out = out.select("*", F.inline(F.array(*rows)))
    for rule in exclude or []:
        # A rule naming an unknown column can match nothing.
        if all(k in out.columns for k in rule):
            hit = reduce(lambda p, q: p & q, [F.col(k) == F.lit(v) for k, v in rule.items()], F.lit(True))
            out = out.where(~hit)
    return out


_FIELD = re.compile(r"\{(\w+)\}")


def substitute(template: str, names: list[str]) -> Column:
    """A string with ``{name}`` replaced by columns; an unknown name is an error."""
    parts, at = [], 0
    for m in _FIELD.finditer(template):
        require(m.group(1) in names, f"template refers to unknown variable {m.group(0)} in {template!r}")
        parts += [F.lit(template[at : m.start()]), F.col(m.group(1)).cast("string")]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def fingerprint(cols: list[str]) -> Column:
    """SHA-256 of the chosen fields as JSON in name order, NULL fields dropped."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)])), 256)


def default_id(name: str, cols: list[str]) -> Column:
    """``name__k-v_k-v`` with the keys in name order; other characters become ``-``."""
    if not cols:
        return F.lit(name)
    pairs = [F.concat(F.lit(f"{c}-"), F.col(c).cast("string")) for c in sorted(cols)]
    return F.regexp_replace(F.concat(F.lit(f"{name}__"), F.concat_ws("_", *pairs)), r"[^A-Za-z0-9._-]", "-")


# --- sets ------------------------------------------------------------------

def pool(parts: dict[str, DataFrame], vector: str | None = None, group: str | None = None) -> DataFrame:
    """Stacked captures with a task tag; groups become ``task:group``.

    Differing vector widths are refused.
    """
    tagged = [df.withColumn("pool_task", F.lit(name)) for name, df in parts.items()]
    out = reduce(lambda a, b: a.unionByName(b), tagged)
    if group:
        named = F.when(F.col(group).isNotNull(), F.concat_ws(":", "pool_task", group))
        out = out.withColumn(group, named)
    if vector:
        widths = out.agg(F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi")).first()
        require(widths.lo == widths.hi, f"vector widths differ: {widths.lo} and {widths.hi}")
    return out


def complement(df: DataFrame, fold: str, k: int) -> DataFrame:
    """Train rows of fold k: all others."""
    return df.where(F.col(fold) != k)


def distinct_candidates(df: DataFrame, by: list[str], score: str, constants: list[float]) -> DataFrame:
    """Distinct scores of each group plus constants."""
    extra = F.array(F.col(score).cast("double"), *[F.lit(float(c)) for c in constants])
    cells = df.select(*by, F.col(score).cast("double").alias(score)).distinct()
    return cells.select(*by, F.explode(extra).alias("candidate")).distinct()


def same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: ids only in a, only in b, and whether the two sets are equal."""
    left = a.select(key).distinct().withColumn("__a", F.lit(True))
    right = b.select(key).distinct().withColumn("__b", F.lit(True))
    got = left.join(right, key, "full_outer").agg(
        count_if(F.col("__b").isNull()).alias("only_a"), count_if(F.col("__a").isNull()).alias("only_b")
    )
    return got.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def incomplete_shards(source: DataFrame, derived: DataFrame, shard: str = "shard") -> DataFrame:
    """Shards whose derived rows do not match the source rows in number."""
    a = source.groupBy(shard).agg(F.count(F.lit(1)).alias("n_source"))
    b = derived.groupBy(shard).agg(F.count(F.lit(1)).alias("n_derived"))
    return a.join(b, shard, "left").where(~F.col("n_source").eqNullSafe(F.col("n_derived")))


def scorer_inputs(
    parts: dict[str, tuple[DataFrame, DataFrame, DataFrame | None]], target_name: str,
    source: str = "auto", allow_v1: bool = False,
) -> DataFrame:
    """Labels, meta and confidence of several tasks in one table, reduced to a target.

    parts: task -> (labels, meta, sidecar or None).
    """
    from .labels import target

    rows = []
    for task, (labels, meta, sidecar) in parts.items():
        own = [c for c in meta.columns if c not in ("correct_off", "correct_on")]
        conf = resolve_confidence(meta.select(*own), sidecar, source)
        rows.append(align_labels(labels, conf).withColumn("task", F.lit(task)))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    if not allow_v1:
        ok = F.col("confidence_version") != 1
        out = out.withColumn(
            "confidence_version", or_fail(ok, F.col("confidence_version"), "rows carry confidence version 1")
        )
    return target(out, target_name)
