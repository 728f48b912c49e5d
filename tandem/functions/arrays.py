"""Array expressions: option scoring, token confidence, vector features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checks import or_fail, require
from ..columns import attach

TINY = 1e-30
CONFIDENCE_FEATURES = ("mean_logprob", "min_logprob", "mean_entropy", "n_tokens_off")


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


# Option scoring ---------------------------------------------------------------

def option_probs(logprobs: Column, token_ids: Column, options: Column) -> Column:
    """Probability of each option: exp of the log-probs of its token ids, added up."""
    return F.transform(
        options,
        lambda o: _sum(F.transform(F.try_element_at(token_ids, o), lambda i: F.exp(F.get(logprobs, i)))),
    )


def score_options(
    df: DataFrame, logprobs: str, token_ids: str, options: str,
    alt: tuple[str, str, str] | None = None,
) -> DataFrame:
    """Adds probs, argmax, p_max, entropy, entropy_norm, option_mass, mass_direct.

    ``alt`` = (bridge log-prob, log-probs after the bridge, token ids after it): a
    second, disjoint way to spell each option, added to the direct one.
    """
    opts = F.col(options)
    out = df.withColumn("__d", option_probs(F.col(logprobs), F.col(token_ids), opts))
    if alt is None:
        out = out.withColumn("__raw", F.col("__d"))
    else:
        bridge, alt_lp, alt_ids = (F.col(c) for c in alt)
        out = (
            out.withColumn("p_bridge", F.exp(bridge))
            .withColumn("__a", option_probs(alt_lp, alt_ids, opts))
            .withColumn("__v", F.transform("__a", lambda p: p * F.col("p_bridge")))
            .withColumn("mass_after_paren", _sum(F.col("__a")))
            .withColumn("mass_paren", _sum(F.col("__v")))
            .withColumn("__raw", F.zip_with("__d", "__v", lambda a, b: a + b))
            .drop("__a", "__v")
        )
    k = F.size(opts).cast("double")
    out = (
        out.withColumn("mass_direct", _sum(F.col("__d")))
        .withColumn("option_mass", _sum(F.col("__raw")))
        .withColumn(
            "probs",
            F.transform(
                "__raw", lambda p: F.when(F.col("option_mass") > 0, F.try_divide(p, F.col("option_mass"))).otherwise(1 / k)
            ),
        )
        .withColumn("p_max", F.array_max("probs"))
        .withColumn("argmax", F.try_element_at(opts, F.array_position("probs", F.col("p_max")).cast("int")))
        .withColumn(
            "entropy", -_sum(F.transform("probs", lambda p: p * F.ln(F.greatest(p, F.lit(TINY)))))
        )
        .withColumn("entropy_norm", F.try_divide(F.col("entropy"), F.ln(k)))
    )
    return out.drop("__d", "__raw")


def token_confidence(logprobs: Column, entropies: Column) -> Column:
    """struct(mean_logprob, min_logprob, mean_entropy); NULLs when no token was generated."""
    n = F.size(logprobs).cast("double")
    n = F.when(n > 0, n)
    return F.struct(
        (_sum(logprobs) / n).alias("mean_logprob"),
        F.array_min(logprobs).alias("min_logprob"),
        (_sum(entropies) / n).alias("mean_entropy"),
    )


def end_token(ids: Column, ends: list[int]) -> Column:
    """struct(length, truncated): up to the first end token, inclusive."""
    at = F.array_position(F.transform(ids, lambda x: x.isin(*ends)), F.lit(True))
    return F.struct(
        F.when(at > 0, at).otherwise(F.size(ids)).cast("bigint").alias("length"), (at == 0).alias("truncated")
    )


# Layers and vectors -------------------------------------------------------------

def resolve_layers(layers: list[int], n_layers: int) -> list[int]:
    for k in layers:
        require(-n_layers <= k < n_layers, f"layer {k} out of range for {n_layers} layers")
    return [k % n_layers for k in layers]


def select_layers(
    act: DataFrame, keys: list[str], n_layers: int, layers: list[int] | None = None, stride: int | None = None
) -> DataFrame:
    """(keys, vec): one layer, or several joined end to end in the given order.

    Default is the middle layer; ``stride`` takes every n-th. At most n_layers
    rows meet per key.
    """
    if layers is None:
        layers = list(range(0, n_layers, stride)) if stride else [n_layers // 2]
    picked = resolve_layers(layers, n_layers)
    rows = act.where(F.col("layer").isin(*picked))
    if len(picked) == 1:
        return rows.select(*keys, "vec")
    places = F.filter(
        F.array(*[F.when(F.col("layer") == k, F.lit(i)) for i, k in enumerate(picked)]), lambda p: p.isNotNull()
    )
    placed = rows.withColumn("__pos", F.explode(places))
    parts = F.array_sort(F.collect_list(F.struct("__pos", "vec")))
    return placed.groupBy(*keys).agg(F.flatten(F.transform(parts, lambda x: x["vec"])).alias("vec"))


def default_layers(n: Column) -> Column:
    """Quarter, middle, three-quarter and the last four indices, sorted and distinct."""
    last = F.sequence(F.greatest(F.lit(1), n - 3), n)
    marks = F.array(F.floor(n / 4), F.floor(n / 2), F.floor(3 * n / 4)).cast("array<int>")
    return F.array_sort(F.array_distinct(F.concat(marks, last.cast("array<int>"))))


def fit_standardizer(df: DataFrame, by: list[str], vec: str) -> DataFrame:
    """by..., pos, mean, sd (population; below 1e-6 it becomes 1) of each dimension."""
    sd = F.stddev_pop("x")
    return (
        df.select(*by, F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "x"))
        .groupBy(*by, "pos")
        .agg(F.avg("x").alias("mean"), F.when(sd < 1e-6, 1.0).otherwise(sd).alias("sd"))
    )


def standardizer_state(fitted: DataFrame, by: list[str]) -> DataFrame:
    """by..., mean ARRAY, sd ARRAY: the stored form, one row per fit."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "mean", "sd")))
    return fitted.groupBy(*by).agg(
        F.transform(parts, lambda x: x["mean"]).alias("mean"), F.transform(parts, lambda x: x["sd"]).alias("sd")
    )


def standardize(df: DataFrame, state: DataFrame, by: list[str], vec: str) -> DataFrame:
    """(x - mean) / sd with a stored state."""
    centred = F.zip_with(F.col(vec).cast("array<double>"), F.col("mean"), lambda x, m: x - m)
    return attach(df, state, by).withColumn(
        vec, F.zip_with(centred, F.col("sd"), lambda x, s: x / s)
    ).drop("mean", "sd")


def linear_score(vec: Column, coef: Column, intercept: Column) -> Column:
    """sigmoid(x . coef + b)."""
    z = _sum(F.zip_with(vec.cast("array<double>"), coef, lambda x, w: x * w)) + intercept
    return 1.0 / (1.0 + F.exp(-z))


# Feature columns ----------------------------------------------------------------

def confidence_features(df: DataFrame, confidence: str = "confidence_off") -> DataFrame:
    """The four confidence scalars as columns; a missing or NaN value fails the job."""
    def checked(c, name):
        c = c.cast("double")
        return or_fail(~(c.isNull() | F.isnan(c)), c, f"confidence value missing: {name}").alias(name)

    feats = [checked(F.col(f"{confidence}.{n}"), n) for n in CONFIDENCE_FEATURES[:3]]
    feats.append(checked(F.col("n_tokens_off"), "n_tokens_off"))
    keep = [c for c in df.columns if c not in CONFIDENCE_FEATURES]
    return df.select(*keep, *feats)


def nonfinite_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: how many values of each feature are NULL, NaN or infinite."""
    def bad(c):
        return F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))

    return df.agg(*[F.count(F.when(bad(c), 1)).alias(c) for c in cols])


def clean_features(df: DataFrame, cols: list[str], clip: str | None = "min_logprob") -> DataFrame:
    """NULL and NaN to 0, infinities to +-50; one feature is clipped to [-50, 0]."""
    def fixed(name):
        c = F.col(name).cast("double")
        c = (
            F.when(c.isNull() | F.isnan(c), 0.0).when(c == float("inf"), 50.0)
            .when(c == float("-inf"), -50.0).otherwise(c)
        )
        return F.least(F.greatest(c, F.lit(-50.0)), F.lit(0.0)) if name == clip else c

    return df.withColumns({c: fixed(c) for c in cols})


def task_crosses(df: DataFrame, tasks: list[str], task: str = "task",
                 crossed: tuple[str, ...] = ("mean_logprob", "mean_entropy")) -> tuple[DataFrame, list[str]]:
    """Task indicator columns and their products with two features; also the new names."""
    new = {}
    for t in tasks:
        hot = F.when(F.col(task) == t, 1.0).otherwise(0.0)
        new[f"is_{t}"] = hot
        new.update({f"{c}_x_{t}": hot * F.col(c) for c in crossed})
    return df.withColumns(new), list(new)
