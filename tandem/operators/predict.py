"""Predictors: scalar, TF-IDF, logistic, network, cross-fitted linear."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checks import require
from ..columns import attach, count_if, join_on, truth
from ..functions.arrays import fit_standardizer, linear_score, standardize, standardizer_state
from ..session import settle, small_table
from .rank import auroc

WORD = r"(?U)\b\w\w+\b"


# Scalar scorers ------------------------------------------------------------------

def text_lengths(df: DataFrame, text: str) -> DataFrame:
    """Adds length_chars and length_words (runs of non-space)."""
    words = F.size(F.filter(F.split(F.col(text), r"(?U)\s+"), lambda w: w != ""))
    return df.withColumn("length_chars", F.length(text).cast("double")).withColumn(
        "length_words", words.cast("double")
    )


def scalar_scores(rows: DataFrame, by: list[str], y: str, score: str, split: str = "split") -> DataFrame:
    """Validation and test rows with a signed ``score``; the sign is chosen on train rows."""
    train = auroc(rows.where(F.col(split) == "train"), by, y, score)
    sign = train.select(*by, F.when(F.col("auroc") >= 0.5, 1.0).otherwise(-1.0).alias("__sign"))
    held = rows.where(F.col(split) != "train")
    return attach(held, sign, by).withColumn("score", F.col("__sign") * F.col(score)).drop("__sign")


# TF-IDF ---------------------------------------------------------------------------

def word_grams(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys..., term, tf: word 1-grams and 2-grams."""
    t = df.select(*keys, F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)).alias("t"))
    pairs = F.zip_with(
        F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))),
        F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    terms = t.select(*keys, F.explode(F.concat("t", pairs)).alias("term"))
    return terms.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def char_grams(df: DataFrame, keys: list[str], text: str, lo: int = 3, hi: int = 5) -> DataFrame:
    """keys..., term, tf: character grams inside space-padded words.

    Words are counted first, so a repeated word is cut once. A padded word no
    longer than n is one gram, and ends the list for that word.
    """
    words = df.select(*keys, F.explode(F.split(F.lower(text), r"(?U)\s+")).alias("w")).where("w <> ''")
    counted = words.groupBy(*keys, "w").agg(F.count(F.lit(1)).alias("c"))
    padded = counted.withColumn("w", F.concat(F.lit(" "), "w", F.lit(" ")))
    size, at = F.length("w"), F.col("at")
    placed = padded.withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(size - lo + 1, F.lit(1)))))

    def cut(n):
        fits = at <= F.greatest(size - n + 1, F.lit(1)) if n == lo else at <= size - n + 1
        return F.when(fits, F.substring(F.col("w"), at, F.lit(n)))

    grams = F.array_compact(F.array(*[cut(n) for n in range(lo, hi + 1)]))
    terms = placed.select(*keys, "c", F.explode(grams).alias("term"))
    return terms.groupBy(*keys, "term").agg(F.sum("c").alias("tf"))


def tfidf(grams: DataFrame, docs: DataFrame, by: list[str], doc: str, split: str = "split",
          min_df: int = 2) -> DataFrame:
    """by..., doc, term, weight with vocabulary and idf fitted on train documents only.

    grams: (by..., doc, split, term, tf) as word_grams / char_grams give with
    those keys; docs: one row per document, for the number of train documents.
    Weight = (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), L2-normed per document.
    """
    train = F.col(split) == "train"
    sizes = docs.groupBy(*by).agg(count_if(train).alias("__n"))
    # tf is read here as well, so both branches share one shuffled gram table.
    seen = grams.groupBy(*by, "term").agg(count_if(train & (F.col("tf") > 0)).alias("df"))
    idf = join_on(seen.where(f"df >= {min_df}"), sizes, by).select(
        *by, "term", (F.ln((1.0 + F.col("__n")) / (1.0 + F.col("df"))) + 1.0).alias("idf")
    )
    raw = join_on(grams, idf, by + ["term"]).select(
        *by, doc, "term", ((1.0 + F.ln("tf")) * F.col("idf")).alias("__w")
    )
    # A window group is one document's terms.
    norm = F.sqrt(F.sum(F.col("__w") * F.col("__w")).over(Window.partitionBy(*by, doc)))
    return raw.select(*by, doc, "term", (F.col("__w") / norm).alias("weight"))


# Fitted scorers -------------------------------------------------------------------

def class_weights(df: DataFrame, y: str) -> Column:
    """Balanced weights n / (2 n_class) from one aggregate of two numbers."""
    n = df.agg(count_if(truth(F.col(y))).alias("p"), F.count(F.lit(1)).alias("n")).first()
    pos, neg = max(n.p, 1), max(n.n - n.p, 1)
    return F.when(truth(F.col(y)), n.n / (2.0 * pos)).otherwise(n.n / (2.0 * neg))


def fit_logistic(train: DataFrame, features: str, y: str, balanced: bool = False,
                 max_iter: int = 2000, c: float = 1.0):
    """L2 logistic regression with the penalty of C = c: regParam = 1 / (c * sum of weights)."""
    weight = class_weights(train, y) if balanced else F.lit(1.0)
    data = train.select(
        F.col(features).alias("features"), truth(F.col(y)).cast("double").alias("label"), weight.alias("w")
    ).persist()
    try:
        total = data.agg(F.sum("w")).first()[0]
        model = LogisticRegression(
            maxIter=max_iter, regParam=1.0 / (c * total), standardization=False, weightCol="w"
        ).fit(data)
        require(model.summary.totalIterations < max_iter, f"no convergence in {max_iter} steps")
        return model
    finally:
        data.unpersist()


NEWTON_WIDTH = 512


def fit_logistic_groups(train: DataFrame, by: str, vec: str, y: str, balanced: bool = False,
                        c: float = 1.0, max_iter: int = 50, tol: float = 1e-7) -> dict:
    """One L2 logistic fit per value of ``by``, all groups together.

    Newton steps: each task adds up gradient and curvature of its rows (d x d
    numbers per group, so for widths up to NEWTON_WIDTH), Spark adds the tasks
    up, and only the d coefficients of each group live on the driver. A step
    that does not lower the loss is halved. Returns {group: coefficients}, the
    intercept last.
    """
    data = train.select(by, F.col(vec).cast("array<double>").alias("x"), truth(F.col(y)).alias("label")).persist()
    try:
        sizes = data.groupBy(by).agg(
            count_if(F.col("label")).alias("p"), F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")
        ).collect()
        width = max(r.d for r in sizes) + 1
        weights = {
            r[by]: (r.n / (2.0 * max(r.n - r.p, 1)), r.n / (2.0 * max(r.p, 1))) if balanced else (1.0, 1.0)
            for r in sizes
        }
        beta = {g: np.zeros(width) for g in weights}
        tried, loss, step = dict(beta), {g: np.inf for g in beta}, {}
        active, upper = set(beta), np.triu_indices(width)
        for _ in range(max_iter):
            sums = _newton_sums(data.where(F.col(by).isin(list(active))), by, tried, weights, upper)
            for g in list(active):
                got = sums[g]
                at = got[0] + 0.5 / c * float(tried[g][:-1] @ tried[g][:-1])
                if at > loss[g] + 1e-12:
                    step[g] = step[g] / 2
                    tried[g] = beta[g] + step[g]
                    if np.max(np.abs(step[g])) < tol:
                        active.discard(g)
                    continue
                loss[g], beta[g] = at, tried[g]
                ridge = np.r_[np.ones(width - 1), 0.0] / c
                grad = got[1 : width + 1] + ridge * beta[g]
                curve = np.zeros((width, width))
                curve[upper] = got[width + 1 :]
                curve = curve + np.triu(curve, 1).T + np.diag(ridge)
                step[g] = -np.linalg.lstsq(curve, grad, rcond=None)[0]
                tried[g] = beta[g] + step[g]
                if np.max(np.abs(step[g])) < tol:
                    beta[g] = tried[g]
                    active.discard(g)
            if not active:
                break
        require(not active, f"no convergence in {max_iter} Newton steps for {sorted(map(str, active))}")
        return beta
    finally:
        data.unpersist()


def _newton_sums(data: DataFrame, by: str, beta: dict, weights: dict, upper) -> dict:
    """{group: [loss, gradient..., upper curvature...]} at the given coefficients."""
    def kernel(batches):
        acc: dict = {}
        for batch in batches:
            for g, part in batch.groupby(by):
                x = np.column_stack([np.array(part["x"].tolist(), dtype=float), np.ones(len(part))])
                hit = part["label"].to_numpy(dtype=bool)
                w = np.where(hit, weights[g][1], weights[g][0])
                z = x @ beta[g]
                p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
                loss = float(w @ (np.logaddexp(0.0, z) - hit * z))
                curve = (x * (w * p * (1 - p))[:, None]).T @ x
                row = np.r_[loss, x.T @ (w * (p - hit)), curve[upper]]
                acc[g] = acc[g] + row if g in acc else row
        if acc:
            yield pd.DataFrame({by: list(acc), "v": list(acc.values())})

    kind = data.schema[by].dataType.simpleString()
    parts = data.mapInPandas(kernel, f"`{by}` {kind}, v array<double>")
    total = parts.select(by, F.posexplode("v").alias("i", "x")).groupBy(by, "i").agg(F.sum("x").alias("x"))
    got = total.toPandas().sort_values("i")
    return {g: part["x"].to_numpy() for g, part in got.groupby(by)}


def logistic_scores(rows: DataFrame, vec: str, y: str, seed_col: str = "seed", split: str = "split",
                    balanced: bool = False) -> tuple[DataFrame, list[dict]]:
    """Validation and test rows scored by a logistic fit per seed, and the checkpoints.

    Each checkpoint holds coef, intercept and the scaler state (d numbers each);
    scoring runs as column arithmetic for all seeds in one pass.
    """
    # Scaler, fits and scoring all read the split rows.
    rows = settle(rows)
    train = rows.where(F.col(split) == "train")
    state = standardizer_state(fit_standardizer(train, [seed_col], vec), [seed_col])
    stats = {r[seed_col]: r for r in state.collect()}
    kind = rows.schema[seed_col].dataType.simpleString()
    spark = rows.sparkSession
    known = small_table(
        spark, [{seed_col: s, "mean": list(r.mean), "sd": list(r.sd)} for s, r in stats.items()],
        f"`{seed_col}`: {kind}, mean: array<double>, sd: array<double>",
    )
    scaled = standardize(train, known, [seed_col], vec)
    if max(len(r.mean) for r in stats.values()) <= NEWTON_WIDTH:
        fits = fit_logistic_groups(scaled, seed_col, vec, y, balanced)
    else:
        wide = scaled.withColumn("features", array_to_vector(F.col(vec)))
        fits = {}
        for s in stats:
            model = fit_logistic(wide.where(F.col(seed_col) == s), "features", y, balanced)
            fits[s] = np.r_[np.array(model.coefficients), model.intercept]
    points = [
        {seed_col: s, "coef": [float(v) for v in fits[s][:-1]], "intercept": float(fits[s][-1]),
         "mean": list(stats[s].mean), "sd": list(stats[s].sd)}
        for s in sorted(stats)
    ]
    saved = small_table(
        spark, points,
        f"`{seed_col}`: {kind}, coef: array<double>, intercept: double, mean: array<double>, sd: array<double>",
    )
    return apply_probes(rows.where(F.col(split) != "train"), saved, vec, [seed_col]), points


def apply_probes(rows: DataFrame, probes: DataFrame, vec: str, by: list[str]) -> DataFrame:
    """Adds ``score`` from stored probes, using the probe's own scaler. Nothing is refitted."""
    got = standardize(rows, probes.select(*by, "mean", "sd"), by, vec)
    both = join_on(got, probes.select(*by, "coef", "intercept"), by)
    return both.withColumn("score", linear_score(F.col(vec), F.col("coef"), F.col("intercept"))).drop(
        "coef", "intercept"
    )


def network_scores(rows: DataFrame, vec: str, y: str, budgets: tuple[int, ...] = (20, 60),
                   hidden: tuple[int, ...] = (256, 64), split: str = "split", seed: int = 0) -> DataFrame:
    """Validation and test rows scored by a 256-64 network.

    Classes are balanced by repeating rows of the rarer class; the iteration
    budget is the one with the best validation AUROC (the first on ties).
    """
    train = rows.where(F.col(split) == "train")
    state = standardizer_state(fit_standardizer(train, [], vec), [])
    data = standardize(rows, state, [], vec).withColumn("features", array_to_vector(F.col(vec)))
    data = data.withColumn("label", truth(F.col(y)).cast("double"))
    n = train.agg(count_if(truth(F.col(y))).alias("p"), F.count(F.lit(1)).alias("n")).first()
    rare, times = (n.p <= n.n - n.p), max(1, round(max(n.p, n.n - n.p) / max(1, min(n.p, n.n - n.p))))
    copies = F.when(truth(F.col(y)) == F.lit(rare), F.lit(times)).otherwise(F.lit(1))
    fit_on = data.where(F.col(split) == "train").withColumn(
        "__copy", F.explode(F.sequence(F.lit(1), copies))
    ).select("features", "label")
    width = len(data.select(vec).first()[0])
    best = None
    for budget in budgets:
        model = MultilayerPerceptronClassifier(
            layers=[width, *hidden, 2], maxIter=budget, seed=seed, blockSize=128
        ).fit(fit_on)
        scored = model.transform(data.where(F.col(split) != "train")).withColumn(
            "score", vector_to_array("probability")[1]
        )
        val = auroc(scored.where(F.col(split) == "val"), [], y, "score").first().auroc
        val = -1.0 if val is None else val
        if best is None or val > best[0]:
            best = (val, budget, scored)
    return best[2].withColumn("budget", F.lit(best[1])).drop(
        "features", "label", "rawPrediction", "probability", "prediction"
    )


def cross_fit(df: DataFrame, features: list[str], y: str, fold: str = "fold", out: str = "score",
              by: list[str] | None = None) -> DataFrame:
    """Out-of-fold least squares with an intercept.

    One pass adds up the cross products of every fold; the fit of "all other
    folds" is the total minus the fold, solved from a small d x d system.
    """
    by = by or []
    cols = ["__one", *features, "__y"]
    data = df.withColumn("__one", F.lit(1.0)).withColumn("__y", F.col(y).cast("double"))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    sums = data.groupBy(*by, fold).agg(
        *[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"p{i}_{j}") for i, j in pairs]
    ).collect()
    grams: dict[tuple, dict] = {}
    for r in sums:
        m = np.zeros((len(cols), len(cols)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"p{i}_{j}"]
        grams.setdefault(tuple(r[c] for c in by), {})[r[fold]] = m
    rows = []
    for key, parts in grams.items():
        total = sum(parts.values())
        for k, part in parts.items():
            fit = {f"__c{i}": float(v) for i, v in enumerate(_solve(total - part))}
            rows.append({**dict(zip(by, key)), fold: k, **fit})
    kinds = {c: df.schema[c].dataType.simpleString() for c in [*by, fold]}
    kinds.update({f"__c{i}": "double" for i in range(len(features) + 1)})
    coefs = small_table(df.sparkSession, rows, ", ".join(f"`{a}`: {b}" for a, b in kinds.items()))
    fitted = join_on(df, coefs, by + [fold])
    value = F.col("__c0")
    for i, name in enumerate(features, 1):
        value = value + F.col(f"__c{i}") * F.col(name)
    return fitted.withColumn(out, value).drop(*[f"__c{i}" for i in range(len(features) + 1)])


def _solve(gram: np.ndarray) -> np.ndarray:
    """Intercept and slopes from the cross products of (1, x..., y), least norm if collinear."""
    n, sx, sy = gram[0, 0], gram[0, 1:-1], gram[0, -1]
    if n == 0:
        return np.zeros(len(sx) + 1)
    xx = gram[1:-1, 1:-1] - np.outer(sx, sx) / n
    xy = gram[1:-1, -1] - sx * sy / n
    scale = np.sqrt(np.maximum(np.diag(xx), 0))
    scale[scale < 1e-12] = 1.0
    slopes = np.linalg.pinv(xx / np.outer(scale, scale), rcond=1e-11) @ (xy / scale) / scale
    return np.r_[(sy - sx @ slopes) / n, slopes]
