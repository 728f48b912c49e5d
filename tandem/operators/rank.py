"""Rank statistics on score cells.

Rows are first collapsed to one cell per distinct score (map-side combined),
so ties cost nothing and the order work sees only distinct scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checks import no_nan
from ..columns import attach, count_if, join_on, ratio, truth
from ..session import settle
from .ordered import HIGH_BITS, LOW_BITS, order_key, running

HOT_TIE = 1 << 12  # rows of one score that a task may order by itself


def score_cells(df: DataFrame, by: list[str], y: str, score: str) -> DataFrame:
    """One row per (by, score): ``p`` positives, ``n`` negatives, as DOUBLE."""
    s = no_nan(F.col(score).cast("double"), "scores")
    hit = truth(F.col(y))
    return df.groupBy(*by, s.alias("score")).agg(
        count_if(hit).cast("double").alias("p"), count_if(~hit).cast("double").alias("n")
    )


def concordance(cells: DataFrame, by: list[str]) -> DataFrame:
    """by..., p, n, u: counts and the number of concordant (pos, neg) pairs, ties half.

    A run of neighbouring scores is summarised by (p, n, u), and two runs merge
    as u = u1 + u2 + p2 * n1. Groups merge in three rounds (cells into
    blocks, blocks into blocks, blocks into the group); nothing is joined.
    """
    out = cells.select(*by, "score", "p", "n", (F.col("p") * F.col("n") / 2).alias("u"))
    out = out.withColumn("__k", order_key(F.col("score")))
    for at, shift in (("__k", LOW_BITS), ("__b1", HIGH_BITS - LOW_BITS), ("__b2", None)):
        up = {"__k": "__b1", "__b1": "__b2"}.get(at)
        if shift is not None:
            out = out.withColumn(up, F.shiftright(at, shift))
        keys = by + ([up] if shift is not None else [])
        before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        seen = F.coalesce(F.sum("n").over(before), F.lit(0.0))
        out = (
            out.withColumn("__seen", seen)
            .groupBy(*keys)
            .agg(
                F.sum("p").alias("p"),
                F.sum("n").alias("n"),
                F.sum(F.col("u") + F.col("p") * F.col("__seen")).alias("u"),
            )
        )
    return out


def auroc(
    df: DataFrame, by: list[str], y: str, score: str
) -> DataFrame:
    """by..., n_pos, n_neg, auroc (NULL when a class is missing)."""
    got = concordance(score_cells(df, by, y, score), by)
    return got.select(
        *by,
        F.col("p").cast("bigint").alias("n_pos"),
        F.col("n").cast("bigint").alias("n_neg"),
        F.try_divide("u", F.col("p") * F.col("n")).alias("auroc"),
    )


def within_group(
    df: DataFrame, by: list[str], group: str, y: str, score: str
) -> DataFrame:
    """Concordance pooled over pairs of the same group, with group and pair counts."""
    keyed = df.withColumn("__grp", F.coalesce(F.col(group).cast("string"), F.lit("None")))
    got = concordance(score_cells(keyed, by + ["__grp"], y, score), by + ["__grp"])
    pairs = F.col("p") * F.col("n")
    return got.groupBy(*by).agg(
        ratio(F.sum("u"), F.sum(pairs)).alias("auroc"),
        F.count(F.lit(1)).alias("n_groups"),
        count_if(pairs > 0).alias("n_informative_groups"),
        F.sum(pairs).cast("bigint").alias("n_pairs"),
    )


def average_ranks(
    df: DataFrame, by: list[str], score: str, out: str = "rank"
) -> DataFrame:
    """Every row with its 1-based rank; ties share the mean rank."""
    cells = df.groupBy(*by, F.col(score)).agg(F.count(F.lit(1)).alias("__c"))
    ranked = running(cells, by, score, ["__c"]).select(
        *by, score, (F.col("cum___c") - (F.col("__c") - 1) / 2.0).alias(out)
    )
    return join_on(df, ranked, by + [score])


def average_precision(
    df: DataFrame, by: list[str], y: str, score: str, row_id: str
) -> DataFrame:
    """by..., auprc. Ties are read in ``row_id`` order, as a stable sort would."""
    rows = df.select(
        *by, F.col(score).cast("double").alias("s"), row_id, truth(F.col(y)).cast("bigint").alias("hit")
    ).withColumn("one", F.lit(1).cast("bigint"))
    cells = settle(rows.groupBy(*by, "s").agg(F.sum("hit").alias("h"), F.sum("one").alias("c")))
    above = running(cells, by, "s", ["h", "c"], descending=True).select(
        *by,
        "s",
        (F.col("cum_h") - F.col("h")).alias("h0"),
        (F.col("cum_c") - F.col("c")).alias("c0"),
        F.col("tot_h").alias("pos"),
    )
    # A tie of up to HOT_TIE rows is one array; only larger ones are ordered across tasks, row by row.
    hot = cells.where(F.col("c") > HOT_TIE).select(*by, "s", F.lit(True).alias("hot"))
    marked = attach(rows, hot, [*by, "s"], "left")
    tied = marked.where("hot is null").groupBy(*by, "s").agg(F.array_sort(F.collect_list(F.struct(row_id, "hit"))).alias("t"))
    nothing = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("j"))

    def read(acc, x):
        k, j = acc["k"] + x["hit"], acc["j"] + 1
        value = F.when(x["hit"] == 1, (F.col("h0") + k) / (F.col("c0") + j)).otherwise(0.0)
        return F.struct((acc["sum"] + value).alias("sum"), k.alias("k"), j.alias("j"))

    few = join_on(tied, above, [*by, "s"]).select(*by, "pos", F.aggregate("t", nothing, read, lambda acc: acc["sum"]).alias("v"))
    inside = running(marked.where("hot").drop("hot"), by + ["s"], row_id, ["hit", "one"])
    at = join_on(inside, above, by + ["s"])
    precision = (F.col("h0") + F.col("cum_hit")) / (F.col("c0") + F.col("cum_one"))
    many = at.select(*by, "pos", F.when(F.col("hit") == 1, precision).alias("v"))
    return few.unionByName(many).groupBy(*by).agg(ratio(F.sum("v"), F.max("pos")).alias("auprc"))


def rank_correlation(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Spearman: the correlation of average ranks."""
    ranked = average_ranks(average_ranks(df, by, a, "__ra"), by, b, "__rb")
    return ranked.groupBy(*by).agg(F.corr("__ra", "__rb").alias("spearman"))
