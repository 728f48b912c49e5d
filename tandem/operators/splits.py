"""Seeded splits, folds, shuffles and group heads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered


def stratified_split(
    df: DataFrame, by: list[str], y: str, seed, row_id: str,
    fractions: tuple[float, float] = (0.6, 0.2), out: str = "split",
) -> DataFrame:
    """train / val / test within each class: round(f * n) rows each, the rest is test."""
    placed = numbered(df, by + [y], seed, row_id, "__rn")
    n_train = F.bround(F.col("tot___rn") * fractions[0])
    n_val = F.bround(F.col("tot___rn") * fractions[1])
    return placed.withColumn(
        out,
        F.when(F.col("__rn") <= n_train, "train")
        .when(F.col("__rn") <= n_train + n_val, "val")
        .otherwise("test"),
    ).drop("__rn", "tot___rn")


def seed_splits(df: DataFrame, seeds: list[int], y: str, row_id: str) -> DataFrame:
    """Every row once per seed with its split; the seed is a column, not a loop."""
    fanned = df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    return stratified_split(fanned, ["seed"], y, F.col("seed"), row_id)


def folds(df: DataFrame, by: list[str], k: int, seed, row_id: str, out: str = "fold") -> DataFrame:
    """k near-equal folds (0-based) of a seeded shuffle; the first ones take the remainder."""
    placed = numbered(df, by, seed, row_id, "__rn")
    size, extra = F.floor(F.col("tot___rn") / k), F.col("tot___rn") % k
    big = extra * (size + 1)
    at = F.col("__rn") - 1
    fold = F.when(at < big, F.floor(at / (size + 1))).otherwise(
        extra + F.floor(F.try_divide(at - big, size))
    )
    return placed.withColumn(out, fold.cast("int")).drop("__rn", "tot___rn")


def round_robin(df: DataFrame, index: str, shard: int, shards: int) -> DataFrame:
    """Row i belongs to shard i mod shards."""
    return df if shards <= 1 else df.where(F.pmod(F.col(index), F.lit(shards)) == shard)


def shuffled_prefix(df: DataFrame, n: int, seed, row_id: str) -> DataFrame:
    """The first n rows of a seeded shuffle, with their ``position``; 0 keeps all."""
    placed = numbered(df, [], seed, row_id, "position").drop("tot_position")
    return placed if n <= 0 else placed.where(F.col("position") <= n)


def group_head(df: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """The first k rows of each group. Spark limits each task's rows before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")
