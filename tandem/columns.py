"""Small DataFrame helpers used by all operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import plan_bytes, settle


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def ratio(num: Column, den: Column) -> Column:
    """num / den as DOUBLE, NULL where den is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def truth(col: Column) -> Column:
    """A missing flag counts as false."""
    return F.coalesce(col.cast("boolean"), F.lit(False))


def gain(off: str, on: str) -> Column:
    return truth(F.col(on)).cast("int") - truth(F.col(off)).cast("int")


def join_on(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that treats null keys as equal and keeps one copy of the keys.

    Without keys the right side must be a single row.
    """
    if not cols:
        return left.crossJoin(right)
    renamed = reduce(lambda d, c: d.withColumnRenamed(c, f"__r_{c}"), cols, right)
    cond = reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in cols]
    )
    return left.join(renamed, cond, how).drop(*[f"__r_{c}" for c in cols])


def _joins(df: DataFrame) -> bool:
    """Whether a plan may give more than its leaves hold: only filters and plain columns may not."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.children().size() == 1 and node.nodeName() in ("Filter", "Project"):
        node = node.children().head()
    return node.children().size() > 0


ATTACH_BYTES = 8 * 1024 * 1024
SALTS = 32


def attach(rows: DataFrame, groups: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``groups``, a table of one row per key, without shuffling rows on a hot key.

    Unless it is read from a small written table as it is, the table is written
    out, so that its real size is known. If it is small it is broadcast; else every key is repeated under a few salts that rows are dealt to.
    """
    table = groups if plan_bytes(groups) <= ATTACH_BYTES and not _joins(groups) else settle(groups)
    if plan_bytes(table) <= ATTACH_BYTES:
        return join_on(rows, F.broadcast(table), by, how)
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return join_on(dealt, salted, [*by, "__salt"], how).drop("__salt")


def cube_level(df: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Overall row plus one row per key value, in one pass (GROUPING SETS).

    The ``level`` column is ``overall`` or ``group``.
    """
    sets = [[], [F.col(k) for k in keys]]
    out = df.groupingSets(sets, *[F.col(k) for k in keys]).agg(
        F.grouping(keys[0]).alias("__g"), *aggs
    )
    return out.withColumn(
        "level", F.when(F.col("__g") == 1, "overall").otherwise("group")
    ).drop("__g")
