"""Ordered work on groups of any size: running sums, row numbers, exact quantiles.

A window over one huge group would run in one task. Instead a number is mapped
to a 64-bit integer with the same order and cut into blocks by its leading
bits: sums are taken per block, then per block of blocks, and the offsets are
joined back. The cut depends on the value alone, so a retried task sees the
same blocks, and no window over numbers ever holds more than 2^24 rows. Texts
are cut at splitters, a sorted sample of themselves, so that blocks have about
``PER_BLOCK`` rows whatever the texts begin with.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import join_on
from ..functions.rand import hash32, seeded

LOW_BITS, HIGH_BITS = 20, 40
PER_BLOCK = 20_000  # texts between two splitters
MOST_SPLITTERS, OVERSAMPLE = 1 << 16, 8  # bound of what the driver gathers: their product
_MIN_NORMAL = 2.2250738585072014e-308
_UNBOUNDED = Window.unboundedPreceding


def order_key(col: Column) -> Column:
    """Order-preserving bigint of a double: its IEEE bits, negated below zero."""
    mag = F.abs(col)
    guess = F.floor(F.log2(mag)).cast("int")
    lead = mag / F.pow(F.lit(2.0), guess.cast("double"))
    # log2 may round across a power of two; the exact mantissa shows it.
    exp = guess + F.when(lead >= 2.0, 1).when(lead < 1.0, -1).otherwise(0)
    mant = mag / F.pow(F.lit(2.0), exp.cast("double"))
    two52 = 4503599627370496
    normal = (exp + 1023).cast("bigint") * F.lit(two52) + (
        (mant - 1.0) * F.lit(float(two52))
    ).cast("bigint")
    tiny = (mag * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint")
    bits = (
        F.when(mag == float("inf"), F.lit(2047 * two52))
        .when(mag < _MIN_NORMAL, tiny)
        .otherwise(normal)
    )
    return F.when(col < 0, -bits).otherwise(bits)


def splitters(df: DataFrame, order: str) -> list[str]:
    """Texts that cut a column into runs of about PER_BLOCK rows: every eighth of a sample chosen by hash, in order."""
    rows = df.count()
    wanted = min(MOST_SPLITTERS, rows // PER_BLOCK)
    if not wanted:
        return []
    share = 1 << 20
    per_row = F.pmod(F.xxhash64(order), F.lit(share))
    picked = F.col(order).isNotNull() & (per_row < F.ceil(F.lit(share * OVERSAMPLE * wanted) / F.lit(rows)))
    found = sorted(r[0] for r in df.where(picked).select(order).distinct().collect())
    return found[OVERSAMPLE - 1 :: OVERSAMPLE]


def text_key(df: DataFrame, order: str) -> Column:
    """Bigint that never falls from one text to the next: the number of splitters up to it."""
    cuts = df.sparkSession.sparkContext.broadcast(np.array(splitters(df, order), dtype=object))

    @F.pandas_udf("bigint")
    def block(texts: pd.Series) -> pd.Series:
        # Code points compare as the bytes of UTF-8 do; a null goes before all texts.
        return pd.Series(np.searchsorted(cuts.value, texts.fillna("").to_numpy(object), side="right").astype(np.int64) << LOW_BITS)

    return block(F.col(order)) if len(cuts.value) else F.lit(0).cast("bigint")


def _key(df: DataFrame, order: str) -> Column:
    """Blocks only need a key that never decreases; inside a block the value itself is ordered."""
    kind = dict(df.dtypes)[order]
    if kind in ("bigint", "int", "smallint", "tinyint"):
        return F.col(order).cast("bigint")
    if kind == "string":
        return text_key(df, order)
    return order_key(F.col(order).cast("double"))


def running(
    df: DataFrame,
    by: list[str],
    order: str,
    sums: list[str],
    descending: bool = False,
    few: bool = False,
) -> DataFrame:
    """Inclusive running sum ``cum_<c>`` and group total ``tot_<c>`` of each column.

    ``df`` has at most one row per (by, order) value. ``few`` says that the
    order column only takes a handful of values whatever the data (a gain of
    -1, 0 or 1), so that one window per group is enough.
    """
    if few:
        head = F.col(order).desc() if descending else F.col(order).asc()
        local = Window.partitionBy(*by).orderBy(head).rowsBetween(_UNBOUNDED, 0)
        whole = Window.partitionBy(*by)
        return df.select(
            "*",
            *[F.sum(c).over(local).alias(f"cum_{c}") for c in sums],
            *[F.sum(c).over(whole).alias(f"tot_{c}") for c in sums],
        )

    def before(keys, at):
        head = F.col(at).desc() if descending else F.col(at).asc()
        return Window.partitionBy(*keys).orderBy(head).rowsBetween(_UNBOUNDED, -1)

    keyed = df.withColumn("__k", _key(df, order))
    keyed = keyed.withColumn("__b1", F.shiftright("__k", LOW_BITS)).withColumn(
        "__b2", F.shiftright("__k", HIGH_BITS)
    )
    mid = keyed.groupBy(*by, "__b2", "__b1").agg(*[F.sum(c).alias(c) for c in sums])
    top = mid.groupBy(*by, "__b2").agg(*[F.sum(c).alias(c) for c in sums])
    top = top.select(
        *by,
        "__b2",
        *[
            F.coalesce(F.sum(c).over(before(by, "__b2")), F.lit(0)).alias(f"__t_{c}")
            for c in sums
        ],
        *[F.sum(c).over(Window.partitionBy(*by)).alias(f"tot_{c}") for c in sums],
    )
    mid = mid.select(
        *by,
        "__b2",
        "__b1",
        *[
            F.coalesce(F.sum(c).over(before(by + ["__b2"], "__b1")), F.lit(0)).alias(f"__m_{c}")
            for c in sums
        ],
    )
    offsets = join_on(mid, top, by + ["__b2"]).drop("__b2")
    head = F.col(order).desc() if descending else F.col(order).asc()
    local = Window.partitionBy(*by, "__b1").orderBy(head).rowsBetween(_UNBOUNDED, 0)
    keyed = keyed.select(
        *[c for c in keyed.columns if c not in ("__k", "__b2")],
        *[F.sum(c).over(local).alias(f"__l_{c}") for c in sums],
    )
    out = join_on(keyed, offsets, by + ["__b1"])
    return out.select(
        *df.columns,
        *[(F.col(f"__l_{c}") + F.col(f"__m_{c}") + F.col(f"__t_{c}")).alias(f"cum_{c}") for c in sums],
        *[F.col(f"tot_{c}") for c in sums],
    )


def numbered(
    df: DataFrame,
    by: list[str],
    seed,
    row_id: str,
    out: str = "rn",
) -> DataFrame:
    """1-based position of each row in a seeded shuffle of its group, and ``tot_<out>``.

    The shuffle order is (hash of seed and id, id). Groups are ranked
    inside 2^16 equal hash slices; a slice's offset comes from slice counts.
    """
    hashed = df.withColumn("__h", hash32(seeded(seed, row_id)))
    order = [F.col("__h"), F.col(row_id)]
    hashed = hashed.withColumn("__s", F.shiftright("__h", 16))
    counts = hashed.groupBy(*by, "__s").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__s").rowsBetween(_UNBOUNDED, -1)
    offsets = counts.select(
        *by,
        "__s",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"),
        F.sum("__n").over(Window.partitionBy(*by)).alias(f"tot_{out}"),
    )
    local = hashed.withColumn(
        "__r", F.row_number().over(Window.partitionBy(*by, "__s").orderBy(*order))
    )
    return join_on(local, offsets, by + ["__s"]).select(
        *df.columns, (F.col("__r") + F.col("__o")).cast("bigint").alias(out), f"tot_{out}"
    )


def quantiles(
    df: DataFrame, by: list[str], col: str, probs: list[float], weight: str | None = None
) -> DataFrame:
    """Exact linear-interpolated quantiles: by..., ``i`` (index into probs), ``q``, ``value``.

    ``weight`` is a column of whole row counts, where rows are already collapsed.

    Read off running counts of the distinct values, so no group is gathered. The
    interpolation starts from the nearer neighbour, which keeps a quantile that
    falls on a value equal to that value.
    """
    cells = (
        df.where(F.col(col).isNotNull())
        .groupBy(*by, F.col(col).cast("double").alias("__x"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("__n"))
    )
    ranked = running(cells, by, "__x", ["__n"])
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("q")) for i, p in enumerate(probs)])
    pos = (F.col("tot___n") - 1) * F.col("p.q")
    lo, hi = F.floor(pos), F.ceil(pos)
    first, last = F.col("cum___n") - F.col("__n"), F.col("cum___n") - 1
    # Every probability meets the one or two value cells that hold its neighbours.
    hit = ranked.withColumn("p", F.explode(wanted)).where(
        lo.between(first, last) | hi.between(first, last)
    )
    ends = hit.groupBy(*by, F.col("p.i").alias("i"), F.col("p.q").alias("q")).agg(
        F.max(F.when(lo.between(first, last), F.col("__x"))).alias("a"),
        F.max(F.when(hi.between(first, last), F.col("__x"))).alias("b"),
        F.max(pos - lo).alias("t"),
    )
    step = F.col("b") - F.col("a")
    value = F.when(F.col("t") < 0.5, F.col("a") + step * F.col("t")).otherwise(
        F.col("b") - step * (1 - F.col("t"))
    )
    return ends.select(*by, "i", "q", value.alias("value"))
