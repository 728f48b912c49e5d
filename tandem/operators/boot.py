"""Bootstrap intervals.

Two resamplers:

* exact: as many draws with replacement as rows, in every stratum, by a tree of
  binomial splits;
* Poisson: every row is drawn Poisson(1) times. Rows that look the same to the
  statistic form one cell, and a cell of c rows is drawn Poisson(c) times, so
  the work grows with distinct cells and not with rows.

A draw depends only on (seed, replicate, key), so all statistics of one seed
share their resamples, and retries or other partitionings change nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checks import no_nan
from ..columns import count_if, join_on, ratio, truth
from ..functions.rand import multinomial_weights, poisson_weights
from ..session import settle
from .ordered import numbered, running
from .curves import nauc, normalised, segments
from .rank import auroc, concordance

_ELEMENTS = 1 << 19  # weights held at once by one task


# --- exact resampling ------------------------------------------------------

def _placed(cell_df: DataFrame, strata: list[str], key: str, seed: int) -> DataFrame:
    """Cells with the rows they hold of their stratum: [__a, __z) of __n, in an order by the hash of their key."""
    ranked = numbered(cell_df, strata, f"{seed}:pos", key, "__rn")
    spot = running(ranked, strata, "__rn", ["c"])
    text_of = F.concat_ws(":", *[F.coalesce(F.col(s).cast("string"), F.lit("")) for s in strata]) if strata else F.lit("")
    return spot.select(
        *cell_df.columns, text_of.alias("__stratum"), (F.col("cum_c") - F.col("c")).alias("__a"),
        F.col("cum_c").alias("__z"), F.col("tot_c").alias("__n"),
    )


def _in_order(placed: DataFrame) -> DataFrame:
    """Neighbouring cells in one task: they share most of their way down the tree."""
    n_parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(n_parts, "__stratum", "__a").sortWithinPartitions("__stratum", "__a")


def _tree_weights(pdf: pd.DataFrame, n_boot: int, seed: int, first: int = 0) -> np.ndarray:
    out = np.zeros((len(pdf), n_boot))
    for (stratum,), at in _groups(pdf, ["__stratum"]):
        own = pdf.iloc[at]
        out[at] = multinomial_weights(
            stratum, int(own["__n"].iloc[0]), own["__a"].to_numpy(np.int64), own["__z"].to_numpy(np.int64), n_boot, seed, first
        )
    return out


def exact_weights(
    df: DataFrame, strata: list[str], row_id: str, n_boot: int, seed: int = 0
) -> DataFrame:
    """Rows of each replicate with their multiplicity: (df columns, b, w).

    Every replicate draws as many rows of each stratum as there are, with
    replacement. Tasks derive the draws of their own rows (see
    functions.rand.multinomial_weights); no draw is shuffled.
    """
    src = _in_order(_placed(df.withColumn("c", F.lit(1).cast("bigint")), strata, row_id, seed))
    helpers = ["c", "__stratum", "__a", "__z", "__n"]
    schema = T.StructType(_fields(df, df.columns) + [T.StructField("b", T.IntegerType()), T.StructField("w", T.LongType())])

    def kernel(batches):
        for batch in batches:
            for pdf in _chunks(batch, n_boot):
                w = _tree_weights(pdf, n_boot, seed).astype(np.int64)
                i, b = np.nonzero(w)
                out = pdf.drop(columns=helpers).iloc[i]
                yield out.assign(b=b.astype(np.int32), w=w[i, b])

    return src.mapInPandas(kernel, schema)


def exact_sums(
    cell_df: DataFrame, by: list[str], strata: list[str], sums: dict[str, Column], n_boot: int, seed: int = 0
) -> DataFrame:
    """As replicate_sums, from exact resamples of the rows in the cells (``c``, ``key``).

    Each group of ``by`` and, inside it, each stratum keeps its number of rows in
    every replicate: the cells of a stratum are drawn multinomially.
    """
    return _summed(_in_order(_placed(cell_df, [*by, *strata], "key", seed)), by, sums, n_boot, ["__stratum", "__a", "__z", "__n"],
                   lambda pdf: _tree_weights(pdf, n_boot, seed))


# --- Poisson resampling ----------------------------------------------------

def cells(df: DataFrame, by: list[str], cols: list[str], row_id: str) -> DataFrame:
    """Distinct (by, cols) with their row count ``c`` and the smallest row id ``key``."""
    return df.groupBy(*by, *[c for c in cols if c not in by]).agg(
        F.count(F.lit(1)).alias("c"), F.min(row_id).alias("key")
    )


def _chunks(pdf: pd.DataFrame, n_boot: int) -> Iterator[pd.DataFrame]:
    step = max(1, _ELEMENTS // n_boot)
    for at in range(0, len(pdf), step):
        yield pdf.iloc[at : at + step]


def _fields(df: DataFrame, names: list[str]) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def replicate_sums(
    cell_df: DataFrame, by: list[str], sums: dict[str, Column], n_boot: int, seed: int = 0
) -> DataFrame:
    """by..., b and, per replicate, the weighted sum of each per-row value in ``sums``.

    Tasks add up their own cells first; only (by, b) partial sums are shuffled.
    """
    src = cell_df.withColumn("key", F.col("key").cast("string"))
    return _summed(src, by, sums, n_boot, ["c", "key"], lambda pdf: poisson_weights(pdf["key"].to_numpy(), pdf["c"].to_numpy(), n_boot, seed))


def _summed(cell_df: DataFrame, by: list[str], sums: dict[str, Column], n_boot: int, used: list[str], weights: Callable) -> DataFrame:
    """Sums over cells by the weights (cells x replicates) that ``weights`` gives for the columns ``used``."""
    names = list(sums)
    src = cell_df.select(*by, *used, *[v.cast("double").alias(n) for n, v in sums.items()])
    schema = T.StructType(
        _fields(src, by)
        + [T.StructField("b", T.IntegerType())]
        + [T.StructField(n, T.DoubleType()) for n in names]
    )

    def emit(acc):
        for group, mat in acc.items():
            out = pd.DataFrame(mat, columns=names)
            for name, value in zip(by, group):
                out[name] = [value] * n_boot
            out["b"] = np.arange(n_boot, dtype=np.int32)
            yield out[by + ["b"] + names]

    def kernel(batches):
        acc: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for pdf in _chunks(batch, n_boot):
                w = weights(pdf)
                vals = pdf[names].to_numpy(dtype=float)
                for group, at in _groups(pdf, by):
                    part = w[at].T @ vals[at]
                    acc[group] = acc[group] + part if group in acc else part
            if len(acc) > 256:
                yield from emit(acc)
                acc = {}
        yield from emit(acc)

    parts = src.mapInPandas(kernel, schema)
    return parts.groupBy(*by, "b").agg(*[F.sum(n).alias(n) for n in names])


def _groups(pdf: pd.DataFrame, by: list[str]):
    """(key tuple, row positions) in order of first appearance; groups that lie together come as slices."""
    if not by:
        yield (), slice(0, len(pdf))
        return
    codes = pdf.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
    step = np.diff(codes)
    together = not (step < 0).any()
    order = np.arange(len(codes)) if together else np.argsort(codes, kind="stable")
    edges = np.r_[0, np.flatnonzero(step if together else np.diff(codes[order])) + 1, len(codes)]
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
        key = tuple(None if pd.isna(v) else v for v in (pdf[c].iloc[order[a]] for c in by))
        yield key, slice(a, z) if together else order[a:z]


def replicate_pairs(
    cell_df: DataFrame, by: list[str], y: str, score: str, n_boot: int, seed: int = 0
) -> DataFrame:
    """by..., b, p, n, u of every replicate (see rank.concordance).

    Cells are range-partitioned by score, also within ties, so a hot score or
    group is spread over tasks. A task reports one run of whole scores and, at
    its two ends, scores it may share with a neighbour; those are added up
    before the runs are merged in score order.
    """
    s = no_nan(F.col(score).cast("double"), "scores")
    src = cell_df.select(
        *by, s.alias("s"), truth(F.col(y)).alias("y"), "c", F.col("key").cast("string").alias("key")
    )
    n_parts = int(cell_df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = src.repartitionByRange(n_parts, *by, "s", "key").sortWithinPartitions(*by, "s")
    schema = T.StructType(
        _fields(src, by)
        + [T.StructField("b", T.IntegerType()), T.StructField("lo", T.DoubleType()),
           T.StructField("tie", T.BooleanType())]
        + [T.StructField(n, T.DoubleType()) for n in "pnu"]
    )

    def rows(group, lo, tie, p, n, u):
        out = pd.DataFrame({"lo": lo, "tie": tie, "p": p, "n": n, "u": u})
        for name, value in zip(by, group):
            out[name] = [value] * n_boot
        out["b"] = np.arange(n_boot, dtype=np.int32)
        return out[by + ["b", "lo", "tie", "p", "n", "u"]]

    def close(group, state):
        yield rows(group, state["first"][0], True, *state["first"][1:], 0.0)
        if state["last"] is not None:
            yield rows(group, state["last"][0], True, *state["last"][1:], 0.0)
        if state["mid"] is not None:
            yield rows(group, state["mid"][0], False, *state["mid"][1:])

    def kernel(batches):
        open_group, state = None, None
        for batch in batches:
            for pdf in _chunks(batch, n_boot):
                w = poisson_weights(pdf["key"].to_numpy(), pdf["c"].to_numpy(), n_boot, seed)
                hit = pdf["y"].to_numpy(dtype=bool)
                s_all = pdf["s"].to_numpy()
                for group, at in _groups(pdf, by):
                    if group != open_group:
                        if state is not None:
                            yield from close(open_group, state)
                        open_group, state = group, None
                    state = _extend(state, s_all[at], w[at], hit[at])
        if state is not None:
            yield from close(open_group, state)

    runs = src.mapInPandas(kernel, schema)
    merged = runs.groupBy(*by, "b", "lo", "tie").agg(*[F.sum(x).alias(x) for x in "pnu"])
    merged = merged.withColumn("u", F.when(F.col("tie"), F.col("p") * F.col("n") / 2).otherwise(F.col("u")))
    before = Window.partitionBy(*by, "b").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum("n").over(before), F.lit(0.0))
    return (
        merged.withColumn("seen", seen)
        .groupBy(*by, "b")
        .agg(F.sum("p").alias("p"), F.sum("n").alias("n"),
             F.sum(F.col("u") + F.col("p") * F.col("seen")).alias("u"))
    )


def _extend(state, s, w, hit):
    """Append scores (ascending) of one group to its running state in this task."""
    starts = np.r_[0, np.flatnonzero(np.diff(s)) + 1]
    p, n = _sums_at(w * hit[:, None], starts), _sums_at(w, starts)
    n -= p
    s = s[starts]
    if state is None:
        state = {"first": (s[0], p[0], n[0]), "last": None, "mid": None}
        s, p, n = s[1:], p[1:], n[1:]
    elif state["last"] is None and state["first"][0] == s[0]:
        state["first"] = (s[0], state["first"][1] + p[0], state["first"][2] + n[0])
        s, p, n = s[1:], p[1:], n[1:]
    if len(s) == 0:
        return state
    if state["last"] is not None:
        lead = state["last"]
        if lead[0] == s[0]:
            p[0] += lead[1]
            n[0] += lead[2]
        else:
            state["mid"] = _followed(state["mid"], lead[0], lead[1], lead[2], lead[1] * lead[2] / 2)
    state["last"] = (s[-1], p[-1].copy(), n[-1].copy())
    if len(s) > 1:
        p, n = p[:-1], n[:-1]
        below = np.cumsum(n, axis=0)
        total = below[-1].copy()
        below -= n / 2
        state["mid"] = _followed(state["mid"], s[0], p.sum(axis=0), total, np.einsum("ij,ij->j", p, below))
    return state


def _sums_at(values, starts):
    """Sums of the rows from each start to the next."""
    return values.copy() if len(starts) == len(values) else np.add.reduceat(values, starts, axis=0)


def _followed(mid, lo, p, n, u):
    """A run of scores (see rank.concordance) followed by another one."""
    if mid is None:
        return lo, p, n, u
    return mid[0], mid[1] + p, mid[2] + n, mid[3] + u + p * mid[2]


def replicate_auroc(
    cell_df: DataFrame, by: list[str], y: str, score: str, n_boot: int, seed: int = 0
) -> DataFrame:
    """by..., b, v: AUROC of each replicate, NULL where a class is missing."""
    got = replicate_pairs(cell_df, by, y, score, n_boot, seed)
    return got.select(*by, "b", F.try_divide("u", F.col("p") * F.col("n")).alias("v"))


CURVE_SUMS = ["n", "gain", "base", "helped", "hurt"]
_START = ["n0", "gain0", "n_all", "gain_all", "base_all"]


def _curve_values(off: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Per row of weight one: the CURVE_SUMS."""
    return np.column_stack([np.ones(len(off)), on - off, off, (on > off) * 1.0, (off > on) * 1.0])


class CurveReads:
    """What is read from a curve, as sums, minima and maxima over its segments.

    A segment is ``n`` rows with ``gain`` that begins after ``k0`` rows and
    ``g0`` gain; a curve has n_all rows, gain_all and base_all right answers.
    """

    def __init__(self, ranges: dict, allowances: dict, fractions: dict):
        self.ranges, self.allowances, self.fractions = ranges, allowances, fractions
        self.names = [*(f"area_{x}" for x in ranges), *(f"min_{x}" for x in allowances), *(f"at_{x}" for x in fractions)]

    @staticmethod
    def fold(name: str):
        """(over rows of numpy, over two arrays, over a column, of nothing)"""
        return {"area": (np.sum, np.add, F.sum, 0.0), "min_": (np.min, np.minimum, F.min, np.inf),
                "at_": (np.max, np.maximum, F.max, -np.inf)}[next(p for p in ("area", "min_", "at_") if name.startswith(p))]

    def one(self, name, n, gain, k0, g0, n_all, gain_all, base):
        """One value per segment for a read; arrays of any one shape, or that broadcast to it."""
        k1 = k0 + n
        what, _, x = name.partition("_")
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(n > 0, gain / n, 0.0)
            accuracy = lambda x: (base + g0 + step * (x - k0)) / n_all
            if what == "area":
                lo, hi = self.ranges[x]
                a, b = np.maximum(k0 / n_all, lo), np.minimum(k1 / n_all, hi)
                piece = (b - a) * (accuracy(a * n_all) + accuracy(b * n_all)) / 2
                return np.where((n > 0) & (b > a), piece, 0.0)
            if what == "min":
                need = self.needed(x, n_all, gain_all, base) - g0
                up = np.ceil(k0 + need / np.where(step > 0, step, np.nan))
                first = np.where(need <= 0, k0, np.where(up <= k1, up, np.inf))
                return np.where(n > 0, first, np.inf) / n_all
            x = self.fractions[x] * n_all
            inside = (n > 0) & ((x > k0) & (x <= k1) if self.fractions[name[3:]] > 0 else k0 == 0)
            return np.where(inside, accuracy(x), -np.inf)

    def needed(self, allowance, n_all, gain_all, base):
        """The gain at which the accuracy suffices."""
        return ((base + gain_all) / n_all - self.allowances[allowance] - 1e-9) * n_all - base

    def __call__(self, *segments):
        """(name, one value per segment) for every read."""
        for name in self.names:
            yield name, self.one(name, *segments)

    def add(self, got, n, gain, k0, g0, n_all, gain_all, base):
        """Fold segments (segments x replicates) that follow one another from (k0, g0) on into ``got``.

        Most replicates begin or end nothing among them: inside a range their
        area is one sum, and no other read needs them. The others are read segment by segment.
        """
        g1 = np.cumsum(gain, 0)
        g1 += g0
        end = k0 + n.sum(0)
        area, top = None, None

        def by_segment(name, which):
            at = np.flatnonzero(which)
            if len(at):
                n_, gain_ = n[:, at], gain[:, at]
                k0_ = k0[at] + np.cumsum(n_, 0) - n_
                over, two = self.fold(name)[:2]
                values = self.one(name, n_, gain_, k0_, g1[:, at] - gain_, n_all[at], gain_all[at], base[at])
                got[name][at] = two(got[name][at], over(values, axis=0))

        for name in self.names:
            what, _, x = name.partition("_")
            if what == "area":
                lo, hi = (v * n_all for v in self.ranges[x])
                within = (k0 >= lo) & (end <= hi)
                if within.any():
                    if area is None:
                        area = (base * (end - k0) + np.einsum("ij,ij->j", n, g1) - np.einsum("ij,ij->j", n, gain) / 2) / n_all**2
                    got[name][within] += area[within]
                by_segment(name, ~within & (k0 < hi) & (end > lo))
            elif what == "min":
                if top is None:
                    top = np.maximum(g1.max(0), g0)
                by_segment(name, (top >= self.needed(x, n_all, gain_all, base) - 1e-6) & ~(got[name] * n_all <= k0))
            else:
                at = self.fractions[x] * n_all
                by_segment(name, (k0 <= at) & (at <= end))


class _Run:
    """Cells of one group in falling score, as segments; the last one stays open for what may follow."""

    def __init__(self):
        self.score, self.n, self.gain = None, None, None

    def closed(self, s, w, gain):
        """(scores, n, gain) of the segments that end before the last score of ``s``."""
        at = np.r_[0, np.flatnonzero(np.diff(s)) + 1]
        lead = self.score is not None and self.score != s[0]
        scores = np.r_[self.score, s[at]] if lead else s[at]
        n, g = np.empty((2, len(scores), w.shape[1]))
        for own, values in ((n, w), (g, w * gain[:, None])):
            if len(at) == len(s):
                own[int(lead) :] = values
            else:
                np.add.reduceat(values, at, 0, out=own[int(lead) :])
        if self.score is not None:  # the segment that was open: a row of its own, or the first score goes on
            n[0], g[0] = (self.n, self.gain) if lead else (n[0] + self.n, g[0] + self.gain)
        self.score, self.n, self.gain = scores[-1], n[-1].copy(), g[-1].copy()
        return scores[:-1], n[:-1], g[:-1]


def _stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal flags."""
    edges = np.r_[0, np.flatnonzero(flags[1:] != flags[:-1]) + 1, len(flags)].tolist()
    return list(zip(edges[:-1], edges[1:]))


class _Ends:
    """Sums over cells in falling score, and those of the first and the last score apart."""

    def __init__(self):
        self.total, self.first, self.last = 0.0, None, None

    @staticmethod
    def _joined(end, s, w, gain):
        n, g = w.sum(0), gain @ w
        return (s, n, g) if end is None or end[0] != s else (s, end[1] + n, end[2] + g)

    def add(self, s, w, values):
        self.total = self.total + w.T @ values
        gain = values[:, 1]
        if self.first is None or self.first[0] == s[0]:
            head = slice(0, int((s == s[0]).sum()))
            self.first = self._joined(self.first, s[0], w[head], gain[head])
        tail = slice(len(s) - int((s == s[-1]).sum()), len(s))
        self.last = self._joined(self.last, s[-1], w[tail], gain[tail])


def replicate_curve_reads(
    cell_df: DataFrame, by: list[str], off: str, on: str, score: str, n_boot: int, seed: int = 0,
    ranges: dict[str, tuple[float, float]] | None = None, allowances: dict[str, float] | None = None,
    fractions: dict[str, float] | None = None,
) -> DataFrame:
    """by..., b and what is read from the curve of each replicate (see curves.read_curve).

    ``ranges`` give structs of normalised areas, ``allowances`` the fraction
    that suffices for always-on accuracy minus so much, ``fractions`` the accuracy there.

    Cells lie in ranges of falling (score, key), so a hot tie is spread over
    tasks. A first pass sums each range per replicate, and apart from that its
    first and last score, which neighbours may share: summed over ranges, those
    are whole segments, read as rows. A second pass streams each range from
    where it begins in the curve and reads the segments inside as matrices
    (segments x replicates). What is shuffled is a few rows per range and
    replicate, never one per cell and replicate, and no task holds a range.
    """
    reads = CurveReads(ranges or {}, allowances or {}, fractions or {})
    src = cell_df.select(
        *by, no_nan(F.col(score).cast("double"), "router scores").alias("s"), truth(F.col(off)).alias("off"),
        truth(F.col(on)).alias("on"), "c", F.col("key").cast("string").alias("key"),
    )
    n_parts = int(cell_df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*by, F.desc("s"), "key"]
    dealt = settle(src.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()))
    keys = ["pid", *by]
    b_field = T.StructField("b", T.IntegerType())
    doubles = lambda names: [T.StructField(x, T.DoubleType()) for x in names]

    def drawn(batches):
        """(group, its rows, weights, values), chunk by chunk."""
        for batch in batches:
            for pdf in _chunks(batch, n_boot):
                w = poisson_weights(pdf["key"].to_numpy(), pdf["c"].to_numpy(), n_boot, seed)
                values = _curve_values(pdf["off"].to_numpy(dtype=float), pdf["on"].to_numpy(dtype=float))
                for group, at in _groups(pdf, keys):
                    yield group, pdf["s"].to_numpy()[at], w[at], values[at]

    def framed(group, values: dict, columns):
        out = pd.DataFrame({"b": np.arange(n_boot, dtype=np.int32), **values})
        for name, value in zip(keys, group):
            out[name] = [value] * n_boot
        return out[columns]

    ends = ["first_s", "last_s", "first_n", "first_gain", "last_n", "last_gain"]
    summed = T.StructType(_fields(dealt, keys) + [b_field] + doubles([*CURVE_SUMS, *ends]))

    def add_up(batches):
        open_group, ends_of = None, None

        def done():
            names = dict(zip(["first_s", "first_n", "first_gain", "last_s", "last_n", "last_gain"], [*ends_of.first, *ends_of.last]))
            return framed(open_group, {**dict(zip(CURVE_SUMS, ends_of.total.T)), **names}, summed.names)

        for group, s, w, values in drawn(batches):
            if group != open_group:
                if ends_of is not None:
                    yield done()
                open_group, ends_of = group, _Ends()
            ends_of.add(s, w, values)
        if ends_of is not None:
            yield done()

    parts = dealt.mapInPandas(add_up, summed)
    # A file may be read in parts: they follow one another by what they begin and end with.
    place = Window.partitionBy(*by, "b").orderBy("pid", F.desc("first_s"), F.desc("last_s")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by, "b")
    starts = settle(parts.select(
        *keys, "b", *ends, "n", "gain",
        *[F.coalesce(F.sum(x).over(place), F.lit(0.0)).alias(f"{x}0") for x in ("n", "gain")],
        *[F.sum(x).over(whole).alias(f"{x}_all") for x in CURVE_SUMS],
    ).where("n_all > 0"))
    totals = [f"{x}_all" for x in CURVE_SUMS]

    # The shared scores: one segment each, wherever its cells lie.
    at_first = F.struct(F.col("first_s").alias("s"), F.col("first_n").alias("n"), F.col("first_gain").alias("gain"),
                        F.col("n0").alias("k0"), F.col("gain0").alias("g0"))
    at_last = F.struct(F.col("last_s").alias("s"), F.col("last_n").alias("n"), F.col("last_gain").alias("gain"),
                       (F.col("n0") + F.col("n") - F.col("last_n")).alias("k0"), (F.col("gain0") + F.col("gain") - F.col("last_gain")).alias("g0"))
    both = F.when(F.col("first_s") == F.col("last_s"), F.array(at_first)).otherwise(F.array(at_first, at_last))
    ties = starts.select(*by, "b", *totals, F.explode(both).alias("t")).groupBy(*by, "b", F.col("t.s").alias("s")).agg(
        F.sum("t.n").alias("n"), F.sum("t.gain").alias("gain"), F.min("t.k0").alias("k0"), F.min_by("t.g0", "t.k0").alias("g0"),
        *[F.max(x).alias(x) for x in totals],
    )
    shape = T.StructType(_fields(dealt, by) + [b_field] + doubles(reads.names))

    def read_ties(batches):
        for pdf in batches:
            got = reads(*(pdf[x].to_numpy() for x in ("n", "gain", "k0", "g0", "n_all", "gain_all", "base_all")))
            yield pd.concat([pdf[[*by, "b"]], pd.DataFrame(dict(got), index=pdf.index)], axis=1)

    # Where a range begins, per replicate, goes before its cells, with the scores that are read as ties.
    begin = starts.groupBy(*keys, "b").agg(
        F.min_by(F.struct("n0", "gain0"), F.struct(-F.col("first_s"), -F.col("last_s"))).alias("at"), *[F.max(x).alias(x) for x in _START[2:]],
        F.collect_list("first_s").alias("f"), F.collect_list("last_s").alias("l"),
    )
    begin = begin.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("b", "at.n0", "at.gain0", *_START[2:]))).alias("r"),
        F.array_union(F.max("f"), F.max("l")).alias("shared"),
    ).select(*keys, *[F.col(f"r.{x}").alias(x) for x in ["b", *_START]], "shared")

    def pack(batches):
        # One value beside the cells: six array columns that are null in every cell cost more than the cells.
        for pdf in batches:
            heads = [pickle.dumps([np.asarray(row[x]) for x in ["b", *_START, "shared"]]) for _, row in pdf.iterrows()]
            yield pdf[keys].assign(head=heads)

    heads = begin.mapInPandas(pack, T.StructType([*_fields(dealt, keys), T.StructField("head", T.BinaryType())]))
    own = [x for x in dealt.columns if x not in keys]
    streams = dealt.select(*keys, *own, F.lit(None).cast("binary").alias("head")).unionByName(
        heads.select(*keys, *[F.lit(None).cast(dealt.schema[x].dataType).alias(x) for x in own], "head")
    ).repartitionById(n_parts, F.col("pid")).sortWithinPartitions("pid", *by, F.col("head").isNull(), F.desc("s"))

    def read_inside(batches):
        open_group, state, run, got = None, None, None, None

        def cells():
            nonlocal open_group, state, run, got
            for batch in batches:
                head = batch["head"].notna().to_numpy()
                edges = np.r_[0, np.flatnonzero(head), len(batch)]
                for a, z in zip(edges[:-1], edges[1:]):
                    if a == z:
                        continue
                    if head[a]:
                        if got is not None:
                            yield "end", None
                        row = batch.iloc[a]
                        open_group = tuple(None if pd.isna(row[k]) else row[k] for k in keys)
                        drawn_at, *given, shared = pickle.loads(row["head"])
                        spread = {}
                        for x, value in zip(_START, given):  # replicates without rows have no start and are left out
                            spread[x] = np.full(n_boot, np.nan)
                            spread[x][drawn_at.astype(int)] = value
                        state, run = {**spread, "shared": shared.astype(float)}, _Run()
                        got = {x: np.full(n_boot, reads.fold(x)[3]) for x in reads.names}
                        a += 1
                    if a < z:
                        for pdf in _chunks(batch.iloc[a:z], n_boot):
                            yield "cells", pdf
            if got is not None:
                yield "end", None

        def finished():
            out = framed(open_group, got, ["pid", *shape.names])
            return out[~np.isnan(state["n_all"])][shape.names]

        for what, pdf in cells():
            if what == "end":
                yield finished()
                continue
            w = poisson_weights(pdf["key"].to_numpy(), pdf["c"].to_numpy(), n_boot, seed)
            gain = pdf["on"].to_numpy(dtype=float) - pdf["off"].to_numpy(dtype=float)
            scores, n, g = run.closed(pdf["s"].to_numpy(dtype=float), w, gain)
            if not len(scores):
                continue
            # The scores read as ties only move on where the others begin.
            shared = np.isin(scores, state["shared"])
            for a, z in _stretches(shared):
                if not shared[a]:
                    reads.add(got, n[a:z], g[a:z], *(state[x] for x in _START))
                state["n0"], state["gain0"] = state["n0"] + n[a:z].sum(0), state["gain0"] + g[a:z].sum(0)

    partial = ties.mapInPandas(read_ties, shape).unionByName(streams.mapInPandas(read_inside, shape))
    return _read_off(partial, starts, by, reads)


def _read_off(partial: DataFrame, starts: DataFrame, by: list[str], reads: CurveReads) -> DataFrame:
    """by..., b and the reads, folded from parts of the curves; ``starts`` has the totals of each."""
    named = lambda x: F.col(f"`{x}`")
    merged = join_on(
        partial.groupBy(*by, "b").agg(*[reads.fold(x)[2](named(x)).alias(x) for x in reads.names]),
        starts.groupBy(*by, "b").agg(*[F.max(f"{x}_all").alias(f"{x}_all") for x in CURVE_SUMS]), [*by, "b"],
    )
    share = lambda c: F.col(f"{c}_all") / F.col("n_all")
    inf = float("inf")
    return merged.select(
        *by, "b",
        *[normalised(named(f"area_{x}"), share("base"), share("gain"), share("helped"), share("hurt"), lo, hi).alias(x) for x, (lo, hi) in reads.ranges.items()],
        *[F.when(named(f"min_{x}") < inf, named(f"min_{x}")).otherwise(1.0).alias(x) for x in reads.allowances],
        *[F.when(named(f"at_{x}") > -inf, named(f"at_{x}")).alias(x) for x in reads.fractions],
    )


FEW_SCORES = 64  # of a group, whose sums a task holds for all replicates


def few_curve_reads(
    cell_df: DataFrame, by: list[str], off: str, on: str, score: str, n_boot: int, seed: int = 0,
    ranges: dict[str, tuple[float, float]] | None = None, allowances: dict[str, float] | None = None,
    fractions: dict[str, float] | None = None,
) -> DataFrame:
    """As replicate_curve_reads, for scores of few values: each cell is drawn once, and a score is one segment of sums."""
    reads = CurveReads(ranges or {}, allowances or {}, fractions or {})
    o, w = truth(F.col(off)).cast("double"), truth(F.col(on)).cast("double")
    src = cell_df.withColumn("s", no_nan(F.col(score).cast("double"), "router scores")).sortWithinPartitions(*by, "s")
    sums = {"n": F.lit(1.0), "gain": w - o, "base": o, "helped": F.greatest(w - o, F.lit(0.0)), "hurt": F.greatest(o - w, F.lit(0.0))}
    got = replicate_sums(src, [*by, "s"], sums, n_boot, seed)
    before = Window.partitionBy(*by, "b").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by, "b")
    segments = settle(got.select(
        *by, "b", "n", "gain", *[F.coalesce(F.sum(x).over(before), F.lit(0.0)).alias(at) for x, at in (("n", "k0"), ("gain", "g0"))],
        *[F.sum(x).over(whole).alias(f"{x}_all") for x in CURVE_SUMS],
    ).where("n_all > 0"))
    shape = T.StructType(_fields(segments, [*by, "b"]) + [T.StructField(x, T.DoubleType()) for x in reads.names])

    def read(batches):
        for pdf in batches:
            values = reads(*(pdf[x].to_numpy() for x in ("n", "gain", "k0", "g0", "n_all", "gain_all", "base_all")))
            yield pd.concat([pdf[[*by, "b"]], pd.DataFrame(dict(values), index=pdf.index)], axis=1)

    return _read_off(segments.mapInPandas(read, shape), segments, by, reads)


def replicate_nauc(
    cell_df: DataFrame, by: list[str], off: str, on: str, score: str, n_boot: int,
    seed: int = 0, lo: float = 0.0, hi: float = 0.5,
) -> DataFrame:
    got = replicate_curve_reads(cell_df, by, off, on, score, n_boot, seed, {"area": (lo, hi)})
    return got.select(*by, "b", F.col("area.nauc").alias("v"))


# --- intervals -------------------------------------------------------------

def percentile_interval(
    reps: DataFrame, by: list[str], value: str = "v", confidence: float = 0.95, also: dict[str, Column] | None = None
) -> DataFrame:
    """by..., ci_lo, ci_hi, n_boot over the defined replicates, and the aggregates in ``also``."""
    v = F.col(value)
    v = F.when(~F.isnan(v), v)
    got = reps.groupBy(*by).agg(
        F.percentile(v, F.array(F.lit((1 - confidence) / 2), F.lit((1 + confidence) / 2))).alias("__q"),
        F.count(v).alias("n_boot"), *[x.alias(name) for name, x in (also or {}).items()],
    )
    return got.select(
        *by, F.col("__q")[0].alias("ci_lo"), F.col("__q")[1].alias("ci_hi"), "n_boot", *(also or {})
    )


def difference(reps: DataFrame, by: list[str], scorer: str, a: str, b: str) -> DataFrame:
    """by..., b, v: value of scorer ``a`` minus scorer ``b`` in the same replicate."""
    def of(name):
        return F.max(F.when(F.col(scorer) == name, F.col("v")))

    return reps.where(F.col(scorer).isin(a, b)).groupBy(*by, "b").agg((of(a) - of(b)).alias("v"))


def paired_summary(
    estimate: DataFrame, reps: DataFrame, by: list[str], confidence: float = 0.95
) -> DataFrame:
    """estimate, ci, n_boot, se and the share of replicates at or below zero."""
    # One pass over the replicates, which are dear to make.
    spread = {"se": F.stddev_samp("v"), "p_le_zero": ratio(count_if(F.col("v") <= 0), F.count("v"))}
    return join_on(estimate, percentile_interval(reps, by, "v", confidence, spread), by)


def paired_mean(
    cell_df: DataFrame, by: list[str], off: str, on: str, n_boot: int, seed: int = 0, strata: list[str] | None = None,
    confidence: float = 0.95,
) -> DataFrame:
    """Mean of ``on`` minus mean of ``off`` on the same resamples; with ``strata`` each of them keeps its size."""
    sums = {"a": truth(F.col(on)).cast("double"), "o": truth(F.col(off)).cast("double"), "w": F.lit(1.0)}
    got = replicate_sums(cell_df, by, sums, n_boot, seed) if strata is None else exact_sums(cell_df, by, strata, sums, n_boot, seed)
    reps = got.select(*by, "b", (F.try_divide("a", "w") - F.try_divide("o", "w")).alias("v"))
    counted = lambda c: F.sum(F.when(truth(F.col(c)), F.col("c")).otherwise(0))
    estimate = cell_df.groupBy(*by).agg(ratio(counted(on) - counted(off), F.sum("c")).alias("estimate"))
    return paired_summary(estimate, reps, by, confidence)


def long_scorers(df: DataFrame, keep: list[str], scorers: dict[str, str]) -> DataFrame:
    """One row per (row, scorer) with its ``score``; the other columns in ``keep`` stay."""
    return df.select(
        *keep,
        F.inline(F.array(*[
            F.struct(F.lit(name).alias("scorer"), F.col(col).cast("double").alias("score"))
            for name, col in scorers.items()
        ])),
    )


# --- summaries over seeds --------------------------------------------------

def mean_interval(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Seed mean with a normal interval: mean +- 1.96 sd / sqrt(n), NaN and NULL dropped."""
    v = F.col(value).cast("double")
    v = F.when(~F.isnan(v), v)
    got = df.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.count(v).alias("n"))
    half = F.when(F.col("n") == 1, F.lit(0.0)).otherwise(1.96 * F.col("sd") / F.sqrt(F.col("n")))
    return got.select(
        *by, "mean", (F.col("mean") - half).alias("ci_lo"), (F.col("mean") + half).alias("ci_hi"),
        F.when(F.col("n") > 1, F.col("sd")).alias("sd"), "n",
    )


def average_interval(df: DataFrame, by: list[str], lo: str = "ci_lo", hi: str = "ci_hi") -> DataFrame:
    """Mean of the lower and of the upper bounds over seeds, undefined ones dropped."""
    def ok(c):
        return F.when(~F.isnan(c), F.col(c))

    return df.groupBy(*by).agg(
        F.avg(ok(lo)).alias("ci_lo"), F.avg(ok(hi)).alias("ci_hi"), F.count(ok(lo)).alias("n_seeds")
    )


# --- user statistics -------------------------------------------------------

BLOCK = 100  # replicates whose states meet in one group


def user_statistic(
    df: DataFrame, columns: list[str], init: Callable, update: Callable, merge: Callable, finish: Callable,
    row_id: str, n_boot: int, seed: int = 0,
) -> DataFrame:
    """b, v: any Python statistic of exact resamples that can be folded.

    ``init(n)`` makes the state of n replicates, ``update(state, rows, w)`` takes
    rows (a frame of ``columns``) and their weights (rows x n), ``merge(a, b)``
    joins two states and ``finish(state)`` gives n numbers. Rows go to tasks once
    per block of replicates, so a task holds the state of one block; one state
    per task and block is shuffled, and the table may be of any size as long as
    a state may.
    """
    n_blocks = -(-n_boot // BLOCK)
    placed = _placed(df.select(row_id, *columns).withColumn("c", F.lit(1).cast("bigint")), [], row_id, seed)
    dealt = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("__block"))
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = dealt.repartitionByRange(n_parts, "__block", "__a").sortWithinPartitions("__block", "__a")

    def fold(batches):
        block, state, width = None, None, 0

        def done():
            return pd.DataFrame({"block": [block], "state": [pickle.dumps(state)]})

        for batch in batches:
            for (of,), at in _groups(batch, ["__block"]):
                if of != block:
                    if block is not None:
                        yield done()
                    block, width = int(of), min(BLOCK, n_boot - int(of) * BLOCK)
                    state = init(width)
                for pdf in _chunks(batch.iloc[at], width):
                    state = update(state, pdf[columns], _tree_weights(pdf, width, seed, block * BLOCK))
        if block is not None:
            yield done()

    def join(batches):
        # Rows come by block; the states of a block are joined one after another.
        block, state = None, None

        def done():
            values = np.asarray(finish(state), dtype=float)
            return pd.DataFrame({"b": block * BLOCK + np.arange(len(values)), "v": values})

        for pdf in batches:
            for b, raw in zip(pdf["block"], pdf["state"]):
                if b != block:
                    if state is not None:
                        yield done()
                    block, state = b, pickle.loads(raw)
                else:
                    state = merge(state, pickle.loads(raw))
        if state is not None:
            yield done()

    states = src.mapInPandas(fold, "block int, state binary").repartition(n_blocks, "block").sortWithinPartitions("block")
    return states.mapInPandas(join, "b int, v double")


# --- ready-made intervals --------------------------------------------------

def auroc_interval(
    df: DataFrame, by: list[str], y: str, score: str, row_id: str, n_boot: int, seed: int = 0,
    confidence: float = 0.95,
) -> DataFrame:
    reps = replicate_auroc(cells(df, by, [score, y], row_id), by, y, score, n_boot, seed)
    return percentile_interval(reps, by, "v", confidence)


def within_group_interval(
    df: DataFrame, by: list[str], group: str, y: str, score: str, row_id: str, n_boot: int,
    seed: int = 0, confidence: float = 0.95,
) -> DataFrame:
    """Interval of the pooled within-group concordance."""
    keyed = df.withColumn("__grp", F.coalesce(F.col(group).cast("string"), F.lit("None")))
    cell_df = cells(keyed, by + ["__grp"], [score, y], row_id)
    pairs = replicate_pairs(cell_df, by + ["__grp"], y, score, n_boot, seed)
    reps = pairs.groupBy(*by, "b").agg(
        ratio(F.sum("u"), F.sum(F.col("p") * F.col("n"))).alias("v")
    )
    return percentile_interval(reps, by, "v", confidence)


def paired_auroc(
    df: DataFrame, by: list[str], y: str, scorers: dict[str, str], a: str, b: str, row_id: str,
    n_boot: int, seed: int = 0, confidence: float = 0.95,
) -> DataFrame:
    """AUROC(a) - AUROC(b) on the same rows and the same resamples."""
    # Read by the point value and by the replicates.
    cell_df = settle(cells(df, by, [y, *scorers.values()], row_id))
    long = long_scorers(cell_df, by + [y, "c", "key"], scorers)
    keys = by + ["scorer"]
    hit = truth(F.col(y))
    # The point value reads the same cells, each counted c times.
    counted = long.groupBy(*keys, "score").agg(
        F.sum(F.when(hit, F.col("c")).otherwise(0)).cast("double").alias("p"),
        F.sum(F.when(~hit, F.col("c")).otherwise(0)).cast("double").alias("n"),
    )
    point = concordance(counted, keys).select(
        *keys, F.lit(0).alias("b"), F.try_divide("u", F.col("p") * F.col("n")).alias("v")
    )
    estimate = difference(point, by, "scorer", a, b).select(*by, F.col("v").alias("estimate"))
    reps = replicate_auroc(long, keys, y, "score", n_boot, seed)
    return paired_summary(estimate, difference(reps, by, "scorer", a, b), by, confidence)


def paired_nauc(
    df: DataFrame, by: list[str], off: str, on: str, scorers: dict[str, str], a: str, b: str,
    row_id: str, n_boot: int, seed: int = 0, lo: float = 0.0, hi: float = 0.5, confidence: float = 0.95, own: bool = False,
) -> DataFrame:
    """nAUC(a) - nAUC(b) on [lo, hi], same rows and same resamples; with ``own`` also the interval of nAUC(a) as own_lo, own_hi."""
    # Read by the point value and by the replicates.
    cell_df = settle(cells(df, by, [off, on, *scorers.values()], row_id))
    long = long_scorers(cell_df, by + [off, on, "c", "key"], scorers)
    keys = by + ["scorer"]
    point = nauc(segments(long, keys, off, on, "score", weight="c"), keys, lo, hi).select(
        *keys, F.lit(0).alias("b"), F.col("nauc").alias("v")
    )
    estimate = difference(point, by, "scorer", a, b).select(*by, F.col("v").alias("estimate"))
    values = cell_df.groupBy(*by).agg(*[F.approx_count_distinct(c).alias(x) for x, c in scorers.items()])
    most = values.agg(*[F.max(x).alias(x) for x in scorers]).first()
    few = [x for x in scorers if (most[x] or 0) <= FEW_SCORES]
    parts = []
    if few:
        got = few_curve_reads(long.where(F.col("scorer").isin(few)), keys, off, on, "score", n_boot, seed, {"area": (lo, hi)})
        parts.append(got.select(*keys, "b", F.col("area.nauc").alias("v")))
    if len(few) < len(scorers):
        parts.append(replicate_nauc(long.where(~F.col("scorer").isin(few)), keys, off, on, "score", n_boot, seed, lo, hi))
    # A number per group and replicate, dear to make, read by the difference and by a's own interval.
    reps = settle(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
    got = paired_summary(estimate, difference(reps, by, "scorer", a, b), by, confidence)
    if not own:
        return got
    mine = percentile_interval(reps.where(F.col("scorer") == a), by, "v", confidence)
    return join_on(mine.select(*by, F.col("ci_lo").alias("own_lo"), F.col("ci_hi").alias("own_hi")), got, by)


def seed_average(per_seed: DataFrame, by: list[str]) -> DataFrame:
    """Means of estimate, bounds and p over seeds; seeds with undefined bounds are dropped."""
    return per_seed.where(F.col("ci_lo").isNotNull()).groupBy(*by).agg(
        F.avg("estimate").alias("mean"), F.avg("ci_lo").alias("ci_lo"), F.avg("ci_hi").alias("ci_hi"),
        F.avg("p_le_zero").alias("p_le_zero"), F.count(F.lit(1)).alias("n_seeds"),
    )


def stratified_block(
    df: DataFrame, by: list[str], level: str, y: str, score: str, row_id: str, n_boot: int,
    seed: int = 0,
) -> DataFrame:
    """n, base rate, AUROC and its interval per level; levels under 2 rows are skipped."""
    keys, hit = by + [level], truth(F.col(y))
    # Counts, point and replicates read the same cells, each counted c times.
    cell_df = settle(cells(df, keys, [score, y], row_id))
    times = lambda cond: F.sum(F.when(cond, F.col("c")).otherwise(0)).cast("double")
    counts = cell_df.groupBy(*keys).agg(
        F.sum("c").alias("n"), (times(hit) / F.sum("c")).alias("base_rate")
    ).where("n >= 2")
    counted = cell_df.groupBy(*keys, no_nan(F.col(score).cast("double"), "scores").alias("score")).agg(times(hit).alias("p"), times(~hit).alias("n"))
    point = concordance(counted, keys).select(*keys, F.try_divide("u", F.col("p") * F.col("n")).alias("auroc"))
    reps = replicate_auroc(cell_df, keys, y, score, n_boot, seed)
    return join_on(join_on(counts, point, keys), percentile_interval(reps, keys), keys)
