"""Refusals: conditions under which a job must stop instead of guessing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """A data-quality condition does not hold."""


def require(condition: bool, message: str) -> None:
    if not condition:
        raise CheckFailed(message)


def require_empty(df: DataFrame, message: str, show: str | None = None) -> None:
    """Fail if ``df`` has a row; only that one row is fetched."""
    row = df.take(1)
    if row:
        first = f" (first: {row[0][show]!r})" if show else ""
        raise CheckFailed(message + first)


def require_unique(df: DataFrame, cols: list[str], message: str) -> None:
    dup = df.groupBy(*cols).count().where("count > 1")
    require_empty(dup, message, show=cols[0])


def or_fail(ok: Column, value: Column, message: Column | str) -> Column:
    """``value`` where ``ok`` holds; the job fails on the first row where it does not.

    Evaluated inside the job itself, so the check costs no extra pass.
    """
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(ok, value).otherwise(F.raise_error(text))


def no_nan(col: Column, what: str) -> Column:
    """Reject NaN and null scores: Spark would sort NaN above every number."""
    return or_fail(~(F.isnan(col) | col.isNull()), col, f"{what} contain NaN or null")
