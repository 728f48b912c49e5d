"""All registered queries."""

from . import arrays, base, boot, files, joins, labels, rank, reports, text  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
