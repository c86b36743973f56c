"""All queries of the library, by inventory id."""

from __future__ import annotations

from . import corpus_metrics, extra, text_metrics  # noqa: F401
from .base import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
