"""The registered queries of this subpackage, each with its SQL counterpart where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle
        return query

    return keep


def load() -> None:
    """Import the modules that register queries."""
    from evenhand.llm import bpe, hard_negatives, hilbert_ann, html_text, language_id, licenses, mixing, near_dedup, periodic_runs, quality, substring_dedup, token_counts, uniform_topk  # noqa: F401
