"""Every registered query and, where SQL can express it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import codec_queries, corpus_queries, prediction_queries, probe_queries, structure_queries

GROUPS = (prediction_queries, structure_queries, probe_queries, corpus_queries, codec_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for g in GROUPS for k, q in g.QUERIES.items()}
ORACLES: dict[str, str] = {k: q for g in GROUPS for k, q in g.ORACLES.items()}
