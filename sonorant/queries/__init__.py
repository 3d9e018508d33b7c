"""The query catalogue: name -> (spark, sf_dir) -> DataFrame, and the same queries as DuckDB SQL."""

from sonorant.queries import events, metrics, ordinals, payloads, reading, rehearing, rulebooks, speech, stages  # noqa: F401  registers the queries
from sonorant.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
