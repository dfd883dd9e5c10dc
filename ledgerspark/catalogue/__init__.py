"""Named queries over the given tables, each with its DuckDB equivalent where there is one."""

from ledgerspark.catalogue.base import ORACLES, QUERIES
from ledgerspark.catalogue import eda, evaluation, features, ingest, training  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
