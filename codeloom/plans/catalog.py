"""All queries of the engine and their SQL."""

from . import across, detectors, insights, paths, quality, queries, reporting

QUERIES, SQL = queries.QUERIES, queries.SQL

__all__ = ["QUERIES", "SQL", "across", "detectors", "insights", "paths", "quality", "reporting"]
