"""Named queries over the test tables, with SQL equivalents."""

from gaugeworks.plans import records, roundtrips, scoring, statistics  # noqa: F401
from gaugeworks.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
