"""Named queries with the SQL that they are checked against."""

from millrace.plans import connectors, estimates, families, more, relational, scalars, scale, semantics, streams, subqueries, udfs  # noqa: F401  they register themselves
from millrace.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
