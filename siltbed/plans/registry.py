"""All registered queries; importing the modules that hold them fills QUERIES and SQL."""

from siltbed.plans import lookup, nested, stores  # noqa: F401
from siltbed.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
