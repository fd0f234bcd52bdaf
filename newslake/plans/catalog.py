"""All registered queries of the article operators, with their SQL."""

from newslake.plans import ingesting, outboxes, serving, stores, stories  # noqa: F401  (register their queries)
from newslake.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
