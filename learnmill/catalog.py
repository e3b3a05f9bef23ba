"""All queries with the SQL twins that check them."""

from __future__ import annotations

from learnmill.plans import basic, clusters, models  # noqa: F401
from learnmill.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "dbscan_user"
