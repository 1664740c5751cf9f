"""All queries on nets and chains by name, each with the SQL that gives the same rows."""

from fillgap.plans import catalog, chains, texts  # noqa: F401  they register their queries
from fillgap.plans.registry import QUERIES, SQL  # noqa: F401
