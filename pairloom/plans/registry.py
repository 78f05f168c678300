"""All queries of the core and the SQL that states the same."""

from __future__ import annotations

from pairloom.plans import analogues, domain, problems

QUERIES = {**problems.QUERIES, **domain.QUERIES, **analogues.QUERIES}
SQL: dict[str, str] = {**problems.SQL, **domain.SQL, **analogues.SQL}
