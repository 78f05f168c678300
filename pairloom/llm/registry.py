"""All queries of this subpackage and the SQL that states the same."""

from __future__ import annotations

from pairloom.llm import problems

QUERIES = {**problems.QUERIES}
SQL: dict[str, str] = {**problems.SQL}
