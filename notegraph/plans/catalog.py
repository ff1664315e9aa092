"""All queries outside the subpackage for training text, with their SQL."""

from __future__ import annotations

from . import details, problems, reference, vaults


def queries() -> dict:
    return reference.queries() | details.queries() | vaults.queries() | problems.queries()


def oracle_sql() -> dict[str, str]:
    return reference.oracle_sql() | details.oracle_sql() | vaults.oracle_sql() | problems.oracle_sql()
