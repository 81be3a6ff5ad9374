"""Names, functions and DuckDB oracles of the evaluation and audit queries."""

from __future__ import annotations

from auditframe.plans import audit, audit_sql, evaluation, evaluation_sql

QUERIES = evaluation.QUERIES | audit.QUERIES
ORACLES = evaluation_sql.ORACLES | audit_sql.ORACLES
FLAGSHIP = "boot_specificity_ci"
