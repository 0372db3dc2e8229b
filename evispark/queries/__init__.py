"""The operators' queries over the driver's tables, each with SQL that gives the same rows."""

from . import comparison, documents, merges, rules, specifications

QUERIES = comparison.QUERIES | documents.QUERIES | merges.QUERIES | rules.QUERIES | specifications.QUERIES
ORACLE_SQL = comparison.ORACLE_SQL | documents.ORACLE_SQL | merges.ORACLE_SQL | rules.ORACLE_SQL | specifications.ORACLE_SQL
