"""All registered queries of the recording library, with their SQL."""

from takewise.plans import catalog_queries, edit_queries, file_queries, matching_queries, report_queries, signal_queries

_MODULES = [matching_queries, catalog_queries, edit_queries, signal_queries, report_queries, file_queries]


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
