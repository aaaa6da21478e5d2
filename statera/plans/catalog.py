"""All queries of the statement engine and their SQL."""

from statera.plans import report_queries, shown_sql, statement_queries, text_queries, whole_report_queries

QUERIES = {**statement_queries.QUERIES, **text_queries.QUERIES, **report_queries.QUERIES, **whole_report_queries.QUERIES}
ORACLE = {**statement_queries.ORACLE, **text_queries.ORACLE, **report_queries.ORACLE, **whole_report_queries.ORACLE, **shown_sql.ORACLE}
