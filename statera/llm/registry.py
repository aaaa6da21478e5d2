"""All queries of the subpackage and their SQL."""

from statera.llm import queries_near, queries_pages, queries_sets, queries_tables, queries_text

QUERIES = {**queries_text.QUERIES, **queries_sets.QUERIES, **queries_pages.QUERIES, **queries_near.QUERIES, **queries_tables.QUERIES}
ORACLE = {**queries_text.ORACLE, **queries_sets.ORACLE, **queries_pages.ORACLE, **queries_near.ORACLE, **queries_tables.ORACLE}
