"""The library's queries over the driver's tables, and their SQL."""

from folioworks.plans import document_queries, file_queries, report_queries, retrieval_queries, table_queries  # noqa: F401  they register
from folioworks.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
