"""Query plans: modules with QUERIES and ORACLES."""

from . import acl_queries, analytics_queries, answer_queries, document_queries, graph_queries, memory_queries, report_queries, retrieval_queries, sharing_queries

ALL = [retrieval_queries, acl_queries, analytics_queries, graph_queries, document_queries, memory_queries, answer_queries, sharing_queries, report_queries]
