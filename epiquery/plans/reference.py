"""All queries of the reference's operators."""

from . import corpus_queries, post_queries, text_queries

MODULES = (text_queries, corpus_queries, post_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
