"""All registered queries: name -> (query, check SQL or None)."""

from trailmark.session import ship_package
from workload import graph_queries, page_queries, search_queries, state_queries, stream_queries, variant_queries, vector_queries

_QUERIES = {
    **search_queries.QUERIES,
    **page_queries.QUERIES,
    **vector_queries.QUERIES,
    **graph_queries.QUERIES,
    **state_queries.QUERIES,
    **stream_queries.QUERIES,
    **variant_queries.QUERIES,
}


def _ready(query):
    def run(spark, sf_dir):
        return query(ship_package(spark), sf_dir)

    run.__doc__ = query.__doc__
    return run


ALL = {name: (_ready(query), sql) for name, (query, sql) in _QUERIES.items()}
