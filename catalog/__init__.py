"""The queries checked against SQL, and that SQL."""


def all_queries() -> dict:
    from catalog import graph_queries, source_queries

    return {**graph_queries.QUERIES, **source_queries.QUERIES}


def all_oracles() -> dict:
    from catalog import graph_sql, source_sql

    return {**graph_sql.ORACLES, **source_sql.ORACLES}
