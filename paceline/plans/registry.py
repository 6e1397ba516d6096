"""All queries of the rating engine by name, with the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register ``f(spark, sf_dir)`` under its name, and its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


from paceline.plans import box_queries, efficiency_queries, evaluation_queries, game_queries, rating_queries, walkforward_queries  # noqa: E402, F401
