"""The registry that the query modules fill."""

from __future__ import annotations

from pagemask.plans.views_sql import with_views
from pagemask.sources.layout import Views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Registers a function of Views as the query `name`; sql is its DuckDB form, over the sample views that `views` names."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(views, sql) if views else sql
        return f

    return register
