"""The register of queries and their SQL twins."""

from __future__ import annotations

from lumenlake.plans.views import duck, views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(names: str = "", sql: str | None = None, plain: bool = False):
    """Register f(v, spark, sf_dir), where v(name) is a catalogue view; sql: its DuckDB twin over `names`."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(views(spark, sf_dir), spark, sf_dir)
        if sql:
            ORACLES[f.__name__] = sql if plain else duck(names, sql)
        return f

    return add
