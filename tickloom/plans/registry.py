"""How a named query and its DuckDB twin are declared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name.  ``doubles`` are rounded (and -0 becomes 0) and ``longs`` cast in both engines, so values compare."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, views: tuple[str, ...] = (), doubles: str = "", longs: str = "", digits: int = 6):
        ds, ls = doubles.split(), longs.split()

        def wrap(f: Query) -> Query:
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                df = f(spark, sf_dir)
                return df.withColumns({**{c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in ds}, **{c: F.col(c).cast("long") for c in ls}}) if ds or ls else df

            query.__name__, query.__doc__ = name, f.__doc__
            self.queries[name] = query
            if sql is not None:
                repl = ", ".join([f"round(CAST({c} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS {c}" for c in ds] + [f"CAST({c} AS BIGINT) AS {c}" for c in ls])
                head = f"WITH {with_views(*views)}\n" if views else ""
                self.oracles[name] = f"{head}SELECT * {f'REPLACE ({repl})' if repl else ''} FROM ({sql})"
            return f

        return wrap
