"""The registered queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "group_voxel_ttest"


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name, with its SQL if there is any."""

    def keep(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return keep


def join_twins(suffix: str = "_all") -> None:
    """Queries that were first registered over a part of their tables, and the whole job under the same name with `suffix`, become
    one: both names are the whole job, with its SQL."""
    for whole in [name for name in QUERIES if name.endswith(suffix)]:
        name = whole.removesuffix(suffix)
        if name in QUERIES:
            QUERIES[name] = QUERIES[whole]
            ORACLE_SQL[name] = ORACLE_SQL[whole]
