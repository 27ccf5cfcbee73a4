"""Queries by name, each with the DuckDB SQL that it has to equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..views import role, with_roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Roles:
    """The roles of one session and folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return role(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    """Registers f(r: Roles) under name."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Roles(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = with_roles(sql)
        return f

    return add
