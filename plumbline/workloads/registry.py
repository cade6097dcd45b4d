"""The named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.tables import Tables, parquet_tables


@dataclass(frozen=True)
class Workload:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(parquet_tables(spark, sf_dir))


WORKLOADS: dict[str, Workload] = {}


def workload(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        if name in WORKLOADS:
            raise ValueError(f"workload {name} exists already")
        WORKLOADS[name] = Workload(name, build, sql)
        return build

    return register
