"""Named tables as DataFrames."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Resolves table names to DataFrames: given frames, then files in a folder, then the catalog."""

    def __init__(
        self, spark: SparkSession, frames: Mapping[str, DataFrame] | None = None, folder: str | None = None
    ):
        self.spark = spark
        self._frames = {name.lower(): df for name, df in (frames or {}).items()}
        self.folder = folder

    def __getitem__(self, name: str) -> DataFrame:
        key = name.lower()
        if key not in self._frames:
            if self.folder:
                self._frames[key] = self.spark.read.parquet(os.path.join(self.folder, f"{key}.parquet"))
            else:
                self._frames[key] = self.spark.table(name)
        return self._frames[key]


def parquet_tables(spark: SparkSession, folder: str) -> Tables:
    return Tables(spark, folder=folder)
