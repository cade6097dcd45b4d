"""Check specifications: what to test, on which table, with which limits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config.library import CHECKS, THRESHOLD_VALUES
from plumbline.schemas import ASSIGNMENTS


@dataclass(frozen=True)
class CheckSpec:
    check_id: int
    check_name: str
    target_table: str
    target_column: str | None
    params: Mapping[str, str] = field(default_factory=dict)
    severity: str = "MEDIUM"
    weight: Decimal = Decimal("1.00")
    warning: Decimal | None = None
    fail: Decimal | None = None
    target_database: str = "main"
    target_schema: str = "public"

    @property
    def label(self) -> str:
        """Tells apart several uses of one check on one table."""
        settings = hashlib.md5(repr(sorted(self.params.items())).encode()).hexdigest()[:8]
        return f"{self.check_id}:{self.target_column or '*'}:{settings}"

    def param(self, key: str) -> str:
        try:
            return self.params[key]
        except KeyError:
            raise KeyError(f"check {self.check_id} on {self.target_table} needs parameter '{key}'") from None

    def column(self) -> str:
        if not self.target_column:
            raise KeyError(f"check {self.check_id} on {self.target_table} needs a target column")
        return self.target_column


def spec(check_id: int, table: str, column: str | None = None, **params) -> CheckSpec:
    """A specification with the library's name, severity, weight and limits."""
    _, name, _, severity, weight, _ = next(c for c in CHECKS if c[0] == check_id)
    _, _, warn, fail = next(t for t in THRESHOLD_VALUES if t[0] == check_id)
    return CheckSpec(
        check_id, name, table, column, {k: str(v) for k, v in params.items()},
        severity, Decimal(weight), Decimal(warn), Decimal(fail),
    )


def assignment_frame(spark: SparkSession, specs: Iterable[CheckSpec]) -> DataFrame:
    rows = [
        (i, s.check_id, s.target_database, s.target_schema, s.target_table, s.target_column,
         dict(s.params), True)
        for i, s in enumerate(specs, start=1)
    ]
    return spark.createDataFrame(rows, ASSIGNMENTS)


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    """Assignments from JSON lines; ``params`` is an object of texts."""
    return spark.read.schema(ASSIGNMENTS).option("mode", "FAILFAST").json(path)


def parse_params(assignments: DataFrame, json_column: str = "params_json") -> DataFrame:
    """Replace a JSON text column by a typed ``params`` map."""
    return assignments.withColumn("params", F.from_json(json_column, "map<string,string>")).drop(json_column)


def resolve_checks(assignments: DataFrame, library: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Active assignments with library metadata and active limits.

    A check with two active limits appears twice, and runs twice.
    """
    limits = thresholds.where("is_active").select("check_id", "warning_value", "fail_value")
    catalog = library.where("is_active").select("check_id", "check_name", "severity", "weight")
    return (
        assignments.where("is_active")
        .join(catalog, "check_id")
        .join(limits, "check_id", "left")
    )


def load_specs(assignments: DataFrame, library: DataFrame, thresholds: DataFrame) -> list[CheckSpec]:
    """Configuration is a handful of rows per table; the driver needs it to build the plans."""
    resolved = resolve_checks(assignments, library, thresholds)
    ordered = resolved.orderBy("target_database", "target_schema", "target_table", "check_id", "assignment_id")
    return [
        CheckSpec(
            r.check_id, r.check_name, r.target_table, r.target_column, dict(r.params or {}),
            r.severity, r.weight, r.warning_value, r.fail_value, r.target_database, r.target_schema,
        )
        for r in ordered.toLocalIterator()
    ]
