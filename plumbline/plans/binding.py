"""From a check specification to Spark expressions.

Three shapes exist. A *row* check is one predicate: any number of them share a scan. A *keyed*
check is a test on groups: those on the same keys share a shuffle. A *frame* check brings its own
plan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config.specs import CheckSpec
from plumbline.frames import scalar
from plumbline.functions import predicates as p
from plumbline.operators import relational_checks as rel
from plumbline.operators import schema_checks
from plumbline.operators.skew import compact_key
from plumbline.operators.stat_checks import zscore
from plumbline.sources.tables import Tables


@dataclass
class TableContext:
    tables: Tables
    table: str
    as_of: dt.datetime
    snapshots: DataFrame | None = None
    catalog: str = "main"
    namespace: str = "public"

    @property
    def df(self) -> DataFrame:
        return self.tables[self.table]

    def total(self) -> Column:
        return scalar(self.df, F.count(F.lit(1)))


@dataclass
class RowCheck:
    spec: CheckSpec
    predicate: Column
    record: Column
    value: Column


@dataclass
class KeyedCheck:
    spec: CheckSpec
    keys: tuple[str, ...]
    test: Column
    record: Column | None
    value: Column
    where: str | None = None
    measures: dict[str, Column] = field(default_factory=dict)


@dataclass
class FrameCheck:
    spec: CheckSpec
    counts: DataFrame
    failing: DataFrame | None



def _no_value() -> Column:
    return F.lit(None).cast("string")


def _row(spec: CheckSpec, predicate: Column, value: Column | None = None) -> RowCheck:
    return RowCheck(spec, predicate, F.col(spec.param("record_id")), _no_value() if value is None else value)


def _rule(spec: CheckSpec, ctx: TableContext, key: str) -> Column:
    return F.expr(p.bind_clock(spec.param(key), ctx.as_of))


def _names(text: str) -> tuple[str, ...]:
    return tuple(name.strip() for name in text.split(","))


def _where(text: str) -> str | None:
    text = text.strip()
    if text.upper().startswith("WHERE "):
        text = text[6:]
    return text or None


def _null(spec, ctx):
    return _row(spec, p.is_missing(F.col(spec.column())))


def _unique(spec, ctx):
    column = spec.column()
    return KeyedCheck(spec, (column,), F.col("n") > 1, F.col(column), _no_value())


def _duplicate(spec, ctx):
    where = _where(spec.params.get("where_clause", ""))
    return KeyedCheck(spec, _names(spec.param("columns")), F.col("n") > 1, None, _no_value(), where)


def _reference(spec, ctx):
    child, parent = ctx.df, ctx.tables[spec.param("parent_table")]
    fk, pk = spec.param("fk_column"), spec.param("pk_column")
    found = rel.orphan_counts(child, fk, parent, pk)
    counts = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failure_count"))
    failing = found.select(F.col(fk).alias("record_id"), F.col(fk).alias("failed_value"), F.col("n").alias("copies"))
    return FrameCheck(spec, counts, failing)


def _type(spec, ctx):
    value = F.col(spec.column())
    wrong = p.has_wrong_type(value, spec.param("expected_type"))
    row_filter = spec.params.get("filter", "").strip()
    return _row(spec, F.expr(row_filter) & wrong if row_filter else wrong, value)


def _range(spec, ctx):
    value = F.col(spec.column())
    low, high = F.expr(spec.param("min_value")), F.expr(spec.param("max_value"))
    return _row(spec, p.is_out_of_range(value, low, high), value)


def _length(spec, ctx):
    value = F.col(spec.column())
    return _row(spec, p.has_bad_length(value, int(spec.param("min_length")), int(spec.param("max_length"))), value)


def _pattern(spec, ctx):
    value = F.col(spec.column())
    return _row(spec, p.breaks_pattern(value, spec.param("pattern")), value)


def _domain(spec, ctx):
    value = F.col(spec.column())
    outside = F.expr(f"`{spec.column()}` NOT IN ({spec.param('allowed_values')})")
    return _row(spec, value.isNotNull() & outside, value)


def _violation(spec, ctx):
    return _row(spec, _rule(spec, ctx, "rule_expression"))


def _fresh(spec, ctx):
    moment = F.col(spec.param("timestamp_column"))
    limit = int(spec.param("max_staleness_days"))
    return _row(spec, p.is_stale(moment, p.as_of_column(ctx.as_of), limit), moment)


def _complete(spec, ctx):
    return _row(spec, _rule(spec, ctx, "null_check_expression"))


def _volume(spec, ctx):
    volume = F.col(spec.param("volume_column"))
    return _row(spec, p.is_zero_volume(volume, F.col(spec.param("date_column"))), volume)


def _skew(spec, ctx):
    column = spec.column()
    share = F.col("n") * F.lit(100.0) / F.nullif(ctx.total(), F.lit(0))
    return KeyedCheck(spec, (column,), share > float(spec.param("max_pct")), None, F.col(column))


def _outlier(spec, ctx):
    column = spec.column()
    far = F.abs(zscore(ctx.df, column)) > float(spec.param("z_threshold"))
    return _row(spec, F.col(column).isNotNull() & far, F.col(column))


def _drift(spec, ctx):
    if ctx.snapshots is None:
        raise ValueError(f"check {spec.check_id} on {ctx.table} needs schema snapshots")
    columns = schema_checks.schema_frame(ctx.tables.spark, ctx.df.schema, ctx.table, ctx.catalog, ctx.namespace)
    failing = schema_checks.changed_columns(columns, ctx.snapshots, ctx.table)
    return FrameCheck(spec, failing.agg(F.count(F.lit(1)).alias("failure_count")),
                      failing.withColumn("copies", F.lit(1)))


def _reconcile(spec, ctx):
    keep = None
    if "tgt_filter_col" in spec.params:
        value = spec.param("tgt_filter_val").replace("'", "''")
        keep = f"`{spec.param('tgt_filter_col')}` = '{value}'"
    found = rel.reconcile(
        ctx.tables[spec.param("source_table")], spec.param("src_date_col"), spec.param("src_amount_col"),
        ctx.df, spec.param("tgt_date_col"), spec.param("tgt_count_col"), spec.param("tgt_amount_col"), keep,
    )
    counts = found.agg(F.coalesce(F.sum("matches"), F.lit(0)).alias("failure_count"))
    failing = found.select("record_id", _no_value().alias("failed_value"), F.col("matches").alias("copies"))
    return FrameCheck(spec, counts, failing)


def _file(spec, ctx):
    column = spec.param("file_column")
    value = F.col(column)
    return KeyedCheck(spec, (column,), value.isNotNull() & (F.col("n") > 1), value, value)


def _negative(spec, ctx):
    value = F.col(spec.column())
    return _row(spec, p.is_negative(value), value)


def _total(spec, ctx):
    total = F.col(spec.param("total_column"))
    wrong = p.total_differs(
        total, F.col(spec.param("qty_column")), F.col(spec.param("price_column")), F.expr(spec.param("tolerance"))
    )
    return _row(spec, wrong, total)


def _hierarchy(spec, ctx):
    found = rel.hierarchy_findings(ctx.df, spec.param("id_column"), spec.param("parent_column"))
    counts = found.agg(F.coalesce(F.sum("findings"), F.lit(0)).alias("failure_count"))
    return FrameCheck(spec, counts, found.withColumnRenamed("findings", "copies"))


def _sources(spec, ctx):
    date, group, amount = (spec.param(k) for k in ("date_column", "group_column", "amount_column"))
    value = spec.param("group_value").replace("'", "''")
    return KeyedCheck(
        spec, (date, group), F.col("smallest") < F.col("largest"), F.col(date), F.col(group),
        where=f"`{group}` = '{value}' AND `{date}` IS NOT NULL",
        measures={"smallest": F.min(amount), "largest": F.max(amount)},
    )


def _cdc(spec, ctx):
    """Either a row rule, or ``duplicate_keys`` with optional group and row filters."""
    value = F.col(spec.param("cdc_op_column"))
    if "duplicate_keys" not in spec.params:
        return _row(spec, _rule(spec, ctx, "rule_expression"), value)
    keys = list(_names(spec.param("duplicate_keys")))
    inner, outer = spec.params.get("group_filter"), spec.params.get("row_filter")
    found = rel.repeated_tuple_counts(ctx.df, keys, inner, outer)
    counts = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failure_count"))
    failing = rel.repeated_tuples(
        ctx.df, keys, spec.param("record_id"), spec.param("cdc_op_column"), inner, outer
    ).withColumn("copies", F.lit(1))
    return FrameCheck(spec, counts, failing)


BINDERS: dict[int, Callable] = {
    1: _null, 2: _unique, 3: _duplicate, 4: _reference, 5: _type, 6: _range, 7: _length, 8: _pattern,
    9: _domain, 10: _violation, 11: _violation, 12: _fresh, 13: _complete, 14: _volume, 15: _skew,
    16: _outlier, 17: _drift, 18: _reconcile, 19: _file, 20: _negative, 21: _total, 22: _hierarchy,
    23: _sources, 24: _violation, 25: _cdc,
}


def bind(spec: CheckSpec, ctx: TableContext) -> RowCheck | KeyedCheck | FrameCheck:
    """Bind and analyse one check; a wrong column or expression raises here, not in the shared job."""
    bound = BINDERS[spec.check_id](spec, ctx)
    if isinstance(bound, RowCheck):
        ctx.df.select(bound.predicate.alias("p"), bound.record.alias("r"), bound.value.alias("v"))
    elif isinstance(bound, KeyedCheck):
        grouped(ctx.df, [bound]).select(bound.test.alias("t"))
    return bound


def grouped(df: DataFrame, checks: list[KeyedCheck], compact: bool = False) -> DataFrame:
    """One aggregation serving all given checks, which share keys and row filter.

    ``compact`` groups long text by fingerprint: enough for counting, not for showing the keys.
    """
    first = checks[0]
    rows = df.where(first.where) if first.where else df
    keys = [compact_key(k, df.schema) if compact else F.col(k) for k in first.keys]
    measures = {name: m for check in checks for name, m in check.measures.items()}
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[m.alias(name) for name, m in measures.items()]
    )
