"""Table and column profiles: counts, extremes and means of all columns come from one aggregate.

Everything that depends on single values (distinct counts, most frequent values, distributions) comes from one
frequency frame of (column, value, count), whose shuffle is shared.
"""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.frames import literal_frame
from plumbline.functions.predicates import as_of_column
from plumbline.operators.quantiles import exact_quantiles
from plumbline.session import cut_lineage

TOP_VALUES = 5
LOW_CARDINALITY = 20
NULL_BUCKET = "<NULL>"
KEPT_TEXT = 128
SHOWN_TEXT = 64


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_supported(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.ArrayType, T.StructType, T.BinaryType, T.VariantType))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def as_text(name: str, kind: T.DataType) -> Column:
    value = F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = F.when(value == 0, F.lit(0).cast(kind)).otherwise(value)
    return value.cast("string")


def _shortened(value: Column) -> Column:
    """Long text as its beginning and a fingerprint, longer than any text that is kept."""
    return F.when(
        F.length(value) > KEPT_TEXT, F.concat(F.substring(value, 1, SHOWN_TEXT), F.lit("#"), F.sha2(value, 256))
    ).otherwise(value)


def _families(df: DataFrame, names: list[str]) -> list[tuple[T.DataType, list[str]]]:
    """Columns by the type in which they are grouped: whole numbers together, others by their type."""
    families: dict[str, tuple[T.DataType, list[str]]] = {}
    for f in df.schema.fields:
        if f.name in names:
            kind = T.LongType() if isinstance(f.dataType, T.IntegralType) else f.dataType
            families.setdefault(kind.simpleString(), (kind, []))[1].append(f.name)
    return list(families.values())


def _unpivoted(df: DataFrame, names: list[str], kind: T.DataType) -> DataFrame:
    """(position, raw) of all non-NULL values of columns of one kind; positions count ``names``."""
    tagged = df.select(*[F.col(c).cast(kind).alias(str(i)) for i, c in enumerate(names)])
    return tagged.unpivot([], tagged.columns, "position", "raw").where("raw IS NOT NULL")


def _named(names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in names]), F.col("position").cast("int") + 1)


def value_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """The frequency frame: (column_name, value, n) for all non-NULL values of the columns.

    One shuffle per type family, however many columns: values travel in their own type and become
    text once they are counted. Long text takes part as a fingerprint, so that no shuffle ever
    carries whole documents.
    """
    frame = None if names else literal_frame(df.sparkSession, [], T.StructType().add(
        "column_name", "string").add("value", "string").add("n", "long"))
    for kind, members in _families(df, names):
        raw = F.col("raw")
        key = _shortened(raw) if isinstance(kind, T.StringType) else raw
        counted = (
            _unpivoted(df, members, kind).select("position", key.alias("raw"))
            .groupBy("position", "raw").agg(F.count(F.lit(1)).alias("n"))
            .select(_named(members).alias("column_name"), as_text("raw", kind).alias("value"), "n")
        )
        frame = counted if frame is None else frame.unionByName(counted)
    return frame


def value_counts_of(df: DataFrame) -> DataFrame | None:
    """The frequency frame of all columns that can be profiled, written once to be read several times."""
    names = [f.name for f in df.schema.fields if is_supported(f.dataType)]
    return cut_lineage(value_counts(df, names), "values") if names else None


def _restored(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """Replace fingerprints in a frame (``column_name``, ``value``, ...) by the full text.

    Which side is broadcast, if any, is left to the measured sizes. Without any text column the table is not read
    again.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return chosen
    long = chosen.where(F.length("value") > KEPT_TEXT).select("column_name", "value")
    sources = (
        _unpivoted(df, texts, T.StringType()).where(F.length("raw") > KEPT_TEXT)
        .select(_named(texts).alias("column_name"), F.col("raw").alias("text"), _shortened(F.col("raw")).alias("value"))
        .join(long, ["column_name", "value"])
        .groupBy("column_name", "value").agg(F.any_value("text").alias("text"))
    )
    return chosen.join(sources, ["column_name", "value"], "left").withColumn(
        "value", F.coalesce("text", "value")).drop("text")


def top_values(df: DataFrame, counts: DataFrame, limit: int = TOP_VALUES) -> DataFrame:
    """The most frequent values per column, the smaller text first among equals.

    Each task keeps what can be among the first before the shuffle: by count and beginning, with all that are equal
    in both to the last one kept. Those are ranked once more by their whole text.
    """
    beginning = F.substring("value", 1, SHOWN_TEXT)
    rough = Window.partitionBy("column_name").orderBy(F.desc("n"), beginning)
    possible = counts.withColumn("place", F.rank().over(rough)).where(F.col("place") <= limit).drop("place")
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    ranked = _restored(df, possible).withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    listed = F.array_sort(F.collect_list(F.struct("place", "value", F.col("n").alias("count"))))
    return ranked.groupBy("column_name").agg(
        F.transform(listed, lambda e: F.struct(e["value"].alias("value"), e["count"].alias("count")))
        .alias("top_values")
    )


def _base_statistics(df: DataFrame, fields: list[T.StructField], signed_zeros: bool = False) -> DataFrame:
    """One row per column with what a single pass without shuffle can tell."""
    aggregates: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        value = F.col(f.name).cast("string") if signed_zeros else as_text(f.name, f.dataType)
        aggregates += [
            F.count(f.name).alias(f"filled{i}"), F.min(value).alias(f"min{i}"), F.max(value).alias(f"max{i}"),
            F.min(f.name).alias(f"low{i}"), F.max(f.name).alias(f"high{i}"),
        ]
        if is_numeric(f.dataType):
            aggregates.append(F.avg(f.name).alias(f"mean{i}"))
    rows = []
    for i, f in enumerate(fields):
        nulls = F.col("rows") - F.col(f"filled{i}")
        mean = F.round(F.col(f"mean{i}").cast("double"), 4) if is_numeric(f.dataType) else F.lit(None)
        rows.append(F.struct(
            F.lit(f.name).alias("column_name"), F.lit(f.dataType.typeName()).alias("data_type"),
            F.col("rows").alias("row_count"), nulls.alias("null_count"),
            F.round(nulls * F.lit(100.0) / F.nullif(F.col("rows"), F.lit(0)), 4).alias("null_pct"),
            F.col(f"min{i}").alias("min_value"), F.col(f"max{i}").alias("max_value"),
            as_text(f"low{i}", f.dataType).alias("typed_min"), as_text(f"high{i}", f.dataType).alias("typed_max"),
            mean.cast("double").alias("mean"),
        ))
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def column_profiles(
    df: DataFrame, medians: bool = True, counts: DataFrame | None = None, signed_zeros: bool = False
) -> DataFrame:
    """One row per column. Columns of unsupported types only carry an error note.

    ``counts`` is the frequency frame, if it is at hand. The median is exact; ``typed_median`` shows it in full.

    ``min_value`` and ``max_value`` compare values as text; ``typed_min`` and ``typed_max`` compare them
    in their own type. With ``signed_zeros`` a negative zero keeps its sign in the former, as it does in a plain cast to
    text; in its own type it equals zero.
    """
    fields = [f for f in df.schema.fields if is_supported(f.dataType)]
    refused = [f for f in df.schema.fields if not is_supported(f.dataType)]
    spark = df.sparkSession
    profiles = None
    if fields:
        names = [f.name for f in fields]
        counts = value_counts(df, names) if counts is None else counts
        distinct = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count"))
        profiles = (
            _base_statistics(df, fields, signed_zeros)
            .join(distinct, "column_name", "left")
            .join(top_values(df, counts), "column_name", "left")
        )
        numeric = [f.name for f in fields if is_numeric(f.dataType)] if medians else []
        middle = exact_quantiles(df, {c: [0.5] for c in numeric})
        median, typed = F.lit(None).cast("double"), F.lit(None).cast("string")
        for c in numeric:
            if middle[c][0] is not None:
                here = F.col("column_name") == c
                median = F.when(here, F.round(F.lit(float(middle[c][0])), 4)).otherwise(median)
                typed = F.when(here, F.lit(str(middle[c][0]))).otherwise(typed)
        profiles = profiles.select(
            "column_name", "data_type", "row_count", "null_count", "null_pct",
            F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"), "min_value", "max_value", "typed_min",
            "typed_max", "mean",
            median.alias("median"), typed.alias("typed_median"), "top_values", F.lit(None).cast("string").alias("pattern_summary"),
        )
    if refused:
        notes = literal_frame(
            spark, [(f.name, f.dataType.typeName(), f"ERROR: cannot profile {f.dataType.typeName()}"[:200])
                    for f in refused],
            T.StructType().add("column_name", "string").add("data_type", "string").add("pattern_summary", "string"),
        )
        profiles = notes if profiles is None else profiles.unionByName(notes, allowMissingColumns=True)
    return profiles


def _few_valued(df: DataFrame, names: list[str], limit: int) -> list[str]:
    """Columns that may have few values: a sketch leaves out those with more than four times as many.

    The rest is counted exactly. The sketch errs by some hundredths, so none that matters is left out.
    """
    seen = df.agg(*[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if seen[f"d{i}"] <= 4 * limit + 100]


def distributions(df: DataFrame, limit: int = LOW_CARDINALITY, counts: DataFrame | None = None) -> DataFrame:
    """Counts and shares of every value of text and boolean columns with few values, NULL included.

    The frequency frame is cut down to these columns before it is joined: a column name is a hot key, and a join on it
    would bring all values of a column to one task.
    """
    fields = [f for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    names = [f.name for f in fields]
    if not names:
        return literal_frame(df.sparkSession, [], T.StructType().add("column_name", "string")
                             .add("value_or_bucket", "string").add("record_count", "long").add("percentage", "double"))
    if counts is None:
        counts = value_counts(df, _few_valued(df, names, limit))
    totals = _base_statistics(df, fields).select("column_name", "row_count", "null_count")
    sizes = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("values"))
    few = totals.join(sizes, "column_name", "left").where(
        (F.coalesce("values", F.lit(0)) <= limit)
        & (F.col("values").isNotNull() | (F.col("row_count") == F.col("null_count"))))
    chosen = few.agg(F.collect_set("column_name").alias("names")).scalar()
    filled = counts.where(F.array_contains(chosen, F.col("column_name"))).join(
        few.select("column_name", "row_count"), "column_name")
    absent = few.where("null_count > 0").select(
        "column_name", F.lit(NULL_BUCKET).alias("value"), F.col("null_count").alias("n"), "row_count")
    share = F.round(F.col("n") * F.lit(100.0) / F.col("row_count"), 4)
    return _restored(df, filled).unionByName(absent).select(
        "column_name", F.col("value").alias("value_or_bucket"), F.col("n").alias("record_count"),
        share.alias("percentage"),
    )


def approximate_profiles(df: DataFrame) -> DataFrame:
    """Column profiles from a single scan without any shuffle of values.

    Distinct counts, medians and most frequent values are sketches with the engine's default
    error bounds; everything else is exact.
    """
    fields = [f for f in df.schema.fields if is_supported(f.dataType)]
    sketches: list[Column] = []
    for i, f in enumerate(fields):
        sketches += [
            F.approx_count_distinct(f.name).alias(f"distinct{i}"),
            F.expr(f"approx_top_k({_quoted(f.name)}, {TOP_VALUES})").alias(f"top{i}"),
        ]
        if is_numeric(f.dataType):
            sketches.append(F.percentile_approx(F.col(f.name).cast("double"), 0.5).alias(f"median{i}"))
    rows = [
        F.struct(
            F.lit(f.name).alias("column_name"), F.col(f"distinct{i}").alias("distinct_count"),
            (F.round(F.col(f"median{i}"), 4) if is_numeric(f.dataType) else F.lit(None).cast("double")).alias("median"),
            F.transform(f"top{i}", lambda e: F.struct(
                e["item"].cast("string").alias("value"), e["count"].alias("count"))).alias("top_values"),
        )
        for i, f in enumerate(fields)
    ]
    sketched = df.agg(*sketches).select(F.inline(F.array(*rows)))
    return _base_statistics(df, fields).join(sketched, "column_name").withColumn(
        "pattern_summary", F.lit(None).cast("string"))


def table_profile(
    df: DataFrame, table: str, profiled_at: dt.datetime, catalog: str = "main", namespace: str = "public"
) -> DataFrame:
    profile_id = hashlib.sha256(f"{catalog}.{namespace}.{table}|{profiled_at}".encode()).hexdigest()[:36]
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(profile_id).alias("profile_id"), F.lit(catalog).alias("database_name"),
        F.lit(namespace).alias("schema_name"), F.lit(table).alias("table_name"), "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        as_of_column(profiled_at).alias("profiled_at"), F.lit("COMPLETED").alias("profile_status"),
    )


def profile_receipt(profile: DataFrame) -> DataFrame:
    return profile.select("profile_id", F.to_json(F.struct(
        "profile_id", F.col("table_name").alias("table"), F.col("row_count").alias("rows"),
        F.col("column_count").alias("columns"), F.col("profile_status").alias("status"),
    )).alias("receipt"))


def located(profile: DataFrame, table: str, moment: dt.datetime, moment_column: str = "profiled_at",
            catalog: str = "main", namespace: str = "public") -> DataFrame:
    """Profile rows with the names and the time under which they are stored."""
    return profile.select(
        F.lit(catalog).alias("database_name"), F.lit(namespace).alias("schema_name"),
        F.lit(table).alias("table_name"), "*", as_of_column(moment).alias(moment_column),
    )
