"""Readers for the two trial tables and the parameter frames of a simulation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.study import (
    MAR_SCRIPT,
    MCAR_RATES,
    RESPONSE_SCHEMA,
    SUBJECT_SCHEMA,
    MarRates,
    mcar_label,
)


def _typed(df: DataFrame, schema: T.StructType, keep_extra: bool) -> DataFrame:
    known = []
    for f in schema.fields:
        value = F.col(f"`{f.name}`")
        if isinstance(df.schema[f.name].dataType, T.StringType):
            # An empty field is missing; any other unreadable text fails the cast.
            if not isinstance(f.dataType, T.StringType):
                value = F.when(F.trim(value) != "", value)
        known.append(value.cast(f.dataType).alias(f.name))
    names = set(schema.fieldNames())
    extra = [F.col(f"`{c}`") for c in df.columns if c not in names] if keep_extra else []
    return df.select(*known, *extra)


def _load(spark, path, schema, fmt, keep_extra):
    if fmt == "csv":
        # Columns are taken by header name: files may hold more columns, in any order.
        raw = spark.read.csv(path, header=True, nullValue="NA", inferSchema=False)
    else:
        raw = spark.read.format(fmt).load(path)
    return _typed(raw, schema, keep_extra)


def load_responses(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "csv",
    keep_extra: bool = False,
) -> DataFrame:
    """Long response table, one row per subject, parameter and visit."""
    return _load(spark, path, RESPONSE_SCHEMA, fmt, keep_extra)


def load_subjects(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "csv",
    keep_extra: bool = False,
) -> DataFrame:
    """Subject table, one row per subject."""
    return _load(spark, path, SUBJECT_SCHEMA, fmt, keep_extra)


def subject_universe(
    subjects: DataFrame | None = None,
    *,
    spark: SparkSession | None = None,
    size: int | None = None,
) -> DataFrame:
    """Ids that can be drawn: those of the subject table, or literally 1..size."""
    if subjects is not None:
        return subjects.select("SUBJID").distinct()
    return spark.range(1, size + 1).select(F.col("id").alias("SUBJID"))


def seed_frame(spark: SparkSession, seeds: Sequence[int]) -> DataFrame:
    """The replicate seeds as a one-column frame."""
    if isinstance(seeds, range):
        return spark.range(seeds.start, seeds.stop, seeds.step).toDF("seed")
    return spark.createDataFrame([(int(s),) for s in seeds], "seed long")


def scenario_grid(
    spark: SparkSession,
    mcar: Iterable[float] = MCAR_RATES,
    mar: Iterable[MarRates] = MAR_SCRIPT,
) -> DataFrame:
    """One row per scenario with its mechanism and rates."""
    rows = [(mcar_label(p), "MCAR", float(p), None, None) for p in mcar]
    rows += [(m.label, "MAR", None, float(m.high), float(m.low)) for m in mar]
    return spark.createDataFrame(
        rows, "scenario string, mechanism string, p double, p_high double, p_low double"
    )
