"""Ways of handling the missing responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators.analysis import analysis_set
from lacuna.study import DEFAULT_STUDY, LAGGED, RESPONSE, Study


def complete_case(
    responses: DataFrame, subjects: DataFrame, study: Study = DEFAULT_STUDY
) -> DataFrame:
    """The truth: analysis-visit rows before anything is made missing."""
    return analysis_set(responses, subjects, study)


def completers(rows: DataFrame, missing: str | None = None) -> DataFrame:
    """Leave missing subjects out.

    With a flag column the flagged rows go; otherwise rows without a response.
    """
    if missing is not None:
        return rows.filter(~F.col(missing))
    return rows.filter(F.col(RESPONSE).isNotNull())


def impute_composite(rows: DataFrame, missing: str | None = None) -> DataFrame:
    """Count missing as no response.

    With a flag column only flagged rows change and other nulls stay; otherwise
    every null does.
    """
    y = F.col(RESPONSE)
    if missing is not None:
        return rows.withColumn(RESPONSE, F.when(F.col(missing), 0).otherwise(y))
    return rows.withColumn(RESPONSE, F.coalesce(y, F.lit(0)))


def impute_locf(
    rows: DataFrame,
    missing: str | None = None,
    mode: str = "lag1_original",
    first_visit: int | None = None,
    first_visit_value: int = 0,
    study: Study = DEFAULT_STUDY,
) -> DataFrame:
    """Carry an earlier response forward.

    ``lag1_original`` carries the preceding row's response as it was before
    masking; ``last_observed`` the last response that is still there (needs the
    columns of ``last_observed``). With a flag column only flagged rows change;
    otherwise every null does, and a null at ``first_visit`` becomes a fixed value.
    """
    if mode == "lag1_original":
        carried = F.col(LAGGED)
    elif mode == "last_observed":
        carried = F.col("SEEN")
        if "dropout_visit" in rows.columns:
            # A row before the dropout visit still sees everything before it.
            gone = F.when(F.col("AVISITN") >= F.col("dropout_visit"), F.col("dropout_visit"))
            carried = F.when(gone.isNull(), carried)
            for v in study.dropout_visits:
                carried = carried.when(gone == v, F.col(f"SEEN_{v}"))
    else:
        raise ValueError(f"unknown mode: {mode}")
    y = F.col(RESPONSE)
    if missing is not None:
        return rows.withColumn(RESPONSE, F.when(F.col(missing), carried).otherwise(y))
    filled = F.when(y.isNotNull(), y)
    if first_visit is not None:
        filled = filled.when(F.col("AVISITN") == first_visit, first_visit_value)
    return rows.withColumn(RESPONSE, filled.otherwise(carried))
