"""Frames behind the figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.study import STRATEGIES

# Axis, group and legend labels, in display order.
AXIS_LABELS = {
    "AvsP": "TRTP Active control \n vs Placebo",
    "T140vsP": "TRTP Test drug 140mg \n vs Placebo ",
    "T210vsP": "TRTP Test drug 210mg \n vs Placebo ",
    "SexM2F": "Sex(M vs F)",
}
GROUP_LABELS = {
    "completers": "Completers Data",
    "imputed": "Imputed Data (Composite)",
    "locf": "Imputed Data (LOCF)",
    "complete": "Complete Data",
}
LEGEND_LABELS = {
    "AvsP": "Active Control vs Placebo",
    "T140vsP": "140 mg Test Drug vs Placebo",
    "T210vsP": "210 mg Test Drug vs Placebo",
}
HANDLING_LABELS = {"completers": "completers", "imputed": "composite", "locf": "LOCF"}


def _label(column: str, labels: dict[str, str]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for value, label in labels.items():
        out = out.when(F.col(column) == value, label)
    return out


def _place(column: str, labels: dict[str, str]) -> Column:
    return F.array_position(F.array(*map(F.lit, labels)), F.col(column))


def truth_frame(truth: DataFrame) -> DataFrame:
    """Four rows: the true odds ratios."""
    return truth.orderBy(_place("contrast", AXIS_LABELS)).select(
        _label("contrast", AXIS_LABELS).alias("yAxis"),
        F.col("or_value").alias("boxOdds"),
        F.round("or_value", 3).alias("VAL"),
    )


def forest_frame(summary: DataFrame, truth: DataFrame) -> DataFrame:
    """Sixteen rows per scenario: three strategies with limits, then the truth.

    The truth's limits are its value.
    """
    known = truth.select("contrast", F.col("or_value").alias("known"))

    def row(strategy: Column, *values: str) -> Column:
        names = ("boxOdds", "boxCILow", "boxCIHigh")
        return F.struct(
            strategy.alias("strategy"), *[F.col(v).alias(n) for v, n in zip(values, names)]
        )

    own = row(F.col("strategy"), "mean", "low", "high")
    complete = row(F.lit("complete"), "known", "known", "known")
    # The truth stands beside one strategy of each scenario.
    both = F.when(F.col("strategy") == STRATEGIES[0], F.array(own, complete))
    return (
        summary.join(known, "contrast")
        .select("scenario", "contrast", F.inline(both.otherwise(F.array(own))))
        .orderBy("scenario", _place("strategy", GROUP_LABELS), _place("contrast", AXIS_LABELS))
        .select(
            "scenario",
            _label("contrast", AXIS_LABELS).alias("yAxis"),
            "boxOdds",
            "boxCILow",
            "boxCIHigh",
            _label("strategy", GROUP_LABELS).alias("group"),
            F.round("boxOdds", 3).alias("VAL"),
        )
    )


def variance_frame(summary: DataFrame) -> DataFrame:
    """Nine rows per scenario: the variance of the treatment odds ratios."""
    return (
        summary.filter(F.col("contrast") != "SexM2F")
        .orderBy("scenario", _place("strategy", HANDLING_LABELS), _place("contrast", LEGEND_LABELS))
        .select(
            "scenario",
            _label("contrast", LEGEND_LABELS).alias("OR"),
            _label("strategy", HANDLING_LABELS).alias("dataHandling"),
            F.round("var", 2).alias("var"),
        )
    )


def single_draw_frame(ratios: DataFrame, truth: DataFrame) -> DataFrame:
    """Eight rows per scenario and strategy: one draw beside the truth."""
    drawn = ratios.select(
        "scenario", "strategy", "contrast", F.col("or_value").alias("boxOdds")
    )
    known = truth.select("contrast", F.col("or_value").alias("known"))
    both = drawn.join(known, "contrast").select(
        "scenario",
        "strategy",
        "contrast",
        F.inline(
            F.array(
                F.struct(F.col("strategy").alias("source"), "boxOdds"),
                F.struct(F.lit("complete").alias("source"), F.col("known").alias("boxOdds")),
            )
        ),
    )
    return both.orderBy(
        "scenario",
        _place("strategy", GROUP_LABELS),
        _place("source", GROUP_LABELS),
        _place("contrast", AXIS_LABELS),
    ).select(
        "scenario",
        "strategy",
        _label("contrast", AXIS_LABELS).alias("yAxis"),
        "boxOdds",
        _label("source", GROUP_LABELS).alias("group"),
        F.round("boxOdds", 3).alias("VAL"),
    )
