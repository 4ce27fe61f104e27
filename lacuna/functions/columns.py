"""Column expressions shared by the operators. All run inside generated code."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.study import Design, Study


def draw_key(subject: Column, seed: Column, draw: int) -> Column:
    """Reproducible 64-bit sort key of a subject in one draw of one replicate.

    Drawing the k subjects with the smallest keys is a simple random sample
    without replacement. The rate is not part of the key, so a smaller sample
    is always contained in a larger one.
    """
    return F.xxhash64(subject.cast("long"), seed.cast("long"), F.lit(draw).cast("long"))


def sample_size(rate: Column, pool: Column) -> Column:
    """Whole number of subjects to draw: the product of rate and size, truncated."""
    return F.floor(rate.cast("double") * pool).cast("long")


def poor_response(visit: int, study: Study) -> Column:
    """True on a row of the visit with a poor change from baseline, never null."""
    change = F.col("PCHG")
    poor = change < study.poor_cut if study.poor_below else change > study.poor_cut
    return F.coalesce((F.col("AVISITN") == visit) & poor, F.lit(False))


def cell_code(design: Design, columns: dict[str, Column] | None = None) -> Column:
    """Number of a row's cell in the crossed design, null where a factor is null.

    A level the design does not list stops the job; it would otherwise be lost.
    """
    code = F.lit(0)
    for factor in design.factors:
        value = columns[factor.name] if columns else F.col(factor.name)
        code = code * len(factor.levels) + level_code(factor, value)
    return code.cast("int")


def level_code(factor, value: Column) -> Column:
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for i, level in enumerate(factor.levels):
        out = out.when(value == level, i)
    return out.otherwise(
        F.raise_error(F.concat(F.lit(f"unlisted {factor.name} level: "), value)).cast("int")
    )


def cell_label(design: Design, cell: Column) -> list[Column]:
    """The factor columns a cell number stands for."""
    out, width = [], 1
    for factor in reversed(design.factors):
        levels = F.array(*map(F.lit, factor.levels))
        at = F.floor(cell / width).cast("int") % len(factor.levels)
        out.append(F.element_at(levels, at + 1).alias(factor.name))
        width *= len(factor.levels)
    return list(reversed(out))


def pick(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Columns by one-based position."""
    return df.select(*[df[df.columns[i - 1]] for i in positions])


def standard_normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)
