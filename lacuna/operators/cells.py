"""Counts per model cell: all a fit on factors needs to know of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.study import DEFAULT_DESIGN, RESPONSE, Contrast, Design, Factor

MOST_LEVELS = 200


def design_of(rows: DataFrame, names: Sequence[str]) -> Design:
    """The main-effects design of the factor levels in the data.

    The first level in alphabetical order is a factor's base, and every other
    level's odds ratio against it is reported. Nulls are no level. A factor's
    levels come to the driver; more than ``MOST_LEVELS`` stop the job, as they do
    not suit a crossed design: ``level_ratios`` fits any number.
    """
    factors, contrasts = [], []
    for name in names:
        found = rows.select(name).filter(F.col(name).isNotNull()).distinct()
        levels = sorted(str(r[0]) for r in found.limit(MOST_LEVELS + 1).collect())
        if not 0 < len(levels) <= MOST_LEVELS:
            raise ValueError(f"{name} has no level or more than {MOST_LEVELS}")
        factors.append(Factor(name, tuple(levels)))
        contrasts += [Contrast(f"{v} vs {levels[0]}", name, v, levels[0]) for v in levels[1:]]
    return Design(tuple(factors), tuple(contrasts))


def model_cells(
    rows: DataFrame,
    by: Sequence[str] = (),
    design: Design = DEFAULT_DESIGN,
    response: str = RESPONSE,
) -> DataFrame:
    """Observations ``n`` and responders ``r`` per group and cell.

    Rows with a null response or factor do not enter a fit and are not counted.
    """
    usable = F.col(response).isNotNull()
    for name in design.factor_names:
        usable = usable & F.col(name).isNotNull()
    return (
        rows.filter(usable)
        .groupBy(*by, *design.factor_names)
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col(response).cast("long")).alias("r")
        )
    )
