"""Logistic fits of many groups at once, from their cell counts."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions import cell_code
from lacuna.study import DEFAULT_DESIGN, Design

# Executors get the fit by value, so they need numpy but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOLERANCE = 1e-10
LONGEST_STEP = 5.0


def _indicators(design: Design) -> tuple[np.ndarray, list[list[int]]]:
    """Cells x (intercept and every factor level), and each factor's columns."""
    x = np.zeros((design.n_cells, 1 + len(design.terms())))
    x[:, 0] = 1
    for cell in range(design.n_cells):
        for factor, level in zip(design.factors, design.cell_levels(cell)):
            x[cell, design.position(factor.name, level)] = 1
    groups = [[design.position(f.name, v) for v in f.levels] for f in design.factors]
    return x, groups


def _without_separated(x: np.ndarray, n: np.ndarray, r: np.ndarray):
    """Counts without the levels of only responders or only non-responders, and these levels.

    The likelihood grows towards an infinite coefficient of such a level, where
    its rows no longer bear on the others. Taking it out can leave another level
    one-sided, so this repeats.
    """
    separated = np.zeros((len(n), x.shape[1]), bool)
    while True:
        margin_n, margin_r = n @ x, r @ x
        one_sided = (margin_n > 0) & ((margin_r == 0) | (margin_r == margin_n))
        one_sided[:, 0] = False
        if not one_sided.any():
            return n, r, separated
        separated |= one_sided
        gone = one_sided @ x.T > 0
        n, r = np.where(gone, 0, n), np.where(gone, 0, r)


def newton_fit(x: np.ndarray, groups: list[list[int]], n: np.ndarray, r: np.ndarray):
    """Coefficients (rows x terms) and convergence flags by Newton steps.

    The first level left is the base with coefficient 0; absent levels get NaN
    and separated ones an infinite value. A fit whose likelihood still has no
    finite maximum gets NaN in every term. Steps that lower the likelihood are
    halved; the maximum is found when a step is next to nothing, and there is
    none when a fitted logit leaves the range that counts of this size allow.
    """
    n, r, separated = _without_separated(x, n, r)
    present = (n @ x) > 0
    free = present.copy()
    for columns in groups:
        base = present[:, columns].argmax(axis=1)
        free[np.arange(len(n)), np.array(columns)[base]] = False
    diagonal = np.arange(x.shape[1])

    def curvature(weight, active):
        h = np.matmul(x.T * weight[:, None, :], x)
        h *= active[:, :, None] & active[:, None, :]
        h[:, diagonal, diagonal] += ~active
        return h

    def solve(h, g):
        try:
            return np.linalg.solve(h, g[:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:
            return (np.linalg.pinv(h, hermitian=True) @ g[:, :, None])[:, :, 0]

    def likelihood(at, values):
        eta = values @ x.T
        return (r[at] * eta - n[at] * np.logaddexp(0, eta)).sum(axis=1)

    theta = np.zeros(free.shape)
    todo = n.sum(axis=1) > 0
    if todo.any():
        occupied = curvature((n > 0).astype(float), free)
        todo &= np.linalg.matrix_rank(occupied, hermitian=True) == x.shape[1]
    # Start at the least-squares fit of the cells' own, slightly shrunken logits.
    p = (r + 0.5) / (n + 1)
    weight = n * p * (1 - p)
    target = weight * np.log(p / (1 - p)) + (r - n * p)
    at = np.flatnonzero(todo)
    theta[at] = solve(curvature(weight[at], free[at]), (target[at] @ x) * free[at])
    farthest = 12 + 3 * np.log(n.sum(axis=1) + 2)
    converged = np.zeros(len(n), dtype=bool)
    while True:
        eta = theta @ x.T
        todo &= np.abs(np.where(n > 0, eta, 0)).max(axis=1) < farthest
        at = np.flatnonzero(todo)
        if not len(at):
            break
        # The rarer outcome's chance, so that nothing cancels in long tails.
        rare = 1 / (1 + np.exp(np.abs(eta[at])))
        high = eta[at] > 0
        residual = np.where(high, n[at] * rare - (n[at] - r[at]), r[at] - n[at] * rare)
        step = solve(curvature(n[at] * rare * (1 - rare), free[at]), (residual @ x) * free[at])
        size = np.abs(step).max(axis=1)
        step *= np.minimum(1, LONGEST_STEP / np.maximum(size, TOLERANCE))[:, None]
        before = likelihood(at, theta[at])
        slack = 1e-12 * np.abs(before) + 1e-12
        low = (likelihood(at, theta[at] + step) < before - slack) & (size >= TOLERANCE)
        while low.any():
            step[low] /= 2
            low &= np.abs(step).max(axis=1) >= TOLERANCE
            low &= likelihood(at, theta[at] + step) < before - slack
        theta[at] += step
        done = at[np.abs(step).max(axis=1) < TOLERANCE]
        converged[done] = True
        todo[done] = False
    theta[~present] = np.nan
    theta[~converged] = np.nan
    theta[separated] = np.inf
    return theta, converged


def fit_cells(
    cells: DataFrame, by: Sequence[str], design: Design = DEFAULT_DESIGN
) -> DataFrame:
    """One row per group: ``coef`` (intercept, then every level) and ``converged``.

    ``cells`` has the ``by`` and factor columns and the counts ``n`` and ``r``.
    """
    return fit_coded(cells.withColumn("cell", cell_code(design)), by, design)


def fit_coded(
    cells: DataFrame, by: Sequence[str], design: Design = DEFAULT_DESIGN
) -> DataFrame:
    """As ``fit_cells``, for cells given by number in a ``cell`` column."""
    by = list(by)
    size = design.n_cells
    counts = [
        F.expr(f"double(sum(if(cell = {i}, {c}, 0L))) as _{c}{i}")
        for c in ("n", "r")
        for i in range(size)
    ]
    wide = cells.groupBy(*by).agg(*counts)
    n_cols = [f"_n{i}" for i in range(size)]
    r_cols = [f"_r{i}" for i in range(size)]
    schema = T.StructType(
        [wide.schema[c] for c in by]
        + [
            T.StructField("coef", T.ArrayType(T.DoubleType())),
            T.StructField("converged", T.BooleanType()),
        ]
    )

    x, groups = _indicators(design)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            coef, converged = newton_fit(
                x, groups, batch[n_cols].to_numpy(float), batch[r_cols].to_numpy(float)
            )
            out = batch[by].copy()
            out["coef"] = list(coef)
            out["converged"] = converged
            yield out

    return wide.mapInPandas(fit, schema)


def contrast_rows(
    fits: DataFrame, by: Sequence[str], design: Design = DEFAULT_DESIGN
) -> DataFrame:
    """Long odds ratios: plain (``or_raw``) and rounded to four places (``or_value``).

    ``converged`` is false where the fit has no maximum, or not in this contrast's
    levels.
    """
    rows = []
    for c in design.contrasts:
        top = F.col("coef")[design.position(c.factor, c.level)]
        bottom = F.col("coef")[design.position(c.factor, c.reference)]
        ratio = F.exp(top - bottom)
        endless = (top == float("inf")) | (bottom == float("inf"))
        rows.append(
            F.struct(
                F.lit(c.name).alias("contrast"),
                F.when(~F.isnan(ratio) & ~endless, ratio).alias("or_raw"),
                (F.col("converged") & ~endless).alias("converged"),
            )
        )
    return fits.select(*by, F.inline(F.array(*rows))).select(
        *by, "contrast", "or_raw", F.round("or_raw", 4).alias("or_value"), "converged"
    )


_RATIO = [
    T.StructField("factor", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("base", T.StringType()),
    T.StructField("or_raw", T.DoubleType()),
    T.StructField("converged", T.BooleanType()),
]


def _levels_fit(factors: Sequence[str], cells: list) -> Iterator[tuple]:
    """(factor, level, base, odds ratio, converged) of one group's cells."""
    levels = [sorted({c["levels"][i] for c in cells}) for i in range(len(factors))]
    place = [{v: k for k, v in enumerate(own)} for own in levels]
    first = 1 + np.concatenate([[0], np.cumsum([len(own) for own in levels])])
    x = np.zeros((len(cells), int(first[-1])))
    x[:, 0] = 1
    for row, c in enumerate(cells):
        for i, v in enumerate(c["levels"]):
            x[row, first[i] + place[i][v]] = 1
    groups = [list(range(first[i], first[i + 1])) for i in range(len(factors))]
    n, r = (np.array([[c[k] for c in cells]], float) for k in "nr")
    theta, converged = newton_fit(x, groups, n, r)
    for name, own, columns in zip(factors, levels, groups):
        values = theta[0, columns]
        for v, value in zip(own[1:], values[1:]):
            finite = bool(np.isfinite(value) and np.isfinite(values[0]))
            ratio = float(np.exp(value - values[0])) if finite else None
            endless = bool(np.isinf(value) or np.isinf(values[0]))
            yield name, v, own[0], ratio, bool(converged[0]) and not endless


def level_ratios(cells: DataFrame, factors: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Odds ratio of every level of the factors against the first one, for every group of cells.

    ``cells`` has the ``by`` and factor columns and the counts ``n`` and ``r``. Levels
    are those of the group, as text in alphabetical order; there may be any number,
    and none of them comes to the driver. A fit takes its group's own cells, so its
    work is bounded by the cells that occur, not by a crossed design.
    """
    by, factors = list(by), list(factors)
    levels = F.array(*[F.col(f).cast("string") for f in factors]).alias("levels")
    known = cells.filter(" AND ".join(f"`{f}` IS NOT NULL" for f in factors)).filter("n > 0")
    lists = known.groupBy(*by).agg(F.collect_list(F.struct(levels, "n", "r")).alias("_cells"))
    schema = T.StructType([*[lists.schema[c] for c in by], *_RATIO])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for at, own in enumerate(batch["_cells"]):
                if len(own):
                    rows += [(*batch[by].iloc[at], *row) for row in _levels_fit(factors, own)]
            yield pd.DataFrame(rows, columns=schema.names)

    found = lists.mapInPandas(fit, schema)
    return found.withColumn("or_value", F.round("or_raw", 4))


def odds_ratios(
    cells: DataFrame, by: Sequence[str] = (), design: Design = DEFAULT_DESIGN
) -> DataFrame:
    """Adjusted odds ratios of every group of cells."""
    return contrast_rows(fit_cells(cells, by, design), by, design)
