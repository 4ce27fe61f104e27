"""Making subjects missing: completely at random, or by sequential dropout.

Replicates are rows. A mechanism first finds the cuts of all its samples (a
table of one row per replicate), after which any table with a subject id can be
flagged row by row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import attach_small, draw_key, tasks_for
from lacuna.functions.staging import BROADCAST_ROWS
from lacuna.operators.dropout import (
    Dropout,
    dropout_cuts,
    dropout_folded,
    scenario_of,
    seed_of,
)
from lacuna.operators.profile import poor_before
from lacuna.operators.sampling import Fold, PoolClass, draw_cuts, draw_folded, is_drawn
from lacuna.study import DEFAULT_STUDY, MarRates, Study

MCAR_DRAW = 0
MASKED = ("AVAL", "PCHG", "PCHGCA1N")


@dataclass(frozen=True)
class Draws:
    """The samples of a mechanism in all replicates.

    ``cuts`` has a row per replicate and sample: which sample it is (``rate`` or
    ``visit`` and ``is_high``), its pool size, the number taken and the cut.
    """

    cuts: DataFrame
    seeds: Sequence[int]
    scenarios: int

    @property
    def n_replicates(self) -> int:
        return len(self.seeds) * self.scenarios

    def side_by_side(self, samples: dict[str, str]) -> DataFrame:
        """One row per replicate; the cuts of each named sample as columns."""
        columns = [
            F.expr(f"max(if({where}, {part}, null)) as {part}_{name}")
            for name, where in samples.items()
            for part in ("cut_key", "cut_id")
        ]
        return self.cuts.groupBy("replicate").agg(*columns)


def seed_blocks(seeds: Sequence[int], scenarios: int = 1) -> list[Sequence[int]]:
    """The seeds in parts whose cuts are few enough to be sent to every task."""
    size = max(1, BROADCAST_ROWS // scenarios)
    return [seeds[i : i + size] for i in range(0, len(seeds), size)]


def expand(rows: DataFrame, seeds: Sequence[int], scenarios: int = 1) -> DataFrame:
    """Repeat rows once per scenario and seed; ``replicate`` numbers the pair."""

    def numbers(first: int, last: int) -> Column:
        return F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long")))

    s = scenarios
    if not len(seeds):
        return rows.select("*", F.lit(None).cast("long").alias("replicate")).limit(0)
    if isinstance(seeds, range) and seeds.step == 1:
        return rows.select("*", numbers(seeds.start * s, seeds.stop * s - 1).alias("replicate"))
    if isinstance(seeds, range):
        counted = rows.select("*", numbers(0, len(seeds) * s - 1).alias("_at"))
        seed = F.lit(seeds.start) + F.expr(f"_at div {s}") * F.lit(seeds.step)
        return counted.withColumn("replicate", seed * s + F.col("_at") % s).drop("_at")
    parts = [_expand_listed(rows, block, s) for block in seed_blocks(seeds)]
    return reduce(DataFrame.unionByName, parts)


def _expand_listed(rows: DataFrame, seeds: Sequence[int], scenarios: int) -> DataFrame:
    """As ``expand`` for at most BROADCAST_ROWS listed seeds, which every task gets."""
    listed = rows.sparkSession.createDataFrame(
        pd.DataFrame({"_place": np.arange(len(seeds)), "_seed": np.asarray(seeds, np.int64)})
    )
    places = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(seeds) * scenarios - 1).cast("long")))
    return (
        rows.select("*", places.alias("_at"))
        .withColumn("_place", F.expr(f"_at div {scenarios}"))
        .join(F.broadcast(listed), "_place")
        .withColumn("replicate", F.col("_seed") * scenarios + F.col("_at") % scenarios)
        .drop("_at", "_place", "_seed")
    )


def spread(rows: DataFrame, n_rows: int, n_replicates: int) -> DataFrame:
    """Partition rows by subject into as many tasks as expanding them needs."""
    return rows.repartition(tasks_for(rows.sparkSession, n_rows * n_replicates), "SUBJID")


def _with_cuts(
    rows: DataFrame, seeds: Sequence[int], scenarios: int, cuts: DataFrame
) -> DataFrame:
    """Expanded rows with their replicate's cuts (one row each), one block of seeds at a time."""
    parts = []
    for block in seed_blocks(seeds, scenarios):
        low, high = min(block) * scenarios, (max(block) + 1) * scenarios
        # A listed block may leave out seeds in between; their cuts are not there.
        own = cuts.filter((F.col("replicate") >= low) & (F.col("replicate") < high))
        expanded = expand(rows, block, scenarios)
        parts.append(attach_small(expanded, own, "replicate", len(block) * scenarios))
    return reduce(DataFrame.unionByName, parts) if parts else expand(rows, seeds, scenarios)


# --- missing completely at random -------------------------------------------


def mcar_draws(
    universe: DataFrame, n_universe: int, seeds: Sequence[int], rates: Sequence[float]
) -> Draws:
    """Samples of the universe at every rate; smaller samples lie inside larger ones.

    ``universe`` has one row per subject. A subject gets one key per replicate,
    whatever the rate, so all rates are found in the same pass.
    """
    rows = expand(universe.select("SUBJID"), seeds)
    cuts = draw_cuts(rows, ["replicate"], *_mcar_search(n_universe, seeds, rates))
    return Draws(cuts, seeds, 1)


def mcar_folded(
    universe: DataFrame,
    n_universe: int,
    seeds: Sequence[int],
    rates: Sequence[float],
    fold: Fold,
) -> DataFrame:
    """Totals per replicate, level and ``fold.by``, in a single pass over the subjects."""
    cuts, folded = draw_folded(
        expand(universe, seeds),
        ["replicate"],
        *_mcar_search(n_universe, seeds, rates),
        fold,
    )
    cuts = Draws(cuts, seeds, 1).side_by_side(_per_rate(rates))
    placed = attach_small(folded, cuts, "replicate", len(seeds))
    level = _level(F.col("at_key"), F.col("at_id"), len(rates))
    return placed.select("*", level.alias("level"))


def _mcar_search(n_universe, seeds, rates):
    rates = sorted(map(float, rates))
    return (
        draw_key(F.col("SUBJID"), F.col("replicate"), MCAR_DRAW),
        [F.lit(p) for p in rates],
        [PoolClass(tuple(rates), n_universe)],
    )


def _per_rate(rates: Sequence[float]) -> dict[str, str]:
    return {str(i): f"rate = double({float(p)})" for i, p in enumerate(sorted(rates), 1)}


def _level(key: Column, id_: Column, n: int) -> Column:
    """The first of n nested samples that holds a key, n + 1 if none does."""
    level = F.when(F.lit(False), 0)
    for i in range(1, n + 1):
        level = level.when(is_drawn(key, id_, F.col(f"cut_key_{i}"), F.col(f"cut_id_{i}")), i)
    return level.otherwise(n + 1)


def mark_level(rows: DataFrame, draws: Draws, rates: Sequence[float]) -> DataFrame:
    """Expand rows over the replicates and add the first rate that draws the subject.

    ``level`` counts from 1 in rising order of the rates and is one more than
    their number for a subject that is never drawn. Rows outside the universe
    (``in_universe`` false) are never drawn.
    """
    n = len(rates)
    cuts = draws.side_by_side(_per_rate(rates))
    wide = _with_cuts(rows, draws.seeds, 1, cuts)
    key = draw_key(F.col("SUBJID"), F.col("replicate"), MCAR_DRAW)
    level = F.when(F.col("in_universe"), _level(F.col("_key"), F.col("SUBJID"), n))
    return (
        wide.withColumn("_key", key)
        .withColumn("level", level.otherwise(n + 1))
        .select(*rows.columns, "replicate", "level")
    )


# --- missing at random: sequential dropout ----------------------------------

HIGH, LOW = "high", "low"


def _leaves(visit: int, scenarios: int) -> Column:
    """Whether the step of a visit draws the subject, provided it is still there."""
    poor = F.col(poor_before(visit))

    def cut(name):
        high, low = (F.col(f"{name}_{visit}_{pool}") for pool in (HIGH, LOW))
        return F.when(poor, high).otherwise(low)

    key = draw_key(F.col("SUBJID"), seed_of(scenarios), visit)
    drawn = is_drawn(key, F.col("SUBJID"), cut("cut_key"), cut("cut_id"))
    return (poor | F.col("in_universe")) & drawn


def _dropout(rows: DataFrame, draws: Draws, visits: Sequence[int]) -> DataFrame:
    """Expanded rows with the dropout visit after the given steps."""
    if not visits:
        out = expand(rows, draws.seeds, draws.scenarios)
        return out.withColumn("dropout_visit", F.lit(None).cast("int"))
    cuts = draws.side_by_side(
        {
            f"{v}_{pool}": f"visit = {v} and {where}"
            for v in visits
            for pool, where in ((HIGH, "is_high"), (LOW, "not is_high"))
        }
    )
    out = _with_cuts(rows, draws.seeds, draws.scenarios, cuts)
    steps = [F.when(_leaves(v, draws.scenarios), F.lit(v)) for v in visits]
    return out.withColumn("dropout_visit", F.coalesce(*steps))


def pool_counts(study: Study = DEFAULT_STUDY) -> dict[str, Column]:
    """Aggregates over a profile from which first pool sizes are guessed."""
    poor = [poor_before(v) for v in study.dropout_visits]
    return {c: F.count_if(F.col(c)) for c in ("in_universe", *poor)}


def _pool_hints(counts, rates, study) -> dict[int, tuple[int, int]]:
    """Rough (poor, other) pool sizes per dropout visit, a little on the low side."""
    stay, hints = 1.0, {}
    for visit in study.dropout_visits:
        n_poor = counts[poor_before(visit)]
        hints[visit] = (int(n_poor * stay), max(counts["in_universe"] - n_poor, 0))
        stay *= 1 - max(max(r.high, r.low) for r in rates)
    return hints


def mar_draws(
    profile: DataFrame,
    counts: dict[str, int],
    seeds: Sequence[int],
    rates: Sequence[MarRates],
    study: Study = DEFAULT_STUDY,
) -> Draws:
    """Samples of both pools at every dropout visit, each step knowing the last.

    ``counts`` are the values of ``pool_counts`` for the profile. All visits of all
    replicates are found in one scan.
    """
    subjects = profile.select("SUBJID", "in_universe", *map(poor_before, study.dropout_visits))
    cuts = dropout_cuts(expand(subjects, seeds, len(rates)), _dropout_of(counts, rates, study))
    return Draws(cuts, seeds, len(rates))


def mar_folded(
    profile: DataFrame,
    counts: dict[str, int],
    seeds: Sequence[int],
    rates: Sequence[MarRates],
    fold: Fold,
    study: Study = DEFAULT_STUDY,
) -> DataFrame:
    """Totals per replicate, ``fold.by`` and ``dropout_visit``, in one scan as well."""
    rows = expand(profile, seeds, len(rates))
    return dropout_folded(rows, _dropout_of(counts, rates, study), fold)


def _dropout_of(counts, rates, study) -> Dropout:
    return Dropout(study.dropout_visits, rates, _pool_hints(counts, rates, study))


def mark_dropout(
    rows: DataFrame, draws: Draws, study: Study = DEFAULT_STUDY
) -> DataFrame:
    """Expand rows over the replicates and add the visit at which the subject leaves.

    Rows need ``in_universe`` and the ``poor_before_v`` columns of the profile.
    """
    out = _dropout(rows, draws, study.dropout_visits)
    return out.select(*rows.columns, "replicate", "dropout_visit")


def mask_from(
    rows: DataFrame, dropout: Column | None = None, columns: Sequence[str] = MASKED
) -> DataFrame:
    """Blank the measurements from the dropout visit on."""
    dropout = F.col("dropout_visit") if dropout is None else dropout
    gone = F.coalesce(F.col("AVISITN") >= dropout, F.lit(False))
    return rows.withColumns({c: F.when(~gone, F.col(c)) for c in columns})


def pool_table(draws: Draws) -> DataFrame:
    """Pool and sample size per replicate, dropout visit and non-empty pool."""
    return draws.cuts.select(
        "replicate",
        "visit",
        F.when(F.col("is_high"), HIGH).otherwise(LOW).alias("pool"),
        F.col("pool").alias("n_pool"),
        F.col("taken").alias("n_drawn"),
    )
