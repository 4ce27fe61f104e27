"""Whole simulations: every replicate of every scenario in one set of jobs.

Responses are folded once into a narrow row per subject. Each pass then expands
those rows over the replicates and reduces them at once to counts per replicate
and model cell, so nothing the size of subjects x replicates is ever shuffled
or stored.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import settle_counting, standard_normal_quantile
from lacuna.functions.columns import cell_label
from lacuna.operators.cells import model_cells
from lacuna.operators.logit import contrast_rows, fit_coded, odds_ratios
from lacuna.operators.mechanisms import (
    Draws,
    expand,
    mar_draws,
    mar_folded,
    mcar_folded,
    pool_counts,
    scenario_of,
    seed_blocks,
    seed_of,
    spread,
)
from lacuna.operators.profile import poor_before, subject_profile
from lacuna.operators.sampling import Fold
from lacuna.operators.strategies import complete_case, impute_locf
from lacuna.plans.rows import mar_rows, scenario_label
from lacuna.study import (
    DEFAULT_STUDY,
    MAR_SCRIPT,
    MCAR_RATES,
    REPLICATES,
    STRATEGIES,
    MarRates,
    Study,
    mcar_label,
)

KEYS = ("scenario", "seed", "strategy")


def complete_odds_ratios(
    responses: DataFrame, subjects: DataFrame, study: Study = DEFAULT_STUDY
) -> DataFrame:
    """The true odds ratios, from the data before anything is made missing."""
    cells = model_cells(complete_case(responses, subjects, study), design=study.design)
    return odds_ratios(cells, design=study.design)


# --- from marked subjects to cells per strategy -----------------------------


def _sums(**columns: str | Column) -> tuple[Column, ...]:
    zero = F.lit(0).cast("long")
    return tuple(F.coalesce(F.sum(c), zero).alias(name) for name, c in columns.items())


def _by_strategy(counts: DataFrame, cases: Sequence[tuple[Column, Column]], keep) -> DataFrame:
    """Cells of the three strategies from (observations, responders) of each."""
    parts = [
        F.struct(F.lit(strategy).alias("strategy"), n.alias("n"), r.alias("r"))
        for strategy, (n, r) in zip(STRATEGIES, cases)
    ]
    return counts.select(*keep, "cell", F.inline(F.array(*parts))).filter(F.col("n") > 0)


def _if(condition: Column, yes: str | Column, no: str | Column) -> Column:
    yes, no = (F.col(c) if isinstance(c, str) else c for c in (yes, no))
    return F.when(condition, yes).otherwise(no)


def _mcar_coded(responses, subjects, seeds, rates, study) -> DataFrame:
    rates = sorted(map(float, rates))
    columns = ["n_rows", "y_n", "y_r", "lag_n", "lag_r"]
    profile = subject_profile(responses, subjects, study)
    profile, size = settle_counting(
        profile.select("SUBJID", "in_universe", *columns, "cell"), n=F.count_if("in_universe")
    )
    totals = _sums(**{c: c for c in columns})
    kept = ["replicate", "cell", "level", *columns]
    listed = spread(profile.filter("in_universe"), size["n"], len(seeds))
    drawn = [
        mcar_folded(listed, size["n"], block, rates, Fold(("cell",), totals))
        for block in seed_blocks(seeds)
    ]
    unlisted = profile.filter("not in_universe").groupBy("cell").agg(*totals)
    never = expand(unlisted, seeds).withColumn("level", F.lit(len(rates) + 1))
    parts = [part.select(*kept) for part in [*drawn, never]]
    counts = reduce(DataFrame.unionByName, parts).filter(F.col("cell").isNotNull())
    # Each scenario takes as missing all levels up to its own.
    per_scenario = counts.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(rates)))).alias("at"))
    per_scenario = per_scenario.withColumns(
        {
            "scenario": scenario_label([mcar_label(p) for p in rates], F.col("at") - 1),
            "seed": F.col("replicate"),
        }
    )
    missing, zero = F.col("level") <= F.col("at"), F.lit(0).cast("long")
    cases = [
        (_if(missing, zero, "y_n"), _if(missing, zero, "y_r")),
        (_if(missing, "n_rows", "y_n"), _if(missing, zero, "y_r")),
        (_if(missing, "lag_n", "y_n"), _if(missing, "lag_r", "y_r")),
    ]
    return _by_strategy(per_scenario, cases, KEYS[:2])


def _mar_coded(responses, subjects, seeds, rates, study, locf) -> DataFrame:
    return _mar_coded_and_pools(responses, subjects, seeds, rates, study, locf)[0]


def _mar_coded_and_pools(responses, subjects, seeds, rates, study, locf):
    """The coded cells, the subjects' pools and the pools' sizes."""
    s = len(rates)
    *earlier, last = study.dropout_visits
    if locf == "lag1_original":
        null, carries = "null_lag", ["lag"]
        gone = {part: F.col(f"lag_{part}") for part in "nr"}
    elif locf == "last_observed":
        null, carries = "null_seen", [f"gone_{v}" for v in study.dropout_visits]
        gone = {}
        for part in "nr":
            gone[part] = F.col(f"gone_{last}_{part}")
            for v in earlier:
                at_v = F.col("dropout_visit") == v
                gone[part] = F.when(at_v, F.col(f"gone_{v}_{part}")).otherwise(gone[part])
    else:
        raise ValueError(f"unknown mode: {locf}")
    columns = ["n_rows", *[f"{name}_{part}" for name in ("y", null, *carries) for part in "nr"]]
    profile = subject_profile(responses, subjects, study, lag_skips_visit=False)
    poor = [poor_before(v) for v in study.dropout_visits]
    profile, sizes = settle_counting(
        profile.select("SUBJID", "in_universe", *poor, *columns, "cell"), **pool_counts(study)
    )
    profile = spread(profile, sizes["in_universe"], len(seeds) * s)
    fold = Fold(("cell",), _sums(**{c: c for c in columns}), tuple(columns))
    counts = mar_folded(profile, sizes, seeds, rates, fold, study)
    counts = counts.filter(F.col("cell").isNotNull()).withColumns(
        {
            "scenario": scenario_label([r.label for r in rates], scenario_of(s)),
            "seed": seed_of(s),
        }
    )
    # A response that was null all along is handled like one masked by dropout.
    left, zero = F.col("dropout_visit").isNotNull(), F.lit(0).cast("long")
    cases = [
        (_if(left, zero, "y_n"), _if(left, zero, "y_r")),
        (F.col("n_rows"), _if(left, zero, "y_r")),
        (
            _if(left, gone["n"], F.col("y_n") + F.col(f"{null}_n")),
            _if(left, gone["r"], F.col("y_r") + F.col(f"{null}_r")),
        ),
    ]
    return _by_strategy(counts, cases, KEYS[:2]), profile, sizes


def _labelled(coded: DataFrame, study: Study) -> DataFrame:
    cells = coded.groupBy(*KEYS, "cell").agg(F.sum("n").alias("n"), F.sum("r").alias("r"))
    return cells.select(*KEYS, *cell_label(study.design, F.col("cell")), "n", "r")


def mcar_cells(
    responses: DataFrame,
    subjects: DataFrame,
    seeds: Sequence[int] = REPLICATES,
    rates: Sequence[float] = MCAR_RATES,
    study: Study = DEFAULT_STUDY,
) -> DataFrame:
    """Model cells of every MCAR scenario, seed and strategy."""
    return _labelled(_mcar_coded(responses, subjects, seeds, rates, study), study)


def mar_cells(
    responses: DataFrame,
    subjects: DataFrame,
    seeds: Sequence[int] = REPLICATES,
    rates: Sequence[MarRates] = MAR_SCRIPT,
    study: Study = DEFAULT_STUDY,
    locf: str = "lag1_original",
) -> DataFrame:
    """Model cells of every MAR scenario, seed and strategy."""
    return _labelled(_mar_coded(responses, subjects, seeds, rates, study, locf), study)


# --- replicates and their summary -------------------------------------------


def _ratios(coded: DataFrame, study: Study) -> DataFrame:
    return contrast_rows(fit_coded(coded, KEYS, study.design), KEYS, study.design)


def run_mcar(
    responses: DataFrame,
    subjects: DataFrame,
    seeds: Sequence[int] = REPLICATES,
    rates: Sequence[float] = MCAR_RATES,
    study: Study = DEFAULT_STUDY,
) -> DataFrame:
    """Odds ratios per scenario, seed, strategy and contrast.

    All strategies of a seed handle the same draw.
    """
    return _ratios(_mcar_coded(responses, subjects, seeds, rates, study), study)


def run_mar(
    responses: DataFrame,
    subjects: DataFrame,
    seeds: Sequence[int] = REPLICATES,
    rates: Sequence[MarRates] = MAR_SCRIPT,
    study: Study = DEFAULT_STUDY,
    locf: str = "lag1_original",
) -> DataFrame:
    """Odds ratios per scenario, seed, strategy and contrast under dropout."""
    return _ratios(_mar_coded(responses, subjects, seeds, rates, study, locf), study)


def mar_locf_all_visits(
    responses: DataFrame,
    subjects: DataFrame,
    seeds: Sequence[int],
    rates: Sequence[MarRates] = MAR_SCRIPT,
    study: Study = DEFAULT_STUDY,
    setup: tuple[DataFrame, Draws] | None = None,
) -> DataFrame:
    """The interactive LOCF variant: no dropout step at the last visit, a null at
    the first treated visit set to no response, and one fit over all visits.

    ``setup`` are pools and draws of these seeds, if they are known already.
    """
    study = study.with_visits(*study.dropout_visits[:-1])
    rows = mar_rows(responses, subjects, seeds, rates, study, skip_visit=False, setup=setup)
    filled = impute_locf(rows, first_visit=study.dropout_visits[0] - 1, study=study)
    by = ["scenario", "seed"]
    cells = model_cells(filled, by, study.design)
    return odds_ratios(cells, by, study.design).withColumn("strategy", F.lit(STRATEGIES[2]))


def mc_summary(replicates: DataFrame, confidence: float = 0.95, **stats) -> DataFrame:
    """Mean, variance and confidence limits of the mean over the replicates.

    Replicates without an odds ratio are left out and counted in ``n_failed``.
    Further aggregates can be given as ``name=function``.
    """
    z = standard_normal_quantile(0.5 + confidence / 2)
    value = F.col("or_value")
    n = F.count(value)
    summary = replicates.groupBy("scenario", "strategy", "contrast").agg(
        F.avg(value).alias("mean"),
        F.var_samp(value).alias("var"),
        n.alias("n"),
        (F.count(F.lit(1)) - n).alias("n_failed"),
        *[fn(value).alias(name) for name, fn in stats.items()],
    )
    margin = F.lit(z) * F.sqrt("var") / F.sqrt("n")
    return (
        summary.withColumn("low", F.col("mean") - margin)
        .withColumn("high", F.col("mean") + margin)
        .select(
            "scenario", "strategy", "contrast", "mean", "var", "low", "high", "n", "n_failed", *stats
        )
        .orderBy("scenario", "strategy", "contrast")
    )


def compare_once(
    responses: DataFrame,
    subjects: DataFrame,
    mcar: Sequence[float] = (),
    mar: Sequence[MarRates] = (),
    seed: int | None = None,
    study: Study = DEFAULT_STUDY,
    interactive_locf: bool = False,
) -> tuple[DataFrame, int]:
    """Odds ratios of a single draw of each scenario, and the seed used.

    Without a seed one is chosen. ``interactive_locf`` swaps the LOCF result of
    the MAR scenarios for the all-visits variant.
    """
    seed = random.randrange(1, 2**31) if seed is None else seed
    seeds = range(seed, seed + 1)
    parts = []
    if mcar:
        parts.append(run_mcar(responses, subjects, seeds, mcar, study))
    if mar:
        coded, pools, sizes = _mar_coded_and_pools(
            responses, subjects, seeds, mar, study, "lag1_original"
        )
        if interactive_locf:
            coded = coded.filter(F.col("strategy") != STRATEGIES[2])
        ratios = _ratios(coded, study)
        if interactive_locf:
            early = study.with_visits(*study.dropout_visits[:-1])
            pools = pools.select("SUBJID", "in_universe", *map(poor_before, early.dropout_visits))
            draws = mar_draws(pools, sizes, seeds, mar, early)
            ratios = ratios.unionByName(
                mar_locf_all_visits(responses, subjects, seeds, mar, study, (pools, draws))
            )
        parts.append(ratios)
    if not parts:
        raise ValueError("give at least one scenario")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, seed
