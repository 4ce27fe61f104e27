"""Row-level replicates: the response rows themselves, once per replicate."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import sample_size, settle_counting, tasks_for
from lacuna.operators.analysis import (
    parameter_rows,
    response_history,
    response_lag,
    unique_subjects,
    with_sex,
)
from lacuna.operators.mechanisms import (
    Draws,
    mar_draws,
    mark_dropout,
    mark_level,
    mask_from,
    mcar_draws,
    pool_counts,
    scenario_of,
    seed_of,
    spread,
)
from lacuna.operators.profile import poor_before, subject_profile
from lacuna.sources.tables import scenario_grid, subject_universe
from lacuna.study import DEFAULT_STUDY, MarRates, Study, mcar_label

#: Masked rows and the columns to group by -> sums per group.
Totals = Callable[[DataFrame, list[str]], DataFrame]


def scenario_label(labels: Sequence[str], at: Column) -> Column:
    """Label by zero-based index."""
    if len(labels) == 1:
        return F.lit(labels[0])
    return F.element_at(F.array(*map(F.lit, labels)), at + 1)


def _universe(subjects: DataFrame, seeds: Sequence[int]) -> tuple[DataFrame, int]:
    """The ids that can be drawn, spread for the expanded scans, and their number."""
    universe, size = settle_counting(subject_universe(subjects), n=F.count(F.lit(1)))
    return spread(universe, size["n"], len(seeds)), size["n"]


def mcar_sample(
    subjects: DataFrame, seeds: Sequence[int], rates: Sequence[float]
) -> DataFrame:
    """Drawn subjects with the smallest rate that draws them."""
    rates = sorted(map(float, rates))
    universe, n = _universe(subjects, seeds)
    draws = mcar_draws(universe, n, seeds, rates)
    level = F.col("level")
    return (
        mark_level(universe.withColumn("in_universe", F.lit(True)), draws, rates)
        .filter(level <= len(rates))
        .select(
            F.col("replicate").alias("seed"),
            "SUBJID",
            F.element_at(F.array(*map(F.lit, rates)), level).alias("rate"),
        )
    )


def mcar_rows(
    responses: DataFrame,
    subjects: DataFrame,
    seeds: Sequence[int],
    rate: float,
    study: Study = DEFAULT_STUDY,
) -> DataFrame:
    """Analysis-visit rows of every replicate with lag and the flag ``missing``."""
    universe, n = _universe(subjects, seeds)
    draws = mcar_draws(universe, n, seeds, [rate])
    rows = response_lag(parameter_rows(responses, study), study)
    rows = rows.filter(F.col("AVISITN") == study.analysis_visit)
    listed = unique_subjects(subjects.select("SUBJID", "SEX"))
    rows = rows.join(listed.withColumn("in_universe", F.lit(True)), "SUBJID", "left").withColumn(
        "in_universe", F.coalesce("in_universe", F.lit(False))
    )
    rows, size = settle_counting(rows, n=F.count(F.lit(1)))
    rows = rows.repartition(tasks_for(rows.sparkSession, size["n"] * len(seeds)))
    return (
        mark_level(rows, draws, [rate])
        .withColumn("missing", F.col("level") == 1)
        .withColumn("scenario", F.lit(mcar_label(rate)))
        .withColumnRenamed("replicate", "seed")
        .drop("level", "in_universe")
    )


def mar_setup(
    responses: DataFrame,
    subjects: DataFrame,
    seeds: Sequence[int],
    rates: Sequence[MarRates],
    study: Study = DEFAULT_STUDY,
) -> tuple[DataFrame, Draws]:
    """(pool membership of every subject, samples of all replicates)."""
    pools = subject_profile(responses, subjects, study).select(
        "SUBJID", "in_universe", *map(poor_before, study.dropout_visits)
    )
    n_replicates = len(seeds) * len(rates)
    pools, counts = settle_counting(pools, **pool_counts(study))
    pools = spread(pools, counts["in_universe"], n_replicates)
    return pools, mar_draws(pools, counts, seeds, rates, study)


def mar_dropout(
    responses: DataFrame,
    subjects: DataFrame,
    seeds: Sequence[int],
    rates: Sequence[MarRates],
    study: Study = DEFAULT_STUDY,
) -> DataFrame:
    """Subjects that leave, with the visit from which they are missing."""
    pools, draws = mar_setup(responses, subjects, seeds, rates, study)
    return (
        mark_dropout(pools, draws, study)
        .filter(F.col("dropout_visit").isNotNull())
        .select(
            scenario_label([r.label for r in rates], scenario_of(len(rates))).alias("scenario"),
            seed_of(len(rates)).alias("seed"),
            "SUBJID",
            "dropout_visit",
        )
    )


def mar_rows(
    responses: DataFrame,
    subjects: DataFrame,
    seeds: Sequence[int],
    rates: Sequence[MarRates],
    study: Study = DEFAULT_STUDY,
    skip_visit: bool = True,
    setup: tuple[DataFrame, Draws] | None = None,
    totals: Totals | None = None,
) -> DataFrame:
    """Masked response rows of every replicate, with lag and last observed values.

    Lags are taken over all visits and before masking. ``setup`` is what
    ``mar_setup`` gives, if it is known already.

    ``totals`` is for callers who need no more than sums over the rows. It is given
    the masked rows without scenario and seed, and the columns to group by, and
    returns its sums per group; the result is then these sums per scenario and seed.
    """
    pools, draws = setup or mar_setup(responses, subjects, seeds, rates, study)
    rows = response_history(parameter_rows(responses, study, skip_visit=False), study)
    if skip_visit and study.skipped_visit is not None:
        rows = rows.filter(F.col("AVISITN") != study.skipped_visit)
    rows = with_sex(rows, subjects).join(pools, "SUBJID")
    labels = {
        "scenario": scenario_label([r.label for r in rates], scenario_of(len(rates))),
        "seed": seed_of(len(rates)),
    }
    rows, size = settle_counting(rows, n=F.count(F.lit(1)))
    if totals is not None:
        summed = _totalled(rows, draws, study, totals)
        names = [c for c in summed.columns if c != "replicate"]
        summed = summed.withColumns(labels).groupBy(*labels)
        return summed.agg(*[F.sum(c).alias(c) for c in names])
    rows = rows.repartition(tasks_for(rows.sparkSession, size["n"] * draws.n_replicates))
    marked = mark_dropout(rows, draws, study)
    return (
        mask_from(marked)
        .withColumns(labels)
        .drop("replicate", "in_universe", *map(poor_before, study.dropout_visits))
    )


def _totalled(rows: DataFrame, draws: Draws, study: Study, totals: Totals) -> DataFrame:
    """Sums over the masked rows per replicate.

    All that a masked row takes from its replicate is the visit at which its subject
    leaves. So each row is masked and summed once for every such visit and for
    staying, and what is repeated over the replicates is one row per subject with
    the sums of each case.
    """
    by = ["SUBJID", "in_universe", *map(poor_before, study.dropout_visits)]
    visits = [None, *study.dropout_visits]
    case = F.explode(F.array(*[F.lit(v).cast("int") for v in visits]))
    masked = mask_from(rows.select("*", case.alias("dropout_visit")))
    sums = totals(masked, [*by, "dropout_visit"])
    names = [c for c in sums.columns if c not in (*by, "dropout_visit")]

    def at(visit: int | None) -> Column:
        return F.col("dropout_visit").eqNullSafe(F.lit(visit).cast("int"))

    cases = [F.sum(F.when(at(v), F.col(c))).alias(f"_{c}_{v}") for c in names for v in visits]
    profile, size = settle_counting(sums.groupBy(*by).agg(*cases), n=F.count(F.lit(1)))
    profile = spread(profile, size["n"], draws.n_replicates)
    marked = mark_dropout(profile, draws, study)
    own = {c: F.coalesce(*[F.when(at(v), F.col(f"_{c}_{v}")) for v in visits]) for c in names}
    return marked.groupBy("replicate").agg(*[F.sum(value).alias(c) for c, value in own.items()])


def scenario_sizes(
    responses: DataFrame,
    subjects: DataFrame,
    mcar: Sequence[float],
    mar: Sequence[MarRates],
    study: Study = DEFAULT_STUDY,
) -> DataFrame:
    """The scenario grid with the number of subjects each scenario draws first.

    MAR pools are those of the first dropout visit, which no draw has changed yet.
    """
    grid = scenario_grid(subjects.sparkSession, mcar, mar)
    poor = F.col(poor_before(study.dropout_visits[0]))
    sizes = subject_profile(responses, subjects, study).agg(
        F.count_if("in_universe").alias("n_subjects"),
        F.count_if(poor).alias("n_high"),
        F.count_if(F.col("in_universe") & ~poor).alias("n_low"),
    )
    scenarios = [
        F.struct(*[F.lit(row[c]).cast(t).alias(c) for c, t in grid.dtypes])
        for row in grid.collect()
    ]
    return sizes.select("*", F.inline(F.array(*scenarios))).select(
        *grid.columns,
        "n_subjects",
        sample_size(F.col("p"), F.col("n_subjects")).alias("n_drawn"),
        sample_size(F.col("p_high"), F.col("n_high")).alias("n_drawn_high"),
        sample_size(F.col("p_low"), F.col("n_low")).alias("n_drawn_low"),
    )
