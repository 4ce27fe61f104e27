"""Registered queries and their equivalent SQL."""

from __future__ import annotations

import importlib
import os
import sys
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle_queries  # noqa: E402
from lacuna.functions import draw_key, pick, settle  # noqa: E402
from lacuna.operators import (  # noqa: E402
    analysis_set,
    complete_case,
    completers,
    design_of,
    impute_composite,
    impute_locf,
    level_ratios,
    model_cells,
    parameter_rows,
    response_lag,
    sample_exact,
    three_way_table,
)
from lacuna.operators.mechanisms import MCAR_DRAW, expand, pool_table, spread  # noqa: E402
from lacuna.plans import (  # noqa: E402
    Flagged,
    Sampled,
    compare_once,
    complete_odds_ratios,
    forest_frame,
    mar_cells,
    mar_locf_all_visits,
    mar_rows,
    mc_summary,
    mcar_cells,
    mcar_rows,
    own_cells,
    run_mar,
    run_mcar,
    run_own,
    single_draw_frame,
    truth_frame,
    variance_frame,
)
from lacuna.plans.rows import (  # noqa: E402
    mar_dropout,
    mar_setup,
    mcar_sample,
    scenario_sizes,
)
from lacuna.operators.analysis import with_sex  # noqa: E402
from lacuna.functions.staging import kept_path  # noqa: E402
from lacuna.sources import (  # noqa: E402
    load_responses,
    load_subjects,
    nation_arms,
    subject_universe,
    trial_tables,
)
from lacuna.study import (  # noqa: E402
    DEFAULT_STUDY,
    LAGGED,
    MAR_MENU,
    MAR_SCRIPT,
    MCAR_RATES,
    REPLICATES,
    RESPONSE,
)

try:
    training_data = importlib.import_module("lacuna.llm.registry")
except ModuleNotFoundError:
    # The training-data folders, or a library that only they need, are not there.
    training_data = None

SMOKE_DIR = "/root/testdata/sf0.001"
SINGLE_SEED = 7
Queries = dict[str, Callable[[SparkSession, str], DataFrame]]
RATE = 0.3
VISIT = 6
REPEATED = replace(DEFAULT_STUDY, tie="LINE")
SEPARATED_ARM = "TEST 210MG"
#: Seeds whose masked rows are returned one by one; digests and totals take all.
ROW_SEEDS = range(1, 21)
FITTED = ["seed", "SUBJID", "SEX", "TRTP", "PCHGCA1N"]


def _rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def entry(spark: SparkSession) -> DataFrame:
    """The true odds ratios of the small trial."""
    return complete_odds_ratios(*trial_tables(spark, SMOKE_DIR))


def _trial(run: Callable[[DataFrame, DataFrame], DataFrame]):
    return lambda spark, sf_dir: run(*trial_tables(spark, sf_dir))


def _summary(replicates):
    return _rounded(mc_summary(replicates), 8, "mean", "var", "low", "high")


def _ratios(run):
    return _trial(lambda r, s: _rounded(run(r, s), 6, "or_raw"))


def _forest(run):
    def query(r, s):
        frame = forest_frame(mc_summary(run(r, s)), complete_odds_ratios(r, s))
        return _rounded(frame, 8, "boxOdds", "boxCILow", "boxCIHigh")

    return _trial(query)


def _single(**scenarios):
    def query(r, s):
        ratios, _ = compare_once(r, s, seed=SINGLE_SEED, **scenarios)
        return single_draw_frame(ratios, complete_odds_ratios(r, s))

    return _trial(query)


def _through_csv(table: DataFrame, load) -> DataFrame:
    """The table as the reader finds it in files with a header and NA for missing."""
    path = kept_path(table.sparkSession, "lacuna-csv")
    table.write.csv(path, header=True, nullValue="NA")
    return load(table.sparkSession, path)


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odds ratios with the factor levels that the data hold."""
    responses, subjects = nation_arms(spark, sf_dir)
    design = design_of(analysis_set(responses, subjects), ["SEX", "TRTP"])
    study = replace(DEFAULT_STUDY, design=design)
    return _rounded(complete_odds_ratios(responses, subjects, study), 6, "or_raw")


def _sites(r: DataFrame, s: DataFrame) -> DataFrame:
    """Odds ratios of very many levels: 251 sites, over all visits."""
    site = F.concat(F.lit("S"), F.lpad((F.col("SUBJID") % 251).cast("string"), 3, "0"))
    rows = with_sex(parameter_rows(r, skip_visit=False), s).withColumn("SITE", site)
    rows = rows.filter(F.col(RESPONSE).isNotNull())
    cells = rows.groupBy("SEX", "SITE").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(RESPONSE).cast("long")).alias("r")
    )
    return level_ratios(cells, ["SEX", "SITE"])


def _without_responders(responses: DataFrame) -> DataFrame:
    """One arm has no responder, so its odds ratio has no finite estimate."""
    none = (F.col("TRTP") == SEPARATED_ARM) & F.col(RESPONSE).isNotNull()
    return responses.withColumn(RESPONSE, F.when(none, 0).otherwise(F.col(RESPONSE)))


def source_queries() -> Queries:
    lagged = ["SUBJID", "AVISITN", "PCHGCA1N", "LAGPCHGCA1N"]
    return {
        "load_responses": _trial(lambda r, s: _through_csv(r, load_responses)),
        "load_subjects": _trial(lambda r, s: _through_csv(s, load_subjects)),
        "subject_universe": _trial(lambda r, s: subject_universe(s)),
        "scenario_sizes": _trial(
            lambda r, s: scenario_sizes(r, s, MCAR_RATES, [*MAR_SCRIPT, *MAR_MENU])
        ),
        "analysis_set": _trial(analysis_set),
        "analysis_set_by_position": _trial(
            lambda r, s: pick(analysis_set(r, s), [1, 3, 7, 8, 10])
        ),
        "three_way_table": _trial(lambda r, s: three_way_table(analysis_set(r, s))),
        "response_lag": _trial(lambda r, s: response_lag(parameter_rows(r)).select(*lagged)),
        "response_lag_all_visits": _trial(
            lambda r, s: response_lag(parameter_rows(r, skip_visit=False)).select(*lagged)
        ),
        "complete_cells": _trial(lambda r, s: model_cells(complete_case(r, s))),
        "complete_odds_ratios": _ratios(complete_odds_ratios),
        "odds_ratios_of_nations": _nations,
        "odds_ratios_of_sites": _ratios(_sites),
        "odds_ratios_separated": _ratios(
            lambda r, s: complete_odds_ratios(_without_responders(r), s)
        ),
        "truth_frame": _trial(lambda r, s: truth_frame(complete_odds_ratios(r, s))),
    }


def _per_visit(rows: DataFrame, *more: str) -> DataFrame:
    """All rows of all seeds in exact totals per seed and visit.

    Weighted by the subject, so that a value at a wrong subject shows.
    """
    weight = F.col("SUBJID") % 1009 + 1
    totals = [F.count(F.lit(1)).alias("n")]
    for c in ("AVAL", "PCHG", RESPONSE, *more):
        totals.append(F.sum(F.when(F.col(c).isNotNull(), weight)).alias(f"{c}_seen"))
    for c in (RESPONSE, *more):
        totals.append(F.sum(F.col(c).cast("long") * weight).alias(f"{c}_sum"))
    cents = F.round(F.col("AVAL") * 100).cast("long")
    totals.append(F.sum(cents).alias("cents"))
    return rows.groupBy("seed", "AVISITN").agg(*totals)


def _digest(rows: DataFrame, by: list[str], *more: str) -> DataFrame:
    """Per group, the number of rows and a sum of hashes, of every row and column in any order."""
    values = ["SUBJID", "AVISITN", RESPONSE, *more]
    exact = [F.floor(F.col(c) * 1_000_000) for c in ("AVAL", "PCHG")]
    texts = [F.coalesce(c.cast("string"), F.lit("-")) for c in (*map(F.col, values), *exact)]
    first = F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 8), 16, 10).cast("long")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(first).alias("digest"))


def _own_rows(r: DataFrame, s: DataFrame) -> DataFrame:
    rows = response_lag(parameter_rows(r)).filter(F.col("AVISITN") == VISIT)
    return with_sex(rows, s)


#: What a user may write: the missing count against the tested arms, or carry what is known.
OWN_STRATEGIES = {
    "worst": lambda missing: F.when(
        missing, (F.col("TRTP") == "PLACEBO").cast("int")
    ).otherwise(F.col(RESPONSE)),
    "carried": lambda missing: F.when(missing, F.coalesce(LAGGED, F.lit(0))).otherwise(
        F.col(RESPONSE)
    ),
}
OWN_SAMPLE = Sampled(
    {"PLACEBO": 0.4, "ACTIVE": 0.2, "TEST 140MG": 0.2, "TEST 210MG": 0.1}, "TRTP", draw=21
)
OWN_FLAG = Flagged(lambda draw: draw(22) < F.when(F.col(LAGGED) == 1, 0.1).otherwise(0.35))


def _chosen_seed(r: DataFrame, s: DataFrame) -> DataFrame:
    """A draw whose seed was chosen, beside the draw that this seed gives when named."""
    free, seed = compare_once(r, s, mcar=MCAR_RATES)
    named, _ = compare_once(r, s, mcar=MCAR_RATES, seed=seed)
    keys = ["scenario", "strategy", "contrast"]
    both = free.select(*keys, "seed", "or_raw").join(
        named.select(*keys, F.col("seed").alias("named"), F.col("or_raw").alias("again")), keys
    )
    same = F.col("or_raw").eqNullSafe(F.col("again")) & (F.col("seed") == F.col("named"))
    return both.select(*keys, (same & (F.col("seed") == seed)).alias("same"))


def row_queries(seeds) -> Queries:
    """Queries that return rows per subject and seed."""

    def sample(r, s):
        universe = settle(subject_universe(s))
        n = universe.count()
        rows = expand(spread(universe, n, len(seeds)), seeds)
        rows = rows.withColumnRenamed("replicate", "seed")
        key = draw_key(F.col("SUBJID"), F.col("seed"), MCAR_DRAW)
        return sample_exact(rows, ["seed"], key, RATE, n).select("seed", "SUBJID")

    def mcar(strategy):
        return _trial(
            lambda r, s: strategy(mcar_rows(r, s, seeds, RATE), missing="missing").select(*FITTED)
        )

    def masked(r, s, totals=None):
        return mar_rows(r, s, seeds, MAR_SCRIPT, totals=totals)

    def few(r, s):
        return mar_rows(r, s, [x for x in seeds if x in ROW_SEEDS], MAR_SCRIPT)

    listed = ["scenario", "seed", "SUBJID", "AVISITN", "AVAL", RESPONSE]

    def mar(strategy):
        return _trial(
            lambda r, s: strategy(masked(r, s).filter(F.col("AVISITN") == VISIT)).select(*FITTED)
        )

    return {
        "mcar_sample": _trial(sample),
        "mcar_sample_nested": _trial(lambda r, s: mcar_sample(s, seeds, MCAR_RATES)),
        "mcar_completers": mcar(completers),
        "mcar_composite": mcar(impute_composite),
        "mcar_locf": mcar(impute_locf),
        "mar_dropout": _trial(lambda r, s: mar_dropout(r, s, seeds, MAR_SCRIPT)),
        "mar_masked_long": _trial(lambda r, s: _per_visit(masked(r, s), LAGGED)),
        "mar_masked_rows": _trial(lambda r, s: few(r, s).select(*listed, LAGGED)),
        "mar_masked_digest": _trial(
            lambda r, s: masked(r, s, lambda rows, by: _digest(rows, by, LAGGED))
        ),
        "mar_completers": mar(completers),
        "mar_composite": mar(impute_composite),
        "mar_locf": mar(impute_locf),
        "mar_locf_last_observed": _trial(
            lambda r, s: _per_visit(impute_locf(masked(r, s), mode="last_observed"))
        ),
        "mar_last_observed_rows": _trial(
            lambda r, s: impute_locf(few(r, s), mode="last_observed").select(*listed)
        ),
        "mar_last_observed_digest": _trial(
            lambda r, s: masked(
                r, s, lambda rows, by: _digest(impute_locf(rows, mode="last_observed"), by)
            )
        ),
        "mar_locf_all_visits": _ratios(lambda r, s: mar_locf_all_visits(r, s, seeds)),
    }


def simulation_queries(seeds) -> Queries:
    """Queries that reduce every replicate to cells, odds ratios or summaries."""

    def mcar(r, s):
        return run_mcar(r, s, seeds)

    def mar(r, s):
        return run_mar(r, s, seeds)

    def pools(r, s):
        _, draws = mar_setup(r, s, seeds, MAR_SCRIPT)
        return pool_table(draws).withColumnRenamed("replicate", "seed")

    return {
        "mcar_cells": _trial(lambda r, s: mcar_cells(r, s, seeds)),
        "mcar_cells_repeated": lambda spark, sf_dir: mcar_cells(
            *trial_tables(spark, sf_dir, by_month=True), seeds, study=REPEATED
        ),
        "mcar_replicates": _ratios(mcar),
        "mcar_summary": _trial(lambda r, s: _summary(mcar(r, s))),
        "mcar_summary_median": _trial(
            lambda r, s: _rounded(
                mc_summary(mcar(r, s), median=F.median, lowest=F.min).select(
                    "scenario", "strategy", "contrast", "n", "median", "lowest"
                ),
                8,
                "median",
                "lowest",
            )
        ),
        "mcar_forest_frame": _forest(mcar),
        "mcar_variance_frame": _trial(lambda r, s: variance_frame(mc_summary(mcar(r, s)))),
        "mar_pools": _trial(pools),
        "mar_cells": _trial(lambda r, s: mar_cells(r, s, seeds)),
        "mar_replicates": _ratios(mar),
        "mar_summary": _trial(lambda r, s: _summary(mar(r, s))),
        "mar_summary_last_observed": _trial(
            lambda r, s: _summary(run_mar(r, s, seeds, locf="last_observed"))
        ),
        "mar_forest_frame": _forest(mar),
        "mar_variance_frame": _trial(lambda r, s: variance_frame(mc_summary(mar(r, s)))),
        "own_sampled_replicates": _ratios(
            lambda r, s: run_own(_own_rows(r, s), OWN_SAMPLE, OWN_STRATEGIES, seeds)
        ),
        "own_flagged_cells": _trial(
            lambda r, s: own_cells(_own_rows(r, s), OWN_FLAG, OWN_STRATEGIES, seeds)
        ),
        "own_flagged_summary": _trial(
            lambda r, s: _summary(run_own(_own_rows(r, s), OWN_FLAG, OWN_STRATEGIES, seeds))
        ),
        "single_draw_chosen_seed": _trial(_chosen_seed),
        "single_draw_mcar": _single(mcar=MCAR_RATES),
        "single_draw_mar": _single(mar=MAR_MENU),
        "single_draw_mar_interactive": _single(mar=MAR_MENU, interactive_locf=True),
    }


def queries() -> Queries:
    return {
        **source_queries(),
        **row_queries(REPLICATES),
        **simulation_queries(REPLICATES),
        **(training_data.QUERIES if training_data else {}),
    }


def oracle_sql() -> dict[str, str]:
    return {
        **oracle_queries.build(REPLICATES[-1], REPLICATES[-1], SINGLE_SEED),
        **(training_data.ORACLE_SQL if training_data else {}),
    }
