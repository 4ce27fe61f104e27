import pytest
from pyspark.sql import functions as F

from lacuna.operators import completers, impute_composite, impute_locf, model_cells
from lacuna.plans import (
    compare_once,
    complete_odds_ratios,
    forest_frame,
    mar_cells,
    mar_rows,
    mc_summary,
    mcar_cells,
    mcar_rows,
    run_mcar,
    single_draw_frame,
    truth_frame,
    variance_frame,
)
from lacuna.study import MAR_SCRIPT, MarRates

SEEDS = range(1, 4)


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


CELL = ["seed", "SEX", "TRTP", "n", "r"]


def test_mcar_counts_equal_the_row_level_path(trial):
    responses, subjects = trial
    fast = mcar_cells(responses, subjects, SEEDS, [0.1, 0.3])
    rows = mcar_rows(responses, subjects, SEEDS, 0.3)
    for strategy, handle in (
        ("completers", completers),
        ("imputed", impute_composite),
        ("locf", impute_locf),
    ):
        slow = model_cells(handle(rows, missing="missing"), ["seed"])
        got = fast.filter((F.col("strategy") == strategy) & (F.col("scenario") == "MCAR 30%"))
        assert as_set(got, *CELL) == as_set(slow, *CELL)


@pytest.mark.parametrize("mode", ["lag1_original", "last_observed"])
def test_mar_counts_equal_the_row_level_path(trial, mode):
    responses, subjects = trial
    fast = mar_cells(responses, subjects, SEEDS, MAR_SCRIPT, locf=mode)
    rows = mar_rows(responses, subjects, SEEDS, MAR_SCRIPT).filter("AVISITN = 6")
    for strategy, handled in (
        ("completers", completers(rows)),
        ("imputed", impute_composite(rows)),
        ("locf", impute_locf(rows, mode=mode)),
    ):
        slow = model_cells(handled, ["seed"])
        got = fast.filter(F.col("strategy") == strategy)
        assert as_set(got, *CELL) == as_set(slow, *CELL)


def test_nothing_missing_gives_the_truth(trial):
    responses, subjects = trial
    truth = {r.contrast: r.or_raw for r in complete_odds_ratios(responses, subjects).collect()}
    for r in run_mcar(responses, subjects, [1], [0.0]).collect():
        assert r.or_raw == pytest.approx(truth[r.contrast])


def test_strategies_share_the_draw(trial):
    responses, subjects = trial
    total = (
        mcar_cells(responses, subjects, SEEDS, [0.3])
        .groupBy("seed")
        .pivot("strategy", ["completers", "imputed"])
        .agg(F.sum("n").alias("n"), F.sum("r").alias("r"))
    )
    drawn = (
        mcar_rows(responses, subjects, SEEDS, 0.3).filter("missing").groupBy("seed").count()
    )
    for r in total.join(drawn, "seed").collect():
        assert r.imputed_n == r.completers_n + r["count"]
        assert r.imputed_r == r.completers_r


def test_partitioning_does_not_matter(trial):
    responses, subjects = trial
    results = [
        as_set(mar_cells(r, s, [1, 2]), "seed", "strategy", "SEX", "TRTP", "n", "r")
        for r, s in (
            (responses.coalesce(1), subjects.coalesce(1)),
            (responses.repartition(11), subjects.orderBy(F.desc("SUBJID"))),
        )
    ]
    assert results[0] == results[1]


def test_hot_subject_does_not_change_other_results(trial):
    """Very many rows of one subject under other parameters and visits."""
    responses, subjects = trial
    extra = responses.sparkSession.range(20000).select(
        F.lit(5).cast("long").alias("SUBJID"),
        F.when(F.col("id") % 2 == 0, 20).otherwise(10).alias("PARAMN"),
        (F.col("id") + 100).cast("int").alias("AVISITN"),
        F.lit("later").alias("AVISIT"),
        F.lit(1.0).alias("AVAL"),
        F.lit(99.0).alias("PCHG"),
        F.lit(1).alias("PCHGCA1N"),
        F.lit("ACTIVE").alias("TRTP"),
        F.lit(1).alias("TRTPN"),
    )
    columns = ("seed", "strategy", "SEX", "TRTP", "n", "r")
    plain = as_set(mar_cells(responses, subjects, [3]), *columns)
    assert as_set(mar_cells(responses.unionByName(extra), subjects, [3]), *columns) == plain


# --- summaries and frames ----------------------------------------------------


def replicates(spark, values):
    rows = [
        ("S", seed, strategy, contrast, v, v, v is not None)
        for strategy in ("completers", "imputed", "locf")
        for contrast in ("AvsP", "SexM2F", "T140vsP", "T210vsP")
        for seed, v in enumerate(values, 1)
    ]
    return spark.createDataFrame(
        rows,
        "scenario string, seed long, strategy string, contrast string,"
        " or_raw double, or_value double, converged boolean",
    )


def truth(spark):
    return spark.createDataFrame(
        [("SexM2F", 1.1111), ("T210vsP", 4.0), ("AvsP", 2.0), ("T140vsP", 3.0)],
        "contrast string, or_value double",
    )


def test_summary_by_hand(spark):
    out = mc_summary(replicates(spark, [1.0, 2.0, 3.0, 6.0]), peak=F.max)
    r = out.first()
    assert (r.strategy, r.contrast, r.mean, r.n, r.n_failed, r.peak) == (
        "completers", "AvsP", 3.0, 4, 0, 6.0
    )
    assert r["var"] == pytest.approx(14 / 3)
    half = 1.959963984540054 * (14 / 3) ** 0.5 / 2
    assert (r.low, r.high) == pytest.approx((3 - half, 3 + half))
    order = [(r.strategy, r.contrast) for r in out.collect()]
    assert order == sorted(order) and len(order) == 12


def test_failed_replicates_are_left_out(spark):
    r = mc_summary(replicates(spark, [1.0, None, 3.0])).first()
    assert (r.mean, r.n, r.n_failed) == (2.0, 2, 1)


def test_forest_frame(spark):
    rows = forest_frame(mc_summary(replicates(spark, [1.0, 2.0004])), truth(spark)).collect()
    assert len(rows) == 16
    assert [r.group for r in rows[::4]] == [
        "Completers Data", "Imputed Data (Composite)", "Imputed Data (LOCF)", "Complete Data"
    ]
    assert [r.yAxis.split("\n")[0].strip() for r in rows[:4]] == [
        "TRTP Active control", "TRTP Test drug 140mg", "TRTP Test drug 210mg", "Sex(M vs F)"
    ]
    assert rows[0].VAL == 1.5 and rows[0].boxOdds == pytest.approx(1.5002)
    last = rows[12:]
    assert [r.boxOdds for r in last] == [2.0, 3.0, 4.0, 1.1111]
    assert all(r.boxOdds == r.boxCILow == r.boxCIHigh for r in last)
    assert last[3].VAL == 1.111


def test_variance_frame(spark):
    rows = variance_frame(mc_summary(replicates(spark, [1.0, 2.0, 3.0, 6.0]))).collect()
    assert len(rows) == 9 and {r["var"] for r in rows} == {4.67}
    assert [r.dataHandling for r in rows[::3]] == ["completers", "composite", "LOCF"]
    assert rows[0].OR == "Active Control vs Placebo"


def test_truth_frame(spark):
    rows = truth_frame(truth(spark)).collect()
    assert [(r.boxOdds, r.VAL) for r in rows] == [(2.0, 2.0), (3.0, 3.0), (4.0, 4.0), (1.1111, 1.111)]


def test_single_draw(trial):
    responses, subjects = trial
    ratios, seed = compare_once(
        responses, subjects, mcar=[0.2], mar=[MarRates(0.25, 0.075)], interactive_locf=True
    )
    frame = single_draw_frame(ratios, complete_odds_ratios(responses, subjects)).collect()
    assert len(frame) == 2 * 3 * 8
    again, same = compare_once(responses, subjects, mcar=[0.2], seed=seed)
    assert same == seed
    first = ratios.filter("scenario = 'MCAR 20%'")
    columns = ["strategy", "contrast", "or_value"]
    assert as_set(again, *columns) == as_set(first, *columns)
    with pytest.raises(ValueError):
        compare_once(responses, subjects)


# --- paths that ordinary data does not take ----------------------------------


@pytest.mark.parametrize("hint", [20, 10**13])
def test_folding_survives_wrong_size_hints(trial, hint):
    """A far too large hint makes the first search miss in many replicates."""
    from lacuna.operators.mechanisms import mcar_folded
    from lacuna.operators.profile import subject_profile
    from lacuna.operators.sampling import Fold

    responses, subjects = trial
    universe = subject_profile(responses, subjects).filter("in_universe")
    fold = Fold(("cell",), (F.sum("y_n").alias("seen"),))
    columns = ("replicate", "cell", "level", "n")

    def totals(n):
        folded = mcar_folded(universe, n, SEEDS, [0.1, 0.3], fold)
        return as_set(
            folded.groupBy("replicate", "cell", "level").agg(F.sum("seen").alias("n")), *columns
        )

    expected = totals(1500)
    assert totals(hint) == expected
    assert len({(r, level) for r, _, level, _ in expected}) == 9


def test_unlisted_subject_is_never_missing_under_mcar(make_trial):
    """With a model that does not need the subject table its response still counts."""
    from dataclasses import replace

    from lacuna.study import DEFAULT_STUDY, Contrast, Design, Factor

    design = Design(
        (Factor("TRTP", ("ACTIVE", "PLACEBO")),),
        (Contrast("AvsP", "TRTP", "ACTIVE", "PLACEBO"),),
    )
    study = replace(DEFAULT_STUDY, design=design)
    folk = {i: ("F", ("ACTIVE", "PLACEBO")[i % 2], {6: (0.0, 1)}) for i in range(1, 21)}
    responses, subjects = make_trial(folk, unlisted={1, 2})
    cells = mcar_cells(responses, subjects, [1, 2], [0.5], study)
    got = cells.groupBy("seed", "strategy").agg(F.sum("n").alias("n"), F.sum("r").alias("r"))
    assert as_set(got, "seed", "strategy", "n", "r") == {
        (seed, strategy, n, r)
        for seed in (1, 2)
        for strategy, n, r in (("completers", 11, 11), ("imputed", 20, 11), ("locf", 11, 11))
    }


def test_listed_seeds_equal_a_range(trial):
    """Explicit seeds, a step and blocks of seeds give the same replicates."""
    from lacuna.operators import mechanisms

    responses, subjects = trial
    whole = as_set(mar_cells(responses, subjects, range(1, 8)), "strategy", *CELL)
    odd = {row for row in whole if row[1] % 2}
    assert as_set(mar_cells(responses, subjects, range(1, 8, 2)), "strategy", *CELL) == odd
    assert as_set(mar_cells(responses, subjects, [7, 1, 5, 3]), "strategy", *CELL) == odd
    blocks = mechanisms.seed_blocks
    try:
        mechanisms.seed_blocks = lambda seeds, scenarios=1: [seeds[:3], seeds[3:]]
        assert as_set(mar_cells(responses, subjects, range(1, 8)), "strategy", *CELL) == whole
    finally:
        mechanisms.seed_blocks = blocks


def test_many_listed_seeds_start_quickly(spark):
    from lacuna.operators.mechanisms import expand

    seeds = list(range(1, 18_001, 2))
    rows = expand(spark.range(2).withColumnRenamed("id", "SUBJID"), seeds, 2)
    assert rows.agg(F.count("*"), F.min("replicate"), F.max("replicate")).first()[:] == (
        36_000, 2, 35_999,
    )


def test_two_million_listed_seeds_come_in_blocks(spark):
    """No task gets more of them than the bound, also for rows that are never drawn."""
    from lacuna.functions.staging import BROADCAST_ROWS
    from lacuna.operators.mechanisms import expand

    seeds = list(range(1, 4_000_001, 2))
    rows = expand(spark.range(1).withColumnRenamed("id", "SUBJID"), seeds)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 4 == len(seeds) / BROADCAST_ROWS
    assert rows.agg(F.count("*"), F.min("replicate"), F.max("replicate")).first()[:] == (
        2_000_000, 1, 3_999_999,
    )


def test_one_fit_and_one_aggregate_in_a_forest_frame(trial):
    responses, subjects = trial
    summary = mc_summary(run_mcar(responses, subjects, range(1, 4), [0.3]))
    frame = forest_frame(summary, complete_odds_ratios(responses, subjects))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 2
