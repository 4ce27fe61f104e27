import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lacuna.functions import draw_key, settle_counting
from lacuna.operators import (
    completers,
    impute_composite,
    impute_locf,
    mask_from,
    model_cells,
    parameter_rows,
    response_lag,
    subject_profile,
    three_way_table,
)
from lacuna.operators.analysis import last_observed
from lacuna.operators.mechanisms import pool_table
from lacuna.plans.rows import mar_dropout, mar_rows, mar_setup, mcar_rows, mcar_sample
from lacuna.study import DEFAULT_STUDY, MAR_SCRIPT, MarRates


def people(n=60):
    """Subjects whose change is poor at visits 3..5 by a fixed pattern."""
    arms = ["ACTIVE", "PLACEBO", "TEST 140MG", "TEST 210MG"]
    out = {}
    for i in range(1, n + 1):
        visits = {1: (0.0, 0), 2: (20.0, 0)}
        for v in (3, 4, 5, 6):
            poor = (i * v) % 3 == 0
            visits[v] = (5.0 if poor else 40.0, 0 if poor else 1)
        if i % 11 == 0:
            del visits[3]
        if i % 13 == 0:
            visits[4] = (None, None)
        out[i] = ("FM"[i % 2], arms[i % 4], visits)
    return out


def keys(spark, ids, seed, draw):
    df = spark.createDataFrame([(int(i),) for i in ids], "SUBJID long")
    rows = df.select("SUBJID", draw_key(F.col("SUBJID"), F.lit(seed), draw).alias("k")).collect()
    return {r.SUBJID: (r.k, r.SUBJID) for r in rows}


def simulate(spark, folk, universe, seed, high, low, visits=(4, 5, 6)):
    """Sequential dropout step by step on the driver."""
    left = {}
    sizes = {}
    for v in visits:
        def change(i):
            if i in left:
                return None
            return folk[i][2].get(v - 1, (None, None))[0] if i in folk else None

        poor = {i for i in folk if change(i) is not None and change(i) < 10}
        rest = set(universe) - poor
        for name, pool, rate in (("high", poor, high), ("low", rest, low)):
            key = keys(spark, pool, seed, v) if pool else {}
            drawn = sorted(pool, key=key.get)[: int(rate * len(pool))]
            if pool:
                sizes[v, name] = (len(pool), len(drawn))
            for i in drawn:
                left.setdefault(i, v)
    return left, sizes


@pytest.mark.parametrize("high, low", [(0.3, 0.05), (0.9, 0.5), (1.0, 0.0), (0.0, 0.0)])
def test_dropout_equals_step_by_step(spark, make_trial, high, low):
    folk = people()
    responses, subjects = make_trial(folk)
    rates = [MarRates(high, low, "x")]
    got = mar_dropout(responses, subjects, range(1, 4), rates).collect()
    _, draws = mar_setup(responses, subjects, range(1, 4), rates)
    sizes = {
        (r.replicate, r.visit, r["pool"]): (r.n_pool, r.n_drawn)
        for r in pool_table(draws).collect()
    }
    for seed in (1, 2, 3):
        left, expected = simulate(spark, folk, folk, seed, high, low)
        assert {r.SUBJID: r.dropout_visit for r in got if r.seed == seed} == left
        assert {k[1:]: v for k, v in sizes.items() if k[0] == seed} == expected


def test_masked_subjects_join_the_low_pool(make_trial):
    """Everyone poor leaves at visit 4; afterwards nobody is a poor responder."""
    folk = {
        i: ("F", "ACTIVE", {v: (1.0, 0) for v in (3, 4, 5, 6)}) for i in range(1, 21)
    }
    _, draws = mar_setup(*make_trial(folk), [1], [MarRates(1.0, 0.5, "x")])
    sizes = {(r.visit, r["pool"]): (r.n_pool, r.n_drawn) for r in pool_table(draws).collect()}
    assert sizes == {
        (4, "high"): (20, 20),
        (5, "low"): (20, 10),
        (6, "low"): (20, 10),
    }


def test_subject_without_rows_can_be_drawn_but_masks_nothing(spark, make_trial):
    folk = people(30)
    folk[99] = ("F", "ACTIVE", {})
    responses, subjects = make_trial(folk)
    got = mar_dropout(responses, subjects, [1], [MarRates(0.0, 1.0, "x")]).collect()
    assert 99 in {r.SUBJID for r in got}
    rows = mar_rows(responses, subjects, [1], [MarRates(0.0, 1.0, "x")])
    assert rows.filter("SUBJID = 99").count() == 0


def test_subject_missing_from_the_subject_table(spark, make_trial):
    """Such a subject joins the pool of poor responders but never the others."""
    folk = {i: ("F", "ACTIVE", {3: (1.0, 0), 4: (50.0, 1)}) for i in range(1, 11)}
    responses, subjects = make_trial(folk, unlisted={1, 2})
    _, draws = mar_setup(responses, subjects, [1], [MarRates(0.0, 1.0, "x")])
    sizes = {(r.visit, r["pool"]): r.n_pool for r in pool_table(draws).collect()}
    assert sizes[4, "high"] == 10 and (4, "low") not in sizes
    assert (5, "high") not in sizes and sizes[5, "low"] == 8


def test_several_scenarios_equal_one_at_a_time(make_trial):
    responses, subjects = make_trial(people())
    rates = [MarRates(0.3, 0.05, "a"), MarRates(0.2, 0.1, "b"), MarRates(0.9, 0.4, "c")]
    together = {
        tuple(r) for r in mar_dropout(responses, subjects, [1, 5], rates).collect()
    }
    apart = {
        tuple(r)
        for rate in rates
        for r in mar_dropout(responses, subjects, [1, 5], [rate]).collect()
    }
    assert together == apart and together


def test_poor_direction_and_cut(make_trial):
    from dataclasses import replace

    responses, subjects = make_trial(people())
    study = replace(DEFAULT_STUDY, poor_cut=30.0, poor_below=False)
    profile = subject_profile(responses, subjects, study)
    got = profile.agg(F.count_if("poor_before_5")).first()[0]
    expected = responses.filter("AVISITN = 4 and PCHG > 30").count()
    assert got == expected > 0


def test_masking_is_monotone(make_trial):
    responses, subjects = make_trial(people())
    rows = mar_rows(responses, subjects, range(1, 6), [MarRates(0.5, 0.3, "x")], skip_visit=False)
    gone = F.col("AVISITN") >= F.col("dropout_visit")
    measured = F.coalesce("AVAL", "PCHG", F.col("PCHGCA1N").cast("double"))
    assert rows.filter(gone & measured.isNotNull()).count() == 0
    kept = rows.filter(F.coalesce(~gone, F.lit(True))).select("SUBJID", "AVISITN", "PCHG")
    assert kept.distinct().exceptAll(responses.select("SUBJID", "AVISITN", "PCHG")).count() == 0


def test_mask_from_hand(spark):
    rows = spark.createDataFrame(
        [(v, d, 1.0, 2.0, 1) for v in (3, 4, 5, 6) for d in (None, 5)],
        "AVISITN int, dropout_visit int, AVAL double, PCHG double, PCHGCA1N int",
    )
    got = {(r.AVISITN, r.dropout_visit): r.PCHGCA1N for r in mask_from(rows).collect()}
    assert got == {(v, d): None if d and v >= d else 1 for v in (3, 4, 5, 6) for d in (None, 5)}


# --- lag and strategies ------------------------------------------------------


def test_lag_is_the_preceding_row(make_trial):
    responses, _ = make_trial(
        {
            1: ("F", "ACTIVE", {3: (0.0, 1), 4: (0.0, 0), 6: (0.0, 1)}),
            2: ("F", "ACTIVE", {1: (0.0, 1), 2: (0.0, 0), 6: (0.0, 1)}),
            3: ("F", "ACTIVE", {5: (None, None), 4: (0.0, 1), 6: (0.0, 1)}),
        }
    )
    def lag_at_6(skip):
        rows = response_lag(parameter_rows(responses, skip_visit=skip)).filter("AVISITN = 6")
        return {r.SUBJID: r.LAGPCHGCA1N for r in rows.collect()}
    assert lag_at_6(True) == {1: 0, 2: 1, 3: None}
    assert lag_at_6(False) == {1: 0, 2: 0, 3: None}


def folded(rows, name, value, where="true"):
    """Count and total of a value over the rows of each subject."""
    kept = F.when(F.expr(where), F.col(value))
    return rows.groupBy("SUBJID").agg(
        F.count(kept).alias(f"{name}_n"),
        F.coalesce(F.sum(kept.cast("long")), F.lit(0)).cast("long").alias(f"{name}_r"),
    )


def assert_profile_agrees(responses, subjects, study=DEFAULT_STUDY):
    from lacuna.operators.analysis import response_history

    null = "PCHGCA1N IS NULL"
    for skip in (True, False):
        profile = subject_profile(responses, subjects, study, lag_skips_visit=skip)
        profile = profile.filter("n_rows > 0")
        rows = response_history(parameter_rows(responses, study, skip_visit=skip), study)
        rows = rows.filter("AVISITN = 6")
        expected = {
            "y": folded(rows, "y", "PCHGCA1N"),
            "lag": folded(rows, "lag", "LAGPCHGCA1N"),
            "null_lag": folded(rows, "null_lag", "LAGPCHGCA1N", null),
        }
        if not skip:
            expected["null_seen"] = folded(rows, "null_seen", "SEEN", null)
            for v in study.dropout_visits:
                expected[f"gone_{v}"] = folded(rows, f"gone_{v}", f"SEEN_{v}")
        for name, want in expected.items():
            got = profile.select("SUBJID", f"{name}_n", f"{name}_r")
            assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0, name


def test_profile_agrees_with_the_windows(trial):
    assert_profile_agrees(*trial)


def repeated(spark, responses):
    """Some visits hold several rows: from visit 5 on, pairs of visits are one."""
    visit = F.col("AVISITN")
    paired = F.when(visit > 4, (visit / 2 + 3).cast("int")).otherwise(visit)
    return responses.withColumn("LINE", visit).withColumn("AVISITN", paired)


def test_repeated_rows_count_one_by_one(spark, trial):
    """Both paths take all rows of a visit, in the order of the tie column."""
    from lacuna.plans import mar_cells, mar_rows, mcar_cells, mcar_rows

    responses, subjects = trial
    rows = repeated(spark, responses)
    study = replace(DEFAULT_STUDY, tie="LINE")
    at = rows.filter("PARAMN = 10 AND AVISITN = 6")
    assert at.count() > at.select("SUBJID").distinct().count()
    assert_profile_agrees(rows, subjects, study)
    columns = ["seed", "SEX", "TRTP", "n", "r"]
    seeds = range(1, 3)

    def same(fast, handled, strategy):
        got = fast.filter(F.col("strategy") == strategy).select(*columns)
        want = model_cells(handled, ["seed"]).select(*columns)
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0, strategy

    fast = mcar_cells(rows, subjects, seeds, [0.3], study)
    slow = mcar_rows(rows, subjects, seeds, 0.3, study)
    same(fast, completers(slow, missing="missing"), "completers")
    same(fast, impute_composite(slow, missing="missing"), "imputed")
    same(fast, impute_locf(slow, missing="missing"), "locf")
    for mode in ("lag1_original", "last_observed"):
        fast = mar_cells(rows, subjects, seeds, MAR_SCRIPT, study, mode)
        slow = mar_rows(rows, subjects, seeds, MAR_SCRIPT, study).filter("AVISITN = 6")
        same(fast, completers(slow), "completers")
        same(fast, impute_composite(slow), "imputed")
        same(fast, impute_locf(slow, mode=mode), "locf")


def test_unordered_repeats_stop_both_paths(spark, trial):
    from lacuna.plans import mcar_cells

    responses, subjects = trial
    rows = repeated(spark, responses)
    with pytest.raises(Exception, match="several rows of a subject at one visit"):
        mcar_cells(rows, subjects, range(1, 2), [0.3]).collect()
    with pytest.raises(Exception, match="several rows of a subject at one visit"):
        response_lag(parameter_rows(rows)).collect()


def test_subject_listed_twice_stops_both_paths(spark, trial):
    from lacuna.operators import analysis_set
    from lacuna.plans import mcar_cells

    responses, subjects = trial
    twice = subjects.unionByName(subjects.limit(1))
    with pytest.raises(Exception, match="listed twice"):
        mcar_cells(responses, twice, range(1, 2), [0.3]).collect()
    with pytest.raises(Exception, match="listed twice"):
        analysis_set(responses, twice).collect()


def histories(rows, tie=False):
    """(lag, last seen, last seen before visit 5) of each (subject, visit[, line]) row, row by row."""
    expected = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[3]) if tie else r[1])
        for i, row in enumerate(own):
            before = own[:i]
            seen = [r[2] for r in before if r[2] is not None and r[1] != 2]
            early = [r[2] for r in before if r[2] is not None and r[1] != 2 and r[1] < 5]
            expected[(*row[:2], *row[3:])] = (
                before[-1][2] if before else None,
                seen[-1] if seen else None,
                early[-1] if early else None,
            )
    return expected


def test_history_of_a_subject_with_very_many_visits(spark):
    """Its rows lie in several ranges, and what one leaves over goes to the next."""
    from lacuna.operators import analysis

    rng = random.Random(3)
    rows = [(1, v, rng.choice([0, 1, None])) for v in range(1, 501) if v % 7]
    rows += [(2, v, None) for v in range(1, 301)] + [(2, 400, 1), (3, 6, 0), (0, 3, 1)]
    table = spark.createDataFrame(rows, "SUBJID long, AVISITN int, PCHGCA1N int").repartition(3)
    table = analysis.response_history(table)
    got = {(r.SUBJID, r.AVISITN): (r.LAGPCHGCA1N, r.SEEN, r.SEEN_5) for r in table.collect()}
    assert got == histories(rows)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan


def test_history_with_most_rows_in_one_visit(spark, monkeypatch):
    """90 % of all rows are one subject's at one visit; no range has most of them."""
    from lacuna.operators import analysis, ordered

    rng = random.Random(5)
    rows = [(7, 4, rng.choice([0, 1, None, None]), line) for line in range(1800)]
    rows += [(s, v, rng.choice([0, 1, None]), 0) for s in range(40) for v in (3, 4, 5, 6, 7) if s != 7]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "SUBJID long, AVISITN int, PCHGCA1N int, LINE int")
    kept = []
    settle = ordered.settle
    monkeypatch.setattr(ordered, "settle", lambda df: kept.append(settle(df)) or kept[-1])
    study = replace(DEFAULT_STUDY, tie="LINE")
    got = {
        (r.SUBJID, r.AVISITN, r.LINE): (r.LAGPCHGCA1N, r.SEEN, r.SEEN_5)
        for r in analysis.response_history(table.repartition(5), study).collect()
    }
    assert got == histories(rows, tie=True)
    sizes = [r["count"] for r in kept[0].groupBy(F.expr("at >> 33")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < len(rows) / 3


def test_preceding_in_groups_with_nulls(spark):
    from lacuna.operators.ordered import with_preceding

    rows = [("a", None, i, i % 3 or None) for i in range(9)] + [(None, 1, i, None) for i in range(4)]
    rows += [(None, None, 5, 2), ("b", 1, 0, None)]
    table = spark.createDataFrame(rows, "`k.1` string, k2 int, n int, v int").withColumn("old", F.lit(0))
    found = with_preceding(table, ["k.1", "k2"], ["n"], {"old": F.col("v")}, {"s": F.col("v")}, "first")
    got = {tuple(r)[:3]: tuple(r)[4:] for r in found.collect()}
    for key in {r[:2] for r in rows}:
        own = sorted((r for r in rows if r[:2] == key), key=lambda r: r[2])
        for i, row in enumerate(own):
            seen = [r[3] for r in own[:i] if r[3] is not None]
            assert got[row[:3]] == (own[i - 1][3] if i else None, seen[-1] if seen else None, not i)
    assert with_preceding(table.limit(0), ["k2"], ["n"], {"p": F.col("v")}, {}).count() == 0


def test_natural_nulls_differ_between_mechanisms(spark):
    rows = spark.createDataFrame(
        [(1, True, 1, 0), (2, True, None, 1), (3, False, None, 1), (4, False, 1, None)],
        "id int, missing boolean, PCHGCA1N int, LAGPCHGCA1N int",
    )
    def result(df):
        return {r.id: r.PCHGCA1N for r in df.collect()}
    assert result(completers(rows, "missing")) == {3: None, 4: 1}
    assert result(completers(rows)) == {1: 1, 4: 1}
    assert result(impute_composite(rows, "missing")) == {1: 0, 2: 0, 3: None, 4: 1}
    assert result(impute_composite(rows)) == {1: 1, 2: 0, 3: 0, 4: 1}
    assert result(impute_locf(rows, "missing")) == {1: 0, 2: 1, 3: None, 4: 1}
    assert result(impute_locf(rows)) == {1: 1, 2: 1, 3: 1, 4: 1}


def test_carry_before_masking_or_last_observed(make_trial):
    """Masked at visit 5: the original lag sees visit 5, the last observed visit 4."""
    folk = {1: ("F", "ACTIVE", {3: (50.0, 0), 4: (50.0, 0), 5: (50.0, 1), 6: (50.0, 1)})}
    responses, _ = make_trial(folk)
    rows = last_observed(response_lag(parameter_rows(responses))).withColumn(
        "dropout_visit", F.lit(5)
    )
    rows = mask_from(rows).filter("AVISITN = 6")
    assert impute_locf(rows).first().PCHGCA1N == 1
    assert impute_locf(rows, mode="last_observed").first().PCHGCA1N == 0


def test_first_visit_rule(spark):
    rows = spark.createDataFrame(
        [(3, None, 1), (4, None, 1), (3, 1, 0)], "AVISITN int, PCHGCA1N int, LAGPCHGCA1N int"
    )
    got = [r.PCHGCA1N for r in impute_locf(rows, first_visit=3).collect()]
    assert got == [0, 1, 1]


def test_mcar_rows_keep_their_natural_nulls(trial):
    responses, subjects = trial
    rows = mcar_rows(responses, subjects, range(1, 4), 0.3)
    base = parameter_rows(responses).filter("AVISITN = 6").count()
    assert rows.count() == 3 * base
    sample = mcar_sample(subjects, range(1, 4), [0.3]).select("seed", "SUBJID")
    flagged = rows.filter("missing").select("seed", "SUBJID")
    assert flagged.exceptAll(sample).count() == 0
    assert sample.join(rows.select("seed", "SUBJID"), ["seed", "SUBJID"]).count() == flagged.count()


def test_three_way_table_keeps_empty_cells(spark):
    rows = spark.createDataFrame(
        [(1, "F", 1), (1, "F", 0), (2, "M", 1), (2, None, 1), (3, "M", None)],
        "TRTPN int, SEX string, PCHGCA1N int",
    )
    got = {tuple(r) for r in three_way_table(rows).collect()}
    assert got == {(1, "F", 1, 1), (1, "M", 0, 0), (2, "F", 0, 0), (2, "M", 0, 1)}


def test_three_way_table_of_many_levels_is_lazy(spark, monkeypatch):
    from lacuna.functions import staging

    rows = [(i % 40, f"s{i % 70}", i % 2) for i in range(300)]
    table = spark.createDataFrame(rows, "TRTPN int, SEX string, PCHGCA1N int")
    monkeypatch.setattr(staging, "settle_counting", None)
    found = three_way_table(table)
    got = {tuple(r) for r in found.collect()}
    expected = {
        (a, f"s{b}", *(sum(r == (a, f"s{b}", y) for r in rows) for y in (0, 1)))
        for a in range(40)
        for b in range(70)
    }
    assert got == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan and "Cartesian" not in plan
    assert "ReusedExchange" in plan


def test_counts_taken_while_settling(spark):
    df, seen = settle_counting(spark.range(10), n=F.count(F.lit(1)), even=F.count_if(F.expr("id % 2 = 0")))
    assert seen == {"n": 10, "even": 5} and df.count() == 10


def test_script_rates():
    assert MAR_SCRIPT[0].label == "MAR"
    assert MarRates(0.25, 0.075).label == "MAR 25/7.5%"


@pytest.mark.parametrize("hint", [3, 10**13])
def test_dropout_survives_wrong_size_hints(trial, hint):
    """A far too large hint makes the first scan miss in many replicates."""
    from lacuna.operators.dropout import Dropout, dropout_cuts, dropout_folded
    from lacuna.operators.mechanisms import expand
    from lacuna.operators.sampling import Fold

    profile, _ = settle_counting(subject_profile(*trial))
    rates = [MarRates(0.3, 0.05, "a"), MarRates(0.5, 0.1, "b")]
    rows = expand(profile, range(1, 4), 2)
    fold = Fold(("cell",), (F.sum("y_r").alias("y_r"),), ("y_r",))

    def found(size):
        dropout = Dropout((4, 5, 6), rates, {v: (size, size) for v in (4, 5, 6)})
        cuts = dropout_cuts(rows, dropout).collect()
        folded = dropout_folded(rows, dropout, fold).collect()
        return {tuple(r) for r in cuts}, {tuple(r) for r in folded}

    cuts, folded = found(500)
    assert found(hint) == (cuts, folded)
    assert len(cuts) == 6 * 6 and {v for *_, v, _ in folded} >= {None, 4, 5, 6}
