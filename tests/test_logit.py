import numpy as np
import pytest
from pyspark.ml.feature import RFormula
from pyspark.ml.regression import GeneralizedLinearRegression

from lacuna.operators import analysis_set, model_cells, odds_ratios
from lacuna.operators.logit import fit_cells
from lacuna.study import DEFAULT_DESIGN, Contrast, Design, Factor


def cells(spark, rows):
    return spark.createDataFrame(rows, "g int, SEX string, TRTP string, n long, r long")


ARMS = DEFAULT_DESIGN.factors[1].levels


def full(g, counts):
    """counts: (n, r) for F then M in arm order."""
    pairs = [(s, a) for s in ("F", "M") for a in ARMS]
    return [(g, s, a, n, r) for (s, a), (n, r) in zip(pairs, counts) if n]


def by_contrast(df, g):
    return {r.contrast: r for r in df.collect() if r.g == g}


def test_against_iterated_regression(trial):
    responses, subjects = trial
    rows = analysis_set(responses, subjects).dropna(subset=["PCHGCA1N", "SEX", "TRTP"])
    got = {r.contrast: r.or_raw for r in odds_ratios(model_cells(rows)).collect()}
    formula = RFormula(
        formula="PCHGCA1N ~ SEX + TRTP", stringIndexerOrderType="alphabetDesc"
    ).fit(rows)
    data = formula.transform(rows)
    names = [
        a["name"]
        for kind in data.schema["features"].metadata["ml_attr"]["attrs"].values()
        for a in sorted(kind, key=lambda a: a["idx"])
    ]
    model = GeneralizedLinearRegression(family="binomial", link="logit", tol=1e-12).fit(data)
    coef = dict(zip(names, model.coefficients))
    def at(name):
        return coef.get(name, 0.0)
    expected = {
        "AvsP": at("TRTP_ACTIVE") - at("TRTP_PLACEBO"),
        "SexM2F": at("SEX_M") - at("SEX_F"),
        "T140vsP": at("TRTP_TEST 140MG") - at("TRTP_PLACEBO"),
        "T210vsP": at("TRTP_TEST 210MG") - at("TRTP_PLACEBO"),
    }
    for name, log_ratio in expected.items():
        assert got[name] == pytest.approx(np.exp(log_ratio), abs=1e-6)


def test_no_sex_effect_gives_plain_ratios(spark):
    same = [(100, 20), (100, 50), (100, 40), (100, 10)]
    got = by_contrast(odds_ratios(cells(spark, full(1, same * 2)), ["g"]), 1)
    assert got["SexM2F"].or_raw == pytest.approx(1.0)
    assert got["AvsP"].or_raw == pytest.approx(0.25)
    assert got["T140vsP"].or_value == round((40 / 60) / 1, 4)
    assert got["T210vsP"].or_raw == pytest.approx(1 / 9)
    assert all(r.converged for r in got.values())


def test_many_groups_and_cell_order(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(40):
        n = rng.integers(20, 400, 8)
        rows += full(g, [(int(k), int(rng.integers(3, k - 3))) for k in n])
    together = odds_ratios(cells(spark, rows), ["g"])
    shuffled = odds_ratios(cells(spark, rows[::-1]).repartition(7), ["g"])
    a = {(r.g, r.contrast): r.or_raw for r in together.collect()}
    b = {(r.g, r.contrast): r.or_raw for r in shuffled.collect()}
    assert len(a) == 160 and a == pytest.approx(b)
    # At the maximum, fitted and observed responders agree in every margin.
    coef = {r.g: np.array(r.coef) for r in fit_cells(cells(spark, rows), ["g"]).collect()}
    for g, theta in coef.items():
        mine = [r for r in rows if r[0] == g]
        for level in ("F", "M", *ARMS):
            inside = [r for r in mine if level in r[1:3]]
            fitted = sum(
                r[3] / (1 + np.exp(-(theta[0] + theta[DEFAULT_DESIGN.position("SEX", r[1])]
                                     + theta[DEFAULT_DESIGN.position("TRTP", r[2])])))
                for r in inside
            )
            assert fitted == pytest.approx(sum(r[4] for r in inside), abs=1e-6)


def test_separated_arm_loses_only_its_contrast(spark):
    """The other estimates are those without the rows of that arm."""
    rest = [(10, 5), (10, 4), (10, 6)]
    rows = full(1, [(10, 10), *rest] * 2) + full(2, [(0, 0), *rest] * 2)
    rows += full(3, [(10, 3), *rest] * 2)
    out = odds_ratios(cells(spark, rows), ["g"])
    bad, without, good = by_contrast(out, 1), by_contrast(out, 2), by_contrast(out, 3)
    assert bad["AvsP"].or_raw is None and bad["AvsP"].or_value is None
    assert not bad["AvsP"].converged
    for name in ("SexM2F", "T140vsP", "T210vsP"):
        assert bad[name].converged
        assert bad[name].or_raw == pytest.approx(without[name].or_raw, rel=1e-9)
    assert all(r.or_raw is not None and r.converged for r in good.values())


def test_separated_reference_loses_every_contrast_with_it(spark):
    rows = full(1, [(10, 5), (10, 0), (10, 4), (10, 6)] * 2)
    got = by_contrast(odds_ratios(cells(spark, rows), ["g"]), 1)
    assert {name for name, r in got.items() if r.converged} == {"SexM2F"}


def test_very_rare_responses_have_an_estimate(spark):
    n = 10**14
    rows = full(1, [(n, 1), (n, 2), (n, 3), (n, 4), (n, 3), (n, 4), (n, 5), (n, 6)])
    got = by_contrast(odds_ratios(cells(spark, rows), ["g"]), 1)
    assert all(r.converged for r in got.values())
    assert got["AvsP"].or_raw == pytest.approx(4 / 6, rel=1e-6)


def test_separation_inside_the_margins(spark):
    """No margin is one-sided in group 1, yet its likelihood has no maximum."""
    design = Design(
        (Factor("SEX", ("F", "M")), Factor("TRTP", ("A", "B"))),
        (Contrast("B2A", "TRTP", "B", "A"),),
    )
    rows = [(1, "F", "A", 5, 0), (1, "F", "B", 5, 2), (1, "M", "A", 5, 3), (1, "M", "B", 5, 5)]
    rows += [(2, "F", "A", 5, 0), (2, "F", "B", 5, 5), (2, "M", "A", 5, 5), (2, "M", "B", 5, 5)]
    rows += [(3, "F", "A", 5, 1), (3, "F", "B", 5, 2), (3, "M", "A", 5, 3), (3, "M", "B", 5, 5)]
    out = {r.g: r for r in odds_ratios(cells(spark, rows), ["g"], design).collect()}
    assert out[3].converged and out[3].or_raw > 1
    assert not out[1].converged and out[1].or_raw is None
    assert not out[2].converged and out[2].or_raw is None


def test_small_arm_far_from_the_rest(spark):
    rows = full(1, [(10**6, 20), (10**6, 10), (40, 39), (40, 1)] * 2)
    got = by_contrast(odds_ratios(cells(spark, rows), ["g"]), 1)
    assert got["T140vsP"].converged
    assert got["T140vsP"].or_raw == pytest.approx(39 / (10 / (10**6 - 10)), rel=1e-6)
    assert got["T210vsP"].or_raw == pytest.approx((1 / 39) / (10 / (10**6 - 10)), rel=1e-6)


def test_absent_arm_drops_only_its_contrast(spark):
    rows = full(1, [(0, 0), (50, 20), (50, 10), (50, 30), (0, 0), (50, 25), (50, 15), (50, 20)])
    got = by_contrast(odds_ratios(cells(spark, rows), ["g"]), 1)
    assert got["AvsP"].or_raw is None
    assert got["T140vsP"].or_raw < 1 and got["SexM2F"].or_raw is not None


def test_single_sex(spark):
    rows = full(1, [(50, 20), (50, 25), (50, 10), (50, 30)] + [(0, 0)] * 4)
    got = by_contrast(odds_ratios(cells(spark, rows), ["g"]), 1)
    assert got["SexM2F"].or_raw is None
    assert got["AvsP"].or_raw == pytest.approx((20 / 30) / 1)


def test_null_factors_and_responses_are_not_counted(make_trial):
    responses, subjects = make_trial(
        {
            1: ("F", "ACTIVE", {6: (50.0, 1)}),
            2: (None, "ACTIVE", {6: (50.0, 1)}),
            3: ("F", None, {6: (50.0, 1)}),
            4: ("F", "ACTIVE", {6: (None, None)}),
            5: ("F", "ACTIVE", {6: (1.0, 0)}),
        }
    )
    got = model_cells(analysis_set(responses, subjects)).collect()
    assert [tuple(r) for r in got] == [("F", "ACTIVE", 2, 1)]


def test_unlisted_level_is_an_error(spark):
    rows = cells(spark, [(1, "F", "OTHER DRUG", 3, 1)])
    with pytest.raises(Exception, match="unlisted TRTP level"):
        odds_ratios(rows, ["g"]).collect()


def test_large_counts(spark):
    big = 10**10
    rows = full(1, [(big, big // 5), (big, big // 2), (big, big // 3), (big, big // 10)] * 2)
    got = by_contrast(odds_ratios(cells(spark, rows), ["g"]), 1)
    assert got["AvsP"].or_raw == pytest.approx(0.25, rel=1e-9)


def test_rare_response(spark):
    rows = full(1, [(10**9, 5), (10**9, 10), (10**9, 20), (10**9, 40)] * 2)
    got = by_contrast(odds_ratios(cells(spark, rows), ["g"]), 1)
    assert got["AvsP"].converged and got["AvsP"].or_raw == pytest.approx(0.5, rel=1e-6)


def test_a_thousand_levels(spark):
    """At the maximum every level's fitted responders agree with those observed."""
    from lacuna.operators import level_ratios

    rng = np.random.default_rng(12)
    rows = []
    for g in (1, 2):
        for site in range(1000):
            for sex in "FM":
                n = int(rng.integers(4, 40))
                if rng.random() < 0.9:
                    rows.append((g, sex, f"S{site:04}", n, int(rng.integers(1, n))))
    rows += [(1, None, "S0000", 5, 1), (2, "F", "T9999", 7, 7)]
    table = spark.createDataFrame(rows, "g int, SEX string, SITE string, n long, r long")
    found = level_ratios(table, ["SEX", "SITE"], ["g"]).collect()
    for g in (1, 2):
        own = {(r.factor, r.level): r for r in found if r.g == g}
        assert {r.base for r in own.values()} == {"F", "S0000"}
        mine = [r for r in rows if r[0] == g and r[1] and r[2] != "T9999"]
        effect = {k: np.log(r.or_raw) for k, r in own.items() if r.or_raw is not None}
        effect |= {("SEX", "F"): 0.0, ("SITE", "S0000"): 0.0}
        assert len(effect) == 2 + len({r[2] for r in mine})
        # The intercept follows from the total; then all margins have to agree.
        low, high = -30.0, 30.0
        for _ in range(200):
            at = (low + high) / 2
            p = [1 / (1 + np.exp(-at - effect["SEX", s] - effect["SITE", t])) for _, s, t, _, _ in mine]
            short = sum(n * q for (*_, n, _), q in zip(mine, p)) < sum(r[-1] for r in mine)
            low, high = (at, high) if short else (low, at)
        for factor, column in (("SEX", 1), ("SITE", 2)):
            for level in {r[column] for r in mine}:
                gap = sum(n * q - r for (*k, n, r), q in zip(mine, p) if k[column] == level)
                assert abs(gap) < 1e-5, (factor, level)
    assert own["SITE", "T9999"].or_raw is None and not own["SITE", "T9999"].converged
    assert level_ratios(table.limit(0), ["SEX", "SITE"]).count() == 0
