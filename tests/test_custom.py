from collections import Counter

import pytest
from pyspark.sql import functions as F

from lacuna.functions import draw_key
from lacuna.plans import Flagged, Sampled, own_cells, run_own

PEOPLE = [(i, "FM"[i % 2], ["ACTIVE", "PLACEBO", "TEST 140MG", "TEST 210MG"][i % 4], [1, 0, None][i % 3], i % 5) for i in range(400)]
PEOPLE += [(1000 + i, "F", "ACTIVE", i % 2, None) for i in range(9)] + [(2000, None, "ACTIVE", 1, 1)]
STRATEGIES = {
    "left out": lambda missing: F.when(~missing, F.col("PCHGCA1N")),
    "by stratum": lambda missing: F.when(missing, (F.col("site") > 2).cast("int")).otherwise(F.col("PCHGCA1N")),
}


@pytest.fixture(scope="module")
def subjects(spark):
    return spark.createDataFrame(PEOPLE, "SUBJID long, SEX string, TRTP string, PCHGCA1N int, site int").repartition(3)


def brute(spark, missing, seeds):
    """missing: (person, key of the seed) lists -> set of missing subjects."""
    counts = Counter()
    keyed = spark.createDataFrame([(p[0], s) for p in PEOPLE for s in seeds], "SUBJID long, seed long")
    keys = {(r[0], r[1]): r[2] for r in keyed.select("SUBJID", "seed", draw_key(F.col("SUBJID"), F.col("seed"), 3)).collect()}
    for seed in seeds:
        gone = missing([(p, keys[p[0], seed]) for p in PEOPLE if p[1]])
        for i, sex, arm, y, site in PEOPLE:
            values = {"left out": None if i in gone else y, "by stratum": y}
            if i in gone:
                values["by stratum"] = None if site is None else int(site > 2)
            for name, value in values.items():
                if value is not None and sex:
                    counts[seed, name, sex, arm, "n"] += 1
                    counts[seed, name, sex, arm, "r"] += value
    return {k[:-1]: (n, counts[(*k[:-1], "r")]) for k, n in counts.items() if k[-1] == "n"}


def cells(df):
    return {(r.seed, r.strategy, r.SEX, r.TRTP): (r.n, r.r) for r in df.collect()}


@pytest.mark.parametrize("rates", [{0: 0.5, 3: 0.25, 4: 1.0}, 0.3, {9: 0.5}])
def test_exact_samples_by_brute_force(spark, subjects, rates):
    """Strata that are not listed, and subjects without one, lose nobody."""
    stratum = "site" if isinstance(rates, dict) else None

    def missing(people):
        gone = set()
        for value, rate in rates.items() if stratum else [(None, rates)]:
            pool = sorted((k, p[0]) for p, k in people if not stratum or p[4] == value)
            gone |= {i for _, i in pool[: int(rate * len(pool))]}
        return gone

    found = own_cells(subjects, Sampled(rates, stratum, draw=3), STRATEGIES, range(1, 4))
    assert cells(found) == brute(spark, missing, range(1, 4))


def test_flags_by_brute_force(spark, subjects):
    """A null flag is not missing."""
    flag = Flagged(lambda draw: (draw(3) < 0.4) & (F.col("site") != 1))

    def missing(people):
        return {p[0] for p, k in people if k / 2**64 + 0.5 < 0.4 and p[4] not in (1, None)}

    found = own_cells(subjects, flag, STRATEGIES, [5, 9])
    assert cells(found) == brute(spark, missing, [5, 9])
    ratios = run_own(subjects, flag, STRATEGIES, [5, 9], "mine").collect()
    assert {(r.scenario, r.seed, r.strategy) for r in ratios} == {("mine", s, n) for s in (5, 9) for n in STRATEGIES}
    assert len(ratios) == 16


def test_no_subjects(subjects):
    assert own_cells(subjects.limit(0), Sampled(0.5), STRATEGIES, [1]).count() == 0
