"""Sums over masked rows, which need not repeat the rows over the replicates."""

import datetime
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from lacuna.operators import impute_locf
from lacuna.plans.rows import mar_rows
from lacuna.sources import trial_tables
from lacuna.study import LAGGED, MAR_SCRIPT, RESPONSE, MarRates
from tests.test_mechanisms import people

MODES = {
    "mar_masked_digest": lambda rows: rows,
    "mar_last_observed_digest": lambda rows: impute_locf(rows, mode="last_observed"),
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Orders of 60 customers, at most 9 of each; customer 60 has none."""
    rng, folder = random.Random(4), str(tmp_path_factory.mktemp("tables"))
    customers = [(k, k % 25) for k in range(1, 61)]
    orders = []
    for k, _ in customers[:-1]:
        for _ in range(rng.randint(1, 9)):
            day = datetime.date(1995, 1, 1) + datetime.timedelta(rng.randrange(900))
            orders.append((len(orders) + 1, k, day, round(rng.uniform(900, 400_000), 2)))
    schema = "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double"
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame(orders, schema).write.parquet(f"{folder}/orders.parquet")
    return folder


def by_hand(rows, *more):
    """(scenario, seed) -> rows and sum of the first 32 bits of each row's MD5."""
    out = {}
    for r in rows.collect():
        values = [r.SUBJID, r.AVISITN, r[RESPONSE], *[r[c] for c in more]]
        values += [None if x is None else math.floor(x * 1_000_000) for x in (r.AVAL, r.PCHG)]
        text = "|".join("-" if x is None else str(x) for x in values)
        n, total = out.get((r.scenario, r.seed), (0, 0))
        out[r.scenario, r.seed] = n + 1, total + int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
    return out


@pytest.mark.parametrize("name, more", [("mar_last_observed_digest", []), ("mar_masked_digest", [LAGGED])])
def test_digest_of_all_rows_hashes_a_row_once_per_dropout_visit(spark, tables, name, more):
    seeds = range(1, 31)
    found = registered.row_queries(seeds)[name](spark, tables)
    rows = MODES[name](mar_rows(*trial_tables(spark, tables), seeds, MAR_SCRIPT))
    got = {(r.scenario, r.seed): (r.n, r.digest) for r in found.collect()}
    assert got == by_hand(rows, *more)
    assert len(got) == 30 and len({digest for _, digest in got.values()}) > 20
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan, "rows are hashed once they are repeated over the seeds"


@pytest.mark.parametrize("mode", MODES)
@pytest.mark.parametrize("skip_visit", [True, False])
def test_totals_equal_sums_over_the_repeated_rows(make_trial, mode, skip_visit):
    folk = people()
    folk[99] = ("F", "ACTIVE", {})
    responses, subjects = make_trial(folk, unlisted={3, 7})
    rates = [MarRates(0.3, 0.05, "a"), MarRates(0.9, 0.4, "b"), MarRates(0.0, 0.0, "c"), MarRates(0.5, 0.5, "a")]

    def totals(rows, by):
        weight = F.col("SUBJID") * 10 + F.col("AVISITN")
        return MODES[mode](rows).groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.when(F.col(RESPONSE).isNotNull(), weight)).alias("seen"),
            F.sum(F.col(RESPONSE) * weight).alias("total"),
            F.sum(F.when(F.col("dropout_visit") == 5, weight)).alias("left_at_5"),
        )

    seeds = [5, 2, 11]
    got = mar_rows(responses, subjects, seeds, rates, skip_visit=skip_visit, totals=totals)
    want = totals(mar_rows(responses, subjects, seeds, rates, skip_visit=skip_visit), ["scenario", "seed"])
    rows = [tuple(r) for r in want.collect()]
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rows))
    assert len(rows) == 9 and any(r[-1] is None for r in rows) and any(r[-1] for r in rows)


def test_totals_without_rows(make_trial):
    def totals(rows, by):
        return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))

    responses, subjects = make_trial({9: ("F", "ACTIVE", {6: (1.0, 0)})})
    none = responses.limit(0)
    assert mar_rows(none, subjects, [1, 2], MAR_SCRIPT, totals=totals).count() == 0


def test_totals_check_tied_visits_past_the_analysis(make_trial):
    """As the rows do: a second row of a late visit stops the job."""
    visits = {v: (40.0, 1) for v in (3, 4, 5, 6, 8)}
    responses, subjects = make_trial({i: ("FM"[i % 2], "ACTIVE", visits) for i in range(1, 9)})
    tied = responses.unionByName(responses.filter("SUBJID = 1 and AVISITN = 8"))
    for totals in (None, lambda rows, by: rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))):
        with pytest.raises(Exception, match="several rows of a subject at one visit"):
            mar_rows(tied, subjects, [1], MAR_SCRIPT, totals=totals).collect()
