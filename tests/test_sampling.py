import pytest
from pyspark.sql import functions as F

from lacuna.functions import draw_key
from lacuna.operators.sampling import (
    KEY_MIN,
    KEY_SPAN,
    PoolClass,
    draw_cuts,
    is_drawn,
    key_bands,
    sample_exact,
)


def key():
    return draw_key(F.col("SUBJID"), F.col("seed"), 0)


def pool(spark, size, seeds=(1, 2, 3)):
    ids = spark.range(1, size + 1).withColumnRenamed("id", "SUBJID")
    return ids.select("SUBJID", F.explode(F.array(*[F.lit(int(s)).cast("long") for s in seeds])).alias("seed"))


def brute_force(rows, by, size_of):
    """The k smallest (key, id) of each group, on the driver."""
    groups = {}
    for row in rows.withColumn("k", key()).collect():
        groups.setdefault(tuple(row[c] for c in by), []).append((row.k, row.SUBJID))
    return {
        (*g, i) for g, items in groups.items() for _, i in sorted(items)[: size_of(g, len(items))]
    }


@pytest.mark.parametrize("rate", [0.0, 0.001, 0.1, 0.3, 0.5, 0.999, 1.0])
def test_exact_size_and_members(spark, rate):
    rows = pool(spark, 1831)
    got = sample_exact(rows, ["seed"], key(), rate, 1831)
    found = {(r.seed, r.SUBJID) for r in got.collect()}
    assert found == brute_force(rows, ["seed"], lambda g, n: int(rate * n))


@pytest.mark.parametrize("rate, size", [(0.1, 183), (0.2, 366), (0.3, 549)])
def test_size_is_truncated(spark, rate, size):
    rows = pool(spark, 1831, (5,))
    assert sample_exact(rows, ["seed"], key(), rate, 1831).count() == size


@pytest.mark.parametrize("hint", [1, 10**6, 10**12])
def test_wrong_size_hints_stay_exact(spark, hint):
    """A hint far too large makes the band miss, so the search has to widen."""
    rows = pool(spark, 500)
    found = {
        (r.seed, r.SUBJID)
        for r in sample_exact(rows, ["seed"], key(), 0.3, hint).collect()
    }
    assert found == brute_force(rows, ["seed"], lambda g, n: int(0.3 * n))


def test_groups_of_very_different_size(spark):
    """One group holds nearly all rows, others a handful or too few to draw any."""
    size = F.when(F.col("SUBJID") <= 3, "a").when(F.col("SUBJID") <= 20, "b").otherwise("c")
    rows = pool(spark, 5000).withColumn("part", size)
    by = ["seed", "part"]
    rates = {"a": 0.3, "b": 0.3, "c": 0.05}
    rate = F.when(F.col("part") == "c", 0.05).otherwise(0.3)
    cuts = draw_cuts(rows, by, key(), [rate], [PoolClass((0.3, 0.05), 5000)])
    assert {(r.part, r["pool"], r.taken) for r in cuts.collect()} == {
        ("a", 3, 0),
        ("b", 17, 5),
        ("c", 4980, 249),
    }
    marked = rows.join(cuts, by).filter(
        is_drawn(key(), F.col("SUBJID"), F.col("cut_key"), F.col("cut_id"))
    )
    found = {(r.seed, r.part, r.SUBJID) for r in marked.collect()}
    assert found == brute_force(rows, by, lambda g, n: int(rates[g[1]] * n))


def test_equal_keys_are_split_by_id(spark):
    rows = pool(spark, 100, (1,))
    got = sample_exact(rows, ["seed"], F.lit(12345).cast("long"), 0.25, 100)
    assert sorted(r.SUBJID for r in got.collect()) == list(range(1, 26))


def test_smaller_samples_lie_inside_larger(spark):
    rows = pool(spark, 1000)
    last = set()
    for rate in (0.1, 0.2, 0.3):
        found = {
            (r.seed, r.SUBJID)
            for r in sample_exact(rows, ["seed"], key(), rate, 1000).collect()
        }
        assert last < found
        last = found


def test_partitioning_does_not_matter(spark):
    rows = pool(spark, 700)
    results = [
        {
            (r.seed, r.SUBJID)
            for r in sample_exact(df, ["seed"], key(), 0.3, 700).collect()
        }
        for df in (rows.coalesce(1), rows.repartition(13, "SUBJID"), rows.orderBy(F.desc("SUBJID")))
    ]
    assert results[0] == results[1] == results[2]


def test_draws_are_even(spark):
    """Each subject is drawn in about the rate's share of many replicates."""
    rows = pool(spark, 50, range(1, 401))
    counts = [
        r["count"]
        for r in sample_exact(rows, ["seed"], key(), 0.3, 50).groupBy("SUBJID").count().collect()
    ]
    assert len(counts) == 50 and sum(counts) == 400 * 15
    assert max(abs(c - 120) for c in counts) < 5 * (400 * 0.3 * 0.7) ** 0.5


def test_bands_shrink_with_size_and_merge():
    wide, narrow = (key_bands([0.3], n, 5.0) for n in (10**4, 10**10))
    assert wide[0][1] - wide[0][0] > 100 * (narrow[0][1] - narrow[0][0])
    assert len(key_bands([0.1, 0.2, 0.3], 10**6, 5.0)) == 3
    assert key_bands([0.1, 0.2, 0.3], 1, 5.0) == [(KEY_MIN, KEY_MIN + KEY_SPAN)]


def test_rates_beyond_one_are_an_error(spark):
    with pytest.raises(ValueError, match="between 0 and 1"):
        sample_exact(pool(spark, 10), ["seed"], key(), 1.5, 10)
