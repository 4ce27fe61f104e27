import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lacuna.functions import attach_small, kept_tables, settle, staging, tasks_for
from lacuna.functions.staging import ROWS_PER_TASK


def test_settled_tables_live_in_the_shared_folder(spark):
    with kept_tables(spark) as paths:
        df = settle(spark.range(5))
        assert paths[0].startswith(spark.conf.get("spark.checkpoint.dir"))
        assert sorted(r.id for r in df.collect()) == [0, 1, 2, 3, 4]


def test_a_run_deletes_only_its_own_tables(spark):
    with kept_tables(spark) as outer:
        before = settle(spark.range(5))
        with kept_tables(spark) as inner:
            settle(spark.range(6))
            assert os.path.isdir(inner[0])
        assert not os.path.exists(inner[0])
        assert before.count() == 5
        settle(spark.range(7))
        assert len(outer) == 2
    assert not any(map(os.path.exists, outer))


@pytest.mark.parametrize("master, allowed", [("local[4]", True), ("spark://host:7077", False)])
def test_folder_without_a_named_one(spark, master, allowed):
    """Local mode falls back to the warehouse; a cluster does not take a local disk."""
    sc = spark.sparkContext
    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, *rest: rest[0] if rest else "file:/tmp/house"),
        sparkContext=SimpleNamespace(
            master=master, getCheckpointDir=lambda: None, _jvm=sc._jvm, _jsc=sc._jsc
        ),
    )
    if allowed:
        assert staging.shared_folder(session) == "file:/tmp/house/lacuna-kept"
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            staging.shared_folder(session)


def test_task_count_follows_the_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    assert tasks_for(spark, 10) == cores
    assert tasks_for(spark, ROWS_PER_TASK * (cores + 3)) == cores + 3
    assert tasks_for(spark, 10**15) == 10**15 // ROWS_PER_TASK


@pytest.mark.parametrize("most, expected", [(3, True), (2, False)])
def test_only_tables_of_a_checked_size_are_broadcast(spark, monkeypatch, most, expected):
    monkeypatch.setattr(staging, "BROADCAST_ROWS", most)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = spark.range(3).withColumn("v", F.col("id") * 10)
        joined = attach_small(spark.range(100), small, "id")
        assert joined.filter("v IS NOT NULL").count() == 3
        plan = joined._jdf.queryExecution()
        assert ("BroadcastHashJoin" in plan.executedPlan().toString()) is expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_simulation_scan_shuffles_only_counts(spark, trial, monkeypatch):
    """Between expanding the replicates and counting them there is no exchange."""
    from lacuna.operators import dropout
    from lacuna.plans import mar_cells

    plans = []

    def settle_counting(df, **counts):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staging.settle_counting(df, **counts)

    monkeypatch.setattr(dropout, "settle_counting", settle_counting)
    monkeypatch.setattr(dropout, "settle", lambda df: settle_counting(df)[0])
    mar_cells(*trial, seeds=range(1, 6))
    expanded = [plan for plan in plans if "REPARTITION_BY_NUM" in plan]
    # One scan of subjects x replicates for all dropout visits and the counts.
    assert len(expanded) == 1
    for plan in expanded:
        lines = plan.splitlines()
        scan = max(i for i, line in enumerate(lines) if "Generate explode" in line)
        # The deepest exchange above the scan takes partial counts.
        partial = max(i for i, line in enumerate(lines[:scan]) if "partial_count" in line)
        assert not any(" Exchange" in line for line in lines[partial:scan])
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_expanded_scan_has_the_wanted_tasks(spark, trial, monkeypatch):
    """The narrow table is dealt out again where it is expanded."""
    from lacuna.operators import mechanisms
    from lacuna.plans import mcar_cells

    wanted = []
    real = mechanisms.tasks_for

    def counted(session, rows):
        wanted.append(max(real(session, rows), 23))
        return wanted[-1]

    monkeypatch.setattr(mechanisms, "tasks_for", counted)
    seen = []
    settle_rows = mechanisms.draw_folded

    def folded(rows, *args):
        seen.append(rows.rdd.getNumPartitions())
        return settle_rows(rows, *args)

    monkeypatch.setattr(mechanisms, "draw_folded", folded)
    mcar_cells(*trial, seeds=range(1, 4))
    assert seen == [wanted[0]] == [23]
