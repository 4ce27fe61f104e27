import pytest

from lacuna.sources import load_responses, load_subjects, scenario_grid, seed_frame, subject_universe
from lacuna.study import MAR_MENU, RESPONSE_SCHEMA, SUBJECT_SCHEMA
from lacuna.functions import pick


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "r.csv").write_text(
        "STUDY,SUBJID,TRTP,TRTPN,PARAMN,AVISIT,AVISITN,AVAL,PCHG,PCHGCA1N\n"
        'x,1,"PLACEBO",2,10,Week 4,4,3.5,-12.25,0\n'
        "x,2,TEST 140MG,3,10,Week 4,4,NA,NA,NA\n"
        "x,3,ACTIVE,1,10,,6,,55,1\n"
    )
    (tmp_path / "s.csv").write_text("SEX,AGE,SUBJID\nF,40,1\nM,NA,2\nNA,33,3\n")
    return tmp_path


def test_csv_by_header_name(spark, folder):
    rows = load_responses(spark, str(folder / "r.csv"))
    assert [(f.name, f.dataType) for f in rows.schema] == [
        (f.name, f.dataType) for f in RESPONSE_SCHEMA
    ]
    got = {r.SUBJID: tuple(r)[1:] for r in rows.collect()}
    assert got[1] == (10, 4, "Week 4", 3.5, -12.25, 0, "PLACEBO", 2)
    assert got[2] == (10, 4, "Week 4", None, None, None, "TEST 140MG", 3)
    assert got[3] == (10, 6, None, None, 55.0, 1, "ACTIVE", 1)


def test_extra_columns_are_optional(spark, folder):
    kept = load_responses(spark, str(folder / "r.csv"), keep_extra=True)
    assert kept.columns == [*RESPONSE_SCHEMA.fieldNames(), "STUDY"]


def test_subjects(spark, folder):
    rows = load_subjects(spark, str(folder / "s.csv"))
    assert rows.columns == SUBJECT_SCHEMA.fieldNames()
    assert sorted(map(tuple, rows.collect())) == [(1, "F"), (2, "M"), (3, None)]


def test_text_in_a_number_column_is_an_error(spark, tmp_path):
    (tmp_path / "s.csv").write_text("SUBJID,SEX\nabc,F\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        load_subjects(spark, str(tmp_path / "s.csv")).collect()


def test_parquet(spark, folder, tmp_path):
    rows = load_responses(spark, str(folder / "r.csv"))
    rows.write.parquet(str(tmp_path / "p"))
    again = load_responses(spark, str(tmp_path / "p"), fmt="parquet")
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))


def test_filters_reach_the_scan(spark, folder, tmp_path):
    from lacuna.operators import analysis_set

    load_responses(spark, str(folder / "r.csv")).write.parquet(str(tmp_path / "p"))
    rows = load_responses(spark, str(tmp_path / "p"), fmt="parquet")
    subjects = load_subjects(spark, str(folder / "s.csv"))
    plan = (
        analysis_set(rows, subjects)
        .select("SUBJID", "SEX", "PCHGCA1N")
        ._jdf.queryExecution()
        .executedPlan()
        .toString()
    )
    assert "EqualTo(PARAMN,10)" in plan and "EqualTo(AVISITN,6)" in plan
    assert "AVAL" not in plan


def test_parameter_frames(spark):
    assert [r.seed for r in seed_frame(spark, range(1, 4)).orderBy("seed").collect()] == [1, 2, 3]
    assert [r.seed for r in seed_frame(spark, [9, 4]).orderBy("seed").collect()] == [4, 9]
    assert subject_universe(spark=spark, size=1831).count() == 1831
    grid = scenario_grid(spark, mar=MAR_MENU)
    assert grid.count() == 12
    assert {r.p_low for r in grid.collect()} == {None, 0.1, 0.075, 0.05}


def test_pick(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert pick(df, [3, 1]).columns == ["c", "a"]
