import pytest
from pyspark.sql import SparkSession

from lacuna.study import RESPONSE_SCHEMA, SUBJECT_SCHEMA

MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def trial(spark):
    """The fixture trial at the middle scale, computed once."""
    from lacuna.functions import settle
    from lacuna.sources import trial_tables

    responses, subjects = trial_tables(spark, MEDIUM)
    return settle(responses), settle(subjects)


@pytest.fixture(scope="session")
def make_trial(spark):
    """Small tables: {subject: (sex, arm, {visit: (change, response)})}."""
    arms = {"ACTIVE": 1, "PLACEBO": 2, "TEST 140MG": 3, "TEST 210MG": 4}

    def build(people, unlisted=()):
        responses = [
            (subject, 10, visit, f"Visit {visit}", change, change, y, arm, arms.get(arm))
            for subject, (_, arm, visits) in people.items()
            for visit, (change, y) in visits.items()
        ]
        subjects = [(k, v[0]) for k, v in people.items() if k not in unlisted]
        return (
            spark.createDataFrame(responses, RESPONSE_SCHEMA),
            spark.createDataFrame(subjects, SUBJECT_SCHEMA),
        )

    return build
