"""Trial-shaped tables derived from the order and customer test tables.

A customer is a subject; the customer's orders are visits 1, 2, ... by date and
key, and visit 1 is the baseline. Parameter 10 follows the order price, parameter 20 the
order key. Every 37th order key after baseline is a missing value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.study import DEFAULT_DESIGN

RESPONSE_CUT = 25


def fixture_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = DEFAULT_DESIGN.factors[1].levels
    arm = F.col("c_nationkey") % len(arms)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("SUBJID"),
        F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("SEX"),
        (arm + 1).cast("int").alias("TRTPN"),
        F.element_at(F.array(*map(F.lit, arms)), (arm + 1).cast("int")).alias("TRTP"),
    )


def fixture_responses(
    spark: SparkSession, sf_dir: str, subjects: DataFrame, by_month: bool = False
) -> DataFrame:
    """``by_month``: all orders of a month are one visit, ordered by ``LINE``."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_custkey").alias("SUBJID"), "o_orderkey", "o_orderdate", "o_totalprice"
    )
    # Visits are numbered within a day, after all orders of the days before, so
    # that no task gets all orders of a customer.
    if by_month:
        orders = orders.withColumn("o_orderdate", F.trunc("o_orderdate", "month"))
    day, by_day = ["SUBJID", "o_orderdate"], Window.partitionBy("SUBJID").orderBy("o_orderdate")
    days = orders.groupBy(*day).agg(
        F.count("*").alias("n"),
        F.min("o_orderkey").alias("first_key"),
        F.min_by("o_totalprice", "o_orderkey").alias("first_price"),
    )
    earlier = by_day.rowsBetween(Window.unboundedPreceding, -1)
    so_far = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    days = days.select(
        *day,
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.row_number().over(by_day).alias("day"),
        F.first("first_key").over(so_far).alias("base_key"),
        F.first("first_price").over(so_far).alias("base_price"),
    )
    place = F.row_number().over(Window.partitionBy(*day).orderBy("o_orderkey"))
    visit = F.col("day") if by_month else F.col("before") + F.col("place")
    numbered = orders.withColumn("place", place).join(days, day)
    numbered = numbered.withColumn("visit", visit.cast("int"))

    def parameter(number, value, base):
        return F.struct(
            F.lit(number).alias("PARAMN"), value.alias("value"), base.alias("base")
        )

    def share(key):
        return (F.col(key) % 100 + 1).cast("double")

    both = F.array(
        parameter(10, F.col("o_totalprice"), F.col("base_price")),
        parameter(20, share("o_orderkey"), share("base_key")),
    )
    rows = numbered.select("SUBJID", "o_orderkey", "visit", F.inline(both))
    aval = F.when(
        ~((F.col("visit") > 1) & (F.col("o_orderkey") % 37 == 0)), F.col("value")
    )
    rows = rows.select(
        "SUBJID",
        "PARAMN",
        F.col("visit").alias("AVISITN"),
        F.concat(F.lit("Visit "), F.col("visit").cast("string")).alias("AVISIT"),
        aval.alias("AVAL"),
        (100 * (F.col("base") - aval) / F.col("base")).alias("PCHG"),
        *([F.col("o_orderkey").alias("LINE")] if by_month else []),
    ).withColumn(
        "PCHGCA1N",
        F.when(F.col("PCHG").isNotNull(), (F.col("PCHG") >= RESPONSE_CUT).cast("int")),
    )
    return rows.join(subjects.select("SUBJID", "TRTP", "TRTPN"), "SUBJID")


def trial_tables(
    spark: SparkSession, sf_dir: str, by_month: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(responses, subjects) shaped like the trial's two input tables."""
    subjects = fixture_subjects(spark, sf_dir)
    return fixture_responses(spark, sf_dir, subjects, by_month), subjects


def nation_arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same tables with the customer's nation as the arm."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    arms = customers.join(nations, customers["c_nationkey"] == nations["n_nationkey"]).select(
        F.col("c_custkey").alias("SUBJID"), F.col("n_name").alias("TRTP")
    )
    responses, subjects = trial_tables(spark, sf_dir)
    return responses.drop("TRTP").join(arms, "SUBJID"), subjects.drop("TRTP", "TRTPN")
