"""Row-level preparation of the response table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators.ordered import with_preceding
from lacuna.study import DEFAULT_STUDY, LAGGED, RESPONSE, Study

#: Parts of the second factor's levels, each of which meets all levels of the first.
LEVEL_PARTS = 32
TIED = "several rows of a subject at one visit: name a column that orders them"
LISTED_TWICE = "a subject is listed twice"


def parameter_rows(
    responses: DataFrame, study: Study = DEFAULT_STUDY, skip_visit: bool = True
) -> DataFrame:
    """Rows of the analysed parameter, without the skipped visit."""
    rows = responses.filter(F.col("PARAMN") == study.parameter)
    if skip_visit and study.skipped_visit is not None:
        rows = rows.filter(F.col("AVISITN") != study.skipped_visit)
    return rows


def unique_subjects(subjects: DataFrame) -> DataFrame:
    """The subject table; a subject listed twice stops the job."""
    rest = [c for c in subjects.columns if c != "SUBJID"]
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(LISTED_TWICE)).cast("boolean"))
    grouped = subjects.groupBy("SUBJID").agg(
        *[F.first(c).alias(c) for c in rest], once.alias("_once")
    )
    # ``_once`` is null; using it keeps the check in the plan.
    return grouped.filter(F.col("_once").isNull()).select(*subjects.columns)


def with_sex(rows: DataFrame, subjects: DataFrame) -> DataFrame:
    return rows.join(unique_subjects(subjects.select("SUBJID", "SEX")), "SUBJID", "left")


def analysis_set(
    responses: DataFrame,
    subjects: DataFrame,
    study: Study = DEFAULT_STUDY,
    visit: int | None = None,
) -> DataFrame:
    """Rows of the analysis visit with the subject's sex."""
    at = study.analysis_visit if visit is None else visit
    rows = parameter_rows(responses, study).filter(F.col("AVISITN") == at)
    return with_sex(rows, subjects)


def _with_history(
    rows: DataFrame, study: Study, previous: dict[str, Column], seen: dict[str, Column]
) -> DataFrame:
    """Add values of the preceding row, and values last seen (not null) before the row."""
    order = ["AVISITN", *([study.tie] if study.tie else [])]
    before = dict(previous)
    if study.tie is None:
        before["_visit_before"] = F.col("AVISITN")
    out = with_preceding(rows, ["SUBJID"], order, before, seen)
    if study.tie is None:
        tied = F.col("_visit_before") == F.col("AVISITN")
        stop = F.when(tied, F.raise_error(F.lit(TIED)).cast("int"))
        # ``stop`` is null; using it keeps the check in the plan.
        checked = {c: F.coalesce(stop, F.col(c)) for c in (*previous, *seen)}
        out = out.withColumns(checked).drop("_visit_before")
    return out


def response_lag(rows: DataFrame, study: Study = DEFAULT_STUDY) -> DataFrame:
    """Add the response of the subject's preceding row, in visit order.

    Rows of one visit follow the study's ``tie`` column; without one they stop the
    job.
    """
    return _with_history(rows, study, {LAGGED: F.col(RESPONSE)}, {})


def last_observed(rows: DataFrame, study: Study = DEFAULT_STUDY) -> DataFrame:
    """Add, per dropout visit, the last response seen before it and before this row.

    ``SEEN`` serves subjects who stay, ``SEEN_v`` those who leave at visit v. The
    columns do not depend on the replicate, so no window runs over replicates.
    """
    return _with_history(rows, study, {}, _seen(study))


def response_history(rows: DataFrame, study: Study = DEFAULT_STUDY) -> DataFrame:
    """``response_lag`` and ``last_observed`` at once."""
    return _with_history(rows, study, {LAGGED: F.col(RESPONSE)}, _seen(study))


def _seen(study: Study) -> dict[str, Column]:
    usable = F.col(RESPONSE)
    if study.skipped_visit is not None:
        usable = F.when(F.col("AVISITN") != study.skipped_visit, usable)
    by_visit = {
        f"SEEN_{v}": F.when(F.col("AVISITN") < v, usable) for v in study.dropout_visits
    }
    return {"SEEN": usable, **by_visit}


def three_way_table(
    rows: DataFrame, by: tuple[str, str] = ("TRTPN", "SEX"), response: str = RESPONSE
) -> DataFrame:
    """Counts of responders and non-responders per level pair, empty cells included.

    Levels are those that occur; rows with a null in any of the three drop out.
    """
    first, second = by
    counts = (
        rows.filter(
            F.col(first).isNotNull()
            & F.col(second).isNotNull()
            & F.col(response).isNotNull()
        )
        .groupBy(first, second)
        .agg(
            F.count(F.when(F.col(response) == 0, 1)).alias("n_0"),
            F.count(F.when(F.col(response) == 1, 1)).alias("n_1"),
        )
    )
    # Using the counts, all three readers of the aggregate share its exchange.
    seen = counts.filter(F.col("n_0") + F.col("n_1") >= 0)
    part = F.pmod(F.xxhash64(second), F.lit(LEVEL_PARTS)).alias("_part")
    seconds = seen.select(second).distinct().select(second, part)
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LEVEL_PARTS - 1).cast("long")))
    firsts = seen.select(first).distinct().select(first, parts.alias("_part"))
    grid = firsts.join(seconds, "_part").select(first, second)
    return grid.join(counts, [first, second], "left").na.fill(0, ["n_0", "n_1"])
