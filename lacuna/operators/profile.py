"""One narrow row per subject: all a replicate needs to know about it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import poor_response
from lacuna.functions.columns import level_code
from lacuna.operators.analysis import TIED, parameter_rows, unique_subjects
from lacuna.operators.ordered import with_preceding
from lacuna.study import DEFAULT_STUDY, RESPONSE, Study


def poor_before(visit: int) -> str:
    return f"poor_before_{visit}"


def _fold(rows: DataFrame, study: Study, lag_skips_visit: bool) -> DataFrame:
    """One row per subject of mergeable aggregates over its visits."""
    at, visit, y = study.analysis_visit, F.col("AVISITN"), F.col(RESPONSE)
    here, earlier = visit == at, visit < at
    counted = earlier
    if study.skipped_visit is not None:
        counted = earlier & (visit != study.skipped_visit)
    observed = counted & y.isNotNull()
    zero = F.lit(0).cast("long")

    def number(where: Column) -> Column:
        return F.coalesce(F.count_if(where), zero)

    def total(where: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, value).cast("long")), zero)

    if study.tie is None:
        order, after_first = visit, F.lit(False)
        # A second row of the same visit has no place in the order.
        rows_seen, visits_seen = F.count(F.lit(1)), F.size(F.collect_set(visit))
        alone = F.when(rows_seen > visits_seen, F.raise_error(F.lit(TIED)).cast("boolean"))
        before = carried = F.lit(None).cast("long")
    else:
        order = F.struct(visit, F.col(study.tie))
        response = F.col(RESPONSE).cast("long")
        rows = with_preceding(
            rows,
            ["SUBJID", "AVISITN"],
            [study.tie],
            previous={"_before": response},
            seen={"_carried": response},
            first="_first",
        )
        after_first, before, carried = ~F.col("_first"), F.col("_before"), F.col("_carried")
        alone = F.lit(None).cast("boolean")
    null = here & y.isNull()
    last = counted if lag_skips_visit else earlier
    folds = {
        "n_rows": number(here),
        "y_n": number(here & y.isNotNull()),
        "y_r": total(here, y),
        "alone": alone,
        # Rows of the visit that follow one of the same visit, and those that do not.
        "in_n": number(here & after_first & before.isNotNull()),
        "in_r": total(here & after_first, before),
        "null_in_n": number(null & after_first & before.isNotNull()),
        "null_in_r": total(null & after_first, before),
        "null_first": number(null & ~after_first),
        "null_seen_n": number(null & carried.isNotNull()),
        "null_seen_r": total(null, carried),
        "null_unseen": number(null & carried.isNull()),
        "lag": F.max_by(y, F.when(last, order)),
        "seen": F.max_by(y, F.when(observed, order)),
    }
    for v in study.dropout_visits:
        folds[f"seen_{v}"] = F.max_by(y, F.when(observed & (visit < v), order))
        folds[poor_before(v)] = F.bool_or(poor_response(v - 1, study))
    for f in study.design.factors:
        if f.name in rows.columns:
            level = F.when(here, level_code(f, F.col(f.name)))
            folds[f"at_{f.name}"] = _single(level, f"several {f.name} levels at a visit")
    return rows.groupBy("SUBJID").agg(*[c.alias(name) for name, c in folds.items()])


def _single(level: Column, message: str) -> Column:
    """The level that all rows share."""
    differ = F.min(level) != F.max(level)
    return F.when(differ, F.raise_error(F.lit(message)).cast("int")).otherwise(F.max(level))


def subject_profile(
    responses: DataFrame,
    subjects: DataFrame,
    study: Study = DEFAULT_STUDY,
    lag_skips_visit: bool = True,
) -> DataFrame:
    """Fold the visits of each subject into one row.

    ``n_rows``, ``y_n``, ``y_r``   rows, responses and responders at the analysis visit
    ``lag_n``, ``lag_r``          the same of the rows before each of them
                                  (``lag_skips_visit`` leaves the skipped visit
                                  out, as happens when it is dropped first)
    ``null_lag_n`` ...            of the rows before those without a response
    ``null_seen_n`` ...           of the responses last seen before those
    ``gone_v_n`` ...              last seen before visit v, once for every row
    ``poor_before_v``             poor response at the visit before dropout visit v
    ``cell``                      model cell, null where a factor is unknown
    ``in_universe``               listed in the subject table

    Visits are folded by mergeable aggregates before the shuffle, so a subject
    with very many rows costs one row per task. Several rows of a subject at one
    visit count one by one, in the order of the study's ``tie`` column; without
    one they stop the job, as does a subject listed twice.
    """
    rows = parameter_rows(responses, study, skip_visit=False)
    folded = _fold(rows.filter(F.col("AVISITN") <= study.analysis_visit), study, lag_skips_visit)
    on_subject = [f for f in study.design.factors if f.name not in responses.columns]
    listed = unique_subjects(subjects).select(
        "SUBJID",
        F.lit(True).alias("in_universe"),
        *[level_code(f, F.col(f.name)).alias(f"at_{f.name}") for f in on_subject],
    )
    cell = reduce(
        lambda code, f: code * len(f.levels) + F.col(f"at_{f.name}"),
        study.design.factors,
        F.lit(0),
    )
    zero = F.lit(0).cast("long")
    some = (F.col("n_rows") > 0).cast("long")

    def carried(n: Column, value: str) -> list[Column]:
        """Count and total of a value that each of n rows carries, unless it is null."""
        times = F.when(F.col(value).isNotNull(), n).otherwise(zero)
        return [times, times * F.coalesce(F.col(value).cast("long"), zero)]

    pairs = {"y": [F.col("y_n"), F.col("y_r")]}
    lag, null_lag = carried(some, "lag"), carried(F.col("null_first"), "lag")
    seen = carried(F.col("null_unseen"), "seen")
    pairs["lag"] = [F.col("in_n") + lag[0], F.col("in_r") + lag[1]]
    pairs["null_lag"] = [F.col("null_in_n") + null_lag[0], F.col("null_in_r") + null_lag[1]]
    pairs["null_seen"] = [F.col("null_seen_n") + seen[0], F.col("null_seen_r") + seen[1]]
    for v in study.dropout_visits:
        pairs[f"gone_{v}"] = carried(F.col("n_rows"), f"seen_{v}")
    flags = ["in_universe", *map(poor_before, study.dropout_visits)]
    both = folded.join(listed, "SUBJID", "full")
    # ``alone`` is null; using it keeps the check of tied visits in the plan.
    counts = {"n_rows": F.when(F.col("alone").isNull(), F.col("n_rows"))}
    for name, (n, r) in pairs.items():
        counts |= {f"{name}_n": n, f"{name}_r": r}
    return both.select(
        "SUBJID",
        *[F.coalesce(c, F.lit(False)).alias(c) for c in flags],
        *[F.coalesce(c, zero).alias(name) for name, c in counts.items()],
        cell.cast("int").alias("cell"),
    )
