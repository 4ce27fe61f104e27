"""Replicates of the caller's own making, given as columns.

A replicate is a mechanism, which says who is missing, and strategies, which say
what a missing and an observed subject counts as. All of it runs in the pass over
subjects x seeds that counts the model cells: an exact-size sample is found in the
same pass, because every strategy is totalled for both answers and the right one
is taken for each place on the key range once the cuts are known.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import cell_code, draw_key, settle_counting
from lacuna.functions.columns import cell_label
from lacuna.operators.logit import contrast_rows, fit_coded
from lacuna.operators.mechanisms import expand, spread
from lacuna.operators.sampling import KEY_SPAN, Fold, PoolClass, draw_folded, is_drawn
from lacuna.study import DEFAULT_DESIGN, REPLICATES, Design

KEYS = ("scenario", "seed", "strategy")
#: From the flag "missing" to the response that counts; null leaves the subject out.
Strategy = Callable[[Column], Column]


@dataclass(frozen=True)
class Sampled:
    """Missing: an exact-size sample of each stratum, the rate's share truncated.

    ``rates`` maps values of the column ``stratum`` to rates; other strata, and
    subjects without one, lose nobody. A number is the rate of all subjects
    together.
    """

    rates: Mapping[object, float] | float
    stratum: str | None = None
    draw: int = 0

    @property
    def listed(self) -> list[tuple[object, float]]:
        return list(self.rates.items()) if isinstance(self.rates, Mapping) else [(None, self.rates)]

    def number(self) -> Column:
        """Which listed stratum a row is in; one more than the last for none."""
        if self.stratum is None:
            return F.lit(0)
        out = F.when(F.lit(False), 0)
        for i, (value, _) in enumerate(self.listed):
            out = out.when(F.col(self.stratum) == F.lit(value), i)
        return out.otherwise(len(self.listed))


@dataclass(frozen=True)
class Flagged:
    """Missing where ``flag`` holds, for each subject on its own; null: not missing.

    ``flag`` is given a function from a draw's number to a reproducible number of the
    subject and seed, uniform in [0, 1), and may use any column and ``seed``.
    """

    flag: Callable[[Callable[[int], Column]], Column]


def uniform(draw: int) -> Column:
    key = draw_key(F.col("SUBJID"), F.col("seed"), draw)
    return key.cast("double") / F.lit(float(KEY_SPAN)) + 0.5


def _counted(value: Column, name: str) -> list[Column]:
    return [
        F.count(value).alias(f"{name}_n"),
        F.coalesce(F.sum(value.cast("long")), F.lit(0).cast("long")).alias(f"{name}_r"),
    ]


def _coded(subjects, seeds, mechanism, strategies, scenario, design) -> DataFrame:
    rows = subjects.withColumn("_cell", cell_code(design)).filter(F.col("_cell").isNotNull())
    counts = {"n": F.count(F.lit(1))}
    if isinstance(mechanism, Sampled):
        rows = rows.withColumn("_stratum", mechanism.number())
        for i in range(len(mechanism.listed)):
            counts[f"n_{i}"] = F.count_if(F.col("_stratum") == i)
    rows, sizes = settle_counting(rows, **counts)
    rows = expand(spread(rows, sizes["n"], len(seeds)), seeds).withColumn("seed", F.col("replicate"))
    named = list(enumerate(strategies.items()))
    if isinstance(mechanism, Flagged):
        rows = rows.withColumn("_missing", F.coalesce(mechanism.flag(uniform), F.lit(False)))
        totals = [c for i, (_, s) in named for c in _counted(s(F.col("_missing")), f"_{i}")]
        folded = rows.groupBy("replicate", "_cell").agg(*totals)
        answer = {(i, part): F.col(f"_{i}_{part}") for i, _ in named for part in "nr"}
    else:
        totals = []
        for i, (_, strategy) in named:
            totals += _counted(strategy(F.lit(True)), f"_{i}_gone")
            totals += _counted(strategy(F.lit(False)), f"_{i}_here")
        at, rate, classes = F.col("_stratum"), F.lit(0.0), []
        for i, (_, p) in enumerate(mechanism.listed):
            rate = F.when(at == i, float(p)).otherwise(rate)
            classes.append(PoolClass((float(p),), sizes[f"n_{i}"], at == i))
        classes.append(PoolClass((0.0,), sizes["n"]))
        key = draw_key(F.col("SUBJID"), F.col("replicate"), mechanism.draw)
        by = ["replicate", "_stratum"]
        cuts, folded = draw_folded(rows, by, key, [rate], classes, Fold(("_cell",), tuple(totals)))
        folded = folded.join(cuts.select(*by, "cut_key", "cut_id"), by)
        gone = is_drawn(F.col("at_key"), F.col("at_id"), F.col("cut_key"), F.col("cut_id"))
        answer = {
            (i, part): F.when(gone, F.col(f"_{i}_gone_{part}")).otherwise(F.col(f"_{i}_here_{part}"))
            for i, _ in named
            for part in "nr"
        }
    parts = [
        F.struct(F.lit(name).alias("strategy"), answer[i, "n"].alias("n"), answer[i, "r"].alias("r"))
        for i, (name, _) in named
    ]
    long = folded.select(
        F.lit(scenario).alias("scenario"),
        F.col("replicate").alias("seed"),
        F.col("_cell").alias("cell"),
        F.inline(F.array(*parts)),
    )
    return long.filter("n > 0").groupBy(*KEYS, "cell").agg(F.sum("n").alias("n"), F.sum("r").alias("r"))


def own_cells(
    subjects: DataFrame,
    mechanism: Sampled | Flagged,
    strategies: Mapping[str, Strategy],
    seeds: Sequence[int] = REPLICATES,
    scenario: str = "own",
    design: Design = DEFAULT_DESIGN,
) -> DataFrame:
    """Model cells of every seed and strategy of the caller's own replicate.

    ``subjects`` has one row per subject with SUBJID, the design's factors and
    whatever columns mechanism and strategies use; rows without a factor's level
    take no part. Responses are 0 or 1.
    """
    coded = _coded(subjects, seeds, mechanism, strategies, scenario, design)
    return coded.select(*KEYS, *cell_label(design, F.col("cell")), "n", "r")


def run_own(
    subjects: DataFrame,
    mechanism: Sampled | Flagged,
    strategies: Mapping[str, Strategy],
    seeds: Sequence[int] = REPLICATES,
    scenario: str = "own",
    design: Design = DEFAULT_DESIGN,
) -> DataFrame:
    """Odds ratios as ``run_mcar`` gives them, ready for ``mc_summary``; see ``own_cells``."""
    coded = _coded(subjects, seeds, mechanism, strategies, scenario, design)
    return contrast_rows(fit_coded(coded, KEYS, design), KEYS, design)
