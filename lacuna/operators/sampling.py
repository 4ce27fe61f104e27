"""Exact-size random samples per group, without sorting the groups.

Every row has a uniformly distributed 64-bit key, and a sample of size k is the
k smallest keys of its group. The k-th key lies close to the sampling rate's
quantile of the key range, so one aggregation suffices to find it: keys far from
that quantile are only counted, the few near it are kept exactly. What remains
per group grows with the square root of its size, and the cut found there turns
membership into a comparison on each row: no row is shuffled to be drawn.

The k-th key can miss the narrow band, above all in small groups. Groups where
it does are searched again with a wider band until it is found, so the size is
always exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import attach_small, sample_size, settle, settle_counting

KEY_MIN = -(2**63)
KEY_SPAN = 2**64
FIRST_WIDTH = 5.0
WIDEN = 8.0


@dataclass(frozen=True)
class PoolClass:
    """Groups sampled alike: which rows they are, their rates and expected size."""

    rates: tuple[float, ...]
    size_hint: int
    where: Column | None = None


def key_bands(rates, size_hint: int, width: float) -> list[tuple[int, int]]:
    """Key intervals [low, high) around the quantiles, merged where they meet."""
    if not all(0 <= p <= 1 for p in rates):
        raise ValueError(f"rates must lie between 0 and 1: {sorted(set(rates))}")
    n = max(size_hint, 1)
    bands = []
    for p in sorted(set(rates)):
        half = width * math.sqrt(p * (1 - p) / n) + width / n
        low = KEY_MIN + int(max(p - half, 0.0) * KEY_SPAN)
        high = KEY_MIN + int(min(p + half, 1.0) * KEY_SPAN)
        bands.append((low, high))
    return merged_bands(bands)


def merged_bands(bands: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intervals in order, merged where they meet."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(bands):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def slot(key: Column, bands: list[tuple[int, int]]) -> tuple[Column, Column]:
    """(position, exact): the key itself inside a band, else where its gap starts."""
    position, exact = F.when(F.lit(False), F.lit(KEY_MIN)), F.when(F.lit(False), F.lit(False))
    gap = KEY_MIN
    for low, high in bands:
        if low > gap:
            position = position.when(key < low, F.lit(gap))
            exact = exact.when(key < low, F.lit(False))
        if high >= KEY_MIN + KEY_SPAN:
            return position.otherwise(key), exact.otherwise(F.lit(True))
        position = position.when(key < high, key)
        exact = exact.when(key < high, F.lit(True))
        gap = high
    return position.otherwise(F.lit(gap)), exact.otherwise(F.lit(False))


@dataclass(frozen=True)
class Fold:
    """What to total, and by which columns, while looking for the cuts."""

    by: tuple[str, ...] = ()
    totals: tuple[Column, ...] = ()
    #: The names of the totals, for those who total them again.
    names: tuple[str, ...] = ()


NOTHING = Fold()


def _slots(key: Column, classes: Sequence[PoolClass], width: float) -> tuple[Column, Column]:
    parts = [(c.where, *slot(key, key_bands(c.rates, c.size_hint, width))) for c in classes]
    _, position, exact = parts[-1]
    for where, p, e in reversed(parts[:-1]):
        position = F.when(where, p).otherwise(position)
        exact = F.when(where, e).otherwise(exact)
    return position, exact


def _count(rows, by, key, id_col, classes, width, fold: Fold) -> DataFrame:
    """Rows per group and place on the key range: exact near the cut, else gaps."""
    position, exact = _slots(F.col("_key"), classes, width)
    return (
        rows.withColumn("_key", key)
        .withColumns({"cut_key": position, "cut_id": F.when(exact, F.col(id_col))})
        .groupBy(*by, "cut_key", "cut_id", *fold.by)
        .agg(F.count(F.lit(1)).alias("_n"), *fold.totals)
    )


def _locate(counted, by, rates) -> DataFrame:
    """The place at which each group's sample ends, from the counts per place."""
    group = Window.partitionBy(*by)
    so_far = group.orderBy("cut_key", F.col("cut_id").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = counted.withColumns(
        {"_upto": F.sum("_n").over(so_far), "pool": F.sum("_n").over(group)}
    )
    first = F.col("_upto") == F.col("_n")
    hits = []
    for rate in rates:
        taken = F.least(sample_size(rate, F.col("pool")), F.col("pool"))
        inside = (F.col("_upto") >= taken) & (F.col("_upto") - F.col("_n") < taken)
        hits.append(
            F.when(
                F.when(taken <= 0, first).otherwise(inside),
                F.struct(rate.alias("rate"), taken.alias("taken")),
            )
        )
    hit = F.coalesce(*hits).isNotNull()
    wanted = ranked.filter(hit).select("*", F.explode(F.array_compact(F.array(*hits))).alias("_hit"))
    empty = F.col("_hit.taken") <= 0
    return wanted.select(
        *by,
        "_hit.rate",
        "pool",
        "_hit.taken",
        (empty | F.col("cut_id").isNotNull()).alias("_found"),
        F.when(~empty, F.col("cut_key")).alias("cut_key"),
        F.when(~empty, F.col("cut_id")).alias("cut_id"),
    )


def draw_cuts(
    rows: DataFrame,
    by: list[str],
    key: Column,
    rates: Sequence[Column],
    classes: Sequence[PoolClass],
    id_col: str = "SUBJID",
) -> DataFrame:
    """The last key drawn from each group, at each of its rates.

    ``rates`` are a group's sampling rates, as expressions over the ``by`` columns.
    ``classes`` tell where to look first; wrong size hints cost time, not
    exactness.
    Returns ``by``, ``rate``, ``pool``, ``taken``, ``cut_key``, ``cut_id``; both cut
    columns are null where nothing is drawn.
    """
    return _draw(rows, by, key, rates, classes, id_col, NOTHING)[0]


def draw_folded(
    rows: DataFrame,
    by: list[str],
    key: Column,
    rates: Sequence[Column],
    classes: Sequence[PoolClass],
    fold: Fold,
    id_col: str = "SUBJID",
) -> tuple[DataFrame, DataFrame]:
    """Cuts as from ``draw_cuts``, and the rows folded in the same pass.

    The second frame has ``by``, ``fold.by``, ``at_key``, ``at_id`` and the totals. Its
    places lie wholly on one side of every cut, so ``is_drawn`` of a place holds
    for all rows folded into it.
    """
    cuts, folded = _draw(rows, by, key, rates, classes, id_col, fold)
    return cuts, folded.withColumnsRenamed({"cut_key": "at_key", "cut_id": "at_id"})


def _draw(rows, by, key, rates, classes, id_col, fold):
    todo, width, found, folded = rows, FIRST_WIDTH, None, None
    while True:
        places = counted = _count(todo, by, key, id_col, classes, width, fold)
        if fold is not NOTHING:
            counted = settle(counted)
            places = counted.groupBy(*by, "cut_key", "cut_id").agg(F.sum("_n").alias("_n"))
        cuts, seen = settle_counting(
            _locate(places, by, rates), missed=F.count_if(~F.col("_found"))
        )
        if not seen["missed"]:
            return _also(found, cuts).drop("_found"), _also(folded, counted).drop("_n")
        again = settle(cuts.filter(~F.col("_found")).select(*by).distinct())
        found = _also(found, without_groups(cuts, again, by))
        if fold is not NOTHING:
            folded = _also(folded, without_groups(counted, again, by))
        todo = only_groups(rows, again, by)
        width *= WIDEN


def _also(before: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if before is None else before.unionByName(more)


def without_groups(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    same = [F.col(f"here.{c}").eqNullSafe(F.col(f"there.{c}")) for c in by]
    return rows.alias("here").join(groups.alias("there"), reduce(and_, same), "left_anti")


def only_groups(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """The rows of the given groups; a group's key can be null."""
    small = groups.select(*[F.col(c).alias(f"_{c}") for c in by], F.lit(True).alias("_again"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return attach_small(rows, small, same).filter("_again").select(*rows.columns)


def is_drawn(key: Column, id_: Column, cut_key: Column, cut_id: Column) -> Column:
    """Whether a row is at or below its group's cut; false where there is none."""
    return F.coalesce(
        (key < cut_key) | ((key == cut_key) & (id_ <= cut_id)), F.lit(False)
    )


def sample_exact(
    rows: DataFrame,
    by: list[str],
    key: Column,
    rate: float,
    size_hint: int,
    id_col: str = "SUBJID",
) -> DataFrame:
    """Rows of an exact-size sample without replacement from every group."""
    cuts = draw_cuts(
        rows,
        by,
        key,
        [F.lit(float(rate))],
        [PoolClass((rate,), size_hint)],
        id_col,
    ).select(*by, "cut_key", "cut_id")
    drawn = is_drawn(key, F.col(id_col), F.col("cut_key"), F.col("cut_id"))
    return attach_small(rows, cuts, by).filter(drawn).drop("cut_key", "cut_id")
