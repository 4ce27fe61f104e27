"""Sequential dropout of all replicates in one scan of subjects x replicates.

A subject's key at one dropout visit does not depend on what was drawn before;
only the pool it is sorted into does. So the scan notes for each subject its place
on the key range of every visit, exact near the cuts of the pools it can be in and
else only which gap it lies in, and folds subjects that agree in all of this. What
is left grows with the square root of the subjects. On it the visits are walked
through in turn: the pools of one visit know the draws of the visits before, and a
place is drawn if the running count up to its end is within the sample's size.

A sample's last key can miss the places known exactly, above all in small pools;
such replicates are scanned again with wider bands, so sizes are always exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import draw_key, sample_size, settle, settle_counting
from lacuna.operators.profile import poor_before
from lacuna.operators.sampling import (
    FIRST_WIDTH,
    KEY_MIN,
    KEY_SPAN,
    NOTHING,
    WIDEN,
    Fold,
    key_bands,
    merged_bands,
    only_groups,
    slot,
    without_groups,
)
from lacuna.study import MarRates


def seed_of(scenarios: int) -> Column:
    if scenarios == 1:
        return F.col("replicate")
    return F.expr(f"replicate div {scenarios}")


def scenario_of(scenarios: int) -> Column:
    return F.pmod(F.col("replicate"), F.lit(scenarios)).cast("int")


def pool_of(visit: int) -> Column:
    """True: poor responder, false: everybody else, null: in neither pool.

    The previous visit of a subject that has already left is masked, so such a
    subject counts as everybody else.
    """
    poor = F.col(poor_before(visit)) & F.col("dropout_visit").isNull()
    return F.when(poor, True).when(F.col("in_universe"), False)


def _by_scenario(values: Sequence[float]) -> Column:
    if len(values) == 1:
        return F.lit(float(values[0]))
    rates = F.array(*[F.lit(float(v)) for v in values])
    return F.element_at(rates, scenario_of(len(values)) + 1)


def _inside(place: Column, bands: Sequence[tuple[int, int]]) -> Column:
    parts = []
    for low, high in bands:
        part = place >= low
        parts.append(part if high >= KEY_MIN + KEY_SPAN else part & (place < high))
    return reduce(or_, parts)


@dataclass(frozen=True)
class Dropout:
    """The dropout visits, the rates of each scenario and rough pool sizes (poor, other) per visit."""

    visits: Sequence[int]
    rates: Sequence[MarRates]
    hints: dict[int, tuple[int, int]]
    width: float = FIRST_WIDTH

    @property
    def wider(self) -> Dropout:
        return Dropout(self.visits, self.rates, self.hints, self.width * WIDEN)

    @cached_property
    def bands(self) -> dict[int, tuple[list, list]]:
        """Key intervals of the poor responders' pool and of the other, per visit."""
        out = {}
        for v in self.visits:
            n_poor, n_other = self.hints[v]
            high = key_bands([r.high for r in self.rates], n_poor, self.width)
            out[v] = high, key_bands([r.low for r in self.rates], n_other, self.width)
        return out

    def places(self, rows: DataFrame, fold: Fold) -> DataFrame:
        """Subjects of each replicate with the same flags and places, counted and totalled.

        ``rows`` are profiles, once for each replicate. A poor responder that has
        left is in the other pool from then on, so its place has to be exact in
        the bands of both.
        """
        poor = [poor_before(v) for v in self.visits]
        keys, places = {}, {}
        for i, v in enumerate(self.visits):
            keys[f"_key_{v}"] = draw_key(F.col("SUBJID"), seed_of(len(self.rates)), v)
            high, low = self.bands[v]
            of_poor = slot(F.col(f"_key_{v}"), merged_bands([*high, *low]) if i else high)
            of_other = slot(F.col(f"_key_{v}"), low)
            at, exact = (
                F.when(F.col(poor[i]), a).otherwise(b) for a, b in zip(of_poor, of_other)
            )
            places |= {f"at_{v}": at, f"id_{v}": F.when(exact, F.col("SUBJID"))}
        return (
            rows.withColumns(keys)
            .withColumns(places)
            .groupBy("replicate", "in_universe", *poor, *fold.by, *places)
            .agg(F.count(F.lit(1)).alias("_n"), *fold.totals)
        )

    def walk(self, places: DataFrame) -> DataFrame:
        """Add ``dropout_visit`` and, per visit v, what the draw there was.

        ``is_high_v``, ``pool_v``, ``taken_v``   the pool, its size and the number drawn
        ``first_v``                  one row of each pool
        ``last_v``                   the row whose place ends the sample
        ``missed``                   1 on the first row of a pool for a sample not yet found,
                                     less 1 on each sample's last row
        """
        out = places.repartition("replicate").withColumns(
            {"dropout_visit": F.lit(None).cast("int"), "missed": F.lit(0)}
        )
        for v in self.visits:
            high, low = self.bands[v]
            pool = f"is_high_{v}"
            in_order = Window.partitionBy("replicate", pool).orderBy(
                f"at_{v}", F.col(f"id_{v}").asc_nulls_first()
            )
            whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            out = out.withColumn(pool, pool_of(v)).withColumns(
                {
                    "_upto": F.sum("_n").over(in_order),
                    f"pool_{v}": F.sum("_n").over(whole),
                    f"first_{v}": F.row_number().over(in_order) == 1,
                }
            )
            rate = F.when(F.col(pool), _by_scenario([r.high for r in self.rates])).otherwise(
                _by_scenario([r.low for r in self.rates])
            )
            size = F.col(f"pool_{v}")
            taken = F.when(F.col(pool).isNotNull(), F.least(sample_size(rate, size), size))
            out = out.withColumn(f"taken_{v}", F.coalesce(taken, F.lit(0)))
            some = F.col(f"taken_{v}") > 0
            firm = F.when(F.col(pool), _inside(F.col(f"at_{v}"), high)).otherwise(
                _inside(F.col(f"at_{v}"), low)
            )
            last = some & (F.col("_upto") == F.col(f"taken_{v}")) & F.col(f"id_{v}").isNotNull() & firm
            drawn = some & (F.col("_upto") <= F.col(f"taken_{v}"))
            out = out.withColumn(f"last_{v}", last).withColumns(
                {
                    "dropout_visit": F.coalesce("dropout_visit", F.when(drawn, F.lit(v))),
                    "missed": F.col("missed")
                    + (some & F.col(f"first_{v}")).cast("int")
                    - F.col(f"last_{v}").cast("int"),
                }
            )
        return out.drop("_upto")

    def cuts(self, walked: DataFrame) -> DataFrame:
        """(replicate, visit, is_high, pool, taken, cut_key, cut_id, missed) of every pool that is not empty."""
        samples = []
        for v in self.visits:
            last = F.col(f"last_{v}")
            sample = F.struct(
                F.lit(v).alias("visit"),
                F.col(f"is_high_{v}").alias("is_high"),
                F.col(f"pool_{v}").alias("pool"),
                F.col(f"taken_{v}").alias("taken"),
                F.when(last, F.col(f"at_{v}")).alias("cut_key"),
                F.when(last, F.col(f"id_{v}")).alias("cut_id"),
            )
            samples.append(F.when((F.col(f"first_{v}") | last) & F.col(f"is_high_{v}").isNotNull(), sample))
        rows = walked.select("replicate", F.inline(F.array_compact(F.array(*samples))))
        found = rows.groupBy("replicate", "visit", "is_high").agg(
            *[F.max(c).alias(c) for c in ("pool", "taken", "cut_key", "cut_id")]
        )
        missed = (F.col("taken") > 0) & F.col("cut_id").isNull()
        return found.withColumn("missed", missed.cast("long"))


def _in_rounds(rows: DataFrame, dropout: Dropout, fold: Fold, reduced: Callable) -> DataFrame:
    """``reduced`` of the walked places, kept as a table, with no sample missed."""
    todo, found = rows, None
    while True:
        walked = dropout.walk(settle(dropout.places(todo, fold)))
        part, seen = settle_counting(reduced(dropout, walked), missed=F.sum("missed"))
        if not seen["missed"]:
            part = part.drop("missed")
            return part if found is None else found.unionByName(part)
        missed = part.groupBy("replicate").agg(F.sum("missed").alias("n")).filter("n > 0")
        again = settle(missed.select("replicate"))
        rest = without_groups(part, again, ["replicate"]).drop("missed")
        found = rest if found is None else found.unionByName(rest)
        todo, dropout = only_groups(rows, again, ["replicate"]), dropout.wider


def dropout_cuts(rows: DataFrame, dropout: Dropout) -> DataFrame:
    """The last key drawn from every pool, and its size and the sample's."""
    return _in_rounds(rows, dropout, NOTHING, Dropout.cuts)


def dropout_folded(rows: DataFrame, dropout: Dropout, fold: Fold) -> DataFrame:
    """Totals per replicate, ``fold.by`` and ``dropout_visit`` (null: stays)."""

    def reduced(dropout: Dropout, walked: DataFrame) -> DataFrame:
        names = [c for c in walked.columns if c in fold.names]
        return walked.groupBy("replicate", *fold.by, "dropout_visit").agg(
            *[F.sum(c).alias(c) for c in names], F.sum("missed").alias("missed")
        )

    return _in_rounds(rows, dropout, fold, reduced)
