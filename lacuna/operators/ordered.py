"""What came before a row, for rows in order, without a window over a group.

Rows are dealt to ranges of (group, order) and sorted in them, so a group of any
size, and any number of rows at one place of a visit, is spread over as many tasks
as its rows need. A task looks back over its own rows as they stream by. What the
last rows of a range leave over for the next ones is one small row a range, which
is handed on afterwards.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from lacuna.functions import settle

# Executors get the scan by value, so they need numpy and pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Spark counts rows of a partition in the lower bits of its increasing id.
ROW_BITS = 33


def _equal(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether values agree; nulls agree with nulls."""
    same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
    both = pc.and_(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
    return same | both


def _look_back(
    batches: Iterator[pa.RecordBatch], keys: Sequence[str], previous: Sequence[str], seen: Sequence[str]
) -> Iterator[pa.RecordBatch]:
    """Rows with the preceding and last seen values of their group in this range, and whether it starts there."""
    # The row before the batch; a seen column of it holds the value last seen.
    held: dict[str, pa.Array] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {c: batch.column(c) for c in (*keys, *previous, *seen)}
        if held:
            columns = {c: pa.concat_arrays([held[c], v]) for c, v in columns.items()}
        skip, total = int(bool(held)), batch.num_rows + bool(held)
        at = np.arange(total)
        same = np.ones(total, bool)
        same[0] = False
        for c in keys:
            same[1:] &= _equal(columns[c][1:], columns[c][:-1])
        start = np.maximum.accumulate(np.where(same, 0, at))
        found = {}
        for c in previous:
            found[c] = columns[c].take(pa.array(at - 1, mask=~same))
        held = {c: columns[c][-1:] for c in (*keys, *previous)}
        for c in seen:
            valid = columns[c].is_valid().to_numpy(zero_copy_only=False)
            last = np.maximum.accumulate(np.where(valid, at, -1))
            before = np.concatenate([[-1], last[:-1]])
            found[c] = columns[c].take(pa.array(before, mask=~same | (before < start)))
            held[c] = columns[c].take(pa.array(last[-1:], mask=last[-1:] < start[-1:]))
        out = batch
        for c in (*previous, *seen):
            out = out.append_column(f"{c}_found", found[c][skip:])
        yield out.append_column("new", pa.array(~same[skip:]))


def with_preceding(
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    previous: dict[str, Column],
    seen: dict[str, Column],
    first: str | None = None,
) -> DataFrame:
    """Add values of the rows before, among rows with the same ``group`` columns, by ``order``.

    ``previous`` names values taken from the preceding row, ``seen`` values taken from
    the last preceding row that has one (not null); ``first`` names a flag for the
    first row of a group. Columns of these names are replaced. Rows that ``order``
    does not tell apart come in any order. The sorted rows are kept as a table when
    this is called.
    """
    new = [*previous, *seen, *([first] if first else [])]
    names = [c for c in rows.columns if c not in new]
    inner = [f"c{i}" for i in range(len(names))]
    keys = [f"g{i}" for i in range(len(group))]
    places = [f"o{i}" for i in range(len(order))]
    before = {f"p{i}": v for i, v in enumerate(previous.values())}
    last = {f"s{i}": v for i, v in enumerate(seen.values())}
    plain = rows.select(
        *[F.col(f"`{c}`").alias(i) for c, i in zip(names, inner)],
        *[F.col(f"`{c}`").alias(i) for c, i in zip(group, keys)],
        *[F.col(f"`{c}`").alias(i) for c, i in zip(order, places)],
        *[v.alias(c) for c, v in (before | last).items()],
    )
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *places]
    ranges = plain.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = ranges.drop(*places).withColumn("at", F.monotonically_increasing_id())
    fields = [*placed.schema.fields]
    fields += [StructField(f"{c}_found", placed.schema[c].dataType) for c in (*before, *last)]
    schema = StructType([*fields, StructField("new", BooleanType())])
    p_names, s_names = list(before), list(last)
    scanned = settle(placed.mapInArrow(lambda b: _look_back(b, keys, p_names, s_names), schema))
    scanned = scanned.withColumn("part", F.shiftright("at", ROW_BITS))
    carried = _carried(scanned, keys, p_names, s_names)
    joined = scanned.join(F.broadcast(carried), "part", "left")

    def goes_on(prefix: str) -> Column:
        same = [F.col(c).eqNullSafe(F.col(f"{prefix}_{c}")) for c in keys]
        return F.coalesce(F.col(f"{prefix}_there"), F.lit(False)) & reduce(and_, same)

    opens = (F.col("at") == F.shiftleft("part", ROW_BITS)) & goes_on("last")
    out = {}
    for name, c in zip(previous, p_names):
        out[name] = F.when(opens, F.col(f"last_{c}")).otherwise(F.col(f"{c}_found"))
    for name, c in zip(seen, s_names):
        out[name] = F.coalesce(F.col(f"{c}_found"), F.when(goes_on(c), F.col(f"{c}_value")))
    if first:
        out[first] = F.col("new") & ~opens
    return joined.select(
        *[F.col(i).alias(c) for c, i in zip(names, inner)], *[v.alias(c) for c, v in out.items()]
    )


def _carried(scanned: DataFrame, keys, previous, seen) -> DataFrame:
    """Per range, the last row of the ranges before it and each value last seen in them.

    The rows are in order, so a group that goes on in a range holds the last rows of
    the ranges before. One row a range goes through the driver.
    """
    ends = [F.max_by(F.struct(*keys, *previous), "at").alias("last")]
    ends += [F.max_by(F.struct(*keys, c), F.when(F.col(c).isNotNull(), F.col("at"))).alias(c) for c in seen]
    found = scanned.groupBy("part").agg(*ends)
    fields = [StructField("part", LongType())]
    for prefix, values in [("last", [(c, f"last_{c}") for c in previous]), *[(c, [(c, f"{c}_value")]) for c in seen]]:
        fields.append(StructField(f"{prefix}_there", BooleanType()))
        fields += [StructField(f"{prefix}_{c}", scanned.schema[c].dataType) for c in keys]
        fields += [StructField(name, scanned.schema[c].dataType) for c, name in values]
    carried, so_far = [], {"last": None} | dict.fromkeys(seen)
    for row in sorted(found.collect(), key=lambda row: row["part"]):
        out = [row["part"]]
        for prefix, values in so_far.items():
            width = len(keys) + (len(previous) if prefix == "last" else 1)
            out += [values is not None, *(values or [None] * width)]
        carried.append(tuple(out))
        for prefix in so_far:
            so_far[prefix] = row[prefix] or so_far[prefix]
    return scanned.sparkSession.createDataFrame(carried, StructType(fields))
