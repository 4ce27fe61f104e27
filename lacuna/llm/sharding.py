"""Sharding by a minimax contiguous partition, in DataFrame functions only.

Equal texts are one group, which stays whole. A group that is no smaller than an
equal share of what is still to be dealt (the largest first) fills a shard of its
own. The others, in the order of their texts' MD5, are cut into runs, one for each
shard left, so that the largest run is as small as it can be: a binary search for
the smallest capacity with which filling shards greedily takes all groups.

The groups stay in Spark. What the search walks on is a table of cells, the
totals of all groups with a common start of the key. Its totals bound where each
greedy cut can lie for the capacities still in question; only the cells there are
split, by further digits of the key, until every cut falls between two known
groups. So the capacity is exact, while the cells number some ten thousands
however many groups there are. A row's shard then is a comparison of its key with
the cuts.

Slots follow the order (key, doc_id) within a shard. Rows are sorted by ranges and
numbered by their place in a range and the rows of the ranges before it, so that
neither a shard nor a group of copies has to fit in one task.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import attach_small, settle

SHARDS = 24
OVERHEAD = 8
#: Digits of the key that tell the first cells apart, and those added where cells are split.
FIRST_DIGITS = 4
MORE_DIGITS = 2
#: Rows of one range that is numbered.
RANGE_ROWS = 2_000_000
#: Spark counts rows of a partition in the lower bits of its increasing id.
ROW_BITS = 33


def text_key(text: Column) -> Column:
    """The order of texts; a null text is an empty one."""
    return F.md5(F.coalesce(text, F.lit("")))


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


@dataclass(frozen=True)
class Cuts:
    """Where shards end: keys of groups with a shard of their own, then each other shard's last key."""

    alone: tuple[str, ...]
    last: tuple[str, ...]

    def shard(self, key: Column) -> Column:
        run = F.lit(len(self.alone))
        for last in self.last:
            run = run + (key > last).cast("int")
        shard = F.when(F.lit(False), 0)
        for i, own in enumerate(self.alone):
            shard = shard.when(key == own, i)
        return shard.otherwise(run)


@dataclass(frozen=True)
class Cell:
    """Groups whose keys start alike: their total and the first and last of their keys."""

    start: str
    total: int
    low: str
    high: str

    @property
    def single(self) -> bool:
        return self.low == self.high


def cells_of(rows: DataFrame, digits: int) -> list[Cell]:
    start = F.substring("key", 1, digits).alias("start")
    found = rows.groupBy(start).agg(F.sum("size"), F.min("key"), F.max("key"))
    return sorted((Cell(*row) for row in found.collect()), key=lambda cell: cell.start)


class Walk:
    """Greedy filling over cells whose inner cuts are not known yet."""

    def __init__(self, cells: list[Cell], shards: int):
        self.cells, self.shards = cells, shards
        self.edges = [0, *accumulate(cell.total for cell in cells)]
        self.total = self.edges[-1]

    def ends(self, capacity: int) -> list[tuple[int, int]]:
        """The least and the greatest total at which each greedily filled shard can end."""
        low = high = 0
        out = []
        for _ in range(self.shards):
            low = self.edges[bisect_right(self.edges, low + capacity) - 1]
            high = min(high + capacity, self.total)
            at = bisect_right(self.edges, high) - 1
            if at == len(self.cells) or self.cells[at].single:
                high = self.edges[at]
            out.append((low, high))
        return out

    def smallest(self, side: int) -> int:
        """The smallest capacity that takes all, by the least (0) or greatest (1) ends."""
        capacities = range(-(-self.total // self.shards), self.total + 1)
        found = bisect_left(
            capacities, True, key=lambda c: self.ends(c)[-1][side] >= self.total
        )
        return capacities[found]

    def open_cells(self) -> list[Cell]:
        """Cells of several groups in which a cut can lie."""
        least, most = self.ends(self.smallest(1)), self.ends(self.smallest(0))
        found = set()
        for (low, _), (_, high) in zip(least[:-1], most[:-1]):
            first = bisect_right(self.edges, low) - 1
            found |= {
                i
                for i in range(first, bisect_left(self.edges, high))
                if not self.cells[i].single and low < self.edges[i + 1]
            }
        return [self.cells[i] for i in sorted(found)]

    def last_keys(self) -> list[str]:
        """The last key of every shard but the last, once no cell is open."""
        ends = [end for end, _ in self.ends(self.smallest(0))[:-1] if end < self.total]
        return [self.cells[self.edges.index(end) - 1].high for end in ends]


def minimax_cuts(groups: DataFrame, shards: int = SHARDS) -> Cuts:
    """The cuts of ``groups`` (key, size; any number of rows a key) into ``shards`` shards.

    At most about 16 ** FIRST_DIGITS rows, and some for each pair of shards, come
    to the driver at once, whatever the number of groups. Shards beyond the number
    of groups stay empty; without a row there are no cuts.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    cells = cells_of(groups, FIRST_DIGITS)
    left = sum(cell.total for cell in cells)
    # A group with a shard of its own lies in one of the ``shards`` largest cells:
    # no more of them can be as large as it.
    largest = sorted(cells, key=lambda cell: -cell.total)[:shards]
    within = groups.filter(F.substring("key", 1, FIRST_DIGITS).isin([c.start for c in largest]))
    sums = within.groupBy("key").agg(F.sum("size").alias("total"))
    alone = []
    for key, total in sums.orderBy(F.desc("total"), "key").limit(shards).collect():
        if len(alone) == shards - 1 or total * (shards - len(alone)) < left:
            break
        alone.append(key)
        left -= total
    if alone:
        groups = groups.filter(~F.col("key").isin(alone))
        cells = cells_of(groups, FIRST_DIGITS)
    digits = FIRST_DIGITS
    walk = Walk(cells, shards - len(alone))
    while walk.total and (wide := walk.open_cells()):
        starts = [cell.start for cell in wide]
        inside = groups.filter(F.substring("key", 1, digits).isin(starts))
        digits += MORE_DIGITS
        split = set(wide)
        known = [cell for cell in walk.cells if cell not in split]
        cells = sorted(known + cells_of(inside, digits), key=lambda cell: cell.low)
        walk = Walk(cells, walk.shards)
    return Cuts(tuple(alone), tuple(walk.last_keys() if walk.total else ()))


def shard_rows(documents: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """Every row and column of ``documents`` with its ``shard``; a column of that name is replaced.

    Texts are read twice, once for the cuts; no text is shuffled.
    """
    key = text_key(F.col(f"`{text}`"))
    groups = documents.select(key.alias("key"), text_size(F.col(f"`{text}`")).alias("size"))
    return documents.withColumn("shard", minimax_cuts(settle(groups), shards).shard(key))


def sharded(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``documents`` (doc_id, text).

    A null text counts as empty, with which it makes one group; a null doc_id comes
    first among its copies. Repeated rows get a slot each. An empty table gives no
    rows. Texts are read once, and never shuffled. Jobs start when this is called.
    """
    text = F.col("text")
    rows = settle(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            text_size(text).alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            text_key(text).alias("key"),
            # So that ranges can part rows that are equal in all else.
            F.monotonically_increasing_id().alias("place"),
        )
    )
    placed = rows.withColumn("shard", minimax_cuts(rows.select("key", "size"), shards).shard(F.col("key")))
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-rows.count() // RANGE_ROWS))
    order = ["shard", "key", "doc_id", "place"]
    ranges = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = settle(
        ranges.select("doc_id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("at"))
    ).withColumn("part", F.shiftright("at", ROW_BITS))
    sizes = numbered.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    so_far = Window.partitionBy("shard").orderBy("part")
    sizes = settle(sizes.select("shard", "part", "first", (F.sum("n").over(so_far) - F.col("n")).alias("before")))
    return attach_small(numbered, sizes, ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (F.col("at") - F.col("first") + F.col("before")).alias("slot"),
    )


def sharding_query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sharded(documents).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: Equivalent SQL. The capacity comes from a table over all pairs of cuts, shard by shard.
SHARDING_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce(
           [n] || [0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
  FROM (SELECT unnest(range(0, 256)) AS n)),
d AS (
  SELECT row_number() OVER () AS r, doc_id, md5(coalesce(text, '')) AS key, hex(encode(coalesce(text, ''))) AS x
  FROM documents),
s AS (
  SELECT r, doc_id, key, (length(x) // 2 + {OVERHEAD})::BIGINT AS size,
         xor(list_reduce(
           [4294967295] || list_transform(regexp_extract_all(x, '..'), lambda b: ('0x' || b)::BIGINT),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM d, bits),
g AS (SELECT key, sum(size)::BIGINT AS total FROM s GROUP BY key),
by_size AS (SELECT key, total, row_number() OVER (ORDER BY total DESC, key) AS i FROM g),
alone AS (
  SELECT key, total, i, (SELECT sum(total) FROM g)::BIGINT - total AS rest FROM by_size
  WHERE i = 1 AND {SHARDS} > 1 AND total * {SHARDS} >= (SELECT sum(total) FROM g)
  UNION ALL
  SELECT b.key, b.total, b.i, a.rest - b.total FROM alone a JOIN by_size b ON b.i = a.i + 1
  WHERE a.i < {SHARDS} - 1 AND b.total * ({SHARDS} - a.i) >= a.rest),
p AS (
  SELECT key, row_number() OVER (ORDER BY key) AS j, sum(total) OVER (ORDER BY key)::BIGINT AS upto
  FROM g ANTI JOIN alone USING (key)),
m AS (SELECT {SHARDS} - (SELECT count(*) FROM alone) AS runs, (SELECT max(upto) FROM p) AS whole),
ends AS (SELECT 0 AS j, 0::BIGINT AS upto UNION ALL SELECT j, upto FROM p),
best AS (
  SELECT 1 AS k, j, upto AS capacity FROM ends
  UNION ALL
  SELECT b.k + 1, e.j, min(greatest(b.capacity, e.upto - f.upto))
  FROM best b JOIN ends f ON f.j = b.j JOIN ends e ON e.j >= b.j, m WHERE b.k < m.runs
  GROUP BY b.k + 1, e.j),
c AS (SELECT min(capacity) AS capacity FROM best, m WHERE k <= runs AND j = (SELECT max(j) FROM ends)),
fill AS (
  SELECT 1 AS k, (SELECT max(upto) FROM ends, c WHERE upto <= capacity) AS upto
  UNION ALL
  SELECT k + 1, (SELECT max(e.upto) FROM ends e, c WHERE e.upto <= fill.upto + capacity) FROM fill, m
  WHERE k < m.runs),
shards AS (
  SELECT key, i - 1 AS shard FROM alone
  UNION ALL
  SELECT key, (SELECT count(*) FROM alone) + (SELECT count(*) FROM fill WHERE fill.upto < p.upto) FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY key, doc_id NULLS FIRST) - 1 AS slot,
       NULL::INT AS grown_shard
FROM s JOIN shards USING (key)
"""
