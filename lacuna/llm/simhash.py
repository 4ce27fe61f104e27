"""SimHash near-duplicates, with candidates pruned by the pigeonring principle.

A fingerprint has ``SEGMENTS`` segments in a ring. If two fingerprints differ in at
most t bits, then from some segment on every chain of l segments differs in at
most ``l * t / SEGMENTS`` bits (rounded down: 0, 1, 2, 3 for t = 3). The first
segment is thus equal, and the second differs in one bit at most, so one of its
halves is equal too: a fingerprint is looked up under 8 keys of 24 bits. Within
a key, chains of two and of three segments are checked before all 64 bits.

Equal fingerprints are one node. Keys with more than ``KEY_ROWS`` of them are cut
into blocks, and every pair of blocks is a group of its own. A group gives a
spanning forest of its links, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lacuna.functions import settle
from lacuna.llm.components import connected_components
from lacuna.llm.words import map_batches, mix, tidied

SHINGLE = 3
SEED = 42
DISTANCE = 3
SEGMENTS = 4
#: Rows of one key that are compared with each other in one group.
KEY_ROWS = 2048


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 without any word."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    size = min(shingle, len(words))
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1)
    most = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int.from_bytes(np.packbits(most).tobytes(), "little")


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Every row and column with ``fingerprint`` (64 bits as a long) and ``node``, one to one with it.

    Columns of these names are replaced. A null text counts as empty.
    """
    documents = documents.drop("fingerprint", "node")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        found = np.array([fingerprint(t or "", shingle) for t in texts], np.uint64)
        batch = batch.append_column("fingerprint", pa.array(found.view(np.int64)))
        return batch.append_column("node", pa.array(mix(found).view(np.int64)))

    added = [StructField("fingerprint", LongType()), StructField("node", LongType())]
    return map_batches(documents, work, StructType([*documents.schema.fields, *added]))


def _rotated(values: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """The fingerprints turned so that the given segment is the lowest."""
    shift = segment * np.uint64(64 // SEGMENTS)
    return (values >> shift) | (values << (np.uint64(64) - shift & np.uint64(63)))


def _keys(batch: pa.RecordBatch) -> pa.RecordBatch:
    values = batch.column("fingerprint").to_numpy().view(np.uint64)
    keys = []
    for segment in range(SEGMENTS):
        turned = _rotated(values, np.uint64(segment))
        for half in range(2):
            part = (turned >> np.uint64(16 + 8 * half)) & np.uint64(0xFF)
            number = np.uint64((2 * segment + half) << 24)
            keys.append(number | part << np.uint64(16) | turned & np.uint64(0xFFFF))
    n = len(keys)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate(keys).view(np.int64)),
            pa.array(np.tile(batch.column("fingerprint").to_numpy(), n)),
            pa.array(np.tile(batch.column("node").to_numpy(), n)),
        ],
        ["key", "fingerprint", "node"],
    )


def _near(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs keep to the budgets of chains 2 and 3, and then of the whole ring."""
    kept = np.arange(len(left))
    for chain in range(2, SEGMENTS + 1):
        differ = values[left[kept]] ^ values[right[kept]]
        if chain < SEGMENTS:
            differ &= np.uint64((1 << 16 * chain) - 1)
        kept = kept[np.bitwise_count(differ) <= DISTANCE * chain // SEGMENTS]
    return kept


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least row connected to each of n rows."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while (jumped := label[label]).tolist() != label.tolist():
            label = jumped
        apart = label[left] != label[right]
        left, right = left[apart], right[apart]
    return label


def _links(group: np.ndarray, crossing: np.ndarray, side: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """For rows ordered by group, the least row of each row's links within its group."""
    n = len(group)
    last = np.searchsorted(group, group, side="right")
    lefts, rights = [], []
    at = np.arange(n)
    for distance in range(1, n):
        at = at[at + distance < last[at]]
        if not len(at):
            break
        pair = at[~crossing[at] | (side[at] != side[at + distance])]
        pair = pair[_near(turned, pair, pair + distance)]
        lefts.append(pair)
        rights.append(pair + distance)
    empty = [np.zeros(0, np.int64)]
    return _forest(n, np.concatenate(lefts or empty), np.concatenate(rights or empty))


def _group_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest edges of whole groups; batches come ordered by group."""
    columns = ("key", "low", "high", "block", "fingerprint", "node")
    kept: list[np.ndarray] = []

    def work(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, low, high, block, values, nodes = rows
        new = np.ones(len(key), bool)
        new[1:] = (np.diff(key) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)
        turned = _rotated(values.view(np.uint64), (key >> 25).astype(np.uint64))
        root = _links(np.cumsum(new), low != high, block, turned)
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes[linked]), pa.array(nodes[root[linked]])], ["a", "b"]
        )

    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in columns]
        if kept:
            rows = [np.concatenate(x) for x in zip(kept, rows)]
        key, low, high = rows[:3]
        if not len(key):
            continue
        ended = (key != key[-1]) | (low != low[-1]) | (high != high[-1])
        cut = int(ended.sum())
        if cut:
            yield work([x[:cut] for x in rows])
        kept = [x[cut:] for x in rows]
    if kept:
        yield work(kept)


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between ``nodes`` (fingerprint, node; each once) that connect all near pairs."""
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = nodes.select("fingerprint", "node").mapInArrow(
        tidied(lambda batches: map(_keys, batches)), "key long, fingerprint long, node long"
    )
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    blocks = F.ceil(F.col("n") / KEY_ROWS).cast("int")
    shared = (
        keys.join(sizes, "key")
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key",
            F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"),
            "block",
            "fingerprint",
            "node",
        )
    )
    grouped = shared.repartition(tasks, "key", "low", "high").sortWithinPartitions(
        "key", "low", "high"
    )
    return grouped.mapInArrow(tidied(_group_links), "a long, b long")


def near_duplicates(rows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``rows`` of ``fingerprints`` with ``component_id``, the smallest doc_id connected to each, and ``root``.

    ``root`` names the component even where all its doc_ids are null (then
    ``component_id`` is null). The rows should be a kept table; they are read twice.
    """
    nodes = settle(
        rows.groupBy("node", "fingerprint").agg(F.min(doc_id).alias("least"))
    )
    found = connected_components(links(nodes))
    rooted = nodes.join(found, "node", "left").select(
        "node", "least", F.coalesce("root", "node").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = settle(rooted.drop("least").join(least, "root"))
    return rows.join(named, "node")


def one_of_each(documents: DataFrame) -> DataFrame:
    """One row of each component: that of its smallest doc_id, null last; one of repeated rows."""
    rows = settle(fingerprints(documents).withColumn("row", F.monotonically_increasing_id()))
    found = near_duplicates(rows.select("doc_id", "fingerprint", "node", "row"))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    kept = found.groupBy("root").agg(F.min_by("row", first).alias("row"))
    return rows.join(kept, "row", "left_semi").select(*documents.columns)


def simhash_query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = settle(fingerprints(documents.select("doc_id", "text")).drop("text"))
    found = near_duplicates(rows)
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
