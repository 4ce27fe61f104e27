"""Columns of texts as flat bytes, and words in them, with numpy inside a task."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of text a task works on at once; a longer text is worked on alone.
BLOCK_BYTES = 1_000_000
#: Rows of one Arrow batch of texts.
BATCH_ROWS = 1_000

MULTIPLIER = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def text_rows(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, null texts as empty ones."""
    named = [F.coalesce(df["text"], F.lit("")).alias("text") if c == "text" else c for c in columns]
    return df.select(*named)


def map_batches(
    df: DataFrame,
    work: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str | StructType,
    table: str = "",
) -> DataFrame:
    """``work`` on every Arrow batch, in parts of bounded rows and bytes.

    Inside, columns whose names need quoting have plain ones. ``table`` names the
    worker's table that ``work`` uses.
    """
    plain = {c: f"column_{i}" for i, c in enumerate(df.columns) if "." in c or "`" in c}
    if isinstance(schema, StructType):
        names = schema.names
        schema = StructType(
            [StructField(plain.get(f.name, f.name), f.dataType, f.nullable) for f in schema]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch):
                yield work(part)

    out = df.toDF(*(plain.get(c, c) for c in df.columns)).mapInArrow(tidied(run, table), schema)
    return out.toDF(*names) if plain else out


def tidied(
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], table: str = ""
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, leaving little in a worker that waits for its next task.

    Tables of the worker other than the named one are dropped before, so that a
    stage does not hold what the stages before it needed; memory that is free
    afterwards goes back to the system.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables(table)
        yield from run(batches)
        release()

    return tidy


def split_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of at most BLOCK_BYTES of text, but one row at least."""
    if "text" not in batch.schema.names:
        yield batch
        return
    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, length in enumerate(lengths.tolist()):
        if i > start and (size + length > BLOCK_BYTES or i - start >= BATCH_ROWS):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += length
    if start < batch.num_rows:
        yield batch.slice(start)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of UTF-8 bytes, and the n + 1 offsets of the texts."""
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true positions; none goes across an offset."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    if len(cuts) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    full = inside[cuts[:-1]]
    return cuts[:-1][full], cuts[1:][full]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the words ``[^\\x20\\x09-\\x0D]+``."""
    return runs(~_SPACE[data], offsets)


def owner(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The text that holds each byte position."""
    return np.searchsorted(offsets, positions, side="right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all else as it is."""
    upper = (data >= 0x41) & (data <= 0x5A)
    return data + (upper.astype(np.uint8) << 5)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


class SpanHash:
    """64-bit hashes of byte spans, from sums over all bytes taken once."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + 1) * powers(len(data), MULTIPLIER), out=self.sums[1:])
        self.back = powers(len(data) + 1, pow(MULTIPLIER, -1, 2**64))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def worker_table(name: str, make: Callable[[], object]) -> object:
    """An object that lives as long as the Python worker and serves all tasks it runs."""
    kept = sys.modules.setdefault("lacuna_worker_tables", types.ModuleType("lacuna_worker_tables"))
    kept.__dict__.setdefault("tables", {})
    if name not in kept.tables:
        kept.tables[name] = make()
    return kept.tables[name]


def drop_tables(but: str = "") -> None:
    """Forget the worker's tables except the named one."""
    kept = sys.modules.get("lacuna_worker_tables")
    if kept is not None and set(kept.tables) - {but}:
        kept.tables = {name: table for name, table in kept.tables.items() if name == but}
        release()


def release() -> None:
    """Give the worker's free memory back: Arrow's, and that of the C library (numpy, strings)."""
    pa.default_memory_pool().release_unused()
    # The C library keeps what lies between blocks in use; only glibc has this call.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
