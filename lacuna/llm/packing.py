"""Best-fit packing of token sequences, hierarchically.

Tokens: a text is cut at white space, which the tokenizer drops; each distinct
chunk, and in it each distinct pre-token, is encoded once per Python worker (one
table, which starts anew beyond ``TABLE_BYTES`` of memory).

Packing: every partition packs its pieces by best fit, largest first. A bin is
final when no bin anywhere fits into what it has left, that is when its rest is
below the least fill of all bins. The other bins go on as items, with their
pieces inside, to a round over ``FAN_IN`` times fewer partitions, of about
``ITEMS_PER_TASK`` bins each at most; every round deals them anew. Bins at most half
full always fit together, so a round leaves one in a partition at most. Where
too many bins are left for fewer partitions, only these go on and, of the others,
those with the most room: ``ITEMS_PER_TASK`` bins together, or twice as many as
there are half empty ones. The rounds end when one partition has packed all that
was left. Each round's bins are kept as a table in the shared folder.
"""

from __future__ import annotations

import itertools
import os
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import settle
from lacuna.llm.words import map_batches, text_rows, tidied, worker_table

CAPACITY = 4096
END_ID = 1
#: About what a worker's table may take, and what an entry takes besides its two objects.
TABLE_BYTES = 130_000_000
ENTRY_BYTES = 48
ITEMS_PER_TASK = 20_000
FAN_IN = 8
#: The word pattern of the tokenizer's file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space to str.split(), but not to the tokenizer.
_OTHER_SPACE = "\x1c\x1d\x1e\x1f"


class ChunkIds(dict):
    """Chunk without white space, or pre-token of one -> its ids as bytes of uint32.

    A pre-token stands in the table as the chunk it is when alone. ``size`` is about
    what the entries take in memory.
    """

    def __init__(self, tokenizer_file: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.pattern = regex.compile(PATTERN)
        self.space = regex.compile(rf"[^\S{_OTHER_SPACE}]+")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.bytes = {b: chr(256 + i) for i, b in enumerate(others)}
        self.size = 0

    def start_anew(self) -> None:
        self.clear()
        self.size = 0

    def keep(self, chunk: str, ids: bytes) -> bytes:
        if chunk not in self:
            self.size += sys.getsizeof(chunk) + sys.getsizeof(ids) + ENTRY_BYTES
        self[chunk] = ids
        return ids

    def word(self, word: str) -> bytes:
        """Ids of a lower-case pre-token whose characters all lie below U+0250."""
        if word.isascii():
            mapped = word
        else:
            mapped = word.encode().decode("latin-1").translate(self.bytes)
        ids = array("I", [token.id for token in self.tokenizer.model.tokenize(mapped)])
        return self.keep(word, ids.tobytes())

    def encoded(self, chunk: str) -> bytes:
        lower = chunk.lower()
        plain = len(lower) == len(chunk) and max(chunk) < "ɐ" and min(chunk) > " "
        # U+007F is the one ASCII character beyond the space that has a letter of its own.
        if "<|" in chunk or "\x7f" in chunk or not plain:
            # Special tokens, or characters whose normal form or class is not plain.
            return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        found = [self.get(word) or self.word(word) for word in self.pattern.findall(lower)]
        # Ids of one pre-token are shared with it.
        return found[0] if len(found) == 1 else b"".join(found)

    def __missing__(self, chunk: str) -> bytes:
        return self.keep(chunk, self.encoded(chunk))

    def chunks(self, text: str) -> list[str]:
        if any(c in text for c in _OTHER_SPACE):
            return [chunk for chunk in self.space.split(text) if chunk]
        return text.split()

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text closed by END_ID, and the n + 1 offsets."""
        end = array("I", [END_ID]).tobytes()
        found = []
        for text in texts:
            if self.size > TABLE_BYTES:
                self.start_anew()
            found.append(b"".join(map(self.__getitem__, self.chunks(text))) + end)
        offsets = np.cumsum([0, *map(len, found)]) // len(end)
        return np.frombuffer(b"".join(found), np.uint32), offsets


def pieces(documents: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every text's ids, cut at ``capacity``.

    A null text counts as empty, which has the end id alone. Repeated rows give
    repeated pieces.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = worker_table(f"words:{tokenizer_file}", lambda: ChunkIds(tokenizer_file))
        ids, offsets = table.tokens(batch.column("text").to_pylist())
        ids = ids.astype("<u4", copy=False)
        at, piece, start, length, crc = [], [], [], [], []
        for i in range(batch.num_rows):
            own = ids[offsets[i] : offsets[i + 1]]
            for k, first in enumerate(range(0, len(own), capacity)):
                part = own[first : first + capacity]
                at.append(i)
                piece.append(k)
                start.append(first)
                length.append(len(part))
                crc.append(zlib.crc32(part.tobytes()))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(at, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return map_batches(text_rows(documents, "doc_id", "text"), work, schema, f"words:{tokenizer_file}")


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: largest first, into the bin with the least room that takes it.

    Bins are kept by the room they have left; the set bits of ``rooms`` are the
    rooms of which there is a bin.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = n_bins = 0
    out = np.empty(len(sizes), np.int64)
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, chosen = capacity, n_bins
            n_bins += 1
        left = room - size
        if left:
            by_room[left].append(chosen)
            rooms |= 1 << left
        out[item] = chosen
    return out


PIECE = ("doc_id", "piece", "start", "length", "ids_crc32")
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_BIN = f"fill long, pieces array<struct<{_PIECE}>>"


def _dealt(number: int) -> Column:
    """A hash of a bin, another one in each round."""
    first = F.col("pieces")[0]
    return F.xxhash64(F.lit(number), first["doc_id"], first["piece"], first["ids_crc32"])


def _roomiest(bins: DataFrame, capacity: int, number: int) -> Column:
    """Which bins go on when all are too many: the half empty ones and those with the most room."""
    by_fill = sorted(map(tuple, bins.groupBy("fill").count().collect()))
    half_empty = sum(n for fill, n in by_fill if 2 * fill <= capacity)
    wanted = max(ITEMS_PER_TASK, 2 * half_empty)
    for fill, n in by_fill:
        if n > wanted:
            # Of the bins of this fill, as many as are wanted by a hash.
            some = F.pmod(_dealt(-number), F.lit(1 << 20)) < int(wanted / n * (1 << 20))
            return (F.col("fill") < fill) | ((F.col("fill") == fill) & some)
        wanted -= n
    return F.lit(True)


def _round(bins: DataFrame, capacity: int, tasks: int, number: int) -> DataFrame:
    """Merge bins that fit together within each of ``tasks`` partitions."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [batch for batch in batches if batch.num_rows]
        if not given:
            return
        table = pa.Table.from_batches(given).combine_chunks()
        lists = table.column("pieces").chunk(0)
        fills = table.column("fill").to_numpy()
        # Rows may come in any order after a lost task; the bins must not change.
        first = pc.list_element(lists, 0)
        keys = pa.table([table.column("fill"), *(first.field(c) for c in PIECE)], ["fill", *PIECE])
        order = pc.sort_indices(
            keys, [("fill", "descending"), *((c, "ascending") for c in PIECE)]
        ).to_numpy()
        chosen = best_fit(fills[order], capacity)
        by_bin = np.argsort(chosen, kind="stable")
        members = order[by_bin]
        starts = np.flatnonzero(np.diff(chosen[by_bin], prepend=-1))
        totals = np.add.reduceat(fills[members], starts)
        lists = lists.take(pa.array(members))
        offsets = lists.offsets.to_numpy()[np.append(starts, len(members))]
        merged = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lists.values)
        out = pa.table([pa.array(totals), merged], ["fill", "pieces"])
        yield from out.to_batches(max_chunksize=1000)

    spread = bins.repartition(1) if tasks == 1 else bins.repartition(tasks, _dealt(number))
    return spread.mapInArrow(tidied(merge), _BIN)


def _places(batch: pa.RecordBatch) -> pa.RecordBatch:
    lists = batch.column("pieces")
    members = lists.flatten()
    counts = np.diff(lists.offsets.to_numpy())
    lengths = members.field("length").to_numpy()
    ends = np.cumsum(lengths)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    before = ends - lengths
    return pa.RecordBatch.from_arrays(
        [
            *(members.field(name) for name in PIECE),
            pa.array(np.repeat(batch.column("sequence_id").to_numpy(), counts)),
            pa.array(before - np.repeat(before[first], counts)),
        ],
        [*PIECE, "sequence_id", "offset"],
    )


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (of ``pieces``) with ``sequence_id`` and ``offset``, gapless from 0 in each sequence.

    The rounds run when this is called. An empty input gives no rows.
    """
    final = []
    bins = settle(
        parts.select(F.col("length").alias("fill"), F.array(F.struct(*PIECE)).alias("pieces"))
    )
    count = bins.count()
    tasks = max(1, -(-count // ITEMS_PER_TASK))
    for number in itertools.count(1):
        merged = settle(_round(bins, capacity, tasks, number))
        after, least = merged.agg(F.count("*"), F.min("fill")).first()
        if tasks == 1 or not after:
            final.append(merged)
            break
        full = F.col("fill") > capacity - least
        final.append(merged.filter(full))
        bins = merged.filter(~full)
        left = bins.count()
        if not left:
            break
        if -(-left // ITEMS_PER_TASK) >= tasks:
            going = _roomiest(bins, capacity, number)
            final.append(bins.filter(~going))
            bins = bins.filter(going)
            left = bins.count()
        fewer = max(-(-tasks // FAN_IN), -(-left // ITEMS_PER_TASK))
        tasks = max(1, min(fewer, tasks - 1))
    packed = reduce(DataFrame.unionByName, final)
    packed = packed.withColumn("sequence_id", F.monotonically_increasing_id())
    return packed.mapInArrow(
        tidied(lambda batches: map(_places, batches)), f"{_PIECE}, sequence_id long, offset long"
    )


def packing_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(pieces(documents, public_tokenizers.path("word_bpe_49k.json")))
