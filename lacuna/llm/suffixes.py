"""Removal of long repeated byte strings with a family of suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else
too. Strings (windows) are grouped by their anchor, the place of the least hash
of ``CORE`` bytes in them: equal windows have equal anchors at equal places, so
only windows whose anchor's core is the same can be equal.

1. Each text is cut into runs of neighbouring windows with the same core, one row
   each, with a hash of the run's whole bytes. Rows sorted by core tell runs
   that occur elsewhere as a whole (all their windows are repeated), and runs
   whose core has other surroundings elsewhere, of which one each goes on.
2. The bytes of these are dealt to shards by core. A shard is an index family:
   each new batch gets its suffix array (the order of its windows' bytes), is
   merge-scanned against the suffix arrays of all levels for equal windows, and
   becomes a level; levels of equal rank merge, so their sizes grow
   geometrically. Cores with more than ``CORE_WINDOWS`` windows, as the edges of a
   very common passage have, are not left to one shard: their windows are
   counted by 128 bits of hash.
3. The found spans go back to their texts, which are read a third time.

A text is known by its doc_id and a hash, so that repeated rows share their spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lacuna.functions import settle
from lacuna.llm.words import MULTIPLIER, flat, map_batches, mix, powers, split_batch, tidied

LENGTH = 200
CORE = 64
#: Windows of one core up to which a shard takes them.
CORE_WINDOWS = 50_000
#: Windows of a shard, about, and of one batch of it.
SHARD_WINDOWS = 200_000
BATCH_WINDOWS = 50_000
#: Bytes of a longer text that are looked at together.
CHUNK = 1_000_000

_RUN = "core long, whole long, again boolean, doc long, text_key long, start long, windows long"
_RUN_COLUMNS = [c.split()[0] for c in _RUN.split(", ")]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    out, size = values, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    n = len(values) - width + 1
    return np.minimum(out[:n], out[width - size : width - size + n])


def runs_of_windows(
    data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, core: int = CORE
) -> dict[str, np.ndarray]:
    """Runs of windows with one core: text, start byte in ``data``, windows, hashes.

    ``again`` tells that the core stands in the run more than once.
    """
    n = len(data)
    empty = {c: np.zeros(0, np.int64) for c in ("text", "start", "windows")}
    empty |= {c: np.zeros(0, np.uint64) for c in ("core", "whole")} | {"again": np.zeros(0, bool)}
    if n < length:
        return empty
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + 1) * powers(n, MULTIPLIER), out=sums[1:])
    back = powers(n + 1, pow(MULTIPLIER, -1, 2**64))
    hashes = mix((sums[core:] - sums[:-core]) * back[: n - core + 1])
    place = np.arange(len(hashes), dtype=np.uint64)
    order = (hashes & np.uint64(0xFFFFFFFF00000000)) | place
    anchor = (_least(order, length - core + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Windows that lie in one text.
    inside = np.zeros(n - length + 2, np.int64)
    lengths = np.diff(offsets)
    fits = np.flatnonzero(lengths >= length)
    np.add.at(inside, offsets[fits], 1)
    np.add.at(inside, offsets[fits + 1] - length + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    new = np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    new[1:] |= inside[1:] != inside[:-1]
    new[offsets[fits]] = True
    first = np.flatnonzero(new)
    first_of_text = np.zeros(len(anchor), bool)
    first_of_text[offsets[fits]] = True
    cores = hashes[anchor[first]]
    # Anchors in a row with the same core belong to one run.
    joined = np.zeros(len(first), bool)
    joined[1:] = (cores[1:] == cores[:-1]) & inside[first[1:]] & inside[first[:-1]]
    joined &= ~first_of_text[first]
    again = np.zeros(len(first), bool)
    again[:-1] = joined[1:]
    kept = ~joined
    start, again, cores = first[kept], again[kept], cores[kept]
    end = np.append(start[1:], len(anchor))
    full = inside[start]
    start, end, again, cores = start[full], end[full], again[full], cores[full]
    size = (end - start).astype(np.uint64)
    whole = mix((sums[end - 1 + length] - sums[start]) * back[start] + size * np.uint64(0xD6E8FEB86659FD93))
    text = np.searchsorted(offsets, start, side="right") - 1
    return {
        "text": text, "start": start, "windows": end - start, "core": cores, "whole": whole, "again": again,
    }


def _chunks(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple]:
    """(data, offsets, first byte); a long text comes in chunks that share length - 1 bytes."""
    if len(offsets) > 2 or len(data) <= CHUNK + length:
        yield data, offsets, 0
        return
    for first in range(0, len(data) - length + 1, CHUNK):
        part = data[first : first + CHUNK + length - 1]
        yield part, np.array([0, len(part)]), first


def _runs(batch: pa.RecordBatch, length: int, core: int) -> Iterator[pa.RecordBatch]:
    for piece in split_batch(batch):
        data, offsets = flat(piece.column("text"))
        docs, keys = piece.column("doc").to_numpy(), piece.column("text_key").to_numpy()
        for part, bounds, first in _chunks(data, offsets, length):
            found = runs_of_windows(part, bounds, length, core)
            if not len(found["text"]):
                continue
            start = found["start"] + first - offsets[found["text"]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found["core"].view(np.int64)),
                    pa.array(found["whole"].view(np.int64)),
                    pa.array(found["again"]),
                    pa.array(docs[found["text"]]),
                    pa.array(keys[found["text"]]),
                    pa.array(start),
                    pa.array(found["windows"]),
                ],
                _RUN_COLUMNS,
            )


def recurring(runs: DataFrame) -> DataFrame:
    """Runs that matter: ``repeated`` as a whole elsewhere, or to be compared with others (``compare``).

    Of equal runs (by core and whole, two hashes of 64 bits) the first one is
    compared, if its core has other surroundings somewhere or stands in the run
    more than once. Runs are counted before they meet, so a passage that very many
    documents share is one row of each task.
    """
    wholes = settle(
        runs.groupBy("core", "whole").agg(F.count("*").alias("n"), F.bool_or("again").alias("again"))
    )
    more = wholes.groupBy("core").agg(F.count("*").alias("wholes")).filter("wholes > 1")
    # Tables, so that Spark can split the joins where a core or run is very common.
    cores = settle(more.select("core").unionByName(wholes.filter("again").select("core")).distinct())
    marked = wholes.join(cores.withColumn("compare", F.lit(True)), "core", "left")
    wanted = settle(
        marked.select("core", "whole", (F.col("n") > 1).alias("repeated"), F.coalesce("compare", F.lit(False)).alias("compare"))
        .filter("repeated OR compare")
    )
    place = ["doc", "text_key", "start", "windows"]
    found = settle(runs.drop("again").join(wanted, ["core", "whole"]))
    first = F.min(F.struct(*place)).alias("first")
    compared = found.filter("compare").groupBy("core", "whole").agg(first).select("core", "first.*")
    repeated = found.filter("repeated").select("core", *place)

    def flagged(rows: DataFrame, repeated: bool) -> DataFrame:
        return rows.withColumns({"repeated": F.lit(repeated), "compare": F.lit(not repeated)})

    return flagged(repeated, True).unionByName(flagged(compared, False))


def _windows(data: np.ndarray, length: int) -> np.ndarray:
    """Every window of the bytes, as one fixed-length string that shares memory."""
    return np.lib.stride_tricks.sliding_window_view(data, length)


class Level:
    """A suffix array of windows: their bytes in order, where each comes from, and whether it recurs."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, recurs: np.ndarray):
        self.keys, self.ids, self.recurs, self.rank = keys, ids, recurs, 0

    @classmethod
    def of_batch(cls, keys: np.ndarray, ids: np.ndarray) -> Level:
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], ids[order]
        recurs = np.zeros(len(keys), bool)
        same = keys[1:] == keys[:-1]
        recurs[1:] |= same
        recurs[:-1] |= same
        return cls(keys, ids, recurs)

    def scan(self, other: Level) -> None:
        """Mark the windows that both levels hold."""
        at = np.minimum(np.searchsorted(self.keys, other.keys), len(self.keys) - 1)
        both = self.keys[at] == other.keys
        other.recurs |= both
        # The first of equal windows stands for them; more than one already recur.
        self.recurs[at[both]] = True

    def merged(self, other: Level) -> Level:
        """Both as one level of the next rank."""
        keys = np.concatenate([self.keys, other.keys])
        order = np.argsort(keys, kind="stable")
        out = Level(
            keys[order],
            np.concatenate([self.ids, other.ids])[order],
            np.concatenate([self.recurs, other.recurs])[order],
        )
        out.rank = self.rank + 1
        return out


class IndexFamily:
    """Levels of suffix arrays over all windows added so far."""

    def __init__(self):
        self.levels: list[Level] = []

    def add(self, keys: np.ndarray, ids: np.ndarray) -> None:
        new = Level.of_batch(keys, ids)
        for level in self.levels:
            level.scan(new)
        self.levels.append(new)
        while len(self.levels) > 1 and self.levels[-1].rank == self.levels[-2].rank:
            last = self.levels.pop()
            self.levels[-1] = self.levels[-1].merged(last)

    def recurring(self) -> np.ndarray:
        """Sorted ids of all windows that were added more than once."""
        found = [level.ids[level.recurs] for level in self.levels]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


_SEGMENT = "core long, doc long, text_key long, start long, bytes binary"
_SPAN = "doc long, text_key long, start long, end long"


def _spans(
    rows: list[tuple[int, int, int, int]], bases: list[int], found: np.ndarray, length: int
) -> pa.RecordBatch:
    """Spans of bytes under the found windows; window ids count on from each segment's base."""
    own = np.searchsorted(bases, found, side="right") - 1
    new = np.ones(len(found), bool)
    new[1:] = (np.diff(found) != 1) | (np.diff(own) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(found)) - 1
    table = np.array(rows, np.int64).reshape(-1, 4)[own[first]]
    offset = found - np.asarray(bases, np.int64)[own]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(table[:, 1]),
            pa.array(table[:, 2]),
            pa.array(table[:, 3] + offset[first]),
            pa.array(table[:, 3] + offset[last] + length),
        ],
        ["doc", "text_key", "start", "end"],
    )


def _shard_spans(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """One index family for all segments of a task; cores do not meet, so their order is free."""
    family = IndexFamily()
    rows: list[tuple[int, int, int, int]] = []
    bases: list[int] = []
    keys: list[np.ndarray] = []
    n_windows = waiting = 0

    def flush() -> None:
        nonlocal waiting
        if keys:
            family.add(np.concatenate(keys), np.arange(n_windows - waiting, n_windows))
            keys.clear()
            waiting = 0

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("core", "doc", "text_key", "start", "bytes")]
        for core, doc, text_key, start, data in zip(*columns):
            windows = _windows(np.frombuffer(data, np.uint8), length)
            for first in range(0, len(windows), BATCH_WINDOWS):
                part = np.ascontiguousarray(windows[first : first + BATCH_WINDOWS])
                rows.append((core, doc, text_key, start + first))
                bases.append(n_windows)
                keys.append(part.view(f"V{length}").ravel())
                n_windows += len(part)
                waiting += len(part)
                if waiting >= BATCH_WINDOWS:
                    flush()
    flush()
    if n_windows:
        found = family.recurring()
        if len(found):
            yield _spans(rows, bases, found, length)


_HASHED = "low long, high long, doc long, text_key long, start long"


def _hash_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("doc", "text_key", "start", "bytes")]
        for doc, text_key, start, data in zip(*columns):
            data = np.frombuffer(data, np.uint8).astype(np.uint64) + 1
            hashes = []
            for base in (MULTIPLIER, 0xC2B2AE3D27D4EB4F):
                sums = np.concatenate([[np.uint64(0)], np.cumsum(data * powers(len(data), base))])
                back = powers(len(data) + 1, pow(base, -1, 2**64))
                n = len(data) - length + 1
                hashes.append(mix((sums[length:] - sums[:n]) * back[:n]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    *map(pa.array, hashes),
                    pa.array(np.full(n, doc, np.int64)),
                    pa.array(np.full(n, text_key, np.int64)),
                    pa.array(start + np.arange(n)),
                ],
                [c.split()[0] for c in _HASHED.split(", ")],
            )


def _common_spans(segments: DataFrame, length: int) -> DataFrame:
    """Spans under windows of very common cores that occur more than once."""
    windows = segments.mapInArrow(tidied(lambda batches: _hash_windows(batches, length)), _HASHED)
    counts = windows.groupBy("low", "high").agg(F.count("*").alias("n")).filter("n > 1")
    # A table, so that Spark can split the join where a window is very common.
    twice = settle(counts.select("low", "high"))
    found = settle(windows.join(twice, ["low", "high"]))
    return found.select("doc", "text_key", "start", (F.col("start") + length).alias("end"))


def _keyed(documents: DataFrame, *columns: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).alias("text")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc")
    return documents.withColumn("text", text).select(
        *columns, doc, F.xxhash64("doc_id", "text").alias("text_key"), "text"
    )


def repeated_spans(documents: DataFrame, length: int = LENGTH, core: int = CORE) -> DataFrame:
    """(doc, text_key, spans) of all bytes under repeated windows; spans may touch and overlap.

    ``documents`` has doc_id and text. The shards run when this is called.
    """
    conf = documents.sparkSession.conf
    texts = _keyed(documents)
    runs = texts.mapInArrow(
        tidied(lambda batches: (out for batch in batches for out in _runs(batch, length, core))), _RUN
    )
    found = settle(recurring(settle(runs)))
    compared = found.filter("compare")
    sizes = compared.groupBy("core").agg(F.sum("windows").alias("of_core"))
    common = settle(sizes.filter(F.col("of_core") > CORE_WINDOWS).select("core"))
    n_windows = compared.agg(F.sum("windows")).first()[0] or 0
    shards = max(int(conf.get("spark.sql.shuffle.partitions")), -(-n_windows // SHARD_WINDOWS))
    wanted = compared.groupBy("doc", "text_key").agg(
        F.collect_set(F.struct("core", "start", "windows")).alias("wanted")
    )

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs, keys, texts, lists = (batch.column(c) for c in ("doc", "text_key", "text", "wanted"))
        data, offsets = flat(texts)
        whole = data.data
        runs, count = lists.flatten(), lists.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(count)), count)
        start = runs.field("start").to_numpy()
        ends = start + runs.field("windows").to_numpy() + length - 1
        bounds = zip((offsets[row] + start).tolist(), (offsets[row] + ends).tolist())
        at = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [
                runs.field("core"),
                docs.take(at),
                keys.take(at),
                runs.field("start"),
                pa.array([bytes(whole[a:b]) for a, b in bounds], pa.binary()),
            ],
            [c.split()[0] for c in _SEGMENT.split(", ")],
        )

    # Repeated rows give each segment again, which is right: their windows recur.
    chosen = texts.join(wanted, ["doc", "text_key"]).select("doc", "text_key", "text", "wanted")
    segments = settle(map_batches(chosen, cut, _SEGMENT))
    very_common = bool(common.take(1))
    plain = segments.join(common, "core", "left_anti") if very_common else segments
    plain = plain.repartition(shards, "core")
    spans = settle(plain.mapInArrow(tidied(lambda batches: _shard_spans(batches, length)), _SPAN))
    end = (F.col("start") + F.col("windows") + length - 1).alias("end")
    spans = spans.unionByName(found.filter("repeated").select("doc", "text_key", "start", end))
    if very_common:
        spans = spans.unionByName(_common_spans(segments.join(common, "core", "left_semi"), length))
    return spans.groupBy("doc", "text_key").agg(
        F.collect_list(F.struct("start", "end")).alias("spans")
    )


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes, in order."""
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or []):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for start, end in spans:
        out.append(data[at:start])
        at = end
    out.append(data[at:])
    return b"".join(out)


def _with_spans(documents: DataFrame, length: int, *columns: str) -> DataFrame:
    spans = repeated_spans(documents.select("doc_id", "text"), length)
    return _keyed(documents, *columns).join(spans, ["doc", "text_key"], "left")


def digests(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``documents`` (doc_id, text).

    A null text counts as empty. Repeated rows hold each other's windows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, counts, hashes = [], [], [], []
            texts = batch.column(batch.schema.get_field_index("text"))
            for text, spans in zip(texts, batch.column(batch.schema.get_field_index("spans"))):
                data, own = text.as_py().encode(), merged(spans.as_py())
                kept = kept_bytes(data, own)
                sizes.append(len(data))
                removed.append(len(data) - len(kept))
                counts.append(len(own))
                hashes.append(sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")),
                    *(pa.array(x, pa.int64()) for x in (sizes, removed, counts)),
                    pa.array(hashes, pa.string()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _with_spans(documents, length, "doc_id").select("doc_id", "text", "spans").mapInArrow(tidied(work), schema)


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without parts of UTF-8 characters at their ends."""
    out = []
    for start, end in spans:
        while start < end and data[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        if start < end:
            out.append((start, end))
    return out


def clean(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """Every row with its text's repeated bytes removed, whole characters only.

    A null text becomes an empty one; ``n_chars`` follows if there is one.
    """
    columns = documents.columns
    inner = [c for c in columns if c != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            at = batch.schema.get_field_index("text")
            for text, spans in zip(batch.column(at), batch.column(batch.num_columns - 1)):
                data = text.as_py().encode()
                texts.append(kept_bytes(data, whole_characters(data, merged(spans.as_py()))).decode())
            rest = batch.select(inner)
            yield rest.append_column("text", pa.array(texts, pa.string()))

    fields = [documents.schema[c] for c in inner]
    found = _with_spans(documents, length, *inner).select(*inner, "text", "spans")
    schema = StructType([*fields, StructField("text", StringType())])
    out = found.mapInArrow(tidied(work), schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(documents.schema["n_chars"].dataType))
    return out.select(*columns)


def suffix_query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(documents.select("doc_id", "text"))


#: Equivalent SQL: every window by its hash, found in slices of the text as hexadecimal digits.
SUFFIX_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
blocks AS (
  SELECT r, f, length(x) // 2 - 199 - f AS n, substr(x, 2 * f + 1, 2 * (256 + 199)) AS y
  FROM (SELECT r, x, unnest(range(0, greatest(length(x) // 2 - 199, 0), 256)) AS f FROM d)),
w AS (
  SELECT r, f + q AS p, md5(substr(y, 2 * q + 1, 400)) AS k
  FROM (SELECT r, f, y, unnest(range(0, least(n, 256))) AS q FROM blocks)),
twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
found AS (SELECT r, p FROM w SEMI JOIN twice USING (k)),
marked AS (
  SELECT r, p, coalesce(p - lag(p) OVER (PARTITION BY r ORDER BY p) > 200, true) AS new FROM found),
numbered AS (SELECT r, p, sum(new::INT) OVER (PARTITION BY r ORDER BY p) AS s FROM marked),
spans AS (SELECT r, s, min(p) AS a, max(p) + 200 AS b FROM numbered GROUP BY r, s),
removed AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r),
gaps AS (
  SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM spans
  UNION ALL SELECT r, max(b), NULL FROM spans GROUP BY r),
kept AS (
  SELECT r, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(b, length(x) // 2) - a)), '' ORDER BY a) AS x
  FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, (length(d.x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
FROM d LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)
"""
