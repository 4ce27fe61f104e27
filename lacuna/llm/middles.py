"""Fill-in-middle transformation with piece tables.

A document is a row of descriptors (buffer, start, length) over two immutable
buffers: its own UTF-8 bytes, and one of the three sentinels. Cutting a document
splits its descriptor in three, an arrangement puts descriptors in another order
with sentinels in between, and only rendering or hashing ever reads bytes, piece by
piece. Restoring makes descriptors over the rendered bytes, one for each stretch
between sentinels, and puts them back by the inverse permutation.

Where a document is cut, and its form, come from a hash of the seed and its doc_id,
so a lost task gives the same rows again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lacuna.llm.words import flat, map_batches, text_rows

#: The sentinels, and for each form the parts in the order of the output.
PREFIX, SUFFIX, MIDDLE = 0, 1, 2
SENTINELS = (b"<P>", b"<S>", b"<M>")
ARRANGED = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Where each part stands in the text.
IN_TEXT = (PREFIX, MIDDLE, SUFFIX)
PLAIN = "plain"
SENTINEL_BUFFER = b"".join(SENTINELS)
TEXT, MARKS = 0, 1


@dataclass(frozen=True)
class Rates:
    """Seed of the draws, per cent of documents rearranged, and per cent of these as spm."""

    seed: int = 7
    rearranged: int = 100
    spm: int = 50


@dataclass(frozen=True)
class Draw:
    """The four numbers that a document's hash gives."""

    first: int
    second: int
    rearranges: int
    form: int

    @classmethod
    def of(cls, seed: int, doc_id: int | None) -> Draw:
        """A null doc_id draws like a document without digits."""
        digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return cls(*(int(digest[i : i + 8], 16) for i in range(0, 32, 8)))

    def cuts(self, units: int) -> tuple[int, int]:
        """Units before the end of the prefix and of the middle."""
        a, b = self.first % (units + 1), self.second % (units + 1)
        return min(a, b), max(a, b)

    def form_of(self, text: bytes, rates: Rates) -> str:
        if not text or any(mark in text for mark in SENTINELS):
            return PLAIN
        if self.rearranges % 100 >= rates.rearranged:
            return PLAIN
        return "spm" if self.form % 100 < rates.spm else "psm"


class PieceTable:
    """Descriptors (buffer, start, length) over a text and the sentinels."""

    def __init__(self, text: bytes, pieces: list[tuple[int, int, int]] | None = None):
        self.buffers = (memoryview(text), memoryview(SENTINEL_BUFFER))
        self.pieces = [(TEXT, 0, len(text))] if pieces is None else pieces

    def cut(self, *places: int) -> PieceTable:
        """Split at the given bytes, in rising order; a part can be empty."""
        pieces, at, todo = [], 0, list(places)
        for buffer, start, length in self.pieces:
            used = 0
            while todo and todo[0] <= at + length:
                size = todo.pop(0) - at - used
                pieces.append((buffer, start + used, size))
                used += size
            pieces.append((buffer, start + used, length - used))
            at += length
        return PieceTable(self.buffers[TEXT].obj, pieces)

    def arranged(self, form: str) -> PieceTable:
        """The three parts in the order of the form, each behind its sentinel."""
        of_part = dict(zip(IN_TEXT, self.pieces))
        pieces, at = [], 0
        starts = []
        for mark in SENTINELS:
            starts.append(at)
            at += len(mark)
        for part in ARRANGED[form]:
            pieces += [(MARKS, starts[part], len(SENTINELS[part])), of_part[part]]
        return PieceTable(self.buffers[TEXT].obj, pieces)

    @classmethod
    def of_output(cls, output: bytes, form: str) -> PieceTable:
        """Descriptors over an output, in the order of the text it was made from."""
        order = ARRANGED[form]
        marks, at = [], 0
        for part in order:
            # No part holds a sentinel, and none can arise where two pieces meet.
            at = output.index(SENTINELS[part], at)
            marks.append(at)
            at += len(SENTINELS[part])
        ends = [*marks[1:], len(output)]
        found = {}
        for part, mark, end in zip(order, marks, ends):
            start = mark + len(SENTINELS[part])
            found[part] = (TEXT, start, end - start)
        return cls(output, [found[part] for part in IN_TEXT])

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start : start + length]

    def sha256(self) -> str:
        digest = sha256()
        for part in self.stream():
            digest.update(part)
        return digest.hexdigest()

    def render(self) -> bytes:
        return b"".join(self.stream())


def restored(output: bytes, form: str) -> PieceTable:
    """The text that an output of this form was made from."""
    return PieceTable(output) if form == PLAIN else PieceTable.of_output(output, form)


class Texts:
    """The texts of a batch as bytes, with the ends of their lines."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = flat(column)
        self.whole = self.data.tobytes()
        # A line ends behind a line feed, and where the text does.
        feeds = np.flatnonzero(self.data == 0x0A) + 1
        last = self.offsets[1:][np.diff(self.offsets) > 0]
        self.ends = np.union1d(feeds, last)
        self.first_end = np.searchsorted(self.ends, self.offsets, side="right")
        self.first_end[0] = 0
        #: Code points before each byte.
        self.points = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])

    def text(self, i: int) -> bytes:
        return self.whole[self.offsets[i] : self.offsets[i + 1]]

    def units(self, i: int) -> int:
        return int(self.first_end[i + 1] - self.first_end[i])

    def place(self, i: int, units: int) -> int:
        """The byte of text i behind this many lines."""
        return int(self.ends[self.first_end[i] + units - 1] - self.offsets[i]) if units else 0

    def chars(self, i: int, start: int, end: int) -> int:
        base = self.offsets[i]
        return int(self.points[base + end] - self.points[base + start])


def _each(batch: pa.RecordBatch, rates: Rates) -> Iterator[tuple]:
    """(units, form, prefix and middle characters, piece table) of each row."""
    texts = Texts(batch.column("text"))
    for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
        draw, text, units = Draw.of(rates.seed, doc_id), texts.text(i), texts.units(i)
        form = draw.form_of(text, rates)
        if form == PLAIN:
            yield units, form, None, None, PieceTable(text)
            continue
        a, b = (texts.place(i, k) for k in draw.cuts(units))
        pieces = PieceTable(text).cut(a, b).arranged(form)
        yield units, form, texts.chars(i, 0, a), texts.chars(i, a, b), pieces


def transform(documents: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """Every row of ``documents`` with its text rearranged, and its ``form``.

    Other columns stay as they are; one named ``form`` is replaced. A null text
    becomes an empty one. Repeated rows are worked on one by one.
    """
    names = [c for c in documents.columns if c != "form"]
    inner = [c if c in ("doc_id", "text") else f"beside_{i}" for i, c in enumerate(names)]
    rows = documents.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(names, inner)))
    rows = rows.withColumns({"text": F.coalesce("text", F.lit("")), "doc_id": F.col("doc_id").cast("long")})

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [(pieces.render().decode(), form) for _, form, _, _, pieces in _each(batch, rates)]
        at = batch.schema.get_field_index("text")
        out = batch.set_column(at, "text", pa.array([text for text, _ in made], pa.string()))
        return out.append_column("form", pa.array([form for _, form in made], pa.string()))

    schema = StructType([*rows.schema.fields, StructField("form", StringType())])
    return map_batches(rows, work, schema).toDF(*names, "form")


def restore(documents: DataFrame) -> DataFrame:
    """The rows of ``transform`` with their first texts; a row without a known form stops the job."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        forms, texts = batch.column("form").to_pylist(), batch.column("text").to_pylist()
        made = [restored(text.encode(), form).render().decode() for text, form in zip(texts, forms)]
        at = batch.schema.get_field_index("text")
        return batch.set_column(at, "text", pa.array(made, pa.string()))

    names = documents.columns
    inner = [c if c in ("form", "text") else f"beside_{i}" for i, c in enumerate(names)]
    rows = documents.toDF(*inner).withColumn("text", F.coalesce("text", F.lit("")))
    return map_batches(rows, work, rows.schema).toDF(*names)


_DIGESTS = {
    "n": LongType(),
    "form": StringType(),
    "prefix_chars": LongType(),
    "middle_chars": LongType(),
    "output_sha256": StringType(),
    "restored_sha256": StringType(),
}


def digests(documents: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """What ``transform`` and ``restore`` give for each (doc_id, text), as counts and hashes.

    ``n`` counts lines. Both character counts are null for a document left plain. A
    null text counts as empty, which stays plain with no line. Repeated rows give a
    row each.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [[] for _ in _DIGESTS]
        for units, form, prefix, middle, pieces in _each(batch, rates):
            back = restored(pieces.render(), form)
            row = (units, form, prefix, middle, pieces.sha256(), back.sha256())
            for column, value in zip(columns, row):
                column.append(value)
        types = [pa.int64() if isinstance(t, LongType) else pa.string() for t in _DIGESTS.values()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *map(pa.array, columns, types)], ["doc_id", *_DIGESTS]
        )

    rows = text_rows(documents.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", "text")
    fields = [StructField(name, kind) for name, kind in _DIGESTS.items()]
    return map_batches(rows, work, StructType([StructField("doc_id", LongType()), *fields]))


def middle_query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(documents.select("doc_id", "text"))


def _lines(start: str, end: str) -> str:
    """The lines after ``start`` up to ``end``, as SQL."""
    close = f"CASE WHEN {end} > {start} AND {end} <= feeds THEN chr(10) ELSE '' END"
    return f"array_to_string(parts[{start} + 1 : {end}], chr(10)) || {close}"


#: Equivalent SQL. The text of the restored document is built from the output's parts.
MIDDLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         sha256('{Rates.seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (
  SELECT r, doc_id, t, string_split(t, chr(10)) AS parts,
         length(t) - length(replace(t, chr(10), '')) AS feeds,
         ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
n AS (SELECT *, feeds + (t <> '' AND NOT ends_with(t, chr(10)))::BIGINT AS n FROM h),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                   OR h3 % 100 >= {Rates.rearranged} THEN 'plain'
              WHEN h4 % 100 < {Rates.spm} THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, {_lines("0", "a")} AS prefix, {_lines("a", "b")} AS middle, {_lines("b", "n")} AS suffix FROM c),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN t
                      WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(output) AS output_sha256,
       sha256(CASE form
         WHEN 'plain' THEN output
         WHEN 'psm' THEN string_split(substr(output, 4), '<S>')[1] || string_split(output, '<M>')[2]
                         || string_split(string_split(output, '<S>')[2], '<M>')[1]
         ELSE string_split(string_split(output, '<P>')[2], '<M>')[1] || string_split(output, '<M>')[2]
              || string_split(substr(output, 4), '<P>')[1] END) AS restored_sha256
FROM o
"""
