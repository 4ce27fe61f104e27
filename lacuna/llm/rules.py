"""Quality rules: repetition within a document, and lines that many documents of a host share.

A line is normalised to its sequence of words with A-Z in lower case, and hashed.
A line is boilerplate on a host when at least ``LIMIT_DOCS`` distinct documents of
that host and more than ``LIMIT_SHARE`` of them hold it. Copies of one document
must not make its own lines boilerplate: documents of a host that agree in all
their normalised lines, in order, count as one. No single line decides that, so
documents that share many lines, or hold no others, still count one by one.
Boilerplate lines are removed; a document that loses more than
``DEPLETED_SHARE`` of its words with them is depleted and rejected.

Every shuffle carries hashes and counts only, combined before it, so neither a
host nor a line with a large part of all rows meets in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from lacuna.functions import settle
from lacuna.llm.words import (
    MULTIPLIER,
    SpanHash,
    flat,
    lower_ascii,
    map_batches,
    mix,
    owner,
    powers,
    word_spans,
)

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
LIMIT_DOCS = 20
LIMIT_SHARE = 0.01
DEPLETED_SHARE = 0.6
#: Boilerplate lines up to which they are sent to every task; beyond, Spark joins them.
BROADCAST_LINES = 200_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_text(n: int, text: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(text, weights, n).astype(np.int64)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Positions of the values that occur more than once."""
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    return order[np.append(same, False) | np.append(False, same)] if len(keys) else order


def _sequences(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of runs of words; runs of the same words in the same order agree."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(len(hashes), MULTIPLIER), out=sums[1:])
    back = powers(len(hashes) + 1, pow(MULTIPLIER, -1, 2**64))
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def measure(texts: pa.Array) -> tuple[dict[str, np.ndarray], pa.Array]:
    """The counts of every text, and its lines with a word: hash, line number, words."""
    n = len(texts)
    data, offsets = flat(texts)
    starts, ends = word_spans(data, offsets)
    text = owner(offsets, starts)
    out = {"n_words": _per_text(n, text)}
    first_bytes = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out["word_chars"] = _per_text(n, text, first_bytes[ends] - first_bytes[starts])
    out["n_symbols"] = _per_text(n, owner(offsets, np.flatnonzero(_SYMBOL[data])))

    exact = SpanHash(data)
    words = exact(starts, ends)
    salt = mix(text.astype(np.uint64) + np.uint64(1))
    i = np.arange(max(0, len(words) - WINDOW + 1))
    i = i[text[i] == text[i + WINDOW - 1]]
    found = i[_repeated(_sequences(words, i, i + WINDOW) ^ salt[i])]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + WINDOW, -1)
    out["n_repeat_words"] = _per_text(n, text[np.cumsum(cover[:-1]) > 0])

    # Lines lie between the bounds of a text and its newlines.
    newlines = np.flatnonzero(data == 0x0A)
    per_text = 1 + _per_text(n, owner(offsets, newlines))
    begin = np.sort(np.concatenate([offsets[:-1], newlines + 1]))
    end = np.sort(np.concatenate([offsets[1:], newlines]))
    line_text = np.repeat(np.arange(n), per_text)
    number = np.arange(len(begin)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    first_word, past_word = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    full = past_word > first_word
    begin, end, line_text, number = begin[full], end[full], line_text[full], number[full]
    first_word, past_word = first_word[full], past_word[full]
    per_text = _per_text(n, line_text)
    out["n_dup_lines"] = per_text - _distinct(n, exact(begin, end), line_text)
    lower = SpanHash(lower_ascii(data))(starts, ends)
    lines = pa.StructArray.from_arrays(
        [
            pa.array(_sequences(lower, first_word, past_word).view(np.int64)),
            pa.array(number, pa.int32()),
            pa.array(past_word - first_word, pa.int32()),
        ],
        ["line", "at", "words"],
    )
    ends_at = np.concatenate([[0], np.cumsum(per_text)])
    return out, pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), lines)


def _distinct(n: int, hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    order = np.lexsort([hashes, text])
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(text[order]) != 0) | (hashes[order][1:] != hashes[order][:-1])
    return _per_text(n, text[order][new])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    )


def _measured(documents: DataFrame, host: str, columns: list[str]) -> DataFrame:
    """(columns, row, host hash, counts, lines), kept as a table; ``row`` numbers the rows."""
    named = [F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]
    host_key = F.xxhash64(F.coalesce(F.col(host).cast("string"), F.lit(""))).alias("host")
    rows = documents.select(*named, host_key, F.coalesce("text", F.lit("")).alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index("text")
        counts, lines = measure(batch.column(at))
        kept = [c for i, c in enumerate(batch.columns) if i != at]
        names = [c for i, c in enumerate(batch.schema.names) if i != at]
        return pa.RecordBatch.from_arrays(
            [*kept, *(pa.array(counts[c]) for c in COUNTS), lines], [*names, *COUNTS, "lines"]
        )

    line = StructType(
        [
            StructField("line", LongType()),
            StructField("at", IntegerType()),
            StructField("words", IntegerType()),
        ]
    )
    schema = StructType(
        [
            *(f for f in rows.schema.fields if f.name != "text"),
            *(StructField(c, LongType()) for c in COUNTS),
            StructField("lines", ArrayType(line)),
        ]
    )
    return settle(
        map_batches(rows, work, schema).withColumn("row", F.monotonically_increasing_id())
    )


def boilerplate(measured: DataFrame) -> DataFrame:
    """(row, at, words) of every boilerplate line of the measured rows."""
    spark = measured.sparkSession
    hashes = F.transform("lines", lambda x: x["line"])
    signed = measured.filter(F.size("lines") > 0).withColumn("copy", F.xxhash64(hashes))
    # (host, line) as one hash; a document counts a line once.
    keyed = F.transform(F.array_distinct(hashes), lambda x: F.xxhash64("host", x))
    shared = (
        signed.select("host", "copy", F.explode(keyed).alias("key"))
        .distinct()
        .groupBy("key")
        .agg(F.count("*").alias("n_docs"), F.first("host").alias("host"))
        .filter(F.col("n_docs") >= LIMIT_DOCS)
    )
    hosts = signed.select("host", "copy").distinct().groupBy("host").agg(
        F.count("*").alias("host_docs")
    )
    # The share is judged on the few common lines, before they meet the documents.
    over = F.col("n_docs") > LIMIT_SHARE * F.col("host_docs")
    shared = settle(shared.join(hosts, "host").filter(over).select("key"))
    few = shared.count() <= BROADCAST_LINES
    lines = measured.select("row", "host", F.inline("lines")).withColumn(
        "key", F.xxhash64("host", "line")
    )
    found = lines.join(F.broadcast(shared) if few else shared, "key")
    return found.select("row", "at", "words")


def judge(
    documents: DataFrame, host: str = "source", columns: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """For every row: ``columns``, the counts, base_failed, n_removed_words, removed_lines, kept.

    A null text counts as empty, and a null host as the empty one. Repeated rows
    are judged one by one.
    """
    measured = _measured(documents, host, list(columns))
    lost = (
        boilerplate(measured)
        .groupBy("row")
        .agg(F.sum("words").alias("lost"), F.sort_array(F.collect_list("at")).alias("gone"))
    )
    lost_words = F.coalesce("lost", F.lit(0)).cast("long")
    judged = measured.drop("lines", "host").join(lost, "row", "left")
    return judged.select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)),
        *COUNTS,
        base_failed().alias("base_failed"),
        lost_words.alias("n_removed_words"),
        F.coalesce("gone", F.array().cast("array<int>")).alias("removed_lines"),
        (~base_failed() & (lost_words <= DEPLETED_SHARE * F.col("n_words"))).alias("kept"),
    )


def clean(documents: DataFrame, host: str = "source") -> DataFrame:
    """The rows that are kept, without their boilerplate lines; ``n_chars`` follows if there is one."""
    judged = judge(documents, host, tuple(documents.columns)).filter("kept")
    lines = F.split("text", "\n", -1)
    rest = F.filter(lines, lambda line, at: ~F.array_contains("removed_lines", at))
    cut = F.when(F.size("removed_lines") > 0, F.array_join(rest, "\n")).otherwise(F.col("text"))
    out = judged.withColumn("text", cut)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(documents.schema["n_chars"].dataType))
    return out.select(*documents.columns)


def rules_query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = judge(documents.select("doc_id", "text", "source"))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept")


#: Equivalent SQL: windows of words and lines as text or MD5, documents of a host by their line lists.
RULES_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text
  FROM documents),
words AS (
  SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS p
  FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
windows AS (
  SELECT r, p, w, CASE WHEN lead(w, 7) OVER x IS NOT NULL THEN md5(concat_ws(' ', w,
    lead(w, 1) OVER x, lead(w, 2) OVER x, lead(w, 3) OVER x, lead(w, 4) OVER x,
    lead(w, 5) OVER x, lead(w, 6) OVER x, lead(w, 7) OVER x)) END AS k
  FROM words WINDOW x AS (PARTITION BY r ORDER BY p)),
found AS (
  SELECT r, p, w, (k IS NOT NULL AND count(*) OVER (PARTITION BY r, k) > 1)::INT AS twice FROM windows),
covered AS (
  SELECT r, w, max(twice) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c
  FROM found),
per_word AS (
  SELECT r, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars, sum(c)::BIGINT AS n_repeat_words
  FROM covered GROUP BY r),
split AS (
  SELECT r, host, unnest(ls) AS line, unnest(range(len(ls))) AS i
  FROM (SELECT r, host, string_split(text, chr(10)) AS ls FROM d)),
lines AS (
  SELECT r, host, i, line, len(ws) AS n, md5(array_to_string(ws, ' ')) AS norm
  FROM (SELECT *, regexp_extract_all(
          translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x20\x09-\x0D]+') AS ws FROM split)
  WHERE len(ws) > 0),
per_line AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, md5(string_agg(norm, '' ORDER BY i)) AS copy
  FROM lines GROUP BY r),
hosts AS (SELECT host, count(DISTINCT copy) AS host_docs FROM per_line JOIN d USING (r) GROUP BY host),
shared AS (
  SELECT host, norm FROM (
    SELECT host, norm, count(DISTINCT copy) AS n_docs FROM lines JOIN per_line USING (r)
    GROUP BY host, norm) JOIN hosts USING (host)
  WHERE n_docs >= 20 AND n_docs > 0.01::DOUBLE * host_docs),
lost AS (SELECT r, sum(n) AS lost FROM lines SEMI JOIN shared USING (host, norm) GROUP BY r),
counted AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN per_word USING (r) LEFT JOIN per_line USING (r) LEFT JOIN lost USING (r)),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND lost <= 0.6::DOUBLE * n_words AS kept
FROM judged
"""
