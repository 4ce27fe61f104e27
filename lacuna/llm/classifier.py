"""Quality classifier: logistic regression on hashed word n-grams.

A text is a sparse vector of its distinct word n-grams (n = 1, 2), hashed into
``2 ** HASH_BITS`` places. A word is a run of letters (and bytes above 127), of
digits or of other characters, so that symbols glued to a word count as words
of their own; A-Z are lower-cased. All pairs of a word with itself count as one
n-gram. A place has the value ``(1 + ln count) / norm``; place 0 is the constant 1.

Training follows the regularised leader (FTRL-proximal) on at most ``FIT_ROWS``
labelled texts, those with the smallest hashes of their doc_id; whole texts are
used. As the bound does not depend on the corpus, one learner in one task reads
them in the order of their hashes. The score is the sparse dot product of a text
with the weights, through the logistic function.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lacuna.llm.words import (
    SpanHash,
    flat,
    lower_ascii,
    map_batches,
    mix,
    owner,
    runs,
    split_batch,
    text_rows,
)

HASH_BITS = 18
#: Most labelled texts used for fitting.
FIT_ROWS = 10_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 5.0, 1.0, 0.005, 0.0
THRESHOLD = 0.3
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[range(0x30, 0x3A)] = 2


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds = _KIND[data]
    spans = [runs(kinds == kind, offsets) for kind in (1, 2, 3)]
    starts, ends = (np.concatenate(x) for x in zip(*spans))
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, value) of all hashed n-grams, ordered by text."""
    data, offsets = flat(texts)
    data = lower_ascii(data)
    starts, ends = _words(data, offsets)
    words, text = SpanHash(data)(starts, ends), owner(offsets, starts)
    pairs = mix(words[:-1] * np.uint64(3) + words[1:])
    pairs[words[:-1] == words[1:]] = mix(np.ones(1, np.uint64))
    same = text[:-1] == text[1:]
    grams = np.concatenate([words, pairs[same]])
    at = np.concatenate([text, text[:-1][same]])
    place = (grams >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    place[place == 0] = 1
    keys, counts = np.unique((at << HASH_BITS) | place, return_counts=True)
    at, place = keys >> HASH_BITS, keys & ((1 << HASH_BITS) - 1)
    value = 1 + np.log(counts)
    norm = np.sqrt(np.bincount(at, value * value, len(texts)))
    value /= norm[at]
    bias = np.arange(len(texts))
    at = np.concatenate([bias, at])
    order = np.argsort(at, kind="stable")
    place = np.concatenate([np.zeros(len(texts), np.int64), place])
    value = np.concatenate([np.ones(len(texts)), value])
    return at[order], place[order], value[order]


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


def _learn(rows: pd.DataFrame) -> pd.DataFrame:
    """FTRL-proximal over the texts in the order of their hashes."""
    rows = rows.sort_values(["order", "doc_id"], kind="stable")
    sizes, places, values = [], [], []
    # A part of the texts at a time: only their features are kept.
    for part in split_batch(pa.RecordBatch.from_arrays([pa.array(rows["text"], pa.string())], ["text"])):
        at, place, value = features(part.column("text"))
        sizes.append(np.bincount(at, minlength=part.num_rows))
        places.append(place.astype(np.int32))
        values.append(value.astype(np.float32))
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    place, value = np.concatenate(places), np.concatenate(values)
    labels = rows["label"].to_numpy(np.float64)
    z, n = np.zeros(1 << HASH_BITS), np.zeros(1 << HASH_BITS)
    for _ in range(EPOCHS):
        for i, label in enumerate(labels):
            own, x = place[bounds[i] : bounds[i + 1]], value[bounds[i] : bounds[i + 1]]
            w = _weights(z[own], n[own])
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            after = n[own] + g * g
            z[own] += g - (np.sqrt(after) - np.sqrt(n[own])) / ALPHA * w
            n[own] = after
    w = _weights(z, n)
    used = np.flatnonzero(w)
    return pd.DataFrame({"place": used, "weight": w[used]})


def fit(documents: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights learnt from ``labels`` (doc_id, label 0 or 1) and their texts.

    Several labels of a doc_id are averaged (a tie counts as 1); null labels
    and doc_ids are left out. Without any label all weights are zero.
    """
    order = F.xxhash64("doc_id")
    chosen = (
        labels.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg((F.avg("label") >= 0.5).cast("int").alias("label"))
        .join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
        .withColumn("order", order)
        .orderBy("order", "doc_id")
        .limit(FIT_ROWS)
    )
    # Repeated rows of one doc_id must not exceed the bound either.
    texts = (
        text_rows(documents, "doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .orderBy("order", "doc_id", F.xxhash64("text"))
        .limit(FIT_ROWS)
    )
    learnt = texts.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(
        lambda rows: _learn(rows), "place long, weight double"
    )
    used = learnt.toPandas()  # one row per place at most
    weights = np.zeros(1 << HASH_BITS)
    weights[used["place"]] = used["weight"]
    return weights


def score(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """All rows and columns with ``score``; a null or empty text has the constant's score.

    A column of that name is replaced.
    """
    documents = documents.drop("score")
    shared = documents.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = shared.value
        texts = batch.column(batch.schema.get_field_index("text"))
        at, place, value = features(texts)
        total = np.bincount(at, w[place] * value, batch.num_rows)
        scores = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
        return batch.append_column("score", pa.array(scores))

    out = StructType([*documents.schema.fields, StructField("score", DoubleType())])
    return map_batches(documents, work, out)


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``score`` and ``predicted`` (1 from THRESHOLD up) for every row of ``documents``."""
    scored = score(documents, fit(documents, labels))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def in_fold(doc_id: str, folds: int, fold: int):
    """Whether crc32 of the doc_id as text leaves the remainder ``fold``; null is in none."""
    remainder = F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds
    return F.coalesce(remainder == fold, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """The quality labels outside the held-out fold (remainder 0 of 5)."""
    return labels.filter(~in_fold("doc_id", 5, 0)).select(
        "doc_id", F.col("quality").cast("double").alias("label")
    )


def quality_query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = classify(documents.select("doc_id", "text"), training_labels(labels))
    return scored.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score", "predicted")
