"""Language-model scores from a hierarchical Pitman-Yor model of words.

A token's context is the word before it. Context restaurants share the parent of
their class (the word's last byte and a hash of its last three; ``COARSE`` classes),
and these share the root. Within its class a word has one of ``WORDS`` hashed places,
so ``FINE`` restaurants at most; words of one class and place share a restaurant. Every
word type has one table at the root; the root's base is uniform over the types and
one unknown word, so that a word never seen in training has that share of the mass
of a new table.

Training tokens are dealt by word, with everything about a word in one part: its
counts by context, and in which documents it stands. There are as many parts as
the bytes of text ask for, so a part stays of one size as the input grows. A Gibbs sweep seats all
customers of a part anew, given the restaurants' totals after the sweep before
(bounded by the number of contexts, so they go to every task). The seating of a
part is drawn from numbers fixed by part and sweep, so a later pass or a lost
task draws it again and only totals are kept between passes. Beyond ``SINGLE``
customers of a word in a context, customers sit down in blocks that double, with
the chance of a new table taken at the block's middle.

A token's chance is the mean over the sweeps after ``BURN_IN``; a document's score is
the sum of their logarithms over its words and its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import settle
from lacuna.llm.classifier import in_fold
from lacuna.llm.words import SpanHash, flat, lower_ascii, mix, owner, split_batch, word_spans

COARSE = 1024
WORDS = 1024
FINE = COARSE * WORDS
SWEEPS = 4
BURN_IN = 1
SINGLE = 32
#: Discount and strength of the context, parent and root restaurants.
DISCOUNT = (0.8, 0.8, 0.8)
STRENGTH = (1.0, 1.0, 1.0)
#: Tokens and documents that a task counts together.
BUCKET_TOKENS = 2_000_000
BUCKET_DOCS = 60_000
LEAST_PARTS = 64
#: Bytes of text for each part of words.
PART_BYTES = 32_000_000
#: Totals that travel together.
SLICE = 1 << 16
END = np.uint64(0x2545F4914F6CDD1D)
SEED = 20_000


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, context) of every token, each text's words in order and its end last."""
    data, offsets = flat(texts)
    data = lower_ascii(data)
    starts, ends = word_spans(data, offsets)
    text = owner(offsets, starts)
    hashes = SpanHash(data)
    words = hashes(starts, ends)
    kind = hashes(np.maximum(starts, ends - 3), ends) % np.uint64(COARSE // 64)
    last = data[ends - 1].astype(np.int64) % 64 if len(ends) else np.zeros(0, np.int64)
    group = last * (COARSE // 64) + kind.astype(np.int64)
    after = group * WORDS + (mix(words) % np.uint64(WORDS)).astype(np.int64)
    n_words = np.bincount(text, minlength=len(texts))
    place = np.arange(len(starts)) + text
    size = len(starts) + len(texts)
    of_text = np.repeat(np.arange(len(texts)), n_words + 1)
    word = np.full(size, END, np.uint64)
    word[place] = words
    context = np.zeros(size, np.int64)
    context[place + 1] = after
    return of_text, word, context


class _Bucket:
    """Documents that a task counts together, as rows for the parts of words."""

    def __init__(self, number: int, parts: int):
        self.number, self.parts = number, parts
        self.words, self.contexts, self.docs = [], [], []
        self.n_tokens = self.n_docs = 0
        self.ids: list[pa.Array] = []
        self.held: list[np.ndarray] = []

    def add(self, batch: pa.RecordBatch) -> None:
        text, word, context = tokens(batch.column("text"))
        self.words.append(word)
        self.contexts.append(context.astype(np.uint32))
        self.docs.append(text.astype(np.uint32) + np.uint32(self.n_docs))
        self.ids.append(batch.column("doc_id"))
        self.held.append(batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool))
        self.n_tokens += len(word)
        self.n_docs += batch.num_rows

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.n_docs:
            return
        word, context = np.concatenate(self.words), np.concatenate(self.contexts)
        doc, held = np.concatenate(self.docs), np.concatenate(self.held)
        lengths = np.bincount(doc, minlength=self.n_docs)
        self.words.clear(), self.contexts.clear(), self.docs.clear()
        part = (word % np.uint64(self.parts)).astype(np.uint32)
        # Tokens already stand in the order of documents; the sort keeps it.
        order = np.argsort(context, kind="stable")
        order = order[np.argsort(word[order], kind="stable")]
        order = order[np.argsort(part[order], kind="stable")]
        word, context, doc, part = word[order], context[order], doc[order], part[order]
        pair = np.ones(len(word), bool)
        pair[1:] = (word[1:] != word[:-1]) | (context[1:] != context[:-1])
        entry = pair.copy()
        entry[1:] |= doc[1:] != doc[:-1]
        pair_at, entry_at = np.flatnonzero(pair), np.flatnonzero(entry)
        counts = np.diff(np.append(entry_at, len(word)))
        entry_pair = np.cumsum(pair)[entry_at] - 1
        trained = np.bincount(entry_pair, counts * ~held[doc[entry_at]], len(pair_at))
        entries = np.bincount(entry_pair, minlength=len(pair_at))
        part_pairs = np.searchsorted(part[pair_at], np.arange(self.parts + 1))
        part_entries = np.concatenate([[0], np.cumsum(entries)])[part_pairs]
        for k in range(self.parts):
            a, b = part_pairs[k : k + 2]
            if a == b:
                continue
            of_pairs, of_entries = pair_at[a:b], slice(*part_entries[k : k + 2])
            blobs = [
                _packed(word[of_pairs]),
                _packed(context[of_pairs]),
                _packed(trained[a:b].astype(np.uint32)),
                _packed(entries[a:b].astype(np.uint32)),
                _packed(doc[entry_at[of_entries]].astype(np.uint16)),
                _packed(counts[of_entries].astype(np.uint32)),
            ]
            yield _row(int(k), self.number, *blobs)
        ids = pa.concat_arrays(self.ids)
        yield _row(
            self.number % self.parts,
            self.number,
            _packed(ids.fill_null(0).to_numpy().astype(np.int64)),
            _packed(ids.is_null().to_numpy(zero_copy_only=False)),
            _packed(held),
            _packed(lengths.astype(np.int64)),
            None,
            None,
        )


_BLOBS = ("word", "context", "trained", "entries", "doc", "count")
_COUNTED = "part int, bucket long, " + ", ".join(f"{c} binary" for c in _BLOBS)


def _row(part: int, bucket: int, *blobs: bytes | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([bucket], pa.int64())]
        + [pa.array([blob], pa.binary()) for blob in blobs],
        ["part", "bucket", *_BLOBS],
    )


def _count(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 24
    bucket = _Bucket(number, parts)
    for batch in batches:
        for piece in split_batch(batch):
            if bucket.n_tokens >= BUCKET_TOKENS or bucket.n_docs + piece.num_rows > BUCKET_DOCS:
                yield from bucket.rows()
                number += 1
                bucket = _Bucket(number, parts)
            bucket.add(piece)
    yield from bucket.rows()


# One row for each part: its pairs of word and context, and by bucket the
# documents these stand in. ``about`` rows carry a bucket's documents instead.
_MERGED = (
    "part int, pair_word binary, pair_context binary, trained binary, "
    "buckets array<struct<bucket:long,pair:binary,entries:binary,doc:binary,count:binary>>, "
    "about array<struct<bucket:long,ids:binary,nulls:binary,held:binary,lengths:binary>>"
)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by part to one row for each part."""
    kept: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if kept and kept[0]["part"] != row["part"]:
                yield _merged(kept)
                kept = []
            kept.append(row)
    if kept:
        yield _merged(kept)


def _merged(rows: list[dict]) -> pa.RecordBatch:
    rows.sort(key=lambda r: (r["doc"] is None, r["bucket"]))
    counted = [r for r in rows if r["doc"] is not None]
    words = [_unpacked(r["word"], "<u8") for r in counted]
    contexts = [_unpacked(r["context"], "<u4") for r in counted]
    word = np.concatenate([np.zeros(0, "<u8"), *words])
    context = np.concatenate([np.zeros(0, "<u4"), *contexts])
    trained = np.concatenate([np.zeros(0, "<u4"), *(_unpacked(r["trained"], "<u4") for r in counted)])
    order = np.lexsort([context, word])
    word, context = word[order], context[order]
    new = np.ones(len(order), bool)
    new[1:] = (word[1:] != word[:-1]) | (context[1:] != context[:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    totals = np.bincount(number, trained, int(new.sum())).astype(np.int64)
    buckets, at = [], 0
    for row, own in zip(counted, words):
        pair = np.diff(number[at : at + len(own)], prepend=0)
        at += len(own)
        buckets.append(
            {
                "bucket": row["bucket"],
                "pair": _packed(pair.astype("<u4")),
                "entries": row["entries"],
                "doc": row["doc"],
                "count": row["count"],
            }
        )
    about = [
        {"bucket": r["bucket"], "ids": r["word"], "nulls": r["context"], "held": r["trained"], "lengths": r["entries"]}
        for r in rows
        if r["doc"] is None
    ]
    blob = pa.binary()
    bucket_type = pa.struct([("bucket", pa.int64()), *((c, blob) for c in ("pair", "entries", "doc", "count"))])
    about_type = pa.struct([("bucket", pa.int64()), *((c, blob) for c in ("ids", "nulls", "held", "lengths"))])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([rows[0]["part"]], pa.int32()),
            pa.array([_packed(word[new])], blob),
            pa.array([_packed(context[new])], blob),
            pa.array([_packed(totals)], blob),
            pa.array([buckets], pa.list_(bucket_type)),
            pa.array([about], pa.list_(about_type)),
        ],
        ["part", "pair_word", "pair_context", "trained", "buckets", "about"],
    )


def _seat(
    customers: np.ndarray, new_mass: np.ndarray, discount: float, rng: np.random.Generator
) -> np.ndarray:
    """Tables of each word in each restaurant after all its customers sat down."""
    tables = np.minimum(customers, 1)
    at = np.flatnonzero(customers > 1)
    seated = 1
    while len(at):
        block = 1 if seated < SINGLE else seated
        block = np.minimum(block, customers[at] - seated)
        middle = seated + (block - 1) / 2
        chance = new_mass[at] / (new_mass[at] + np.maximum(middle - discount * tables[at], 1e-9))
        if seated < SINGLE:
            tables[at] += rng.random(len(at)) < chance
            seated += 1
        else:
            tables[at] += rng.binomial(block, chance)
            seated *= 2
        at = at[customers[at] > seated]
    return tables


class Part:
    """The restaurants' customers and tables for the words of one part."""

    def __init__(self, number: int, word: np.ndarray, context: np.ndarray, trained: np.ndarray):
        self.number = number
        self.fine = context.astype(np.int64)
        self.customers = trained
        new_word = np.ones(len(word), bool)
        new_word[1:] = word[1:] != word[:-1]
        self.word = np.cumsum(new_word) - 1
        self.n_words = int(new_word.sum())
        own = self.fine // WORDS
        new = new_word.copy()
        new[1:] |= own[1:] != own[:-1]
        self.parent = np.cumsum(new) - 1  # of a pair, its word in the coarse restaurant
        self.coarse, self.parent_word = own[new], self.word[new]
        self.counts = np.bincount(self.word, trained, self.n_words).astype(np.int64)
        self.tables = np.minimum(trained, 1)
        self._gather()
        self.parent_tables = np.minimum(self.parent_customers, 1)

    def _gather(self) -> None:
        self.parent_customers = np.bincount(self.parent, self.tables, len(self.coarse)).astype(np.int64)

    def root_customers(self) -> np.ndarray:
        return np.bincount(self.parent_word, self.parent_tables, self.n_words)

    def root_chance(self, totals: SimpleNamespace) -> np.ndarray:
        """Of each word; a word without customers has the base's share alone."""
        customers, tables = totals.root  # one table for each type
        own = self.root_customers()
        base = (STRENGTH[2] + DISCOUNT[2] * tables) / (tables + 1)
        return (np.where(own > 0, own - DISCOUNT[2], 0) + base) / (STRENGTH[2] + customers)

    def parent_chance(self, totals: SimpleNamespace) -> np.ndarray:
        customers, tables = totals.coarse[:, self.coarse]
        new = STRENGTH[1] + DISCOUNT[1] * tables
        own = self.parent_customers - DISCOUNT[1] * self.parent_tables
        return (own + new * self.root_chance(totals)[self.parent_word]) / (STRENGTH[1] + customers)

    def chance(self, totals: SimpleNamespace) -> np.ndarray:
        """Of the word of each pair in its context."""
        customers, tables = (of_all[self.fine] for of_all in totals.fine)
        new = STRENGTH[0] + DISCOUNT[0] * tables
        own = self.customers - DISCOUNT[0] * self.tables
        return (own + new * self.parent_chance(totals)[self.parent]) / (STRENGTH[0] + customers)

    def sweep(self, number: int, totals: SimpleNamespace) -> None:
        rng = np.random.default_rng([SEED, self.number, number])
        tables = totals.fine[1][self.fine]
        mass = (STRENGTH[0] + DISCOUNT[0] * tables) * self.parent_chance(totals)[self.parent]
        self.tables = _seat(self.customers, mass, DISCOUNT[0], rng)
        self._gather()
        # The parents' tables can be no more than their new customers.
        self.parent_tables = np.minimum(self.parent_tables, self.parent_customers)
        tables = totals.coarse[1][self.coarse]
        mass = (STRENGTH[1] + DISCOUNT[1] * tables) * self.root_chance(totals)[self.parent_word]
        self.parent_tables = _seat(self.parent_customers, mass, DISCOUNT[1], rng)

    def numbers(self) -> np.ndarray:
        """Customers and tables of every restaurant, then training tokens and types."""
        types = int((self.counts > 0).sum())
        found = [
            np.bincount(self.fine, self.customers, FINE),
            np.bincount(self.fine, self.tables, FINE),
            np.bincount(self.coarse, self.parent_customers, COARSE),
            np.bincount(self.coarse, self.parent_tables, COARSE),
            [self.root_customers().sum(), types, self.counts.sum(), types],
        ]
        return np.concatenate(found).astype(np.int64)


_SLICES = "slice int, numbers binary"


def _slices(numbers: np.ndarray) -> pa.RecordBatch:
    """The slices in which some number is not zero."""
    cut = {k: numbers[k * SLICE : (k + 1) * SLICE] for k in range(-(-len(numbers) // SLICE))}
    cut = {k: part for k, part in cut.items() if part.any()}
    return _slice_rows(list(cut), list(cut.values()))


def _slice_rows(places: list[int], numbers: list[np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array(places, pa.int32()), pa.array(list(map(_packed, numbers)), pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["slice", "numbers"])


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the parts; a task has few of the slices, whatever their number of rows."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for place, packed in zip(*(batch.column(i).to_pylist() for i in range(2))):
            sums[place] = sums.get(place, 0) + _unpacked(packed, "<i8")
    yield _slice_rows(list(sums), list(sums.values()))


def _no_numbers() -> np.ndarray:
    return np.zeros(2 * FINE + 2 * COARSE + 4, np.int64)


def _totals(numbers: np.ndarray) -> SimpleNamespace:
    """Customers and tables of all restaurants, and the training tokens and types.

    A plain object, as a broadcast has to be read without this package.
    """
    n = numbers.astype(np.float64)
    return SimpleNamespace(
        fine=[n[:FINE], n[FINE : 2 * FINE]],
        coarse=n[2 * FINE : -4].reshape(2, COARSE),
        root=n[-4:-2],
        tokens=int(numbers[-2]),
        types=int(numbers[-1]),
    )


def _total(slices: DataFrame) -> SimpleNamespace:
    """The sums over all parts; how many come to the driver is fixed by the restaurants' number."""
    numbers = _no_numbers()
    summed = slices.repartition(-(-len(numbers) // SLICE), "slice").mapInArrow(
        lambda batches: _add_slices(batches), _SLICES
    )
    for place, packed in summed.collect():
        own = _unpacked(packed, "<i8")
        numbers[place * SLICE : place * SLICE + len(own)] = own
    return _totals(numbers)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Part]]:
    """Each part as it is before the first sweep."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            part = Part(
                row["part"],
                _unpacked(row["pair_word"], "<u8"),
                _unpacked(row["pair_context"], "<u4"),
                _unpacked(row["trained"], "<i8"),
            )
            yield row, part


def _read(known: list) -> list[SimpleNamespace]:
    """The totals after every sweep; the contexts' customers stay, so only the first have them."""
    history = [totals.value for totals in known]
    for totals in history:
        totals.fine[0] = history[0].fine[0]
    return history


def _n_parts(documents: DataFrame) -> int:
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST_PARTS, -(-int(size) // PART_BYTES))


def fit(documents: DataFrame) -> tuple[DataFrame, list, int]:
    """The parts as a kept table, the totals after every sweep and the training tokens.

    ``documents`` has doc_id, text (no nulls) and held_out (learn from the others).
    """
    parts = _n_parts(documents)
    counted = documents.select("doc_id", "text", "held_out").mapInArrow(
        lambda batches: _count(batches, parts), _COUNTED
    )
    merged = settle(
        counted.repartition(parts, "part")
        .sortWithinPartitions("part")
        .mapInArrow(lambda batches: _merge(batches), _MERGED)
    )
    counts = merged.select("part", "pair_word", "pair_context", "trained")
    known: list = []
    for _ in range(SWEEPS + 1):

        def summarise(batches: Iterator[pa.RecordBatch], known=tuple(known)) -> Iterator[pa.RecordBatch]:
            history = _read(known)
            for _, part in _parts(batches):
                for number, totals in enumerate(history):
                    part.sweep(number, totals)
                yield _slices(part.numbers())

        totals = _total(counts.mapInArrow(summarise, _SLICES))
        if known:
            totals.fine[0] = None
        known.append(documents.sparkSession.sparkContext.broadcast(totals))
    return merged, known, totals.tokens


_SUMS = "bucket long, doc binary, base binary, score binary, known binary, about boolean"


def _sums(batches: Iterator[pa.RecordBatch], history: list[SimpleNamespace]) -> Iterator[pa.RecordBatch]:
    """By part and bucket, the documents' sums over the tokens of the part."""
    total = history[-1]
    floor = np.log10(total.tokens + total.types + 1)

    def row(bucket: int, about: bool, *blobs: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([bucket], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs), pa.array([about])],
            ["bucket", "doc", "base", "score", "known", "about"],
        )

    for given, part in _parts(batches):
        chance = np.zeros(len(part.fine))
        for number, totals in enumerate(history[:-1]):
            part.sweep(number, totals)
            if number >= BURN_IN:
                chance += part.chance(history[number + 1])
        score = np.log10(chance / (SWEEPS - BURN_IN)) if len(chance) else chance
        base = (np.log10(part.counts + 1) - floor)[part.word]
        known = part.counts[part.word] > 0
        for own in given["buckets"]:
            pair = np.cumsum(_unpacked(own["pair"], "<u4").astype(np.int64))
            pair = np.repeat(pair, _unpacked(own["entries"], "<u4"))
            doc = _unpacked(own["doc"], "<u2").astype(np.int64)
            count = _unpacked(own["count"], "<u4").astype(np.float64)
            used = np.flatnonzero(np.bincount(doc))
            sums = [np.bincount(doc, count * x[pair])[used] for x in (base, score, known)]
            yield row(
                own["bucket"],
                False,
                _packed(used.astype("<u2")),
                _packed(sums[0]),
                _packed(sums[1]),
                _packed(sums[2].astype("<u4")),
            )
        for own in given["about"]:
            yield row(own["bucket"], True, own["ids"], own["nulls"], own["held"], own["lengths"])


_SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double"
)


def _finish(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[pa.RecordBatch]:
    """Rows ordered by bucket, each bucket's documents first, to one row for each document."""
    about, sums, bucket = None, None, None

    def done() -> pa.RecordBatch:
        ids = pa.array(_unpacked(about["doc"], "<i8"), mask=_unpacked(about["base"], "?"))
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array(_unpacked(about["score"], "?")),
                pa.array(_unpacked(about["known"], "<i8")),
                pa.array(sums[2].astype(np.int64)),
                pa.array(np.full(n, tokens, np.int64)),
                pa.array(sums[0]),
                pa.array(sums[1]),
            ],
            [c.split()[0] for c in _SCORED.split(", ")],
        )

    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if row["bucket"] != bucket:
                if about:
                    yield done()
                bucket, about = row["bucket"], row
                sums = np.zeros((3, len(_unpacked(about["doc"], "<i8"))))
                continue
            doc = _unpacked(row["doc"], "<u2")
            for total, (name, kind) in zip(sums, (("base", "<f8"), ("score", "<f8"), ("known", "<u4"))):
                total[doc] += _unpacked(row[name], kind)
    if about:
        yield done()


def score(documents: DataFrame) -> DataFrame:
    """One row for every row of ``documents`` (doc_id, text, held_out).

    A null text counts as empty and has its end alone; null held_out counts as
    false. Without any training row every token has the chance 1. The model is
    fitted when this is called.
    """
    whole = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("held_out", F.lit(False)).alias("held_out"),
    )
    merged, known, n_tokens = fit(whole)
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = merged.mapInArrow(lambda batches: _sums(batches, _read(known)), _SUMS)
    return (
        sums.repartition(tasks, "bucket")
        .sortWithinPartitions("bucket", F.desc("about"))
        .mapInArrow(lambda batches: _finish(batches, n_tokens), _SCORED)
    )


def lm_query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(documents.select("doc_id", "text", in_fold("doc_id", 7, 2).alias("held_out")))
