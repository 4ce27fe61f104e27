"""Ranked lexical search by dense blocked matrix multiplication.

Items (queries) come in blocks of a bounded number of distinct (item, term) pairs,
and every block is searched in all documents:

1. The documents are read once: each becomes its number of terms and the counts of
   the block's terms in it. These rows are kept as a table; the numbers of
   documents and terms are counted along the way, and the documents of each term
   by a grouped count.
2. Over that table, tiles of documents meet tiles of items: for a tile of the
   items' compact vocabulary, a dense matrix of weights (items x terms) is
   multiplied in float64 by a dense matrix of impacts (terms x documents). A
   vocabulary tile is no wider than keeps every partial sum below 2 ** 53, where
   float64 is exact; the partial sums are added up as 64-bit integers.
3. Each tile's scores go through a top-k that keeps ties apart by doc_id: a score
   equal to the k-th so far stays in until the ids decide. A task passes on k rows
   an item at most, and a grouped top-k takes the best of all tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lacuna.functions import settle, settle_counting
from lacuna.llm.words import map_batches, text_rows

K = 50
#: (item, term) pairs of one block of items; an item with more is a block of its own.
BLOCK_PAIRS = 100_000
ITEM_TILE = 128
TERM_TILE = 1024
DOCUMENT_TILE = 512
#: Bytes of a long text that are counted together.
CHUNK = 1_000_000
EXACT = 2**53
#: Fixed values of the ranking.
SCALE = 1000
IMPACT = 10**9
SLOPE = 20
HALF = 50

#: Bytes between terms become spaces, A-Z become a-z.
_TERM_BYTES = bytes(
    (b + 32 if 0x41 <= b <= 0x5A else b) if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)
)


def term_counts(text: str) -> Counter:
    """Occurrences of each term (UTF-8, A-Z lower-cased)."""
    data = text.encode().translate(_TERM_BYTES)
    counts: Counter = Counter()
    start = 0
    while start < len(data):
        end = data.find(b" ", start + CHUNK)
        end = len(data) if end < 0 else end
        counts.update(data[start:end].split())
        start = end
    return counts


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) of ``items`` (item_id, text), each once.

    An item_id given with several texts has the terms of all of them; a null text
    has none. A null item_id is an item of its own.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, terms = [], []
        for i, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
            own = term_counts(text)
            ids += [i] * len(own)
            terms += own
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], ["item_id", "term"]
        )

    rows = text_rows(items.withColumn("item_id", F.col("item_id").cast("long")), "item_id", "text")
    return map_batches(rows, work, "item_id long, term binary").distinct()


@dataclass(frozen=True)
class Totals:
    """Documents with a term, and their terms with repeats."""

    documents: int
    terms: int

    def weight(self, df: int) -> int:
        return math.floor(SCALE * math.log((2 * self.documents + 2) / (2 * df + 1)))

    def norm(self, n: int) -> int:
        """Of a document with n terms."""
        return 100 - HALF + HALF * n * self.documents // self.terms

    @property
    def largest_weight(self) -> int:
        return max(1, self.weight(0))


def impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (IMPACT * tf) // (SCALE * tf + SLOPE * norm)


def term_tile(totals: Totals) -> int:
    """Terms of a tile whose weighted impacts cannot add up to 2 ** 53."""
    largest = totals.largest_weight * (IMPACT // SCALE)
    return max(1, min(TERM_TILE, (EXACT - 1) // largest))


class ItemTile:
    """Weights of some items, dense over their own vocabulary."""

    def __init__(self, first: int, terms: list[np.ndarray], weights: np.ndarray, width: int):
        self.first, self.size = first, len(terms)
        self.vocabulary = np.unique(np.concatenate(terms))
        #: Place of a block's term in this vocabulary, -1 for none.
        self.place = np.full(len(weights), -1, np.int64)
        self.place[self.vocabulary] = np.arange(len(self.vocabulary))
        self.tiles = []
        for start in range(0, len(self.vocabulary), width):
            own = self.vocabulary[start : start + width]
            dense = np.zeros((len(terms), len(own)))
            for row, held in enumerate(terms):
                at = self.place[held] - start
                at = at[(at >= 0) & (at < len(own))]
                dense[row, at] = weights[own[at]]
            self.tiles.append((start, dense))

    def scores(self, document: np.ndarray, term: np.ndarray, impact: np.ndarray, n: int) -> np.ndarray:
        """Exact scores (items x n documents) from the documents' sparse impacts."""
        out = np.zeros((self.size, n), np.int64)
        place = self.place[term]
        for start, dense in self.tiles:
            here = (place >= start) & (place < start + dense.shape[1])
            if not here.any():
                continue
            # Only terms that the tile of documents holds take part.
            held, column = np.unique(place[here] - start, return_inverse=True)
            right = np.zeros((len(held), n))
            right[column, document[here]] = impact[here]
            out += (dense[:, held] @ right).astype(np.int64)
        return out


class TopK:
    """The best documents of each item: greater scores, then smaller ids, null ids last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.least = np.ones(items, np.int64)
        self.kept = [np.zeros(0, np.int64) for _ in range(3)] + [np.zeros(0, bool)]
        self.waiting: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        item, document = np.nonzero(scores >= self.least[first : first + len(scores), None])
        found = [item + first, scores[item, document], ids[document], null[document]]
        self.waiting.append(found)
        self.size += len(item)
        if self.size > 4 * self.k * len(self.least) + DOCUMENT_TILE * ITEM_TILE:
            self.settle()

    def settle(self) -> list[np.ndarray]:
        item, score, ids, null = (np.concatenate(c) for c in zip(self.kept, *self.waiting))
        order = np.lexsort((ids, null, -score, item))
        item, score, ids, null = (c[order] for c in (item, score, ids, null))
        start = np.searchsorted(item, np.arange(len(self.least)))
        place = np.arange(len(item)) - start[item]
        last = place == self.k - 1
        self.least[item[last]] = score[last]
        best = place < self.k
        self.kept = [c[best] for c in (item, score, ids, null)]
        self.waiting, self.size = [], 0
        return self.kept


def _counted(documents: DataFrame, vocabulary: list[bytes]) -> tuple[DataFrame, Totals]:
    """(doc_id, n, terms, tfs) of every document, terms by number; and the corpus' totals."""
    number = {term: i for i, term in enumerate(vocabulary)}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, terms, tfs = [], [], []
        for text in batch.column("text"):
            counts = term_counts(text.as_py())
            sizes.append(counts.total())
            own = sorted((number[t], counts[t]) for t in counts.keys() & number.keys())
            terms.append([t for t, _ in own])
            tfs.append([n for _, n in own])
        lists = [pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"]
        )

    rows = text_rows(documents.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", "text")
    counted = map_batches(rows, work, "doc_id long, n long, terms array<int>, tfs array<long>")
    counted, seen = settle_counting(counted, documents=F.count_if(F.col("n") > 0), terms=F.sum("n"))
    return counted, Totals(seen["documents"] or 0, seen["terms"] or 0)


def _ranked(counted: DataFrame, totals: Totals, pairs: dict, n_terms: int, k: int) -> DataFrame:
    """Each task's best documents of every item; ``pairs``: item_id -> numbers of its terms."""
    by_term = counted.select(F.explode("terms").alias("term")).groupBy("term").count()
    weights = np.full(n_terms, totals.weight(0), np.int64)
    for term, df in by_term.collect():
        weights[term] = totals.weight(df)
    item_ids, held = list(pairs), [np.array(t, np.int64) for t in pairs.values()]
    width = term_tile(totals)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = [
            ItemTile(i, held[i : i + ITEM_TILE], weights, width) for i in range(0, len(held), ITEM_TILE)
        ]
        best = TopK(len(held), k)
        for batch in batches:
            for start in range(0, batch.num_rows, DOCUMENT_TILE):
                part = batch.slice(start, DOCUMENT_TILE)
                lists = part.column("terms")
                count = lists.value_lengths().to_numpy()
                norms = np.array([totals.norm(n) for n in part.column("n").to_pylist()], np.int64)
                document = np.repeat(np.arange(part.num_rows), count)
                term = lists.flatten().to_numpy().astype(np.int64)
                impact = impacts(part.column("tfs").flatten().to_numpy(), norms[document])
                null = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                ids = part.column("doc_id").fill_null(0).to_numpy()
                for tile in tiles:
                    scores = tile.scores(document, term, impact, part.num_rows)
                    best.add(tile.first, scores, ids, null)
        item, score, ids, null = best.settle()
        for start in range(0, len(item), 10_000):
            part = slice(start, start + 10_000)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([item_ids[i] for i in item[part]], pa.int64()),
                    pa.array(ids[part], pa.int64(), mask=null[part]),
                    pa.array(score[part]),
                ],
                ["item_id", "doc_id", "score"],
            )

    return counted.filter("n > 0").mapInArrow(work, _FOUND)


_FOUND = StructType([StructField(c, LongType()) for c in ("item_id", "doc_id", "score")])


def _blocks(pairs: DataFrame) -> Iterator[dict]:
    """The items in blocks: item_id -> its terms. A block is what the driver holds at once."""
    sizes = pairs.groupBy("item_id").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    n_blocks = max(1, -(-2 * total // BLOCK_PAIRS)) if total > BLOCK_PAIRS else 1
    block = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))
    for i in range(n_blocks if total else 0):
        held: dict = {}
        for item_id, term in pairs.filter(block == i).orderBy("item_id", "term").toLocalIterator():
            held.setdefault(item_id, []).append(bytes(term))
        if held:
            yield held


def search(documents: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best ``documents`` (doc_id, text) of every item.

    Ranks count from 1; equal scores go by rising doc_id, a null doc_id last, and
    only scores above 0 are given. A null text has no terms, and a document or item
    without terms is in no result. Repeated documents count and rank one by one.
    Documents are read once for each block of items.
    """
    found = []
    for held in _blocks(settle(item_terms(items))):
        vocabulary = sorted({term for terms in held.values() for term in terms})
        number = {term: i for i, term in enumerate(vocabulary)}
        counted, totals = _counted(documents, vocabulary)
        if not totals.documents:
            break
        numbered = {i: [number[term] for term in terms] for i, terms in held.items()}
        found.append(_ranked(counted, totals, numbered, len(vocabulary), k))
    if not found:
        session = documents.sparkSession
        return session.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (
        reduce(DataFrame.unionByName, found)
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("item_id", "rank", "doc_id", "score")
    )


def lexical_query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return search(documents.select("doc_id", "text"), items.select("item_id", "text"))


_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Equivalent SQL.
LEXICAL_SQL = f"""
WITH t AS (
  SELECT r, doc_id, unnest(regexp_extract_all({_LOWER}, '{_TERMS}')) AS term
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
c AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM t GROUP BY r, term),
d AS (SELECT r, sum(tf)::BIGINT AS n FROM c GROUP BY r),
s AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERMS}')) AS term FROM benchmark),
w AS (
  SELECT term, floor({SCALE} * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM c, s GROUP BY term),
m AS (SELECT r, 100 - {HALF} + (({HALF} * n * big_n) // big_l) AS m FROM d, s),
scored AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id,
         sum(w * (({IMPACT} * tf) // ({SCALE} * tf + {SLOPE} * m)))::BIGINT AS score
  FROM q JOIN c USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, r),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank,
         doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= {K}
"""
