"""SentencePiece encoding and decoding with a table of distinct chunks.

In a model none of whose pieces goes on after a white-space marker that follows
another character, no merge crosses from a word into the marker after it. A
text is then cut before each run of markers, each distinct marked word is
segmented once, and the ids are joined back by position. Decoding undoes one
chunk at a time: a chunk's decoded text lacks just its first marker.

The table lives in the Python worker and serves all its tasks. It starts anew
at ``TABLE_CHUNKS`` entries, which bounds memory and changes no result.
"""

from __future__ import annotations

import re
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lacuna.llm.words import map_batches, text_rows, worker_table

TABLE_CHUNKS = 1_000_000
MARK = "▁"


class ChunkTable(dict):
    """Marked word without its first marker -> (ids, ids as text, decoded text).

    The empty word stands for a lone marker, which only ends a text.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in pieces):
            raise ValueError("pieces of this model cross white-space markers")
        self.chunk = re.compile(f"{MARK}+[^{MARK}]*")
        self.lone = [self.model.piece_to_id(MARK)]

    def words(self, text: str) -> list[str]:
        """The text's chunks in order, each without its first marker."""
        if not text:
            return []
        words = text.split(" ")
        if "" in words or MARK in text:
            marked = MARK + text.replace(" ", MARK)
            words = [chunk[1:] for chunk in self.chunk.findall(marked)]
        return words

    def learn(self, words: list[str]) -> None:
        """Segment the words that the table lacks, in one call."""
        new = [word for word in dict.fromkeys(words) if word not in self]
        if len(self) + len(new) > TABLE_CHUNKS:
            self.clear()
            new = list(dict.fromkeys(words))
        found = self.model.encode(new, out_type=int, num_threads=1)
        found = [ids if word else self.lone for word, ids in zip(new, found)]
        decoded = self.model.decode(found) if found else []
        for word, ids, text in zip(new, found, decoded):
            self[word] = (ids, " ".join(map(str, ids)), text)


def _table(model_file: str) -> ChunkTable:
    return worker_table(f"pieces:{model_file}", lambda: ChunkTable(model_file))


def encode(documents: DataFrame, model_file: str) -> DataFrame:
    """Every row and column with ``ids`` (end id last) and their decoded text ``decoded``.

    Columns of these names are replaced. A null text counts as empty, and an
    empty text has just the end id.
    """
    documents = _whole(documents.drop("ids", "decoded"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = _table(model_file)
        end = table.model.eos_id()
        texts = [table.words(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        table.learn([word for words in texts for word in words])
        ids, decoded = [], []
        for words in texts:
            found = [table[word] for word in words]
            ids.append([i for x in found for i in x[0]] + [end])
            decoded.append(" ".join([x[2] for x in found]))
        batch = batch.append_column("ids", pa.array(ids, pa.list_(pa.int32())))
        return batch.append_column("decoded", pa.array(decoded, pa.string()))

    schema = StructType(
        [
            *documents.schema.fields,
            StructField("ids", ArrayType(IntegerType())),
            StructField("decoded", StringType()),
        ]
    )
    return map_batches(documents, work, schema, f"pieces:{model_file}")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """Every row and column with the text of its ``ids`` as ``decoded``; null ids give null."""
    encoded = encoded.drop("decoded")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = _table(model_file).model
        ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
        texts = [None if x is None else model.decode(x) for x in ids]
        return batch.append_column("decoded", pa.array(texts, pa.string()))

    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])
    return map_batches(encoded, work, schema, f"pieces:{model_file}")


def digests(documents: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode``, without its long columns."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = _table(model_file)
        end = str(table.model.eos_id())
        texts = [table.words(t) for t in batch.column("text").to_pylist()]
        table.learn([word for words in texts for word in words])
        counts, ids, decoded = [], [], []
        for words in texts:
            found = [table[word] for word in words]
            counts.append(sum([len(x[0]) for x in found]) + 1)
            joined = " ".join([*[x[1] for x in found], end])
            ids.append(sha256(joined.encode()).hexdigest())
            decoded.append(sha256(" ".join([x[2] for x in found]).encode()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(text_rows(documents, "doc_id", "text"), work, schema, f"pieces:{model_file}")


def _whole(documents: DataFrame) -> DataFrame:
    return documents.withColumn("text", F.coalesce("text", F.lit("")))


def sentencepiece_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(documents, public_tokenizers.path("piece_bpe_32k.model"))
