import sys
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lacuna.llm import packing, words

FILE = public_tokenizers.path("word_bpe_49k.json")


def test_pieces_equal_the_library(documents):
    rows, table = documents
    tokenizer = Tokenizer.from_file(FILE)
    expected = []
    for doc_id, text, _ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            expected.append((doc_id, k, start, len(part), zlib.crc32(part.tobytes())))
    got = [tuple(r) for r in packing.pieces(table, FILE).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_every_low_character_as_the_library():
    """All code points below U+0250, alone, in words and in random strings."""
    rng = np.random.default_rng(1)
    chars = [chr(c) for c in range(0x250)]
    texts = [t for c in chars for t in (c, f"abc{c}", f"{c}x", f"a{c}b{c}{c}")] + ["abc\x7f", "\x7f\x7f a\x7f"]
    texts += ["".join(rng.choice(chars, 12)) for _ in range(5000)]
    tokenizer = Tokenizer.from_file(FILE)
    ids, offsets = packing.ChunkIds(FILE).tokens(texts)
    for i, encoded in enumerate(tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == [*encoded.ids, 1], texts[i]


@pytest.mark.parametrize("kind", ["long", "short"])
def test_table_is_bounded_by_its_bytes(monkeypatch, kind):
    """Whatever the chunks are; starting anew within a batch changes no ids."""
    monkeypatch.setattr(packing, "TABLE_BYTES", 1_000_000, raising=False)
    if kind == "long":
        texts = [f"{i:05}" * 400 + f" it's w{i}" for i in range(400)]
    else:
        texts = [" ".join(f"x{j:x},é" for j in range(i, i + 50)) for i in range(0, 20_000, 50)]
    table = packing.ChunkIds(FILE)
    tracemalloc.start()
    try:
        parts = [table.tokens(texts[i : i + 100]) for i in range(0, len(texts), 100)]
        ids = sum(part.nbytes for part, _ in parts)
        held = tracemalloc.get_traced_memory()[0] - ids
    finally:
        tracemalloc.stop()
    assert held < 2_000_000
    got = [own[a:b].tolist() for own, at in parts for a, b in zip(at, at[1:])]
    encoded = Tokenizer.from_file(FILE).encode_batch(texts, add_special_tokens=False)
    assert got == [[*x.ids, 1] for x in encoded]


def check_packed(rows, parts, capacity):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(repr, rows[key].itertuples(index=False))) == sorted(
        map(repr, parts[key].itertuples(index=False))
    )
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        assert own.length.sum() <= capacity


def test_packs_tightly_and_gaplessly(documents):
    parts = packing.pieces(documents[1], FILE)
    rows = packing.pack(parts).toPandas()
    check_packed(rows, parts.toPandas(), 4096)
    assert rows.sequence_id.nunique() <= np.ceil(rows.length.sum() / 4096) + 1


@pytest.mark.parametrize("sizes", [(1, 4096), (2049, 4096), (4096, 4097), (1, 60)])
def test_rounds_over_partitions(spark, monkeypatch, sizes):
    monkeypatch.setattr(packing, "ITEMS_PER_TASK", 50)
    lengths = np.random.default_rng(3).integers(*sizes, 400)
    table = spark.createDataFrame(
        [(i, 0, 0, int(n), i) for i, n in enumerate(lengths)],
        "doc_id long, piece int, start long, length long, ids_crc32 long",
    )
    rows = packing.pack(table).toPandas()
    check_packed(rows, table.toPandas(), 4096)
    alone = len(set(packing.best_fit(lengths, 4096).tolist()))
    assert rows.sequence_id.nunique() <= 1.05 * alone + 1


@pytest.mark.parametrize("first", [0, 10, 20])
def test_bins_of_all_partitions_meet(spark, monkeypatch, first):
    """However many bins a task takes, underfull ones of different partitions merge."""
    monkeypatch.setattr(packing, "ITEMS_PER_TASK", 1)
    table = spark.createDataFrame(
        [(first + i, 0, 0, 600, i) for i in range(6)], packing._PIECE
    )
    rows = packing.pack(table).toPandas()
    check_packed(rows, table.toPandas(), 4096)
    assert rows.sequence_id.nunique() == 1


def test_best_fit_takes_the_fullest_bin():
    # 7 opens a bin with room 3, 6 one with room 4: 3 and 4 fill them.
    assert packing.best_fit(np.array([7, 6, 3, 4]), 10).tolist() == [0, 1, 0, 1]


def test_empty_table(no_documents):
    assert packing.pack(packing.pieces(no_documents, FILE)).count() == 0


def test_rounds_drop_the_tokens_table(documents, monkeypatch):
    """A worker that goes on after the tokens, or waits, does not hold their table."""
    parts = packing.pieces(documents[1], FILE)
    runs, real = [], type(parts).mapInArrow
    monkeypatch.setattr(
        type(parts), "mapInArrow", lambda df, run, schema: runs.append(run) or real(df, run, schema)
    )
    packing.pack(parts)
    assert len(runs) >= 2
    for run in runs:
        words.worker_table(f"words:{FILE}", dict)
        assert list(run(iter([]))) == []
        assert not sys.modules["lacuna_worker_tables"].tables
