from hashlib import sha256

import public_tokenizers
import sentencepiece

from lacuna.llm import sentencepieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_equals_the_library(documents):
    rows, table = documents
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    expected = []
    for doc_id, text, _ in rows:
        ids = model.encode(text or "", add_eos=True)
        joined = " ".join(map(str, ids))
        decoded = model.decode(ids)
        expected.append((doc_id, len(ids), sha256(joined.encode()).hexdigest(), sha256(decoded.encode()).hexdigest()))
    got = [tuple(r) for r in sentencepieces.digests(table, MODEL).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_ids_and_texts(documents, clashing):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = sentencepieces.encode(clashing, MODEL)
    for row in found.select("text", "ids", "decoded").collect():
        assert row["ids"] == model.encode(row["text"], add_eos=True)
        assert row["decoded"] == model.decode(row["ids"])
    again = sentencepieces.decode(found.withColumnRenamed("decoded", "before"), MODEL)
    assert again.filter("NOT (before <=> decoded)").count() == 0


def test_full_table_changes_nothing(documents, monkeypatch):
    table = sentencepieces.ChunkTable(MODEL)
    monkeypatch.setattr(sentencepieces, "TABLE_CHUNKS", 3)
    for _, text, _ in documents[0][:40]:
        words = table.words(text or "")
        table.learn(words)
        ids = [i for word in words for i in table[word][0]]
        assert ids == table.model.encode(text or "")


def test_empty_table(no_documents):
    assert sentencepieces.digests(no_documents, MODEL).count() == 0
