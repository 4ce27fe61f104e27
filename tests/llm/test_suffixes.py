from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from lacuna.llm import suffixes
from tests.llm.conftest import SMALL

LENGTH = 200


def covered(rows):
    data = [(text or "").encode() for _, text, _ in rows]
    seen = Counter(d[i : i + LENGTH] for d in data for i in range(len(d) - LENGTH + 1))
    for (doc_id, _, _), d in zip(rows, data):
        gone = np.zeros(len(d) + 1, int)
        for i in range(len(d) - LENGTH + 1):
            if seen[d[i : i + LENGTH]] > 1:
                gone[i] += 1
                gone[i + LENGTH] -= 1
        yield doc_id, d, np.cumsum(gone[:-1]) > 0


@pytest.fixture(scope="module")
def expected(documents):
    out = []
    for doc_id, data, gone in covered(documents[0]):
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((doc_id, len(data), int(gone.sum()), spans, sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(
    "limits",
    [{}, {"CORE_WINDOWS": 200}, {"BATCH_WINDOWS": 500}, {"CHUNK": 700}],
    ids=["plain", "very common cores", "many levels", "chunks of long texts"],
)
def test_by_brute_force(documents, expected, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(suffixes, name, value)
    found = [tuple(r) for r in suffixes.digests(documents[1]).collect()]
    assert sorted(found, key=repr) == expected


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    found = map(tuple, suffixes.suffix_query(spark, SMALL).collect())
    assert sorted(found) == sorted(con.execute(suffixes.SUFFIX_SQL).fetchall())


def test_index_family():
    rng = np.random.default_rng(9)
    words = rng.integers(97, 99, (40, 50, 12)).astype(np.uint8)
    family = suffixes.IndexFamily()
    for i, batch in enumerate(words):
        family.add(np.ascontiguousarray(batch).view("V12").ravel(), np.arange(50) + 50 * i)
        ranks = [level.rank for level in family.levels]
        assert ranks == sorted(set(ranks), reverse=True)
    flat = [bytes(w) for w in words.reshape(-1, 12)]
    seen = Counter(flat)
    assert family.recurring().tolist() == [i for i, w in enumerate(flat) if seen[w] > 1]


def test_clean_keeps_whole_characters(spark, documents, clashing):
    found = suffixes.clean(documents[1].withColumnRenamed("lang", "again")).collect()
    assert len(found) == len(documents[0])
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    expected = {}
    for doc_id, data, gone in covered(documents[0]):
        expected.setdefault(doc_id, (data, gone))
    for row in found:
        data, gone = expected[row["doc_id"]]
        least = bytes(np.frombuffer(data, np.uint8)[~gone])
        assert len(least) <= len(row["text"].encode()) <= len(least) + 6 * (1 + int(gone.sum()) // LENGTH)


def test_empty_table(no_documents):
    assert suffixes.digests(no_documents).count() == 0
    assert suffixes.clean(no_documents).count() == 0
