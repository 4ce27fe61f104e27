import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import lexical
from tests.llm.conftest import SMALL

MIDDLE = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = [
    (1, "the passage, of THE x1"),
    (2, "Ünlü 日本語 é"),
    (3, None),
    (4, "--- !"),
    (5, "nowhere-at-all-zzzqqq"),
    (6, "a b c d e f g a B"),
    (6, "row same"),
    (None, "same row"),
    (7, "the passage, of THE x1"),
    (7, "the passage, of THE x1"),
]


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, k):
    counted = [(i, Counter(terms(t))) for i, t in rows]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(terms(text))
    out = []
    for item, own in wanted.items():
        found = []
        for doc_id, c in counted:
            m = 50 + 50 * c.total() * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in own & c.keys()
            )
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, null, doc_id) in enumerate(sorted(found)[:k], 1):
            out.append((item, rank, None if null else doc_id, -score))
    return sorted(out, key=repr)


@pytest.mark.parametrize(
    "limits",
    [{}, {"ITEM_TILE": 2, "DOCUMENT_TILE": 7, "CHUNK": 20}, {"BLOCK_PAIRS": 4}, {"EXACT": 2**24}],
    ids=["plain", "small tiles", "blocks of items", "narrow vocabulary"],
)
def test_by_brute_force(spark, documents, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lexical, name, value)
    rows, table = documents
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    k = 5 if limits else 50
    found = lexical.search(table, items, k).collect()
    assert sorted(map(tuple, found), key=repr) == brute([(i, t) for i, t, _ in rows], ITEMS, k)


def test_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{MIDDLE}/{name}.parquet'")
    found = lexical.lexical_query(spark, MIDDLE)
    cursor = con.execute(lexical.LEXICAL_SQL)
    assert [d[0] for d in cursor.description] == found.columns
    assert sorted(map(tuple, found.collect())) == sorted(cursor.fetchall())


def test_partial_sums_stay_exact():
    """Widest vocabulary tile, all impacts and weights at their largest."""
    totals = lexical.Totals(10**15, 10**17)
    width = lexical.term_tile(totals)
    assert width * totals.largest_weight * 10**6 < 2**53
    lexical_max = lexical.impacts(np.array([2**30]), np.array([50]))
    assert 0 < lexical_max[0] <= 10**6
    assert lexical.Totals(10**12, 10**15).norm(10**8) == 50 + 50 * 10**8 * 10**12 // 10**15


def test_ties_go_by_id():
    best = lexical.TopK(1, 3)
    rng = np.random.default_rng(4)
    ids = rng.permutation(1000)
    scores = rng.integers(1, 4, 1000)
    for start in range(0, 1000, 10):
        part = slice(start, start + 10)
        best.add(0, scores[part][None, :], ids[part], np.zeros(10, bool))
        best.settle()
    wanted = sorted(zip(-scores, ids))[:3]
    assert list(zip(-best.kept[1], best.kept[2])) == wanted


def test_clashing_columns_and_empty_tables(spark, documents, clashing, no_documents):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("term", F.lit(1))
    rows = [(i, t) for i, t, _ in documents[0]]
    found = lexical.search(clashing.withColumn("terms", F.lit(2)), items, 2).collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows, ITEMS, 2)
    assert lexical.search(no_documents, items).count() == 0
    assert lexical.search(documents[1], items.limit(0)).count() == 0
    assert SMALL


def test_very_long_text(spark):
    text = "wörd " * 300_000 + "Z" * 1_500_000 + " end"
    rows = [(1, text), (2, "end"), (3, "z" * 1_500_000)]
    items = [(1, "END wörd"), (2, "Z" * 1_500_000)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    found = lexical.search(documents, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, items, 50)
