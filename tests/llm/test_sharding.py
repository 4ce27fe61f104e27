import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lacuna.llm import sharding

MIDDLE = "/root/testdata/sf0.01"


def brute_cuts(totals, shards):
    """(groups with their own shard, last keys) by trying every capacity upwards."""
    left, alone = sum(totals.values()), []
    for key in sorted(totals, key=lambda k: (-totals[k], k)):
        if len(alone) == shards - 1 or totals[key] * (shards - len(alone)) < left:
            break
        alone.append(key)
        left -= totals[key]
    keys = sorted(set(totals) - set(alone))
    runs = shards - len(alone)
    capacity = max([-(-left // runs), *(totals[k] for k in keys)])
    while True:
        filled, last = [0], []
        for before, key in zip([None, *keys], keys):
            if filled[-1] + totals[key] > capacity:
                filled.append(0)
                last.append(before)
            filled[-1] += totals[key]
        if len(filled) <= runs:
            return tuple(alone), tuple(last)
        capacity += 1


def brute(rows, shards):
    """Rows (doc_id, text) -> sorted (doc_id, size, crc, shard, slot)."""
    data = [(i, (t or "").encode()) for i, t in rows]
    keyed = [(hashlib.md5(b).hexdigest(), i, b) for i, b in data]
    totals = Counter()
    for key, _, b in keyed:
        totals[key] += len(b) + 8
    alone, last = brute_cuts(totals, shards)
    slots, out = defaultdict(int), []
    for key, i, b in sorted(keyed, key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
        shard = alone.index(key) if key in alone else len(alone) + sum(key > k for k in last)
        out.append((i, len(b) + 8, zlib.crc32(b), shard, slots[shard]))
        slots[shard] += 1
    return sorted(out, key=repr)


@pytest.mark.parametrize("shards", [1, 5, 24, 300])
def test_by_brute_force(spark, documents, shards):
    rows, table = documents
    expected = brute([(i, t) for i, t, _ in rows], shards)
    found = sharding.sharded(table, shards)
    assert sorted(map(tuple, found.collect()), key=repr) == expected


def test_hot_copies(spark):
    """A third of all rows are copies, of which most have the same doc_id too."""
    rows = [(7 if i % 5 else i, "same text " * 30) for i in range(600)] + [(i, f"t{i}" * (i % 90)) for i in range(1200)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = sharding.sharded(table, 6)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, 6)


@settings(max_examples=150, deadline=None)
@given(
    st.dictionaries(st.text("012", min_size=3, max_size=3), st.integers(8, 60), min_size=1, max_size=27),
    st.integers(1, 9),
)
def test_search_is_exact(totals, shards):
    """Cells are split until the capacity and the cuts are those of all groups."""

    def cells(digits, starts=None):
        by = defaultdict(list)
        for key in totals:
            if starts is None or key[: digits - 1] in starts:
                by[key[:digits]].append(key)
        return [
            sharding.Cell(s, sum(totals[k] for k in keys), min(keys), max(keys)) for s, keys in by.items()
        ]

    digits, walk = 1, sharding.Walk(sorted(cells(1), key=lambda c: c.low), shards)
    while wide := walk.open_cells():
        digits += 1
        starts = {c.start for c in wide}
        known = [c for c in walk.cells if c not in wide]
        walk = sharding.Walk(sorted(known + cells(digits, starts), key=lambda c: c.low), shards)
    filled = Counter()
    last = walk.last_keys()
    for key, total in totals.items():
        filled[sum(key > k for k in last)] += total
    best = exhaustive(tuple(totals[k] for k in sorted(totals)), shards)
    assert len(last) < shards
    assert max(filled.values()) == walk.smallest(0) == walk.smallest(1) == best


def exhaustive(sizes, shards):
    """The least largest run over all ways to cut, by a table."""
    upto = [0]
    for size in sizes:
        upto.append(upto[-1] + size)
    best = upto[:]
    for _ in range(shards - 1):
        best = [min(max(best[i], upto[j] - upto[i]) for i in range(j + 1)) for j in range(len(upto))]
    return best[-1]


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{MIDDLE}/documents.parquet'")
    found = sharding.sharding_query(spark, MIDDLE)
    cursor = con.execute(sharding.SHARDING_SQL)
    assert [d[0] for d in cursor.description] == found.columns
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


def test_rows_keep_their_columns(clashing, documents):
    found = sharding.shard_rows(clashing.withColumn("shard", F.lit("own")), 5)
    assert found.columns == [*clashing.columns, "shard"]
    expected = Counter((r[0], r[3]) for r in brute([(i, t) for i, t, _ in documents[0]], 5))
    assert Counter((r["doc_id"], r["shard"]) for r in found.collect()) == expected


def test_no_python_in_the_plan(documents):
    plan = sharding.sharded(documents[1])._jdf.queryExecution().toString()
    assert not [word for word in ("Python", "Pandas", "Arrow") if word in plan]


def test_empty_table(no_documents):
    assert sharding.sharded(no_documents).count() == 0
    assert sharding.minimax_cuts(no_documents.selectExpr("text AS key", "doc_id AS size")) == sharding.Cuts((), ())
