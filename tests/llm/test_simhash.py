import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from lacuna.functions import settle
from lacuna.llm import components, simhash


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    """The least index connected to each value by steps of 3 bits or fewer."""
    values, label = np.array(values, np.uint64), list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i in range(len(values)):
            near = np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3)
            least = min(label[j] for j in near)
            for j in near:
                if label[j] != least:
                    label[j], changed = least, True
    return label


def test_documents_by_brute_force(documents):
    rows, table = documents
    found = simhash.near_duplicates(settle(simhash.fingerprints(table).drop("text"))).collect()
    values = {i: brute_fingerprint(t) for i, t, _ in rows}
    assert {r["doc_id"]: r["fingerprint"] & (2**64 - 1) for r in found} == values
    ids = sorted(i for i in values if i is not None)
    label = brute_components([values[i] for i in ids])
    got = {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None}
    assert got == {i: ids[k] for i, k in zip(ids, label)}


@pytest.mark.parametrize("key_rows", [5, 2048])
def test_links_by_brute_force(spark, monkeypatch, key_rows):
    """Clusters and chains of fingerprints, with keys that are cut into blocks or not."""
    monkeypatch.setattr(simhash, "KEY_ROWS", key_rows)
    rng = np.random.default_rng(11)
    values = set(map(int, rng.integers(0, 2**63, 40)))
    for centre in list(values)[:3]:
        now = centre
        for _ in range(60):
            flip = rng.choice(64, rng.integers(1, 5), replace=False)
            values.add((centre if rng.random() < 0.5 else now) ^ sum(1 << int(b) for b in flip))
            now = list(values)[-1]
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    mixed = simhash.mix(np.array(values, np.uint64)).view(np.int64).tolist()
    rows = spark.createDataFrame(
        [(i, v, m) for i, (v, m) in enumerate(zip(signed, mixed))], "doc_id long, fingerprint long, node long"
    )
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(rows).collect()}
    assert found == dict(enumerate(brute_components(values)))


def test_components_of_a_long_path(spark):
    rng = np.random.default_rng(2)
    number = rng.permutation(300).tolist()
    edges = [(number[i], number[i + 1]) for i in range(299) if i % 100 != 99] + [(1000, 1000)]
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = defaultdict(set)
    for node, root in found:
        roots[root].add(node)
    assert sorted(map(len, roots.values())) == [100, 100, 100]
    assert sorted(map(frozenset, roots.values()), key=min) == sorted(
        (frozenset(number[i : i + 100]) for i in (0, 100, 200)), key=min
    )


def test_one_of_each(spark, documents, clashing, no_documents):
    rows, table = documents
    kept = simhash.one_of_each(table).collect()
    found = simhash.near_duplicates(settle(simhash.fingerprints(table).drop("text")))
    assert len(kept) == found.select("root").distinct().count()
    assert {r["doc_id"] for r in kept} >= {r[0] for r in found.select("component_id").distinct().collect()}
    inner = [f"c{i}" if c not in ("doc_id", "text") else c for i, c in enumerate(clashing.columns)]
    assert simhash.one_of_each(clashing.toDF(*inner)).columns == inner
    assert simhash.one_of_each(no_documents).count() == 0
