import re

import pytest
import xxhash

import corpus_pipeline
from lacuna.functions import settle
from lacuna.llm import classifier, registry, rules, simhash, suffixes
from tests.llm.conftest import SMALL
from tests.llm.test_suffixes import covered


@pytest.fixture(scope="module")
def steps(spark, documents):
    """Each stage's input and output over the small and the odd documents."""
    docs, out = documents[1], []
    for name, stage in corpus_pipeline.STAGES:
        after = settle(stage(spark, docs, SMALL))
        out.append((docs, after))
        docs = after
    return out


def texts(table):
    return sorted((tuple(r) for r in table.select("doc_id", "text").collect()), key=repr)


def test_stages_keep_the_columns(steps):
    for before, after in steps[:-1]:
        assert after.dtypes == before.dtypes


def test_classifier_stage(spark, steps):
    before, after = steps[0]
    learnt = classifier.training_labels(spark.read.parquet(f"{SMALL}/labels.parquet"))
    scored = classifier.classify(before, learnt)
    assert texts(after) == texts(scored.filter(f"score >= {classifier.THRESHOLD}"))


def test_rules_stage(steps):
    before, after = steps[1]
    judged = rules.judge(before, columns=("doc_id", "text")).filter("kept").collect()
    expected = []
    for row in judged:
        lines = (row["text"] or "").split("\n")
        rest = "\n".join(x for i, x in enumerate(lines) if i not in row["removed_lines"])
        expected.append((row["doc_id"], rest if row["removed_lines"] else row["text"]))
    assert texts(after) == sorted(expected, key=repr)


def test_near_dedup_stage(steps):
    before, after = steps[2]
    found = simhash.near_duplicates(settle(simhash.fingerprints(before).drop("text")))
    roots = found.select("root").distinct().count()
    assert after.count() == roots < before.count()
    assert {r["doc_id"] for r in after.collect()} == {
        r[0] for r in found.select("component_id").distinct().collect()
    }


def fingerprint(text):
    """Of three-word shingles, in plain Python."""
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum((2 * sum(h >> bit & 1 for h in hashes) > len(hashes)) << bit for bit in range(64))


def test_near_dedup_stage_by_all_pairs(steps):
    before, after = steps[2]
    prints = [(r["doc_id"], fingerprint(r["text"])) for r in before.select("doc_id", "text").collect()]
    groups = []
    for value in {p for _, p in prints}:
        near = [g for g in groups if any((value ^ other).bit_count() <= 3 for other in g)]
        groups = [g for g in groups if g not in near] + [{value}.union(*near)]
    ids = [[i for i, p in prints if p in g and i is not None] for g in groups]
    expected = [min(own) if own else None for own in ids]
    found = [r["doc_id"] for r in after.collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert len(found) < len(prints)


def test_suffix_stage(steps):
    before, after = steps[3]
    rows = [(r["doc_id"], r["text"], None) for r in before.collect()]
    expected = []
    for doc_id, data, gone in covered(rows):
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone.astype("u1")))]
        kept = suffixes.kept_bytes(data, suffixes.whole_characters(data, spans))
        expected.append((doc_id, kept.decode()))
    assert texts(after) == sorted(expected, key=repr)


def test_packing_stage(steps):
    before, after = steps[4]
    rows = after.toPandas()
    assert set(rows.doc_id.dropna()) == {r["doc_id"] for r in before.collect() if r["doc_id"] is not None}
    for _, own in rows.groupby("sequence_id"):
        assert own.length.sum() <= 4096


def test_other_columns_and_empty_table(spark, documents, clashing, no_documents):
    docs = clashing
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = settle(stage(spark, docs, SMALL))
        assert after.dtypes == docs.dtypes
        docs = after
    docs = no_documents
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, SMALL))
        assert docs.count() == 0


def test_registered():
    names = {int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op")}
    assert names == set(range(1, 11))
    assert registry.QUERIES["pipeline"] is corpus_pipeline.run
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
