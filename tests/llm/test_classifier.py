import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lacuna.llm import classifier
from tests.llm.conftest import SMALL

MIDDLE = "/root/testdata/sf0.01"


def test_separates_held_out_documents(spark):
    scored = classifier.quality_query(spark, MIDDLE)
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    rows = scored.join(labels, "doc_id").filter("held_out").toPandas()
    good, bad = rows.score[rows.quality == 1], rows.score[rows.quality == 0]
    assert (good.to_numpy()[:, None] > bad.to_numpy()).mean() > 0.97
    assert (good >= classifier.THRESHOLD).all()
    assert scored.count() == 1000


def test_labels_of_the_held_out_fold_are_not_learnt(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    held = classifier.in_fold("doc_id", 5, 0)
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    first = classifier.fit(documents, classifier.training_labels(labels))
    second = classifier.fit(documents.repartition(7), classifier.training_labels(turned))
    assert np.array_equal(first, second)


def test_features_are_normalised_counts():
    at, place, value = classifier.features(pa.array(["A b a", "", "b### b"]))
    assert (np.bincount(at, place == 0) == 1).all()
    assert np.allclose(np.bincount(at, value**2 * (place > 0)), [1, 0, 1])
    # a, b, "a b" and "b a"; then b, ###, "b ###" and "### b".
    assert np.bincount(at).tolist() == [5, 1, 5]


def test_odd_rows(spark, documents, clashing, no_documents):
    labels = spark.createDataFrame(
        [(1, 1.0), (1, 0.0), (2, 0.0), (3, None), (None, 1.0), (10**9, 1.0)], "doc_id long, label double"
    )
    found = classifier.classify(clashing, labels)
    assert found.count() == len(documents[0])
    assert set(clashing.columns) | {"predicted"} == set(found.columns)
    assert found.filter("score IS NULL OR score < 0 OR score > 1 OR predicted IS NULL").count() == 0
    assert classifier.classify(no_documents, labels).count() == 0
    untaught = classifier.classify(documents[1], labels.limit(0))
    assert {r[0] for r in untaught.select("score").distinct().collect()} == {0.5}


def grams(text):
    """Values of a text's n-grams by name, with the constant; plain Python."""
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[a-z\x80-\U0010ffff]+|[0-9]+|[^\x20\x09-\x0da-z0-9\x80-\U0010ffff]+", text)
    counts = Counter(words)
    counts.update("same twice" if a == b else f"{a} {b}" for a, b in zip(words, words[1:]))
    values = {g: 1 + math.log(c) for g, c in counts.items()}
    norm = math.sqrt(sum(v * v for v in values.values()))
    return {"": 1.0} | {g: v / norm for g, v in values.items()}


def test_scores_against_stepwise_learning(spark):
    """Every score against one coordinate at a time, without hashing or arrays."""
    texts = {
        1: "The cat sat on the mat", 2: "buy buy buy now!!! 100% free", 3: "A quiet évening, 1 tea",
        4: "free free $$$ click now", 5: "the mat sat quiet", 6: "click 100 buy", 7: "tea on the mat",
        8: "now now now", 9: "", 10: None, 11: "cat tea\tmat\ncat tea", 12: "free tea now",
        13: "unlabelled cat buy", 14: "never seen words",
    }
    labelled = {i: float(i % 2) for i in range(1, 13)}
    documents = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(list(labelled.items()), "doc_id long, label double")
    order = [r[0] for r in labels.orderBy(F.xxhash64("doc_id")).select("doc_id").collect()]
    z, n = defaultdict(float), defaultdict(float)
    alpha, beta, l1, l2 = classifier.ALPHA, classifier.BETA, classifier.L1, classifier.L2

    def weight(g):
        if abs(z[g]) <= l1:
            return 0.0
        return -math.copysign(abs(z[g]) - l1, z[g]) / ((beta + math.sqrt(n[g])) / alpha + l2)

    def chance(text):
        return 1 / (1 + math.exp(-sum(weight(g) * v for g, v in grams(text).items())))

    for _ in range(classifier.EPOCHS):
        for i in order:
            error = chance(texts[i]) - labelled[i]
            for g, v in grams(texts[i]).items():
                step, w = error * v, weight(g)
                z[g] += step - (math.sqrt(n[g] + step**2) - math.sqrt(n[g])) / alpha * w
                n[g] += step**2
    found = {r["doc_id"]: r for r in classifier.classify(documents, labels).collect()}
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        assert found[i]["score"] == pytest.approx(chance(text), abs=1e-5)
        assert found[i]["predicted"] == (found[i]["score"] >= classifier.THRESHOLD)
