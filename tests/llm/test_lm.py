import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lacuna.llm import lm
from lacuna.llm.classifier import in_fold


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), "\n"]


@pytest.mark.parametrize("bucket_tokens", [500, 2_000_000])
def test_counts_and_base_score(documents, monkeypatch, bucket_tokens):
    monkeypatch.setattr(lm, "BUCKET_TOKENS", bucket_tokens)
    rows, table = documents
    counts = Counter(w for i, t, _ in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    expected = []
    for i, text, _ in rows:
        own = words(text)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        expected.append((i, held(i), len(own), sum(w in counts for w in own), n, round(base, 6)))
    found = lm.score(table.withColumn("held_out", in_fold("doc_id", 7, 2))).collect()
    got = [(*tuple(r)[:5], round(r["base_score"], 6)) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    outside = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in outside) > sum(r["base_score"] for r in outside)
    assert all(r["score"] <= 0 for r in found)


def test_chances_sum_to_one():
    """Over all known words and the class of new ones, in every used context."""
    rng = np.random.default_rng(4)
    n_words, contexts = 30, [0, 5, 1025, 1026, 3000]
    word = np.repeat(np.arange(n_words, dtype=np.uint64), len(contexts))
    context = np.tile(contexts, n_words).astype(np.uint32)
    trained = rng.poisson(2, len(word)) * rng.integers(0, 40, len(word))
    trained[word == 3] = 0  # a word that only stands in held-out texts: any new word
    trained[word == 4] = 1

    def totals(part):
        return lm._totals(part.numbers())

    part = lm.Part(0, word, context, trained)
    for sweep in range(3):
        part.sweep(sweep, totals(part))
        assert (part.tables <= part.customers).all()
        assert (part.tables[trained > 0] >= 1).all()
        assert (part.parent_tables <= part.parent_customers).all()
        chance = part.chance(totals(part))
        sums = np.bincount(context, chance)[contexts]
        assert np.allclose(sums, 1)


def test_seating_follows_the_restaurant():
    """The mean number of tables of one word against the exact recursion."""
    customers, mass, discount = 20, 1.5, 0.5
    table_chances = {1: 1.0}
    for n in range(1, customers):
        new = Counter()
        for t, p in table_chances.items():
            q = mass / (mass + n - discount * t)
            new[t + 1] += p * q
            new[t] += p * (1 - q)
        table_chances = new
    mean = sum(t * p for t, p in table_chances.items())
    rng = np.random.default_rng(1)
    drawn = lm._seat(np.full(20_000, customers), np.full(20_000, mass), discount, rng)
    assert drawn.mean() == pytest.approx(mean, rel=0.01)


def test_same_scores_again_and_odd_tables(spark, documents, no_documents):
    rows, table = documents
    table = table.withColumn("held_out", in_fold("doc_id", 7, 2))
    first = {(r["doc_id"], r["n_tokens"]): r["score"] for r in lm.score(table).collect()}
    again = {(r["doc_id"], r["n_tokens"]): r["score"] for r in lm.score(table.coalesce(1)).collect()}
    assert first.keys() == again.keys()
    assert all(first[k] == pytest.approx(again[k], rel=1e-4) for k in first)
    nothing = no_documents.withColumn("held_out", in_fold("doc_id", 7, 2))
    assert lm.score(nothing).count() == 0
    untaught = spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, held_out boolean")
    row = lm.score(untaught).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (3, 0, 0, 0, 0)


def test_gibberish_scores_below_prose(spark, documents):
    """Words never seen are less likely than held-out prose, and no likelier than a word seen once."""
    prose = [(i, t, held(i)) for i, t, _ in documents[0] if i is not None and i < 10**6]
    junk = [(-1 - k, " ".join(f"zq{k}x{j}" for j in range(100)), True) for k in range(5)]
    once = (-100, "onceword", False)
    single = [(-101, "onceword", True), (-102, "neverword", True)]
    table = spark.createDataFrame(
        [*prose, *junk, once, *single], "doc_id long, text string, held_out boolean"
    )
    found = {r["doc_id"]: r for r in lm.score(table).collect()}
    outside = [found[i] for i, _, out in prose if out]
    mean = sum(r["score"] for r in outside) / sum(r["n_tokens"] for r in outside)
    for i, _, _ in junk:
        assert found[i]["n_known"] == 1
        assert found[i]["score"] / found[i]["n_tokens"] < mean
    assert found[-102]["score"] < found[-101]["score"]


def test_words_of_one_ending_are_contexts_of_their_own():
    before = ["station", "question", "million", "xyzion", "on", "n"]
    _, _, context = lm.tokens(pa.array([f"{w} x" for w in before]))
    after = context[1::3]
    assert len(set(after.tolist())) == len(before)
    assert len(set((after[:4] // lm.WORDS).tolist())) == 1
    assert (context[::3] == 0).all() and context.max() < lm.FINE


def scored_by_hand(texts, seat):
    """log10 chances of texts learnt from themselves, by dictionaries of restaurants.

    Seats are those that ``seat`` gives for (restaurant's word, customers, mass of a new table).
    """
    def kind(word):
        return word[-3:]

    pairs = Counter()
    for text in texts:
        own = words(text)
        pairs.update(zip(["", *own], own))
    types = len({w for _, w in pairs})

    def tables_of(customers, tables):
        c, t = Counter(), Counter()
        for (place, w), n in customers.items():
            c[place] += n
            t[place] += tables[place, w]
        return c, t

    def upper(tables):
        customers = Counter()
        for (u, w), t in tables.items():
            customers[kind(u), w] += t
        return customers

    def chances(tables, parents):
        """Of a word after a word, of a word in a class, and of a word alone."""
        middle = upper(tables)
        top = Counter()
        for (_, w), t in parents.items():
            top[w] += t
        n = sum(top.values())

        def alone(w):
            return (max(top[w] - 0.8, 0) + (1 + 0.8 * types) / (types + 1)) / (1 + n)

        c1, t1 = tables_of(middle, parents)
        c0, t0 = tables_of(pairs, tables)

        def in_class(k, w):
            own = middle[k, w] - 0.8 * parents[k, w]
            return (own + (1 + 0.8 * t1[k]) * alone(w)) / (1 + c1[k])

        def after(u, w):
            own = pairs[u, w] - 0.8 * tables[u, w]
            return (own + (1 + 0.8 * t0[u]) * in_class(kind(u), w)) / (1 + c0[u])

        return after, in_class, alone, t0, t1

    tables = Counter(dict.fromkeys(pairs, 1))
    parents = Counter(dict.fromkeys(upper(tables), 1))
    sums = Counter()
    for sweep in range(lm.SWEEPS):
        _, in_class, alone, t0, t1 = chances(tables, parents)
        tables = Counter({
            (u, w): seat(n, (1 + 0.8 * t0[u]) * in_class(kind(u), w)) for (u, w), n in pairs.items()
        })
        parents = Counter({
            (k, w): seat(n, (1 + 0.8 * t1[k]) * alone(w)) for (k, w), n in upper(tables).items()
        })
        if sweep >= lm.BURN_IN:
            after = chances(tables, parents)[0]
            for pair in pairs:
                sums[pair] += after(*pair)
    mean = {pair: x / (lm.SWEEPS - lm.BURN_IN) for pair, x in sums.items()}
    out = []
    for text in texts:
        own = words(text)
        out.append(sum(math.log10(mean[p]) for p in zip(["", *own], own)))
    return out


@pytest.mark.parametrize("fullest", [False, True])
def test_scores_of_a_small_corpus_by_hand(monkeypatch, fullest):
    """One table for each word, or one for each customer: no seat is left to chance."""
    def seat(customers, mass):
        return customers if fullest else min(customers, 1)

    monkeypatch.setattr(
        lm, "_seat", lambda customers, mass, discount, rng: customers if fullest else np.minimum(customers, 1)
    )
    texts = ["the station of the nation", "the nation is the station of a nation", "", "the the the a"]
    by_hand = scored_by_hand(texts, seat)
    # In this process, as executors would not see the seats given here.
    batch = pa.RecordBatch.from_pylist(
        [{"doc_id": i, "text": t, "held_out": False} for i, t in enumerate(texts)]
    )
    bucket = lm._Bucket(0, 1)
    bucket.add(batch)
    merged = next(lm._merge(iter(bucket.rows())))
    history = []
    for _ in range(lm.SWEEPS + 1):
        _, part = next(lm._parts(iter([merged])))
        for number, totals in enumerate(history):
            part.sweep(number, totals)
        history.append(lm._totals(part.numbers()))
    sums = pa.Table.from_batches(lm._sums(iter([merged]), history)).sort_by([("about", "descending")])
    found = pa.Table.from_batches(lm._finish(iter(sums.to_batches()), history[-1].tokens)).to_pylist()
    assert [r["score"] for r in found] == pytest.approx(by_hand, abs=1e-9)
