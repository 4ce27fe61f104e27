import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import chat
from tests.llm.conftest import SMALL

SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.read.parquet(f"{SMALL}/conversations.parquet")


def test_given_roles_and_texts_come_back(conversations):
    given = [tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()]
    found = chat.parse(conversations).select("conv_id", "turn", "role", "text").collect()
    assert sorted(map(tuple, found)) == sorted(given)


def test_hidden_roles_are_recovered(spark, conversations):
    hidden = F.xxhash64("conv_id", "turn") % 3 == 0
    masked = conversations.withColumn("role", F.when(~hidden, F.col("role")))
    found = chat.parse(masked).withColumnRenamed("role", "found").select("conv_id", "turn", "found")
    both = conversations.filter(hidden).join(found, ["conv_id", "turn"]).toPandas()
    assert len(both) > 20
    assert (both.role == both.found).mean() > 0.9


def test_markers_in_the_text(spark):
    rows = [
        (1, 0, None, "User: hi\nthere\nAssistant: hello\n- a\n- b"),
        (1, 1, "human", "ok?"),
        (1, 2, "bot", "[user] yes"),
        (None, None, None, None),
        (None, 2, "AI", "x"),
        (2, 0, "user", "a"),
        (2, 0, "user", "a"),
    ]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit(1)).withColumn("salt", F.lit(2))
    found = chat.parse(table)
    got = sorted([tuple(r) for r in found.drop("rendered").collect()], key=repr)
    expected = [
        (1, 0, 0, "user", "hi\nthere"),
        (1, 0, 1, "assistant", "hello\n- a\n- b"),
        (1, 1, 0, "user", "ok?"),
        (1, 2, 0, "user", "yes"),
        (2, 0, 0, "user", "a"),
        (2, 0, 0, "user", "a"),
        (None, 2, 0, "assistant", "x"),
    ]
    assert [r for r in got if r[1] is not None] == sorted(expected, key=repr)
    assert len(got) == len(expected) + 1
    rendered = found.filter("conv_id = 1 AND turn = 1").first()["rendered"]
    assert rendered == "<|user|>\nok?\n<|end|>\n"


def test_rejected_marker_stays_text(spark):
    """A label in a user's turn that alternates with the assistant's is no marker."""
    rows = [(1, i, ("user", "assistant")[i % 2], f"line {i}") for i in range(1000)]
    rows[500] = (1, 500, "user", "Model: X200 does not start")
    rows[600] = (1, 600, None, "User: what now?")
    found = chat.parse(spark.createDataFrame(rows, SCHEMA)).filter("turn IN (500, 600)")
    got = {r["turn"]: (r["role"], r["text"], r["rendered"]) for r in found.collect()}
    assert got[500][:2] == ("user", "Model: X200 does not start")
    assert got[500][2] == "<|user|>\nModel: X200 does not start\n<|end|>\n"
    assert got[600][:2] == ("user", "what now?")


def test_blocks_join_to_one_best_path(spark, monkeypatch):
    """One conversation over many blocks, with few markers, against Viterbi over all of it."""
    rng = np.random.default_rng(5)
    roles = ["user", "assistant"] * 150
    rows = [
        (7, i, role if rng.random() < 0.1 else None, "x" * int(rng.integers(1, 40 if role == "user" else 400)))
        for i, role in enumerate(roles)
    ]
    rows += [(8, 3, None, "y" * int(rng.integers(1, 300))) for _ in range(40)]
    table = spark.createDataFrame(rows, SCHEMA)
    models = []

    class Model(chat.Model):
        def __init__(self, *counts):
            super().__init__(*counts)
            models.append(self)

    monkeypatch.setattr(chat, "BLOCK_TURNS", 16)
    monkeypatch.setattr(chat, "BLOCK_ROWS", 6)
    monkeypatch.setattr(chat, "Model", Model)
    found = chat.parse(table).filter("conv_id = 7").orderBy("turn", "part").collect()
    lines = [chat.observe(role, text)[0][0] for conv, _, role, text in rows if conv == 7]
    whole = models[0].decode(lines, -1, -1)
    assert [r["role"] for r in found] == [chat.ROLES[i] for i in whole]


def test_ranges_of_a_conversation_chain_as_one(spark):
    """Roles at the ends of 200 random tables, dealt over ranges, against one chain over all."""
    rng = np.random.default_rng(8)
    k = chat._LEVELS
    places = [(t, s) for t in range(50) for s in range(4)]
    rows = [("=1", t, s, rng.random(k * k).tolist()) for t, s in places]
    rows += [("=2", 5, 0, rng.random(k * k).tolist()), ("=2", 6, 0, rng.random(k * k).tolist())]
    table = spark.createDataFrame(rows, "talk string, turns long, sub long, best array<double>")
    found = {(r["talk"], r["turns"], r["sub"]): (r["entry"], r["leave"]) for r in chat._ends(table.repartition(5)).collect()}
    assert len(found) == len(rows)
    for talk in ("=1", "=2"):
        own = [r for r in rows if r[0] == talk]
        best, before = np.array(own[0][3]).reshape(k, k)[0], []
        for r in own[1:]:
            through = best[:, None] + np.array(r[3]).reshape(k, k)
            before.append(through.argmax(axis=0))
            best = through.max(axis=0)
        ends = [int(best.argmax())]
        for back in reversed(before):
            ends.insert(0, int(back[ends[0]]))
        assert [found[r[:3]] for r in own] == list(zip([-1, *ends[:-1]], ends))


def test_a_very_long_text(spark):
    """A text of many lines in one row comes back whole, its roles by its markers."""
    parts = [("User", "what is it " * 3), ("Assistant", "- a line of the answer\n" * 400 + "so it is")]
    text = "\n".join(f"{name}: {said}" for name, said in parts * 50) + "x" * 3_000_000
    rows = [(1, 0, None, text), (1, 1, "user", "")]
    found = chat.parse(spark.createDataFrame(rows, SCHEMA)).orderBy("turn", "part").collect()
    assert [r["role"] for r in found] == ["user", "assistant"] * 50 + ["user"]
    assert [r["text"] for r in found[:-2]] == [said for _, said in parts * 50][:-1]
    assert found[-2]["text"] == parts[1][1] + "x" * 3_000_000 and found[-1]["text"] == ""


def test_empty_table(spark):
    assert chat.parse(spark.createDataFrame([], SCHEMA)).count() == 0


NAMED = {"system": "system", "user": "user", "human": "user", "assistant": "assistant", "bot": "assistant"}


def seen_lines(rows):
    """(marker or None, begins, features) of every line of one conversation, told here anew."""
    for _, _, role, text in sorted(rows, key=lambda r: r[1]):
        for i, line in enumerate(text.split("\n")):
            label, colon, rest = line.partition(": ")
            own = NAMED.get(label.lower()) if colon else None
            marker = own or (NAMED.get(role) if i == 0 else None)
            bare = rest if own else line
            size = min(math.floor(math.log2(len(bare))) + 1 if bare else 0, 11)
            yield marker, bool(own) or i == 0, (size, bare.startswith("- "), bare.endswith("?"))


def test_roles_against_all_paths(spark):
    """Decoded roles against the best of all paths, with chances counted in plain Python."""
    rng = np.random.default_rng(11)
    said = {
        "system": ["be brief"],
        "user": ["what is it?", "why?", "Human: and then?", "tell me"],
        "assistant": ["- one\n- two", "it is a long answer with many words in it", "Bot: yes\n- also"],
    }
    rows = []
    for conv in range(40):
        order = ["system"] * int(rng.random() < 0.3) + ["user", "assistant", "user", "assistant"]
        for turn, role in enumerate(order):
            text = str(rng.choice(said[role]))
            rows.append((conv, turn, role if rng.random() < 0.6 else None, text))
    talks = {c: list(seen_lines([r for r in rows if r[0] == c])) for c in range(40)}
    changes, features = Counter(), Counter()
    for lines in talks.values():
        before, current = "start", None
        for marker, begins, feature in lines:
            if begins:
                if before and marker:
                    changes[before, marker] += 1
                before = current = marker
            if current:
                features[current, feature] += 1
    roles = chat.ROLES
    n_features = 12 * 2 * 2

    def change(a, b):
        return math.log((changes[a, b] + 1) / (sum(changes[a, c] for c in roles) + 3))

    def emitted(role, marker, feature):
        of_role = sum(n for (r, _), n in features.items() if r == role)
        out = math.log((features[role, feature] + 1) / (of_role + n_features))
        if marker:
            out += math.log(chat.MARKER_TRUST if marker == role else (1 - chat.MARKER_TRUST) / 2)
        return out

    def value(path, lines):
        total, before = 0.0, "start"
        for role, (marker, begins, feature) in zip(path, lines):
            if begins:
                total += change(before, role)
            else:
                within = chat.CHANGE_WITHIN
                total += math.log(1 - 2 * within if role == before else within)
            total += emitted(role, marker, feature)
            before = role
        return total

    decoded = {}
    for r in chat.parse(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "turn", "part").collect():
        decoded.setdefault(r["conv_id"], []).extend([r["role"]] * len(r["text"].split("\n")))
    hidden = 0
    for conv, lines in talks.items():
        if len(lines) > 8:
            continue
        best = max(value(path, lines) for path in itertools.product(roles, repeat=len(lines)))
        assert value(decoded[conv], lines) == pytest.approx(best, rel=1e-12)
        hidden += sum(marker is None for marker, _, _ in lines)
    assert hidden > 40
