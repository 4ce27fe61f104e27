import itertools
import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

from lacuna.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def counts(text):
    words = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated)


def test_base_counts(documents):
    rows, table = documents
    found = rules.judge(table).select("doc_id", *rules.COUNTS, "base_failed").collect()
    expected = []
    for doc_id, text, _ in rows:
        own = counts(text or "")
        expected.append((doc_id, *own, own[0] < 20 or 100 * own[4] > 30 * own[0]))
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("broadcast_lines", [0, 200_000])
def test_boilerplate_and_depletion(spark, monkeypatch, broadcast_lines):
    """Lines many documents of a host share go, and a document that is little else; copies stay."""
    monkeypatch.setattr(rules, "BROADCAST_LINES", broadcast_lines)

    def words(prefix, i, n):
        return " ".join(f"{prefix}{i}x{k}" for k in range(n))

    menu = "Home  NEWS sport\tabout us and all the other pages of this host"
    rows = [(i, f"{menu}\n{words('a', i, 30)}\n{words('b', i, 9)}", "h") for i in range(60)]
    rows += [(100, f"{menu.lower()}\n{menu}\n{menu}\n{words('c', 0, 9)}", "h")]  # depleted
    rows += [(200 + i, words("copy", 0, 40) + "\n" + words("copy", 1, 40), "h") for i in range(50)]
    rows += [(300 + i, f"{menu}\n{words('d', i, 40)}", None if i % 2 else "g") for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    found = {r["doc_id"]: r for r in rules.judge(table).collect()}
    assert [i for i, r in found.items() if not r["kept"]] == [100]
    assert {i for i, r in found.items() if r["removed_lines"]} == {*range(60), 100}
    assert found[100]["removed_lines"] == [0, 1, 2]
    assert found[100]["n_removed_words"] == 3 * 13
    kept = {r["doc_id"]: r["text"] for r in rules.clean(table).collect()}
    assert kept[5] == rows[5][1].split("\n", 1)[1]
    assert kept[210] == rows[71][1]
    assert 100 not in kept


def test_documents_of_shared_lines_count_one_by_one(spark):
    """Documents with no line or one line of their own are not copies of each other."""
    template = [" ".join(f"line{i}x{k}" for k in range(10)) for i in range(15)]
    some = [list(c) for c in itertools.combinations(template, 12)][:400]
    own = " ".join(f"own{k}" for k in range(60))
    rows = [(i, "\n".join(c), "only") for i, c in enumerate(some)]
    rows += [(1000 + i, "\n".join([*c[:6], f"{own} {i}"]), "own") for i, c in enumerate(some)]
    assert not any(counts(text)[4] for _, text, _ in rows)
    rows += [(2000 + i, "\n".join(template), "copies") for i in range(50)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    found = {r["doc_id"]: r for r in rules.judge(table).collect()}
    assert [len(found[i]["removed_lines"]) for i in range(400)] == [12] * 400
    assert not any(found[i]["kept"] for i in range(400))
    # The lines that at least 20 of the documents hold.
    held = Counter(line for c in some for line in c[:6])
    for i, c in enumerate(some):
        gone = [k for k, line in enumerate(c[:6]) if held[line] >= 20]
        assert found[1000 + i]["removed_lines"] == gone and found[1000 + i]["kept"]
    assert all(found[2000 + i]["kept"] for i in range(50))


def test_other_columns_and_empty_table(documents, clashing, no_documents):
    found = rules.judge(clashing, columns=("doc_id", "row", "lines"))
    assert found.count() == len(documents[0])
    assert rules.judge(no_documents).count() == 0
    assert rules.clean(no_documents).count() == 0


def test_equivalent_sql(spark, documents, tmp_path):
    """Counts and verdicts of odd documents, copies and shared lines against the SQL."""
    rows = [(i, t, s) for i, t, s in documents[0]]
    menu = ["Home NEWS  sport and more", "all about us", "terms of use and the rest"]
    for i in range(90):
        own = " ".join(f"w{i % 60}x{k}" for k in range(5 + i % 20))
        own_menu = [line.lower() if i % 2 else line for line in menu]
        rows.append((2_000_000 + i, "\n".join([*own_menu, own]), "menu"))
    rows += [(2_000_100 + i, "\n".join(menu * 3), "menu") for i in range(30)]
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "source"])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    frame.to_parquet(tmp_path / "documents.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
        expected = con.execute(rules.RULES_SQL)
        names = [c[0] for c in expected.description]
        expected = expected.fetchall()
    found = rules.rules_query(spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    removed = [r for r in expected if not r[-1] and not r[-2]]
    assert len(removed) > 10 and sum(r[-1] for r in expected) > 50
