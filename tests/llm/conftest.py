import random

import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """The small documents and some odd ones: (rows, table). Rows are (doc_id, text, source)."""
    rng = random.Random(7)

    def noise(n):
        return "".join(rng.choice("abcdefg é\n") for _ in range(n))

    passage, short, exact = noise(300), noise(150), noise(200)
    odd = [
        None,
        "",
        " ",
        "\n\n",
        "  a  b ",
        "▁x ▁▁y\n",
        "a\xa0b\x1cc",
        "<|endoftext|> a<|startoftext|>b",
        "İstanbul ΣΑΣ ς ﬁ É",
        "日本語 テスト 😀a",
        "it's we'LL 123 ½ ²x don't #$",
        "x " * 30,
        " a\n a\na\n\nb\x0bc\nA  B\n",
        "a b c d e f g h a b c d e f g h a",
        passage + noise(50),
        "xy" + passage[3:280] + "q",
        "ab" * 400,
        "x" * 199,
        "y" * 201,
        exact,
        "k" + exact + "k",
        noise(100) + short + short,
        "é" * 150 + noise(60) + "é" * 150,
        noise(250) * 3,
        noise(30_000),
    ]
    rows = [
        (r["doc_id"], r["text"], r["source"])
        for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    ]
    rows += [(10**6 + i, text, "odd" if i % 2 else None) for i, text in enumerate(odd)]
    rows += [(None, "no number", "odd"), (10**6 + 99, "same row " * 40, "odd")]
    rows += [rows[-1]]
    table = spark.createDataFrame(
        [(i, t, None, s, None if t is None else len(t)) for i, t, s in rows], DOCUMENT
    )
    return rows, table.repartition(5)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="session")
def clashing(documents):
    """The documents with columns named like the operators' own."""
    names = ["score", "row", "ids", "decoded", "node", "fingerprint", "lines", "host", "key", "a b.c"]
    table = documents[1]
    for name in names:
        table = table.withColumn(name, F.lit(name))
    return table
