import duckdb
import pytest
from pyspark.sql import functions as F

from lacuna.llm import urls

MIDDLE = "/root/testdata/sf0.01"
ODD = [
    None,
    "",
    "x",
    "http://",
    "http://net",
    "http://NET/",
    "://a.Net/x?y",
    "http://xnet/",
    "http://a.example.net/en/b",
    "http://example.net/en",
    "a://b://org/fr/",
    "http://net./",
    "http://ünet.É.net/#",
    "http://a\0b.net/",
    "http://net-x.net/",
    "http://deep." + "a." * 2000 + "net/" + "p" * 5000,
]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    path = rest[at:].split("?")[0].split("#")[0]
    best = None
    for rule, verdict in rules:
        if not rule or rule.startswith("/"):
            continue
        own, _, tail = rule.partition("/")
        fits = (host == own or host.endswith("." + own)) and path.startswith(rule[len(own) :])
        if fits and (best is None or (len(rule), len(own), verdict) > best[:3]):
            best = (len(rule), len(own), verdict, rule)
    return host, path, best[3] if best else None, best[2] if best else "allow"


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{MIDDLE}/pages.parquet'")
    expected = sorted(con.execute(urls.URL_SQL).fetchall(), key=repr)
    found = urls.url_query(spark, MIDDLE).select("page_id", "host", "path", "rule", "verdict")
    assert sorted(map(tuple, found.collect()), key=repr) == expected


@pytest.mark.parametrize("bound_rows", [4, 20_000])
def test_nested_rules_by_brute_force(spark, monkeypatch, bound_rows):
    monkeypatch.setattr(urls, "BOUND_ROWS", bound_rows)
    rules = [*urls.RULES, ("net/", "allow"), ("example.net/en", "block"), ("a.example.net/", "block")]
    rules += [("b.net", "block"), ("/x", "block"), ("", "block"), (None, "block"), ("net/en/1", "block")]
    hosts = ["net", "b.net", "a.example.net", "x.a.example.net", "example.net", "c.org"]
    texts = ODD + [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en", "/en/", "/en/12", "/fr/")]
    texts += ["http://a.example.net/en/b"] * 200
    table = spark.createDataFrame(list(enumerate(texts)), "page_id long, url string")
    table = table.withColumn("rule", F.lit(1)).withColumn("a b.c", F.lit(2)).repartition(3)
    found = urls.judge(table, urls.rule_rows(spark, rules))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect()}
    assert got == {i: brute(t, rules) for i, t in enumerate(texts)}


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(pages, urls.rule_rows(spark, urls.RULES)).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/")], pages.schema)
    rules = urls.rule_rows(spark, urls.RULES).limit(0)
    assert [tuple(r) for r in urls.judge(one, rules).collect()] == [
        (1, "http://a.net/", "a.net", "/", None, "allow")
    ]
