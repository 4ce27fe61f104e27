"""URL filters by a sort-merge range join.

A host is keyed by its labels in reverse, each closed by a NUL, so a rule's host
and all its subdomains are one interval of keys, and intervals nest or are
apart. URLs and rules are dealt to key ranges of about equal numbers of URLs (a
host with a large part of all URLs is cut by a hash of the row), and a rule goes
to every range that its interval meets. In a range, one sweep over the sorted
keys keeps a stack of the rule hosts around the current key; each level has that
host's rules by path.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

DEFAULT_VERDICT = "allow"
#: Rows sampled to place the bounds of ranges; balance depends on it, results do not.
BOUND_ROWS = 20_000
#: The rules of the registered query.
RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty for a null URL or one without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    labels = F.reverse(F.split(host, r"\."))
    return F.when(host == "", "").otherwise(F.concat(F.array_join(labels, "\0"), F.lit("\0")))


def rule_rows(spark: SparkSession, rules) -> DataFrame:
    """(rule, verdict) as a table; a rule is a host, then a path from its first ``/``."""
    return spark.createDataFrame(list(rules), "rule string, verdict string")


def _longest(levels: list, host: str, path: str) -> tuple[str | None, str]:
    """The longest rule text that fits; of equally long ones the longer host."""
    best, verdict = None, DEFAULT_VERDICT
    for _, rule_host, paths, lengths in reversed(levels):
        if host != rule_host and not host.endswith("." + rule_host):
            continue
        for length in sorted(lengths, reverse=True):
            found = paths.get(path[:length]) if length <= len(path) else None
            if found:
                if best is None or len(found[0]) > len(best):
                    best, verdict = found
                break
    return best, verdict


def _sweep(batches: Iterator[pa.RecordBatch], kept: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by range, key and kind (a rule before the URLs of its key)."""
    part, levels = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("part", "key", "rule", "verdict", "host", "path")]
        at, rules, verdicts = [], [], []
        for i, (own, key, rule, verdict, host, path) in enumerate(zip(*columns)):
            if own != part:
                part, levels = own, []
            while levels and not key.startswith(levels[-1][0]):
                levels.pop()
            if rule is not None:
                if not levels or levels[-1][0] != key:
                    levels.append((key, host, {}, set()))
                levels[-1][2][path] = (rule, verdict)
                levels[-1][3].add(len(path))
            else:
                rule, verdict = _longest(levels, host, path)
                at.append(i)
                rules.append(rule)
                verdicts.append(verdict)
        rows = batch.select(kept).take(pa.array(at, pa.int64()))
        rows = rows.append_column("rule", pa.array(rules, pa.string()))
        yield rows.append_column("verdict", pa.array(verdicts, pa.string()))


def _bounds(urls: DataFrame, parts: int) -> list[tuple[str, int]]:
    """Ends of ranges of about equal numbers of rows, from about BOUND_ROWS rows in all."""
    # Any row can be taken, also each of many that are equal in all columns.
    place = F.xxhash64("salt", F.monotonically_increasing_id())
    least = -(2**63) + int(min(1, BOUND_ROWS / max(1, urls.count())) * (2**64 - 1))
    keys = sorted(map(tuple, urls.filter(place <= least).select("key", "salt").collect()))
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)} if keys else set())


def judge(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Every row and column of ``urls`` with ``host``, ``path``, ``rule`` (or null) and ``verdict``.

    Columns of these names are replaced. Where no rule fits, the verdict is
    DEFAULT_VERDICT. Repeated URLs are judged one by one; a rule given twice
    counts once, with the alphabetically greater verdict (block over allow). A
    rule without a host fits nothing.
    """
    parts = 4 * int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    inner = [f"c{i}" for i in range(len(names))]
    host, path = host_and_path(F.col(url).cast("string"))
    rows = (
        urls.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(names, inner)), host.alias("host"), path.alias("path"))
        .withColumn("key", host_key(F.col("host")))
        .withColumn("salt", F.xxhash64(*inner))
    )
    bounds = _bounds(rows, parts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("key").to_pylist(), batch.column("salt").to_pylist())
            yield batch.append_column("part", pa.array([bisect_right(bounds, k) for k in keys], pa.int32()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, own = [], []
            for i, key in enumerate(batch.column("key").to_pylist()):
                low = bisect_right(bounds, (key, -(2**63) - 1))
                past = bisect_right(bounds, (key[:-1] + "\1", -(2**63) - 1))
                at += [i] * (past - low + 1)
                own += range(low, past + 1)
            yield batch.take(pa.array(at, pa.int64())).append_column("part", pa.array(own, pa.int32()))

    given = rules.groupBy("rule").agg(F.max("verdict").alias("verdict"))
    given = given.withColumn("host", F.regexp_extract("rule", r"^[^/]*", 0)).filter("host != ''")
    given = given.withColumn("path", F.substr("rule", F.length("host") + 1))
    given = given.withColumn("key", host_key(F.col("host")))
    part = StructField("part", IntegerType())
    placed = rows.mapInArrow(place, StructType([*rows.schema.fields, part])).drop("salt")
    ranged = given.mapInArrow(spread, StructType([*given.schema.fields, part]))
    both = placed.unionByName(ranged, allowMissingColumns=True)
    ordered = both.repartition(parts, "part").sortWithinPartitions(
        "part", "key", F.col("rule").isNull()
    )
    fields = [f for f in rows.schema.fields if f.name in inner]
    texts = [StructField(c, StringType()) for c in ("host", "path", "rule", "verdict")]
    kept = [*inner, "host", "path"]
    out = ordered.mapInArrow(lambda batches: _sweep(batches, kept), StructType([*fields, *texts]))
    return out.toDF(*names, "host", "path", "rule", "verdict")


def url_query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages.select("page_id", "url"), rule_rows(spark, RULES)).drop("url")


URL_SQL = f"""
WITH r(rule, verdict) AS (VALUES {", ".join(f"('{r}', '{v}')" for r, v in RULES)}),
rules AS (
  SELECT rule, verdict, regexp_extract(rule, '^[^/]*') AS host,
         regexp_extract(rule, '^[^/]*(.*)', 1) AS path FROM r),
p AS (
  SELECT row_number() OVER () AS n, page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
u AS (
  SELECT n, page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), '{ascii_uppercase}', '{ascii_lowercase}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p),
m AS (
  SELECT u.*, rules.rule, rules.verdict,
         row_number() OVER (PARTITION BY n ORDER BY length(rules.rule) DESC NULLS LAST,
                            length(rules.host) DESC) AS k
  FROM u LEFT JOIN rules
    ON (u.host = rules.host OR ends_with(u.host, '.' || rules.host))
   AND starts_with(u.path, rules.path))
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT_VERDICT}') AS verdict FROM m WHERE k = 1
"""
