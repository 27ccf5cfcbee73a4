"""URL filters as a sort-merge range join with a sweep over nested rules."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

#: Rules in one sweep's broadcast; more take further sweeps over the same sorted rows.
MAX_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_key(host: str) -> bytes:
    """The host's labels from the last to the first, each with a dot: a domain's key is a prefix of its subdomains'."""
    return ("".join(f"{label}." for label in reversed(host.split(".")))).encode()


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), upper, lower)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _sweep(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules: list[tuple[bytes, list[tuple[str, str, str]]]] = shared.value  # by key, each host once
        at, stack = 0, []
        for batch in batches:
            names, verdicts = [], []
            columns = [batch.column(c).to_pylist() for c in ("key", "path", "rule", "rule_verdict")]
            for key, path, best, verdict in zip(*columns):
                key = bytes(key)
                # intervals begin at their key and end before the first key without that prefix
                while at < len(rules) and rules[at][0] <= key:
                    while stack and not rules[at][0].startswith(stack[-1][0]):
                        stack.pop()
                    stack.append(rules[at])
                    at += 1
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                for _, own in stack:
                    for prefix, name, said in own:
                        # deeper hosts come later, so on equal lengths the deeper host wins
                        if path.startswith(prefix) and (best is None or len(name) >= len(best)):
                            best, verdict = name, said
                names.append(best)
                verdicts.append(verdict)
            put = {"rule": pa.array(names, pa.string()), "rule_verdict": pa.array(verdicts, pa.string())}
            yield pa.RecordBatch.from_arrays([put.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)], batch.schema.names)

    return run


def url_filter(spark: SparkSession, pages: DataFrame, rules: list[Rule], *, default: str = "allow", id_col: str = "page_id", url_col: str = "url", max_rules: int = MAX_RULES) -> DataFrame:
    """The longest rule that fits each url, and its verdict; ``default`` where none fits.

    A rule fits its host and all subdomains if the url's path starts with the rule's.  Returns id, host,
    path, rule (host and path as one string, or null) and verdict.  Null urls and urls without ``://`` have an empty
    host and path.  Of two rules with the same host and path the first counts.  Rows with null or repeated
    ids each give a row; an empty table gives none; other columns are ignored.

    Rows are sorted by range of (host key, path, id), so a host with very many pages is spread over
    many partitions; each partition sweeps the sorted rules along and keeps the nested ones that are open on a stack.
    """
    url = F.col("url")
    host, path = host_and_path(url)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).select("id", host.alias("host"), path.alias("path"))
    key = F.encode(F.concat(F.concat_ws(".", F.reverse(F.split("host", r"\."))), F.lit(".")), "UTF-8")
    rows = rows.withColumns({"key": key, "rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
    rows = rows.repartitionByRange("key", "path", "id").sortWithinPartitions("key")
    by_host: dict[bytes, dict[str, tuple[str, str, str]]] = {}
    for r in rules:
        by_host.setdefault(host_key(r.host), {}).setdefault(r.path, (r.path, r.name, r.verdict))
    ordered = [(k, list(v.values())) for k, v in sorted(by_host.items())]
    for lo in range(0, len(ordered), max_rules):
        rows = rows.mapInArrow(_sweep(spark.sparkContext.broadcast(ordered[lo : lo + max_rules])), rows.schema)
    return rows.select("id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))


RULES = [
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark, table(spark, sf_dir, "pages"), RULES).withColumnRenamed("id", "page_id")


OP5_SQL = """
WITH rest AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS r FROM pages
), parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rest
), rules(h, p, v) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), best AS (
  SELECT page_id, host, path, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id, host, path
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM best
"""
