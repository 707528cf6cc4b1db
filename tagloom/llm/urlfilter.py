"""URL allow and block lists: a trie over reversed host labels, then path segments.

A rule is (verdict, host, path). It fits a URL whose host is the rule's host or
one of its subdomains and whose path starts with the rule's path. The longest
match wins: most host labels first, then the longest path; of two rules for the
same host and path, block wins. URLs that no rule fits get the default verdict.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and gets the default verdict; an empty rule table gives every row the default;
repeated rows are judged each for itself; other columns pass through, and those
that clash with the result's names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shipped, unpacked

Rule = tuple[str, str, str]

#: Rules up to this number travel to the executors as one trie; more are joined.
MAX_TRIE_RULES = 200_000


class UrlTrie:
    """Host labels from the right, then whole path segments, then the rest of a rule's path."""

    def __init__(self, rules: Sequence[Rule]):
        self.root: dict = {}
        for verdict, host, path in sorted(rules, key=lambda r: r[0] != "block"):
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault("hosts", {}).setdefault(label, {})
            *whole, rest = path.split("/")
            node = node.setdefault("path", {})
            for segment in whole:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            node.setdefault("ends", {}).setdefault(rest, (host + path, verdict))

    @staticmethod
    def _in_path(node: dict, path: str) -> tuple[str, str] | None:
        best, segments, at = None, path.split("/"), 0
        while True:
            tail = segments[at]
            fits = [(len(end), rule) for end, rule in node.get("ends", {}).items() if tail.startswith(end)]
            if fits:
                best = max(fits, key=lambda f: f[0])[1]
            if at + 1 == len(segments) or (node := node.get("segments", {}).get(tail)) is None:
                return best
            at += 1

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits, or None."""
        best, node = None, self.root
        labels = host.split(".")[::-1]
        for label in [None, *labels]:
            if label is not None and (node := node.get("hosts", {}).get(label)) is None:
                break
            if "path" in node:
                best = self._in_path(node["path"], path) or best
        return best


def host_of(url: str | Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", url: str = "url", max_trie_rules: int = MAX_TRIE_RULES) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    Up to ``max_trie_rules`` rules go out as a broadcast trie, so nothing is
    shuffled. A larger list is joined by equality on host suffix and path prefix.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    split = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if len(rules) > max_trie_rules:
        return _joined(split, rules, default)
    sent = shipped(split.sparkSession, UrlTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = unpacked(sent)
        for hosts, paths in batches:
            yield pd.DataFrame([trie.match(h, p) or (None, default) for h, p in zip(hosts, paths)], columns=["rule", "verdict"])

    return split.withColumn("found", judged("host", "path")).select(*kept, "host", "path", "found.rule", "found.verdict")


def _joined(split: DataFrame, rules: Sequence[Rule], default: str) -> DataFrame:
    spark = split.sparkSession
    listed = spark.createDataFrame(pa.Table.from_pylist([{"verdict": v, "r_host": h, "r_path": p} for v, h, p in rules]))
    listed = listed.groupBy("r_host", "r_path").agg(F.min_by("verdict", F.col("verdict") != "block").alias("r_verdict"))
    lengths = F.array(*[F.lit(n) for n in sorted({len(p) for _, _, p in rules})])
    labels = F.split("host", r"\.")
    suffixes = F.array_distinct(F.array_append(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), ".")), F.lit("")))
    rows = split.withColumn("row", F.monotonically_increasing_id())
    wanted = rows.select("row", F.explode(suffixes).alias("r_host"), "path").select(
        "row", "r_host", F.explode(F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))).alias("r_path")
    )
    order = F.struct(F.when(F.col("r_host") == "", 0).otherwise(F.size(F.split("r_host", r"\."))), F.length("r_path"))
    best = wanted.join(listed, ["r_host", "r_path"]).groupBy("row").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "r_verdict"), order).alias("b"))
    return rows.join(best, "row", "left").select(*split.columns, F.col("b.rule").alias("rule"), F.coalesce("b.r_verdict", F.lit(default)).alias("verdict"))
