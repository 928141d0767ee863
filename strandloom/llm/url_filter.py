"""URL filter: a trie over reversed host labels, then path segments, decides by the longest matching entry.

An entry (host, path, verdict) fits the host itself and its subdomains when the URL's path starts with the entry's.
The longest entry wins: more host labels first, then the longer path; of two entries for the same place, block wins.
The list is broadcast, so its size is checked; a longer list belongs in `filter_urls_by_join`, which shuffles.

Edge cases: a null URL or one without "://" has empty host and path, so only an entry for the empty host could fit and
it gets the default verdict with a null rule.  Repeated rows are judged one by one.  Other columns pass unchanged;
columns of the input named like an output column are replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import free_names

#: Entries a broadcast trie may hold.
MOST_BROADCAST = 1_000_000

#: The rules of the registered query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


class Trie:
    """Host labels from the last to the first, then path segments; the rest of an entry's path may end in a segment."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("h", {}).setdefault(label, {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault("p", {}).setdefault(segment, {})
            entry = (f"{host}{path}", verdict)
            ends = node.setdefault("e", {})
            if rest not in ends or verdict == "block":
                ends[rest] = entry

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node.get("h", {}).get(label)
            if node is None:
                break
            best = self._match_path(node, path) or best
        return best

    @staticmethod
    def _match_path(node: dict, path: str) -> tuple[str, str] | None:
        best, segments = None, path.split("/")
        for k, segment in enumerate(segments):
            fits = [rest for rest in node.get("e", ()) if segment.startswith(rest)]
            if fits:
                best = node["e"][max(fits, key=len)]
            node = node.get("p", {}).get(segment) if k < len(segments) - 1 else None
            if node is None:
                break
        return best


def url_host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, with A-Z lower-cased; empty for other values."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule (the entry that decided, else null) and verdict (its verdict, else the default)."""
    if len(rules) > MOST_BROADCAST:
        return filter_urls_by_join(pages, rules, default, url)
    shared = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("struct<rule string, verdict string>")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = shared.value
        for hosts, paths in parts:
            found = [trie.match(h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"]) if found else pd.DataFrame({"rule": pd.Series(dtype=str), "verdict": pd.Series(dtype=str)})

    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    parts = pages.select(*kept, url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path"))
    (found,) = free_names(parts, "found")
    judged = parts.withColumn(found, judge("host", "path"))
    return judged.select(*[F.col(f"`{c}`") for c in parts.columns], f"{found}.rule", f"{found}.verdict")


def filter_urls_by_join(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", url: str = "url") -> DataFrame:
    """The same for lists too long to broadcast: URLs meet the entries of each host suffix in a shuffled join."""
    spark = pages.sparkSession
    table = spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    parts = pages.select(*[F.col(f"`{c}`") for c in kept], url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path"))
    places = parts.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("rule_host")
    hits = places.select("host", "path", suffix).join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    order = F.struct(F.size(F.split("rule_host", r"\.")), F.length("rule_path"), F.when(F.col("rule_verdict") == "block", 1).otherwise(0))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")), order).alias("won"))
    out = parts.join(best, ["host", "path"], "left")
    return out.select(*[F.col(f"`{c}`") for c in kept], "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
