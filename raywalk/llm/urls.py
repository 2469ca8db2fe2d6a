"""URL allow and block lists.

Rules are a host suffix and a path prefix. They sit in a trie over reversed host labels,
each node of which holds a trie over path segments; the trie is broadcast, and each URL walks it once.
A rule fits its host and all subdomains if the path starts with the rule's path. The longest
rule (host, then path) wins; of two equal rules the blocking one does. A list of more than MAX_RULES is cut into parts, each of which is
a trie and a pass of its own; the longest rule of all passes wins, so their number changes nothing.

Defined results: a null URL, or one without ``://``, has empty host and path and fits no rule
but one of empty host; a URL that fits no rule gets the default verdict; repeated rows are judged
each for itself; an empty table gives no rows; very long URLs are walked whole; other columns pass through, and those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raywalk.llm import shared

#: Rules of one broadcast trie, whose nodes take about 1 KB a rule: 200 MB. More rules are matched in several passes.
MAX_RULES = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host`` is a lower-case host suffix in whole labels, ``path`` a path prefix or empty."""

    verdict: str
    host: str
    path: str = ""

    @property
    def text(self) -> str:
        return self.host + self.path


class PathTrie:
    """Rules of one host by whole path segments; what a rule's path has after its last slash may end inside a segment."""

    __slots__ = ("below", "ends")

    def __init__(self):
        self.below: dict[str, PathTrie] = {}
        self.ends: dict[str, Rule] = {}

    def add(self, rule: Rule) -> None:
        *whole, last = rule.path.split("/")
        node = self
        for segment in whole:
            node = node.below.setdefault(segment, PathTrie())
        if last not in node.ends or rule.verdict == "block":
            node.ends[last] = rule

    def longest(self, path: str) -> Rule | None:
        node, best = self, None
        for segment in path.split("/"):
            fits = [k for k in node.ends if segment.startswith(k)]
            if fits:
                best = node.ends[max(fits, key=len)]
            node = node.below.get(segment)
            if node is None:
                break
        return best


class HostTrie:
    """Nodes by reversed host labels."""

    __slots__ = ("below", "paths")

    def __init__(self):
        self.below: dict[str, HostTrie] = {}
        self.paths: PathTrie | None = None

    @classmethod
    def of(cls, rules: list[Rule]) -> HostTrie:
        top = cls()
        for rule in rules:
            node = top
            for label in reversed(rule.host.split(".")) if rule.host else ():
                node = node.below.setdefault(label, cls())
            node.paths = node.paths or PathTrie()
            node.paths.add(rule)
        return top

    def longest(self, host: str, path: str) -> Rule | None:
        """Rule of the deepest host node that has one for this path."""
        node, best = self, self.paths and self.paths.longest(path)
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            best = (node.paths and node.paths.longest(path)) or best
        return best


def host_of(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or none: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url):
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _passed(df: DataFrame, rules: list[Rule], best: str) -> DataFrame:
    """Keep in ``best`` (weight, rule, verdict) the longest rule so far."""
    trie = df.sparkSession.sparkContext.broadcast(HostTrie.of(rules))

    @F.pandas_udf("host int, path int, blocks int, rule string, verdict string")
    def walk(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        top = trie.value
        for hosts, paths in pairs:
            found = [top.longest(h, p) for h, p in zip(hosts, paths)]
            yield pd.DataFrame({
                "host": np.array([len(r.host) if r else -1 for r in found], np.int32),
                "path": np.array([len(r.path) if r else -1 for r in found], np.int32),
                "blocks": np.array([int(r.verdict == "block") if r else 0 for r in found], np.int32),
                "rule": np.array([r.text if r else None for r in found], object),
                "verdict": np.array([r.verdict if r else None for r in found], object),
            })

    found = walk("host", "path")
    return df.withColumn(best, F.greatest(best, found) if best in df.columns else found)


def judge(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", most: int = MAX_RULES) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``. ``most``: rules of a pass."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    best = shared.free_name(df, "_best")
    parted = df.select(*rest, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    for i in range(0, max(len(rules), 1), most):
        if i:
            parted = shared.write_table(parted, "judged")  # a worker holds one trie at a time
        parted = _passed(parted, rules[i : i + most], best)
    found = lambda c: F.col(best).getField(c)
    return parted.select(*rest, "host", "path", found("rule").alias("rule"), F.coalesce(found("verdict"), F.lit(default)).alias("verdict"))
