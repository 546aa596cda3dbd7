"""URL allow and block lists as a trie over reversed host labels and path segments.

The trie is broadcast and walked once per url: down the labels from the top-level domain, at
each node down the path segments. Of all rules met the longest (host and path together) wins.

Defined results
* Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: from there
  up to `?`, `#` or the end. Null urls and those without `://`: both empty, matched by no rule
  that names a host.
* A rule fits its host and all subdomains if the url's path starts with the rule's.
* Rules of equal length: more host labels first, then block before allow. No rule: `default`.
* Extra columns stay; own columns named host, path, rule or verdict are replaced.
* Lists over `bound` bytes are walked as several tries, each within the bound, and the
  longest of their answers wins; results are the same.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import lower_ascii

TRIE_BYTES = 32 << 20
ANSWER = "rule string, verdict string, size int, labels int, blocks int"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return (
        lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    )


class Trie:
    """Nodes are dictionaries; a host node holds under "" the root of its path trie."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]) -> None:
        self.root: dict = {"next": {}, "paths": None}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node["next"].setdefault(label, {"next": {}, "paths": None})
            *whole, tail = path.split("/")
            if node["paths"] is None:
                node["paths"] = {"next": {}, "tails": {}}
            at = node["paths"]
            for segment in whole:
                at = at["next"].setdefault(segment, {"next": {}, "tails": {}})
            answer = (host + path, verdict, len(host + path), host.count(".") + bool(host), int(verdict == "block"))
            at["tails"][tail] = max(at["tails"].get(tail, answer), answer, key=lambda a: a[2:])

    def longest(self, host: str, path: str) -> tuple | None:
        best, node, segments = None, self.root, path.split("/")
        labels = reversed(host.split("."))
        while node is not None:
            at, depth = node["paths"], 0
            while at is not None:
                for tail, answer in at["tails"].items():
                    if segments[depth].startswith(tail) and (best is None or answer[2:] > best[2:]):
                        best = answer
                at = at["next"].get(segments[depth]) if depth + 1 < len(segments) else None
                depth += 1
            label = next(labels, None)
            node = None if label is None else node["next"].get(label)
        return best


def packs(rules: list[tuple[str, str, str]], bound: int) -> list[list[tuple[str, str, str]]]:
    """The rules in groups of at most `bound` bytes as a trie, at some 600 bytes a node."""
    out, size = [[]], 0
    for rule in rules:
        weight = 600 * (2 + rule[1].count(".") + rule[2].count("/")) + len(rule[1]) + len(rule[2])
        if size + weight > bound and out[-1]:
            out.append([])
            size = 0
        out[-1].append(rule)
        size += weight
    return out


def walker(held: Broadcast):
    """A column function from host and path to the answer of a broadcast trie."""

    @F.pandas_udf(ANSWER)
    def walk(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        none = (None, None, -1, -1, -1)
        answers = [held.value.longest(h, p) or none for h, p in zip(hosts, paths)]
        return pd.DataFrame(answers, columns=["rule", "verdict", "size", "labels", "blocks"])

    return walk


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", bound: int = TRIE_BYTES
) -> DataFrame:
    """pages with host, path, rule and verdict; rules are (allow|block, host, path)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    found = []
    for k, pack in enumerate(packs(rules, bound)):
        walk = walker(pages.sparkSession.sparkContext.broadcast(Trie(pack)))
        rows = rows.withColumn(f"_found{k}", walk("host", "path"))
        found.append(f"_found{k}")
    rank = lambda c: F.struct(f"{c}.size", f"{c}.labels", f"{c}.blocks", f"{c}.rule", f"{c}.verdict")
    best = F.greatest(*map(rank, found)) if len(found) > 1 else rank(found[0])
    rows = rows.withColumn("_best", best)
    return rows.withColumns(
        {"rule": F.col("_best.rule"), "verdict": F.coalesce("_best.verdict", F.lit(default))}
    ).drop("_best", *found)
