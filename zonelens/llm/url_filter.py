"""URL filter: a trie over reversed host labels and path segments.

Method: each rule's host is split into labels, taken from the right, and its path
into segments; the rules form one trie whose nodes after the host continue with
path segments.  The rules that end within a segment are looked up by its beginnings, one
look-up for each length that they have, however many they are.  The trie is broadcast and every url walks it once; the rule of
the deepest host, then of the longest path, wins.  Of an allow and a block entry
for the same host and path, allow wins.  Urls that no rule fits are allowed.

A rule fits its host and all its subdomains if the url's path starts with the
rule's path (plain prefix: ``/en/`` fits ``/en/1`` but not ``/en``).

The trie goes to every worker, so its size is checked: more than ``MOST_RULES``
rules raise an error instead of a broadcast (filter in several passes then).

Defined results: null urls and urls without ``://`` have empty host and path and
fit no rule; an empty rule list allows everything; repeated rows are judged one by
one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelens.llm.common import table
from zonelens.session import prepare_workers

#: (verdict, host, path): the rules of the production query.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
MOST_RULES = 1_000_000
DEFAULT = "allow"

_UPPER = {c: c + 32 for c in range(65, 91)}
_HOST = re.compile(r"[^/?#]*")
_PATH = re.compile(r"[^?#]*")


def host_and_path(url: str | None) -> tuple[str, str]:
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    host = _HOST.match(url, at + 3)
    return host[0].translate(_UPPER), _PATH.match(url, host.end())[0]


class _Node:
    """Of the host trie: next labels, and the path trie of the rules that end
    here.  Of the path trie: next whole segments, and the rules that end in this
    segment by its beginning, with the lengths that these have (longest first)."""

    __slots__ = ("next", "paths", "ends", "sizes")

    def __init__(self) -> None:
        self.next: dict[str, _Node] = {}
        self.paths: _Node | None = None
        self.ends: dict[str, tuple[str, str]] = {}
        self.sizes: list[int] = []

    def longest(self, segment: str) -> tuple[str, str] | None:
        """The rule with the longest beginning of ``segment``: a look-up per length."""
        for size in self.sizes:
            if size <= len(segment) and (found := self.ends.get(segment[:size])):
                return found
        return None


def build_trie(rules: Iterable[tuple[str, str, str]]) -> _Node:
    root, ending = _Node(), {}
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.translate(_UPPER).split(".")) if host else ():
            node = node.next.setdefault(label, _Node())
        node.paths = node.paths or _Node()
        node = node.paths
        *whole, last = path.split("/")
        for segment in whole:
            node = node.next.setdefault(segment, _Node())
        if last not in node.ends or verdict == "allow":
            node.ends[last] = host + path, verdict
        ending[id(node)] = node
    for node in ending.values():
        node.sizes = sorted({len(x) for x in node.ends}, reverse=True)
    return root


def _longest_path(node: _Node, path: str) -> tuple[str, str] | None:
    found = None
    segments = path.split("/")
    for i, segment in enumerate(segments):
        found = node.longest(segment) or found
        if i == len(segments) - 1 or (node := node.next.get(segment)) is None:
            return found
    return found


def judge(trie: _Node, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest match: host first, then path."""
    node, found = trie, trie.paths and _longest_path(trie.paths, path)
    for label in reversed(host.split(".")) if host else ():
        node = node.next.get(label)
        if node is None:
            break
        found = (node.paths and _longest_path(node.paths, path)) or found
    return found or None


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per row."""
    rules = list(rules)
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules are too many for one broadcast; filter in passes of {MOST_RULES}")
    prepare_workers(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(rules)

    def walk(batches):
        import pandas as pd

        trie = build_trie(shared.value)
        for batch in batches:
            parts = [host_and_path(None if u is None or u != u else u) for u in batch["url"]]
            # without :// there is no url to judge
            found = [judge(trie, h, p) if isinstance(u, str) and "://" in u else None
                     for u, (h, p) in zip(batch["url"], parts)]
            yield pd.DataFrame({
                "page_id": batch["page_id"], "host": [h for h, _ in parts], "path": [p for _, p in parts],
                "rule": [f and f[0] for f in found], "verdict": [f[1] if f else DEFAULT for f in found]})

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", F.col("url").cast("string").alias("url")).mapInPandas(
        walk, f"page_id {kind}, host string, path string, rule string, verdict string")


def op10_url_trie(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"))


OP10_SQL = r"""
WITH parts AS (SELECT page_id, url, coalesce(url LIKE '%://%', false) AS ok,
               substr(url, strpos(url, '://') + 3) AS rest FROM pages),
hp AS (SELECT page_id, ok, CASE WHEN ok THEN regexp_extract(rest, '^[^/?#]*') ELSE '' END AS raw_host, rest FROM parts),
u AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      CASE WHEN ok THEN regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') ELSE '' END AS path FROM hp),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
      ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT u.page_id, u.host, u.path, r.rhost, r.rpath, r.verdict,
      row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(r.rhost) DESC, length(r.rpath) DESC) AS k
      FROM u LEFT JOIN rules r ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath))
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
