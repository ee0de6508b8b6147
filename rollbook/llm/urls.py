"""Allow and block lists of hosts and paths, the longest entry that fits deciding.

The entries form a trie over host labels from the last to the first, and at each host one over path segments. It is sent to all
tasks while it has at most ``max_entries`` entries; a longer list is joined by key instead.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries that go to every task at most; at about 500 bytes an entry this is 50 MB.
MAX_ENTRIES = 100_000

Entry = tuple[str, str, str]  # verdict, host, path


@dataclass
class Segments:
    """Path entries below one host: whole segments lead on, the last one need only begin the url's."""

    next: dict[str, Segments] = field(default_factory=dict)
    begins: dict[str, str] = field(default_factory=dict)
    sizes: set[int] = field(default_factory=set)


@dataclass
class Labels:
    next: dict[str, Labels] = field(default_factory=dict)
    bare: str | None = None
    paths: Segments | None = None


def check_entry(verdict: str, host: str, path: str) -> None:
    if verdict not in ("allow", "block") or not host or path and not path.startswith("/"):
        raise ValueError(f"not an entry: {(verdict, host, path)}")


def _stronger(old: str | None, new: str) -> str:
    """Of two entries of the same host and path, the one that blocks."""
    return "block" if "block" in (old, new) else new


def build_trie(entries: Iterable[Entry]) -> Labels:
    root = Labels()
    for verdict, host, path in entries:
        check_entry(verdict, host, path)
        node = root
        for label in reversed(host.lower().split(".")):
            node = node.next.setdefault(label, Labels())
        if not path:
            node.bare = _stronger(node.bare, verdict)
            continue
        node.paths = at = node.paths or Segments()
        *whole, last = path.split("/")[1:]
        for segment in whole:
            at = at.next.setdefault(segment, Segments())
        at.begins[last] = _stronger(at.begins.get(last), verdict)
        at.sizes.add(len(last))
    return root


def match(root: Labels, host: str, path: str) -> tuple[str, str] | None:
    """Entry (host and path as one string) and verdict of the longest entry that fits; of equally long ones the one of the longer host."""
    best: tuple[int, str, str] | None = None
    labels = host.split(".")
    segments = path.split("/")[1:]
    node = root
    for k in range(len(labels) - 1, -1, -1):
        node = node.next.get(labels[k])
        if node is None:
            break
        own = ".".join(labels[k:])
        found = [(len(own), own, node.bare)] if node.bare else []
        at, before = node.paths, "/"
        for i, segment in enumerate(segments):
            if at is None:
                break
            for size in at.sizes:
                verdict = at.begins.get(segment[:size]) if size <= len(segment) else None
                if verdict:
                    rule = own + before + segment[:size]
                    found.append((len(rule), rule, verdict))
            at = at.next.get(segment) if i + 1 < len(segments) else None
            before += segment + "/"
        for x in found:
            if best is None or x[0] >= best[0]:
                best = x
    return best and best[1:]


def split_url(url: str | None) -> tuple[str, str]:
    """Host in lower case (A-Z only) and path; both empty without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, tail = rest[:end], rest[end:]
    cut = min((k for k in map(tail.find, "?#") if k >= 0), default=len(tail))
    return host.encode().lower().decode(), tail[:cut]


def _url_parts(url: Column) -> tuple[Column, Column]:
    parts = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)
    lower = F.transform(F.split(parts[0], ""), lambda c: F.when(c.rlike("^[A-Z]$"), F.lower(c)).otherwise(c))
    return F.coalesce(F.array_join(lower, ""), F.lit("")), F.coalesce(parts[1], F.lit(""))


def _by_trie(rows: DataFrame, entries: list[Entry], default: str, kind: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(build_trie(entries))

    def judge(batches):
        root = sent.value
        for b in batches:
            hosts, paths, rules, verdicts = [], [], [], []
            for url in b.column(1).to_pylist():
                host, path = split_url(url)
                rule, verdict = match(root, host, path) or (None, default)
                hosts.append(host)
                paths.append(path)
                rules.append(rule)
                verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, rules, verdicts))], ["id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(judge, f"id {kind}, host string, path string, rule string, verdict string")


def _by_join(rows: DataFrame, entries: DataFrame, default: str) -> DataFrame:
    """Each distinct host and path meets the entries of its host suffixes and its folders; the last part of an entry is checked after."""
    host, path = _url_parts(F.col("url"))
    parted = rows.select("id", host.alias("host"), path.alias("path"))
    each = parted.select("host", "path").distinct()
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    folders = F.concat(F.array(F.lit("")), F.when(F.size(segments) > 1, F.transform(F.sequence(F.lit(1), F.size(segments) - 1), lambda k: F.concat(F.array_join(F.slice(segments, 1, k), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>")))
    keys = each.withColumn("suffix", F.explode(suffixes)).withColumn("folder", F.explode(folders))
    own = F.regexp_extract("rule_path", r"^(?s:.*/|)", 0)
    listed = entries.select(F.lower("host").alias("suffix"), F.col("path").alias("rule_path"), F.col("verdict")).withColumn("folder", own)
    listed = listed.groupBy("suffix", "folder", "rule_path").agg(F.max("verdict").alias("verdict"))
    fit = keys.join(listed, ["suffix", "folder"]).where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("suffix", "rule_path")
    best = fit.groupBy("host", "path").agg(F.max_by(F.struct(rule.alias("rule"), "verdict"), F.struct(F.length(rule), F.length("suffix"))).alias("best"))
    out = parted.join(best, ["host", "path"], "left")
    return out.select("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def url_filter(df: DataFrame, entries: list[Entry] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_entries: int = MAX_ENTRIES) -> DataFrame:
    """Host, path, deciding entry and verdict of every row's url: ``id, host, path, rule, verdict``.

    An entry fits its host and all hosts below it, if the path begins with the entry's. The longest one decides, counted over host
    and path together, of equally long ones that of the longer host, and of two with one host and path the one that blocks.
    Without an entry that fits, rule is null and the verdict is the default. A null url or one without ``://`` has empty host and
    path. One row for each row of df; ids may be null or repeated; other columns are not read.
    entries: a list, or a DataFrame with ``verdict, host, path``.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("id"), df[url_col].alias("url"))
    if isinstance(entries, DataFrame):
        few = [tuple(r) for r in entries.select("verdict", "host", "path").limit(max_entries + 1).collect()]
    else:
        few = list(entries)
    if len(few) <= max_entries:
        return _by_trie(rows, few, default, kind)
    if not isinstance(entries, DataFrame):
        entries = df.sparkSession.createDataFrame(few, "verdict string, host string, path string")
    return _by_join(rows, entries, default)
