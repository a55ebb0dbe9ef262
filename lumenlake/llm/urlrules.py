"""URL allow and block rules as a sort-merge range join."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JUDGED = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host (after the first :// up to / ? # or the end, A-Z lower-cased) and path (up to ? or #); both empty without ://."""
    u = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


class Paths:
    """The path rules of one host, sorted; each knows the nearest other one that is a prefix of it."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.rules = sorted(rules)
        self.paths, self.within, stack = [r[0] for r in self.rules], [], []
        for k, path in enumerate(self.paths):
            while stack and not path.startswith(self.paths[stack[-1]]):
                stack.pop()
            self.within.append(stack[-1] if stack else -1)
            stack.append(k)

    def longest(self, path: str) -> tuple[str, str, str] | None:
        """The rule with the longest path that `path` starts with."""
        k = bisect_right(self.paths, path) - 1
        while k >= 0 and not path.startswith(self.paths[k]):
            k = self.within[k]
        return self.rules[k] if k >= 0 else None


class Sweep:
    """A stack of the hosts whose interval holds the current key, each with its path rules.

    A host's interval is every key that starts with its own, so intervals are nested or apart. Rules come in
    the order of their keys, before the urls of the same key.
    """

    def __init__(self):
        self.stack: list[tuple[str, Paths]] = []
        self.coming: list[tuple[str, str, str]] = []
        self.key: str | None = None

    def rule(self, key: str, path: str, said: str, verdict: str) -> None:
        if key != self.key:
            self.settle(key)
            self.key = key
        self.coming.append((path, said, verdict))

    def settle(self, key: str) -> None:
        """Close the host whose rules came last, and leave those whose interval ends before key."""
        if self.coming:
            self.stack.append((self.key, Paths(self.coming)))
            self.coming = []
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def best(self, key: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule (host and path) for a url whose key is not below the last one; on ties that of the longer host."""
        self.settle(key)
        found = (None, None)
        for _, paths in reversed(self.stack):
            held = paths.longest(path)
            if held and (found[0] is None or len(held[1]) > len(found[0])):
                found = held[1:]
        return found


def split_points(urls: DataFrame, parts: int, a_part: int) -> list[tuple]:
    """At most parts - 1 places (key, path, page_id) that deal the urls evenly, from about `a_part` of them for each part."""
    share = min(1.0, parts * a_part / max(1, urls.count()))
    picked = urls.select("key", "path", "page_id").sample(share, 5).collect()
    order = sorted((r["key"], r["path"], -1 if r["page_id"] is None else r["page_id"]) for r in picked)
    return sorted({order[k * len(order) // parts] for k in range(1, parts)} if order else set())


def _steps(fits, step: int) -> Column:
    at = F.size(F.filter("_fences", fits))
    before = (F.greatest(at, F.lit(1)) - 1) * step
    return F.when(at > 0, before + F.size(F.filter(F.slice("_points", before + 1, F.lit(step)), fits))).otherwise(0)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", parts: int | None = None, a_part: int = 50) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages.

    rules: host, path, verdict, any number. A rule fits its host and all subdomains if the url's path starts
    with its path; the longest rule (host and path) wins, on equal length that of the longer host. Null urls
    and urls without :// have an empty host and path, no rule and the default verdict. Rules with a null
    field are ignored; of equal rules with two verdicts the greater one (`block` over `allow`) holds. Repeated
    pages are kept; a null page_id keeps its row.

    Urls are dealt to `parts` ranges of (key, path, page_id), so a host with very many pages is spread over tasks.
    The ranges follow from a sample of about a_part urls for each, which decides the balance only. A rule goes to each range that its
    interval of keys meets; a task sweeps the sorted rules and urls of its range and holds no more than the
    rules of the hosts around the current key.
    """
    spark = pages.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path("url")
    key = lambda h: F.concat(F.array_join(F.reverse(F.split(h, r"\.")), "\x00"), F.lit("\x00"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("key", key(F.col("host")))
    points = split_points(urls, parts, a_part)
    step = max(1, math.isqrt(len(points)))
    kind = "array<struct<key:string,path:string,page_id:long>>"
    held = spark.createDataFrame([(points, points[::step])], f"_points {kind}, _fences {kind}")  # one row of parts - 1 places
    # how many of the sorted places fit, if none fits after one that does not: first among every step-th, then within a step
    count = lambda fits: _steps(fits, step)
    own = F.struct("key", "path", F.coalesce("page_id", F.lit(-1)).alias("page_id"))
    dealt = urls.crossJoin(F.broadcast(held)).withColumn("part", count(lambda p: p <= own)).drop("_points", "_fences")
    rules = rules.select("host", "path", "verdict").dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", key(F.col("host")))
    low = count(lambda p: p["key"] < F.col("key"))
    high = count(lambda p: (p["key"] <= F.col("key")) | F.startswith(p["key"], F.col("key")))
    spread = rules.crossJoin(F.broadcast(held)).withColumn("part", F.explode(F.sequence(low, F.greatest(low, high)))).drop("_points", "_fences")
    both = dealt.select("part", "key", F.lit(1).alias("url"), "path", "page_id", "host", F.lit(None).cast("string").alias("verdict"))
    both = both.unionByName(spread.select("part", "key", F.lit(0).alias("url"), "path", F.lit(None).cast("long").alias("page_id"), "host", "verdict"))
    both = both.repartitionByRange(parts, "part").sortWithinPartitions("part", "key", "url")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at = Sweep(), None
        for batch in batches:
            out: list[tuple] = []
            for part, k, url, p, page, h, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    state, at = Sweep(), part
                if url:
                    rule, verdict = state.best(k, p)
                    out.append((page, h, p, rule, verdict or default))
                else:
                    state.rule(k, p, h + p, v)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(JUDGED.types)], schema=JUDGED)

    return both.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")
