"""URL rules by a sort-merge range join.

A host is keyed by its labels in reverse, each closed by a comma, so a rule's host
and all its subdomains are one interval of keys: those that start with the rule's.
URLs and rules are cut into ranges of keys together and sorted. A rule goes to every
range that its interval meets; beside its own range these are only the ranges that
begin inside it, so there are no more rows than rules and, for each range, the
parents of its first host. One sweep over a range keeps a stack of the rules whose
intervals are open; intervals nest, so leaving one pops it. Of the stack's rules
whose path starts the URL's, the longest (host and path together, then host) decides.
A host's own rules are looked up by the lengths of their paths.

Ranges are cut by key and id together, so a host with a third of the rows spreads
over several. Nothing but the ranges' bounds passes through the driver.

Cases: a null url, or one without ``://``, has an empty host and path, no rule and
the default verdict. A url without a path has the empty path, which only a rule with
an empty path starts. Rules that lack host or path are left out; of two with one host
and path the last verdict in order of letters counts (block before allow). Repeated
rows are judged each. Empty tables give empty results. Extra columns are not read. A
null id stays null.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm import ranges
from plumbline.llm.batches import sliced

#: URLs for which a range is made, where there are so many.
RANGE_ROWS = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_key(host: Column) -> Column:
    return F.concat(F.concat_ws(",", F.reverse(F.split(host, r"\."))), F.lit(","))


class Sweep:
    """Takes rules and urls in order of their keys; holds the stack of open rules, an entry for each host."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str, dict[int, dict[str, str]]]] = []  # key, host, verdicts by path, by its length

    def enter(self, key: str) -> None:
        """Leaves the intervals that don't hold the key."""
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def add(self, key: str, host: str, path: str, verdict: str | None) -> None:
        self.enter(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, host, {}))
        same = self.stack[-1][2].setdefault(len(path), {})
        same[path] = max(same.get(path) or "", verdict or "")

    def decide(self, key: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest open rule whose path starts this one."""
        self.enter(key)
        best = None
        for _, host, paths in self.stack:  # outermost first, so hosts get longer
            fit = max((n for n in paths if n <= len(path) and path[:n] in paths[n]), default=None)
            if fit is not None and (best is None or len(host) + fit >= best[0]):
                best = len(host) + fit, host + path[:fit], paths[fit][path[:fit]]
        return best and best[1:]


def _parsed(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    url = F.col(url_col)
    return pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))


def _ranged(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(part, key, kind, page_id, host, path, verdict) in order inside each part, rules (kind 0) first."""
    count = rows.count()
    parts = ranges.buckets(rows.sparkSession, count, RANGE_ROWS)
    place = F.concat("key", F.lit("\0"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    bounds = ranges.sampled_bounds(rows.select(place), parts, count)
    urls = rows.select(ranges.bucket(bounds, lambda b: b < place).alias("part"), "key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    key = F.col("key")
    first, last = ranges.bucket(bounds, lambda b: b < key), ranges.bucket(bounds, lambda b: (b < key) | F.startswith(b, key))
    held = rules.select(F.explode(F.sequence(first, last)).alias("part"), "key", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["page_id"].dataType).alias("page_id"), "host", "path", "verdict")
    return held.unionByName(urls).repartitionById(parts, "part").sortWithinPartitions("part", "key", "kind")


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row; ``rules``: host, path, verdict."""
    rows = _parsed(pages, id_col, url_col).withColumn("key", host_key(F.col("host")))
    keyed = rules.select(host_key(F.col("host")).alias("key"), "host", "path", "verdict").where("host is not null and path is not null")
    ordered = _ranged(rows, keyed)
    struct = T.StructType([rows.schema["page_id"], *T.StructType.fromDDL("host string, path string, rule string, verdict string")])
    arrow = to_arrow_schema(struct)

    def run(batches):
        now, sweep = None, Sweep()
        for batch in sliced(batches):
            urls, found = [], []
            for i, (part, key, kind, host, path, verdict) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("part", "key", "kind", "host", "path", "verdict")), strict=True)):
                if part != now:
                    now, sweep = part, Sweep()
                if kind:
                    urls.append(i)
                    found.append(sweep.decide(key, path) or (None, default))
                else:
                    sweep.add(key, host, path, verdict)
            mine = batch.take(pa.array(urls, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(mine.column(n) for n in ("page_id", "host", "path")), *(pa.array([x[k] for x in found], pa.string()) for k in (0, 1))], schema=arrow)

    return ordered.mapInArrow(run, struct)
