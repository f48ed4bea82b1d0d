"""URL rules by a sort-merge range join: reversed-host keys turn host rules into intervals, a sorted sweep keeps the stack of active ones."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import extended

#: Rows between two cut points of the sorted keys, at least, and cut points at most.
ROWS_PER_RANGE, MAX_RANGES = 200_000, 4096


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def reversed_host(host: str) -> str:
    """Labels from the last to the first, each closed by a character below all others: a host's key is a prefix of its subdomains' keys."""
    return "".join(label + "\x01" for label in reversed(host.split("."))) if host else ""


def split_url(url):
    """Columns (host, path): the host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then the path up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)


class Sweep:
    """Takes rules and urls in the order of their keys and keeps the stack of rules whose host interval holds the key."""

    def __init__(self):
        self.stack: list[tuple[str, list[Rule]]] = []

    def _leave(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def enter(self, key: str, rule: Rule) -> None:
        self._leave(key)
        if self.stack and self.stack[-1][0] == key:
            self.stack[-1][1].append(rule)
        else:
            self.stack.append((key, [rule]))

    def judge(self, key: str, path: str) -> Rule | None:
        self._leave(key)
        fits = [r for _, rules in self.stack for r in rules if path.startswith(r.path)]
        return max(fits, key=lambda r: (len(r.text), len(r.host), r.verdict == "block", r.text), default=None)


def judge_urls(pages: DataFrame, rules: list[Rule] | DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule (host + path of the rule, else null) and verdict to every row of ``pages``.

    A rule fits its host and all subdomains if the path starts with the rule's path. The longest text of host and path wins; of equal
    lengths the longer host, then block, then the greater text. Where no rule fits, the verdict is ``default``.
    Null urls and urls without ``://`` have empty host and path, which no rule fits unless its host is empty too. Repeated rows are judged each.
    ``pages`` keeps its other columns; those named like an added one are replaced.

    The keys are cut into ranges of about equal rows, a host with very many urls among several; a rule goes to each range that its interval
    meets. Rules are a list or a DataFrame (verdict, host, path) of any size: they are never broadcast.
    """
    spark = pages.sparkSession
    added = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c not in added]
    host, path = split_url(pages[f"`{url}`"])
    urls = pages.select(F.struct(*[pages[f"`{c}`"] for c in kept]).alias("row"), host.alias("host"), path.alias("path"))
    labels = F.reverse(F.split("host", r"\."))
    urls = urls.withColumn("key", F.when(F.col("host") == "", "").otherwise(F.concat(F.array_join(labels, "\x01"), F.lit("\x01"))))
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
    rules = rules.select("verdict", "host", "path").where("host is not null and path is not null").dropDuplicates()
    rules = rules.withColumn("key", F.when(F.col("host") == "", "").otherwise(F.concat(F.array_join(labels, "\x01"), F.lit("\x01"))))

    # A cut is (key, place among equal keys); the place spreads a single key over many ranges.
    urls = urls.withColumn("place", F.xxhash64("row", "path"))
    n = pages.count()
    ranges = max(1, min(MAX_RANGES, -(-n // ROWS_PER_RANGE), n), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n))
    part = min(1.0, ranges * 60 / max(n, 1))
    sample = sorted((r["key"], r["place"]) for r in urls.select("key", "place").where(F.pmod("place", F.lit(1 << 20)) < int(part * (1 << 20)) + 1).collect())  # about 60 keys a range
    cuts = [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []
    shared = spark.sparkContext.broadcast(cuts)
    lowest = -(1 << 63)

    def range_of(keys: pa.Array, places: pa.Array) -> list[int]:
        return [bisect_right(shared.value, x) for x in zip(keys.to_pylist(), places.to_pylist(), strict=True)]

    def with_range(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range_of(batch.column("key"), batch.column("place")), pa.int32())], [*batch.schema.names, "range"])

    def to_ranges(batches):
        for batch in batches:
            rows, found = [], []
            for i, key in enumerate(batch.column("key").to_pylist()):
                first, last = bisect_right(shared.value, (key, lowest)), bisect_right(shared.value, (key + "\U0010ffff", 1 << 63))
                rows += [i] * (last - first + 1)
                found += range(first, last + 1)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows, pa.int64())).columns, pa.array(found, pa.int32())], [*batch.schema.names, "range"])

    urls = urls.select("key", "place", "path", "host", "row")
    both = urls.mapInArrow(with_range, extended(urls.schema, range=T.IntegerType()))
    left = rules.select("key", "path", "host", "verdict")
    left = left.mapInArrow(to_ranges, extended(left.schema, range=T.IntegerType()))
    both = both.withColumns({"is_url": F.lit(1), "verdict": F.lit(None).cast("string")}).unionByName(left.withColumns({"is_url": F.lit(0), "place": F.lit(lowest)}), allowMissingColumns=True)
    dealt = both.repartitionById(ranges, "range").sortWithinPartitions("range", "key", "is_url", "place")
    columns = ["range", "key", "is_url", "path", "host", "verdict", "row"]

    def sweep(batches):
        now, at = Sweep(), None
        for batch in batches:
            where, keys, kinds, paths, hosts, verdicts = (batch.column(c).to_pylist() for c in columns[:6])
            keep, rule_texts, found = [], [], []
            for i in range(batch.num_rows):
                if where[i] != at:
                    now, at = Sweep(), where[i]
                if kinds[i]:
                    rule = now.judge(keys[i], paths[i])
                    keep.append(i)
                    rule_texts.append(rule and rule.text)
                    found.append(rule.verdict if rule else default)
                else:
                    now.enter(keys[i], Rule(verdicts[i], hosts[i], paths[i]))
            out = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([out.column("row"), out.column("host"), out.column("path"), pa.array(rule_texts, pa.string()), pa.array(found, pa.string())], ["row", *added])

    dealt = dealt.select(*columns)
    schema = extended(urls.select("row").schema, **{c: T.StringType() for c in added})
    out = dealt.mapInArrow(sweep, schema)
    return out.select(*[F.col("row")[c].alias(c) for c in kept], *added)
