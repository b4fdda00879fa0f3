"""Measures of operations: instruments with timers and counters, their sums, the slowest and the latest.

A measure is a row (name, instance, at, timers map<string,double>, counters map<string,bigint>)."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MEASURES = "name string, instance string, at double, timers map<string,double>, counters map<string,bigint>"
#: Measures of each operation that are kept: so many of the latest, and of the slowest.
KEPT = 20


def totals(measures: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, total, average) for each operation."""
    return measures.groupBy(by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("average"))


def first_of_each(measures: DataFrame, by: str, order: list, count: int) -> DataFrame:
    """The first `count` rows of each operation, with their rank. Spark keeps no more than that from each task."""
    w = Window.partitionBy(by).orderBy(*order)
    return measures.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= count)


def merged(groups: list[DataFrame], by: str, order: list, count: int) -> DataFrame:
    """The first `count` rows of each operation over several groups of measures, of which each may hold its own first."""
    both = groups[0]
    for g in groups[1:]:
        both = both.unionByName(g)
    return first_of_each(both.drop("rank"), by, order, count)


def history(measures: DataFrame, timer: str, count: int = KEPT) -> DataFrame:
    """`measures` (MEASURES) of each operation's latest and slowest, `count` of each, under group Recent or Slowest."""
    slow = first_of_each(measures, "name", [F.element_at("timers", timer).desc_nulls_last(), F.col("at"), F.col("instance")], count)
    recent = first_of_each(measures, "name", [F.desc("at"), F.desc("instance")], count)
    return slow.withColumn("group", F.lit("Slowest")).unionByName(recent.withColumn("group", F.lit("Recent")))


def summed(rows: DataFrame) -> DataFrame:
    """`history` with a Total and an Average for each group and operation: each timer and counter added up, and divided
    by the number of measures, counters in whole numbers."""
    keys = ["group", "name"]
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

    def of(column: str, kind: str) -> DataFrame:
        each = rows.select(*keys, F.explode(column).alias("k", "v")).groupBy(*keys, "k").agg(F.sum("v").cast(kind).alias("v")).join(n, keys)
        mean = F.expr("v div n") if kind == "bigint" else F.col("v") / F.col("n")
        return each.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(f"total_{column}"), F.map_from_entries(F.collect_list(F.struct("k", mean.alias("v")))).alias(f"mean_{column}"))

    none = {c: F.coalesce(c, F.from_json(F.lit("{}"), f"map<string,{k}>")) for c, k in (("total_timers", "double"), ("mean_timers", "double"), ("total_counters", "bigint"), ("mean_counters", "bigint"))}
    both = n.join(of("timers", "double"), keys, "left").join(of("counters", "bigint"), keys, "left").withColumns(none)
    line = lambda label, kind: both.select(*keys, F.lit(label).alias("instance"), F.col(f"{kind}_timers").alias("timers"), F.col(f"{kind}_counters").alias("counters"))
    return rows.select(*keys, "instance", "timers", "counters").unionByName(line("Total", "total")).unionByName(line("Average", "mean"))


class Instruments:
    """What a session has measured: of each operation the latest and the slowest, KEPT of each."""

    def __init__(self, kept: int = KEPT):
        self.kept = kept
        self.recent: dict[str, list[tuple]] = {}
        self.slowest: dict[str, list[tuple]] = {}

    @contextmanager
    def measured(self, name: str, instance: str, timer: str = "seconds") -> Iterator[dict[str, int]]:
        """Times what runs within; the dictionary that it gets is for counters."""
        began, counters = time.time(), {}
        try:
            yield counters
        finally:
            self.add((name, instance, began, {timer: time.time() - began}, dict(counters)))

    def add(self, measure: tuple) -> None:
        name = measure[0]
        self.recent[name] = [*self.recent.get(name, []), measure][-self.kept :]
        self.slowest[name] = sorted([*self.slowest.get(name, []), measure], key=lambda m: -max(m[3].values(), default=0))[: self.kept]

    def merge(self, other: Instruments) -> None:
        """Take the measures of another session in."""
        for name in other.recent:
            self.recent[name] = sorted([*self.recent.get(name, []), *other.recent[name]], key=lambda m: m[2])[-self.kept :]
            self.slowest[name] = sorted([*self.slowest.get(name, []), *other.slowest[name]], key=lambda m: -max(m[3].values(), default=0))[: self.kept]

    def table(self, spark: SparkSession) -> DataFrame:
        """(group, name, instance, timers, counters) of both, with Total and Average."""
        rows = [(g, *m) for g, kept in (("Recent", self.recent), ("Slowest", self.slowest)) for ms in kept.values() for m in ms]
        return summed(spark.createDataFrame(rows, f"group string, {MEASURES}"))
