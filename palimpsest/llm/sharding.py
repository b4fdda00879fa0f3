"""Shards by balanced label propagation.

Documents are first dealt to shards by a hash of their keys, so that counts differ by one at most and groups of linked
documents lie scattered. Then rounds of joins move linked documents towards the shards that hold most of their
neighbours. A move from one shard to another is matched with a move the other way, and otherwise with a document
without links or, where a large group gathers, with members of small ones, so every round leaves every shard's count as it
was. Rounds go on while fewer links are cut.
"""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Workspace, ranked, skew_join, sorted_positions

SHARDS = 40
#: Rows of one part of a rank, and parts of each group at least.
PART_ROWS = 200_000
LEAST_PARTS = 8
#: Members at most of a group that gives way, whole as far as may be, to one that has at least BIG where it gathers.
SMALL = 16
BIG = 64


def quotas(wanted: dict[tuple[int, int], int], free: dict[int, int]) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], int]]:
    """How many linked, and how many free, documents move from one shard to another.

    Each wish is met by a wish the other way, or by a free document of the shard that it goes to; counts stay."""
    linked: dict[tuple[int, int], int] = {}
    loose: dict[tuple[int, int], int] = defaultdict(int)
    left = dict(free)
    for (a, b), n in sorted(wanted.items()):
        swap = min(n, wanted.get((b, a), 0))
        rest = min(n - swap, left.get(b, 0))
        left[b] = left.get(b, 0) - rest
        if swap + rest:
            linked[a, b] = swap + rest
        if rest:
            loose[b, a] += rest
    return linked, dict(loose)


def _parts(largest: int) -> int:
    return max(LEAST_PARTS, -(-largest // PART_ROWS))


def _homes(counts: DataFrame, free: dict[int, int], size: int) -> DataFrame:
    """(hub, out, homes) of hubs in several shards: the shards (shard, n: members, upto) that are to hold the hub, and
    how many members are to move there, of which `upto` go to this home or one before it.

    Shards that have documents to give in exchange come first, then those with most members, then by a hash; there are
    as many homes as members in such shards fill. The first homes are filled first."""
    open_ = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in free.items() for x in kv]) if free else F.create_map(F.lit(-1), F.lit(0)), F.col("shard")), F.lit(0)) > 0
    at = F.sort_array(F.collect_list(F.struct(open_.alias("open"), "n", F.xxhash64("hub", "shard").alias("h"), "shard")), asc=False)
    lists = counts.groupBy("hub").agg(at.alias("at"), F.sum(F.when(open_, F.col("n")).otherwise(0)).alias("moving")).filter(F.size("at") > 1)
    lists = lists.withColumn("k", F.least(F.size("at"), F.greatest(F.lit(1), F.ceil(F.col("moving") / size).cast("int"))))
    leaving = lambda k: F.filter(F.slice("at", k + 1, F.size("at")), lambda x: x["n"] <= F.col("at")[0]["n"])
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    # With all members at home, those of the last home fill the others up.
    k = F.when((total(leaving(F.col("k"))) == 0) & (F.col("k") > 1), F.col("k") - 1).otherwise(F.col("k"))
    lists = lists.withColumn("k", k).withColumn("first", F.slice("at", F.lit(1), F.col("k"))).withColumn("rest", leaving(F.col("k")))
    room = F.transform("first", lambda x: F.greatest(F.lit(0), F.lit(size) - x["n"]))
    homes = F.transform("first", lambda x, i: F.struct(x["shard"].alias("shard"), x["n"].alias("n"), F.aggregate(F.slice("room", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, b: a + b).alias("upto")))
    return lists.withColumn("room", room).select("hub", total("rest").alias("out"), homes.alias("homes")).filter("out > 0")


def propagate(ws: Workspace, nodes: DataFrame, members: DataFrame, report: list[int] | None = None) -> DataFrame:
    """`nodes` (node long, shard int, free boolean) after rounds of moves towards the shards of linked documents.

    `members` (node, hub) are the links: all nodes of a hub are linked to each other; a single edge is a hub of two.
    Nodes without links are free. A shard's count of nodes never changes. The rounds end when no move that gains is
    left, or when one has cut no fewer links than the one before, whose result then stands. `report`, if given, gets
    the number of links cut before the first round and after each.

    Free nodes are alike, so during the rounds they are counted only; they are dealt to what is left at the end.
    """
    spark = ws.spark
    sizes, free = {}, {}
    for r in nodes.groupBy("shard", "free").count().collect():  # two for each shard
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["count"]
        if r["free"]:
            free[r["shard"]] = r["count"]
    first = dict(free)
    linked = nodes.filter(~F.col("free")).select("node", "shard")
    size, before, last, i = max(sizes.values(), default=0), (linked, dict(free)), None, 0
    while True:
        placed = members.join(linked, "node", "inner")
        counts = ws.table(placed.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n")), f"counts{i}")
        square = lambda c: F.col(c).cast("decimal(38,0)") * F.col(c)
        pairs = counts.groupBy("hub").agg(F.sum("n").alias("m"), F.sum(square("n")).alias("q")).select(((square("m") - F.col("q")) / 2).alias("cut"))
        cut = int(pairs.agg(F.coalesce(F.sum("cut"), F.lit(0))).first()[0])
        if last is not None and cut >= last:
            linked, free = before
            break
        if report is not None:
            report.append(cut)
        if not cut:
            break
        before, last = (linked, dict(free)), cut
        moved = _round(ws, i, placed, counts, sizes, free, size)
        if moved is None:
            break
        linked = ws.table(linked.join(moved, "node", "left").select("node", F.coalesce("to", "shard").alias("shard")), f"linked{i}")
        i += 1
    if free == first:
        return linked.withColumn("free", F.lit(False)).unionByName(nodes.filter("free"))
    # Shards that have more free nodes than places for them give those of the last ranks to the others.
    given = [(s, free.get(s, 0), n - free.get(s, 0)) for s, n in sorted(first.items()) if n > free.get(s, 0)]
    wanting = [[s, n - first.get(s, 0)] for s, n in sorted(free.items()) if n > first.get(s, 0)]
    runs = []
    for s, at, n in given:
        while n:
            use = min(n, wanting[0][1])
            runs.append((s, at, at + use, wanting[0][0]))
            at, n, wanting[0][1] = at + use, n - use, wanting[0][1] - use
            if not wanting[0][1]:
                wanting.pop(0)
    at = ranked(nodes.filter("free").select("node", "shard"), ["shard"], [F.col("node")], "rank", _parts(max(first.values())))
    rest = at.select("node", F.coalesce(_target(runs), F.col("shard")).alias("shard"), F.lit(True).alias("free"))
    return ws.table(linked.withColumn("free", F.lit(False)).unionByName(rest), "dealt")


def _target(runs: list[tuple[int, int, int, int]]) -> F.Column:
    """Where a row (shard, rank) moves by runs (shard, low, high, to), of which there are a few for each pair of shards."""
    spans = F.lit(json.dumps([dict(zip(("s", "a", "b", "t"), r, strict=True)) for r in runs]))
    table = F.from_json(spans, "array<struct<s:int,a:bigint,b:bigint,t:int>>")
    return F.try_element_at(F.filter(table, lambda x: (x["s"] == F.col("shard")) & (x["a"] <= F.col("rank")) & (F.col("rank") < x["b"])), F.lit(1))["t"]


def _round(ws: Workspace, i: int, placed: DataFrame, counts: DataFrame, sizes: dict[int, int], free: dict[int, int], size: int) -> DataFrame | None:
    """(node, to) of the linked nodes that move in round i, and `free` changed by the free ones that make room; None if
    none can move."""
    spark = ws.spark
    small = counts.groupBy("hub").agg(F.sum("n").alias("m")).filter(F.col("m") <= SMALL)
    small = ws.table(skew_join(placed, small.select("hub"), ["hub"], "left_semi").groupBy("node", "shard").agg(F.min("hub").alias("hub")), f"small{i}")
    spare = free | {r["shard"]: r["count"] + free.get(r["shard"], 0) for r in small.groupBy("shard").count().collect()}
    away = counts.join(_homes(counts, spare, size), "hub", "inner").filter(~F.exists("homes", lambda x: x["shard"] == F.col("shard")))
    asks = skew_join(placed, away, ["hub", "shard"], "inner")
    turn = F.pmod(F.xxhash64("node", F.lit(i)), F.col("out"))
    home = F.coalesce(F.try_element_at(F.filter("homes", lambda x: x["upto"] > turn), F.lit(1)), F.element_at("homes", -1))
    asks = asks.withColumn("home", home).select("node", "shard", F.col("home.shard").alias("to"), (F.col("home.n") - F.col("n") + 1).alias("gain"), (F.col("home.n") >= BIG).alias("big"))
    asks = asks.groupBy("node", "shard", "to").agg(F.sum("gain").alias("gain"), F.max("big").alias("big")).filter("gain > 0")
    asks = asks.groupBy("node", "shard").agg(F.max(F.struct("gain", F.xxhash64("node", "to", F.lit(i)).alias("h"), "to", "big")).alias("best"))
    asks = ws.table(asks.select("node", "shard", "best.to", "best.big"), f"asks{i}")
    # Members of small groups that stay may give way, in the order of their hubs, so that most groups move as a whole.
    settled = ws.table(small.join(asks.select("node"), "node", "left_anti"), f"settled{i}")
    yielding = {r["shard"]: r["count"] for r in settled.groupBy("shard").count().collect()}
    wanted: dict[bool, dict[tuple[int, int], int]] = {True: {}, False: {}}
    for r in asks.groupBy("shard", "to", "big").count().collect():  # twice the shards squared at most
        wanted[r["big"]][r["shard"], r["to"]] = r["count"]
    limits, runs, start, left = [], [], defaultdict(int), dict(free)
    for big in (True, False):
        room = {s: left.get(s, 0) + big * (yielding.get(s, 0)) for s in sizes}
        mine, loose = quotas(wanted[big], room)
        limits += [(a, b, big, n) for (a, b), n in mine.items()]
        for (a, b), n in sorted(loose.items()):
            use = min(n, left.get(a, 0))
            left[a] = left.get(a, 0) - use
            free[a], free[b] = free.get(a, 0) - use, free.get(b, 0) + use
            if n > use:
                runs.append((a, start[a], start[a] + n - use, b))
                start[a] += n - use
    if not limits:
        return None
    limit = spark.createDataFrame(limits, "shard int, to int, big boolean, quota long")
    own = ranked(asks, ["shard", "to", "big"], [F.col("node")], "rank", _parts(max(n for w in wanted.values() for n in w.values())))
    moved = own.join(F.broadcast(limit), ["shard", "to", "big"], "inner").filter("rank < quota").select("node", "to")
    if runs:
        at = ranked(settled, ["shard"], [F.col("hub"), F.col("node")], "rank", _parts(max(yielding.values())), deal=[F.col("hub")])
        moved = moved.unionByName(at.select("node", _target(runs).alias("to")).filter("to is not null"))
    return moved


def shard_rows(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, report: list[int] | None = None) -> DataFrame:
    """Per row: key, size, text_crc32, law ("rows": counts of any two shards differ by one at most), shard, slot
    (gapless from 0 in each shard) and grown_shard (null). `report` is as in `propagate`.

    Size is the text's UTF-8 bytes plus 16, whatever its length. Null texts count as empty, and are linked with the
    empty ones; rows with null keys and repeated rows are placed like any other; other columns are ignored; an empty
    table gives none. A group larger than a shard fills as many as it needs.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "sharding")
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = df.select(
        F.col(key).alias("key"), (F.octet_length(data) + 16).cast("long").alias("size"), F.crc32(data).cast("long").alias("text_crc32"),
        F.unhex(F.sha2(data, 256)).alias("hub"))
    placed = ws.table(sorted_positions(ws, rows, [F.xxhash64("key"), F.col("key"), F.col("hub")], "sorted", "node"), "placed")
    total = placed.count()
    many = placed.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hub", F.lit(True).alias("linked"))
    nodes = skew_join(placed.select("node", "hub"), many, ["hub"], "left")
    nodes = ws.table(nodes.select("node", F.floor(F.col("node") * shards / max(total, 1)).cast("int").alias("shard"), F.col("linked").isNull().alias("free"), F.when(F.col("linked"), F.col("hub")).alias("hub")), "nodes")
    members = nodes.filter(~F.col("free")).select("node", "hub")
    final = propagate(ws, nodes.select("node", "shard", "free"), members, report)
    located = ws.table(placed.drop("hub").join(final.select("node", "shard"), "node", "inner"), "located")
    out = ranked(located, ["shard"], [F.col("node")], "slot", _parts(-(-total // shards)))
    return out.select(F.col("key").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
