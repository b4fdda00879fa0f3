"""What the operators of this subpackage share: a workspace in the cluster's shared folder, joins and
ranks that stay even when one key holds a large share of the rows, and small expression helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Salts of a two-level rank; each (group, salt) is sorted by one task.
RANK_SALTS = 64
#: Bytes that Catalyst expects in a partition, below which neighbouring partitions are written as one file; and the
#: least number of files that a written table keeps for the tasks that read it.
FILE_BYTES = 32 << 20
LEAST_FILES = 32
#: Rows that go to a Python worker at once while a table is written; texts are long, and several copies of a batch are
#: in memory on either side.
BATCH_ROWS = 1000
#: Ids that are broadcast at most, 8 bytes each.
BROADCAST_IDS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a new temporary one, if all of Spark runs on this
    machine (tests); on a cluster that is an error, as executors would not see the folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='palimpsest-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder with Spark's own file system layer, so any store works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def compacted(df: DataFrame) -> DataFrame:
    """`df` in no more partitions than its size asks for, without a shuffle; they are written as so many files.

    Hundreds of tiny partitions otherwise become as many files, and making a file costs a process on some file
    systems. Catalyst expects too much of joins rather than too little, so what may be large stays as it is."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(int(min((1 << 31) - 1, max(LEAST_FILES, 4 * spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES)))))


class Workspace:
    """Written tables of one operator run. They cut lineage and survive lost executors.

    `table` writes a DataFrame and reads it back; `drop` deletes a table that is no longer needed. What the
    result still reads stays until the session's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._close)

    def _close(self) -> None:
        try:
            delete_path(self.spark, self.root)
        except Exception:  # the session has ended before; its folder is the cluster's to clean
            pass

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        rows, before = "spark.sql.execution.arrow.maxRecordsPerBatch", self.spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        try:
            self.spark.conf.set(rows, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
            compacted(df).write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(rows, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        delete_path(self.spark, self.path(name))


def release() -> None:
    """Give memory that this worker no longer uses back to the machine; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, for mapInArrow, with `release` at the end of each task."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def give_back(spark: SparkSession) -> None:
    """Let the executors give heap that they no longer use back to the machine, for the Python workers beside them.

    A JVM that has once grown to its limit keeps that memory, however little of it is in use, until a full collection
    makes it smaller. One short job with a task for each core asks for one; an executor that gets no task, or whose JVM
    ignores the request, stays as it is. No result depends on it."""
    cores = spark.sparkContext.defaultParallelism
    asked = spark.range(0, cores, 1, cores).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("asked"))
    asked.write.format("noop").mode("overwrite").save()


def input_partitions(df: DataFrame) -> int:
    """How many partitions a shuffle of this session makes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join for keys of which one may hold a third of the left rows.

    A derived second key keeps Spark from reusing a partitioning by `keys` alone, so both inputs get an
    exchange of their own and adaptive execution can split the hot partitions of the left side.
    """
    salt = F.xxhash64(*[F.col(k) for k in keys])
    a = left.withColumn("__key", salt)
    b = right.withColumn("__key", salt)
    return a.join(b, [*keys, "__key"], how).drop("__key")


def only_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of `df` whose `on` is among the long numbers in the one column of the written table `ids`. They are counted
    first: up to BROADCAST_IDS are broadcast, so `df` stays where it is; more are joined by a shuffle."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    named = ids.toDF(on)
    return df.join(F.broadcast(named) if few else named, on, "left_semi").select(*df.columns)


def unique_name(df: DataFrame, wanted: str) -> str:
    """A column name that no column of `df` has, in any case."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted = f"_{wanted}"
    return wanted


def fenced(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    """`df` with the columns `made`, each worked out once for a row.

    Catalyst copies a column's whole expression into every filter on it, also into those that it infers below
    explode(). It never copies what is not deterministic, so the columns travel in a struct with a row number.
    """
    fence = F.struct(*[c.alias(n) for n, c in made.items()], (F.monotonically_increasing_id() >= 0).alias("__done"))
    own = [c for c in df.columns if c not in made]
    return df.select(*own, fence.alias("__fence")).select(*own, *[F.col("__fence").getField(n).alias(n) for n in made])


def ranked(df: DataFrame, groups: list[str], order: list[Column], out: str, salts: int | Column = RANK_SALTS, deal: list[Column] | None = None) -> DataFrame:
    """Gapless rank from 0 within each group, in an arbitrary but repeatable order.

    Rows are dealt to `salts` parts of each group, a number for all or a column that is alike in a group, by a hash of
    `order`, or of `deal`; each part is numbered by itself and shifted by the rows of the parts before it. Only the counts, a row
    for each part, are gathered and broadcast, so `groups` must have a bounded number of values. `df` must be a
    written table or otherwise repeatable.
    """
    s, local, shift = "__salt", "__local", "__shift"
    dealt = df.withColumn(s, F.pmod(F.xxhash64(*(deal or order)), salts if isinstance(salts, Column) else F.lit(salts)).cast("int"))
    counts = dealt.groupBy(*groups, s).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy(s).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn(shift, F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long"))).drop("__n")
    own = Window.partitionBy(*groups, s).orderBy(*order)
    numbered = dealt.withColumn(local, F.row_number().over(own).cast("long") - 1)
    cond = F.lit(True)
    other = shifts.select(*[F.col(g).alias(f"__g_{g}") for g in groups], F.col(s).alias("__s"), shift)
    for g in groups:
        cond = cond & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    joined = numbered.join(F.broadcast(other), cond & (F.col(s) == F.col("__s")), "inner")
    return joined.withColumn(out, F.col(local) + F.col(shift)).drop(s, "__s", local, shift, *[f"__g_{g}" for g in groups])


def sorted_positions(ws: Workspace, df: DataFrame, order: list[Column], name: str, out: str) -> DataFrame:
    """Write `df` in total order of `order` and give every row its position in it, from 0.

    The rows are range-partitioned by all of `order`, so a hot leading key spreads over many tasks. A row's
    number is that within its partition plus the rows of the partitions before; the counts gathered are one
    for each partition.
    """
    n = input_partitions(df)
    laid = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    t = ws.table(laid, name)
    part = F.shiftrightunsigned(F.col("__at"), 33)
    counts = t.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long")).alias("__shift"))
    joined = t.withColumn("__p", part).join(F.broadcast(shifts), "__p", "inner")
    local = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn(out, local + F.col("__shift")).drop("__p", "__at", "__shift")


def connected_components(ws: Workspace, edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (u long, v long); component is the smallest node reachable.

    Alternating large-star and small-star rounds; each is two shuffles of the edge table, which never grows,
    and is written before the next, so a lost executor costs one round at most. The loop ends when a round
    changes nothing.
    """
    flip = lambda e: e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current, before = ws.table(edges, f"{name}-0"), None
    for i in range(1, max_rounds + 1):
        both = flip(current)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = skew_join(both.filter(F.col("v") > F.col("u")), low, ["u"], "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = skew_join(large, least, ["u"], "inner")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        small = small.filter(F.col("u") != F.col("v")).distinct()
        after = ws.table(small, f"{name}-{i}")
        seen = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if i > 1:
            ws.drop(f"{name}-{i - 1}")
        current = after
        if before == tuple(seen):
            break
        before = tuple(seen)
    else:
        raise RuntimeError("connected components did not settle")
    star = current.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return star.unionByName(roots)
