"""The command log: what a queue of additions, drops and associations makes of a collection.

Commands are ordered by queue_id, then priority. The last addition or drop of a document decides. A stream of
commands is folded batch by batch into versions of the collection; a batch that is run again writes the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.sources.store import Table, staged

LOG = "queue_id long, action string, doctype long, docid long, source string, target string, text string, status string"
#: Within one queue_id a drop comes first, so adding a document again replaces it.
PRIORITY = {"drop": 1, "add": 2, "associate_all": 3, "associate": 4, "load": 5}
#: Numbers of the states of a command, by which the queue sorts.
STATUS = {"Finished": 1, "Failed": 2, "Active": 3, "Queued": 4}
#: What may run together: changes of documents, or commands of one other action.
KIND = {"drop": "change", "add": "change", "associate_all": "associate_all", "associate": "associate", "load": "load"}


def priority(action) -> F.Column:
    out = F.lit(9)
    for name, n in PRIORITY.items():
        out = F.when(action == name, n).otherwise(out)
    return out


def command_key(status: int, queue_id: int, action: str, action_number: int, doctype: int, docid: int, source: str = "", target: str = "") -> str:
    """The text by which the queue sorts commands."""
    return f"{status}|{queue_id:020d}|{PRIORITY[action]:03d}|{action_number}|{doctype:010d}|{docid:010d}|{source}|{target}"


def latest(log: DataFrame) -> DataFrame:
    """The last addition or drop of each document. Only the winner of each key leaves a task."""
    changes = log.filter(F.col("action").isin("add", "drop")).withColumn("priority", priority(F.col("action")))
    rest = F.struct(*[c for c in log.columns if c not in ("doctype", "docid")])
    won = changes.groupBy("doctype", "docid").agg(F.max_by(rest, F.struct("queue_id", "priority")).alias("c"))
    return won.select("doctype", "docid", "c.*")


def applied(docs: DataFrame, log: DataFrame) -> DataFrame:
    """`docs` (doctype, docid, text, and meta if `log` has it too) after all commands of `log`. An added document
    replaces the one that was there, with its metadata."""
    columns = ["doctype", "docid", "text", *(["meta"] if "meta" in docs.columns and "meta" in log.columns else [])]
    last = latest(log).select("action", *columns)
    kept = docs.select(*columns).join(last.select("doctype", "docid"), ["doctype", "docid"], "left_anti")
    return kept.unionByName(last.filter(F.col("action") == "add").select(*columns))


def runs(keys: list[tuple[int, str]]) -> list[tuple[str, int, int]]:
    """(kind, first and last place) of the stretches of commands, (queue_id, action) in order, that may run together."""
    out: list[tuple[str, int, int]] = []
    for i, (_, action) in enumerate(keys):
        if out and out[-1][0] == KIND[action]:
            out[-1] = (out[-1][0], out[-1][1], i)
        else:
            out.append((KIND[action], i, i))
    return out


def associations_due(log: DataFrame, docs: DataFrame) -> DataFrame:
    """(queue_id, doctype, docid, target) of single associations whose document exists; the others failed."""
    asked = log.filter(F.col("action") == "associate").select("queue_id", "doctype", "docid", "target")
    return asked.join(docs.select("doctype", "docid"), ["doctype", "docid"], "left_semi")


def finished(log: DataFrame, docs: DataFrame) -> DataFrame:
    """`log` with status Finished, or Failed for associations of documents that are not there."""
    have = docs.select("doctype", "docid").distinct().withColumn("there", F.lit(True))
    out = log.drop("status").join(have, ["doctype", "docid"], "left")
    failed = (F.col("action") == "associate") & F.col("there").isNull()
    return out.withColumn("status", F.when(failed, "Failed").otherwise("Finished")).drop("there")


def listing(log: DataFrame, start: int = 0, limit: int = 100) -> DataFrame:
    """A page of the queue from queue_id `start` on."""
    return log.withColumn("priority", priority(F.col("action"))).filter(F.col("queue_id") >= start).orderBy("queue_id", "priority").limit(limit)


def cursors(log: DataFrame, start: int = 0, limit: int = 100) -> dict[str, int | None]:
    """Queue ids of the first command, of those that the previous, the next and the last page begin with, and how many
    commands there are. Each is a bounded sort."""
    order = [F.col("queue_id"), priority(F.col("action"))]
    take = lambda rows, n, back=False: [r[0] for r in rows.orderBy(*[x.desc() if back else x.asc() for x in order]).select("queue_id").limit(n).collect()]
    here = take(log.filter(F.col("queue_id") >= start), limit + 1)
    before = take(log.filter(F.col("queue_id") < start), limit, True)
    ends = take(log, limit, True)
    first = take(log, 1)
    return {
        "first": first[0] if first else None, "previous": before[-1] if before else None, "next": here[limit] if len(here) > limit else None,
        "last": ends[-1] if ends else None, "total": log.count()}


def numbered(commands: DataFrame, after: int) -> DataFrame:
    """Commands with queue_ids that follow `after`, in the order of their `at` column, without gaps. They are laid out
    by `at` once; each task numbers its own, and the counts of the tasks before, one row for each, are added."""
    n = int(commands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = commands.repartitionByRange(n, "at").sortWithinPartitions("at").withColumn("__at", F.monotonically_increasing_id())
    laid = staged(laid, "commands")
    part = F.shiftrightunsigned(F.col("__at"), 33)
    counts = laid.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    shifts = counts.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    both = laid.withColumn("__p", part).join(F.broadcast(shifts), "__p")
    return both.withColumn("queue_id", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__s") + F.lit(after + 1)).drop("__at", "__p", "__s")


class Versions(Table):
    """Versions of a collection in a folder, one for each batch of commands; the newest complete one counts."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, "doctype long, docid long, text string")

    def apply(self, batch: DataFrame, number: int) -> None:
        """Fold a batch into the version before it. A batch that is run again writes the same version."""
        self.write(applied(self.read(number), batch), number)


def run(spark: SparkSession, log_path: str, versions: Versions, checkpoint: str, files_per_batch: int = 20) -> StreamingQuery:
    """Fold the commands that have arrived as Parquet files in `log_path` into `versions`, then stop."""
    log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).parquet(log_path)
    return log.writeStream.foreachBatch(versions.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
