"""Tables of a collection that stay: versions in a folder, of which the newest complete one counts.

A version is written as a whole and named last by Spark's _SUCCESS file, so a job that fails, or runs again, leaves
the version before it in force. Old versions stay for readers that still hold them, and go when `clean` is called.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "doctype long, docid long, text string, meta map<string,string>"
_PASSAGE = "left: bigint, right: bigint, length: bigint, uc_left: bigint, uc_right: bigint, uc_length: bigint, hash: bigint"
ASSOCIATIONS = f"q_doctype long, q_docid long, doctype long, docid long, fragments array<struct<{_PASSAGE}>>"
POSTINGS = "hash long, doctype long, docid long"
QUEUE = "queue_id long, action string, doctype long, docid long, source string, target string, text string, meta map<string,string>, status string"


def shared_root(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a temporary one, if all of Spark runs on this
    machine; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='palimpsest-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(rows: DataFrame, name: str) -> DataFrame:
    """`rows` written to the shared folder and read back, so that all that is worked out from them sees the same."""
    path = shared_root(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class Table:
    """Versions of one table, v0, v1, ... in a folder."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the complete versions."""
        jvm, root, fs = self._fs()
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].lstrip("-").isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame:
        """The newest complete version, or the newest before a number; without any, no rows."""
        numbers = [n for n in self.versions() if before is None or n < before]
        if not numbers:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{numbers[-1]}")

    def write(self, rows: DataFrame, number: int | None = None) -> DataFrame:
        """`rows` as the next version, or as version `number`; the version read back."""
        if number is None:
            number = max(self.versions(), default=-1) + 1
        rows.select(*[c.strip().split(" ")[0] for c in _columns(self.schema)]).write.mode("overwrite").parquet(f"{self.path}/v{number}")
        return self.read(number + 1)

    def clean(self) -> None:
        """Delete all versions but the newest."""
        jvm, _, fs = self._fs()
        for n in self.versions()[:-1]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{n}"), True)


def _columns(schema: str) -> list[str]:
    """The parts of a schema at its commas, but for those within brackets."""
    out, depth = [""], 0
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


class Store:
    """The tables of a collection: documents with their metadata, associations, postings and the queue."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or shared_root(spark, "store")).rstrip("/")
        kinds = {"documents": DOCUMENTS, "associations": ASSOCIATIONS, "postings": POSTINGS, "queue": QUEUE}
        self.documents, self.associations, self.postings, self.queue = (Table(spark, f"{self.path}/{n}", s) for n, s in kinds.items())

    def clean(self) -> None:
        for t in (self.documents, self.associations, self.postings, self.queue):
            t.clean()
