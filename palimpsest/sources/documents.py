"""Where documents come from and how results leave: tables, folders, forms, other collections, JSON."""

from __future__ import annotations

from urllib.parse import parse_qsl

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.sources.store import staged

SCHEMA = "doctype long, docid long, text string, meta map<string,string>"
#: The type of documents whose source names no number.
OTHER = 999


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `documents` table as a collection: a document type for each source srcN, numbers from 1. Other sources share
    the type OTHER."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    meta = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    doctype = F.coalesce(F.regexp_extract(F.coalesce("source", F.lit("")), r"^src(\d{1,9})$", 1).try_cast("long") + 1, F.lit(OTHER).cast("long"))
    return d.select(doctype.alias("doctype"), (F.col("doc_id") + 1).alias("docid"), "text", meta.alias("meta"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `benchmark` table as queries of type 100."""
    d = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return d.select(F.lit(100).cast("long").alias("doctype"), (F.col("item_id") + 1).alias("docid"), "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `pages` table as documents of type 101."""
    d = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return d.select(F.lit(101).cast("long").alias("doctype"), (F.col("page_id") + 1).alias("docid"), F.col("html").alias("text"), F.create_map(F.lit("url"), F.col("url")).alias("meta"))


def form(body: str, doctype: int, docid: int) -> dict:
    """A document from a form: text is its text, every other field metadata. No text is an error."""
    fields = dict(parse_qsl(body, keep_blank_values=True))
    if not fields.get("text"):
        raise ValueError("a document needs text")
    return {"doctype": doctype, "docid": docid, "text": fields.pop("text"), "meta": fields}


def forms(rows: DataFrame) -> DataFrame:
    """Documents from (doctype, docid, payload) form bodies; rows without text are left out.

    Of a key that is repeated the last value counts. A part that is not url-encoded rightly stands as it is."""
    plain = lambda c: F.coalesce(F.try_url_decode(c), c)
    key = lambda p: F.substring_index(p, "=", 1)
    parts = F.transform(F.split(F.coalesce("payload", F.lit("")), "&"), lambda p: F.struct(plain(key(p)).alias("key"), plain(F.substring(p, F.length(key(p)) + 2, F.length(p))).alias("value")))
    last = F.filter(parts, lambda x: x["key"] != "")
    got = rows.withColumn("parts", last).withColumn("keys", F.transform("parts", lambda x: x["key"]))
    # The last place of each key is the first one from behind.
    fields = F.transform(F.array_distinct("keys"), lambda k: F.struct(k.alias("key"), F.element_at(F.filter("parts", lambda x: x["key"] == k), -1)["value"].alias("value")))
    got = got.withColumn("f", F.map_from_entries(fields))
    return got.filter(F.element_at("f", "text") != "").select("doctype", "docid", F.element_at("f", "text").alias("text"), F.map_filter("f", lambda k, v: k != "text").alias("meta"))


def ranked_within(rows: DataFrame, group: str, order: list, out: str) -> DataFrame:
    """Ranks from 1 in the order of `order` within each value of `group`, however many rows one value has.

    Rows are range-partitioned by group and order, so a large group spreads over tasks; each task numbers its own, and
    the counts of the tasks before, one row for each group and task, are added."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = staged(rows.repartitionByRange(n, group, *order).withColumn("__p", F.spark_partition_id()), "ranked")  # so parts stay as they are
    local = laid.withColumn("__n", F.row_number().over(Window.partitionBy("__p", group).orderBy(*order)))
    tops = local.groupBy(group, "__p").agg(F.max("__n").alias("__m"))
    before = Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    shifts = tops.select(F.col(group).alias("__g"), F.col("__p").alias("__q"), F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__s"))
    both = local.join(shifts, (F.col(group) == F.col("__g")) & (F.col("__p") == F.col("__q")))
    return both.withColumn(out, (F.col("__n") + F.col("__s")).cast("long")).drop("__p", "__n", "__g", "__q", "__s")


def folder(spark: SparkSession, path: str, first_type: int = 1) -> DataFrame:
    """A document for each file below `path`: a type for each folder, a number for each file in it, by name."""
    d = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    file = F.col("_metadata.file_path")
    d = d.select(F.col("value").alias("text"), file.alias("path"), F.regexp_extract(file, r"([^/]*)$", 1).alias("title"), F.regexp_replace(file, r"/[^/]*$", "").alias("dir"))
    # Folders are few against files; their numbers are joined back, so no task sorts all files.
    dirs = d.select("dir").distinct().withColumn("doctype", (F.row_number().over(Window.orderBy("dir")) + first_type - 1).cast("long"))
    d = d.join(dirs, "dir")
    d = ranked_within(d, "doctype", [F.col("title"), F.col("path")], "docid")
    return d.select("doctype", "docid", "text", F.create_map(F.lit("title"), F.col("title"), F.lit("group"), F.regexp_extract("dir", r"([^/]*)$", 1)).alias("meta"))


def missing_from(new: DataFrame, have: DataFrame) -> DataFrame:
    """Documents whose key is not there yet: an insert never overwrites."""
    return new.join(have.select("doctype", "docid"), ["doctype", "docid"], "left_anti")


def numbered(new: DataFrame, have: DataFrame) -> DataFrame:
    """(doctype, text, meta) with the next free document numbers of their types."""
    top = have.groupBy("doctype").agg(F.max("docid").alias("top"))
    ranked = ranked_within(new, "doctype", [F.xxhash64("text"), F.col("text"), F.to_json("meta")], "n")
    return ranked.join(top, "doctype", "left").select("doctype", (F.coalesce("top", F.lit(0)) + F.col("n")).alias("docid"), "text", "meta")


def write(docs: DataFrame, path: str) -> None:
    """Store a collection with one folder for each type, so a range of types prunes."""
    docs.write.mode("overwrite").partitionBy("doctype").parquet(path)


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
