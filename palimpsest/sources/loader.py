"""Loading from another collection: one that lies in a folder, or another instance's service.

A service is listed page by page with its cursor, on the driver, as each page names the next; pages hold numbers and
metadata alone. Texts, the bulk of it, are fetched by the executors, each with retries.
"""

from __future__ import annotations

import base64
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.ranges import parse, within
from palimpsest.sources.store import DOCUMENTS, Table

PAGE = 10
ATTEMPTS = 5
PAUSE = 0.2


def fetch(url: str) -> bytes:
    """The body of a page; user and password in the URL are sent as basic authentication."""
    parts = urllib.parse.urlsplit(url)
    host = parts.netloc.rpartition("@")
    request = urllib.request.Request(urllib.parse.urlunsplit(parts._replace(netloc=host[2])))
    if host[0]:
        request.add_header("Authorization", "Basic " + base64.b64encode(urllib.parse.unquote(host[0]).encode()).decode())
    with urllib.request.urlopen(request, timeout=60) as r:
        return r.read()


def tried(get: Callable[[str], bytes], url: str, attempts: int = ATTEMPTS) -> bytes:
    """`get(url)`, again when it fails, up to so many times."""
    for i in range(attempts):
        try:
            return get(url)
        except OSError:
            if i == attempts - 1:
                raise
            time.sleep(PAUSE * 2**i)
    raise ValueError("at least one attempt is needed")


def listed(base: str, source: str = "", get: Callable[[str], bytes] = fetch, page: int = PAGE, attempts: int = ATTEMPTS) -> Iterator[dict]:
    """The rows of all pages of a service's documents, in order. The listing ends with the first page without a next
    one, or whose next one is the same again."""
    cursor, seen = "", set()
    while cursor not in seen:
        seen.add(cursor)
        url = f"{base.rstrip('/')}/document/{source + '/' if source else ''}?cursor={urllib.parse.quote(cursor, safe='')}&limit={page}"
        body = json.loads(tried(get, url, attempts))
        yield from body.get("rows", [])
        cursor = body.get("cursors", {}).get("next", "")
        if not cursor:
            return


def service(spark: SparkSession, base: str, source: str = "", get: Callable[[str], bytes] = fetch, page: int = PAGE, attempts: int = ATTEMPTS) -> DataFrame:
    """Documents of another instance. Rows are numbered and described by the listing; a text that cannot be fetched after
    all attempts fails the job."""
    parse(source)
    own = lambda r: {k: str(v) for k, v in r.items() if k not in ("id", "doctype", "docid", "characters", "fragments")}
    rows = [(int(r["doctype"]), int(r["docid"]), own(r)) for r in listed(base, source, get, page, attempts)]
    keys = spark.createDataFrame(rows, "doctype long, docid long, meta map<string,string>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [tried(get, f"{base.rstrip('/')}/text/{t}/{i}/", attempts).decode("utf-8", "replace") for t, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["doctype", "docid", "text"])

    texts = keys.select("doctype", "docid").repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "doctype long, docid long, text string")
    return texts.join(keys, ["doctype", "docid"]).select("doctype", "docid", "text", "meta")


def stored(spark: SparkSession, path: str, source: str = "") -> DataFrame:
    """Documents of another collection's folder, with types in a range."""
    return Table(spark, f"{path.rstrip('/')}/documents", DOCUMENTS).read().filter(within(F.col("doctype"), source))


def load(spark: SparkSession, place: str, source: str = "") -> DataFrame:
    """Documents of another collection, by the address of its service or the folder of its store."""
    return service(spark, place, source) if place.startswith(("http://", "https://")) else stored(spark, place, source)
