"""Documents and their metadata: lookup, long form, ordered pages with cursors."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import quote_plus, unquote_plus

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import python_sort_key, sort_key
from palimpsest.operators.ranges import within


def metadata(docs: DataFrame) -> DataFrame:
    """`docs` (doctype, docid, text, meta) with characters (bytes), doctype and docid added to meta."""
    size = F.octet_length(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    own = F.create_map(F.lit("characters"), size.cast("string"), F.lit("doctype"), F.col("doctype").cast("string"), F.lit("docid"), F.col("docid").cast("string"))
    given = F.map_filter(F.coalesce("meta", F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))")), lambda k, v: ~k.isin("characters", "doctype", "docid") & v.isNotNull() & (v != ""))
    return docs.withColumn("meta", F.map_concat(given, own))


def long_form(docs: DataFrame) -> DataFrame:
    """(doctype, docid, key, value, sort_key, numeric): a row for each metadata value."""
    from palimpsest.functions.text import is_number

    rows = metadata(docs).select("doctype", "docid", F.explode("meta").alias("key", "value"))
    return rows.withColumn("sort_key", sort_key(F.col("value"))).withColumn("numeric", is_number(F.col("value")))


def fields(docs: DataFrame) -> DataFrame:
    """(key, n): the metadata fields there are, and in how many documents."""
    return metadata(docs).select(F.explode(F.map_keys("meta")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def field_rank(key: Column) -> Column:
    """By what fields are shown in order: title first, then characters, then the others by name."""
    return F.struct(F.when(key == "title", 0).when(key == "characters", 1).otherwise(2).alias("group"), key.alias("key"))


def field_list(docs: DataFrame) -> DataFrame:
    """(place, key): the metadata fields of some documents in the order that they are shown in; there are few."""
    from pyspark.sql import Window

    return fields(docs).select(F.row_number().over(Window.orderBy(field_rank(F.col("key")))).cast("long").alias("place"), "key")


def typed(meta: Column) -> Column:
    """JSON members of a metadata map, numbers as such and all else as strings, in the order of `field_rank`."""
    from palimpsest.functions.text import is_number

    quoted = lambda c: F.substring(F.to_json(F.struct(c.alias("v"))), F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)
    entries = F.transform(F.map_entries(meta), lambda e: F.struct(field_rank(e["key"]).alias("rank"), e["key"].alias("k"), e["value"].alias("v")))
    shown = F.filter(F.array_sort(entries), lambda x: x["v"].isNotNull() & (x["v"] != ""))
    # A lone minus and a number with leading minuses count as numbers, but JSON has no such.
    return F.array_join(F.transform(shown, lambda x: F.concat(quoted(x["k"]), F.lit(":"), F.when(is_number(x["v"]) & x["v"].rlike("^-?[0-9]"), x["v"]).otherwise(quoted(x["v"])))), ",")


def document(docs: DataFrame, doctype: int, docid: int) -> DataFrame:
    """One document by its key; columns not used later are not read."""
    return docs.filter((F.col("doctype") == doctype) & (F.col("docid") == docid))


@dataclass(frozen=True)
class Page:
    """What a page of documents is: a range of types, an order (a leading - for descending), a cursor, a limit."""

    source: str | None = None
    order_by: str = "doctype"
    cursor: str = ""
    limit: int = 100

    def __post_init__(self) -> None:
        if not re.fullmatch(r"-?\S+", self.order_by) or self.limit < 0:
            raise ValueError("a page needs the name of a field and a limit from 0")

    @classmethod
    def asked(cls, source: str | None = None, order_by: str | None = None, cursor: str | None = None, limit: str | int | None = None) -> Page:
        """A page from parameters as they come; those that make no sense give way to defaults."""
        order = order_by if order_by and re.fullmatch(r"-?\S+", order_by) else "doctype"
        at = cursor if cursor and re.fullmatch(r"[^:]+(:\d+)?(:\d+)?", cursor) else ""
        return cls(source, order, at, int(limit) if re.fullmatch(r"\d+", str(limit)) else 100)

    @property
    def key(self) -> str:
        return self.order_by.removeprefix("-")

    @property
    def descending(self) -> bool:
        return self.order_by.startswith("-")


def _ordered(docs: DataFrame, page: Page) -> DataFrame:
    """(doctype, docid, value, sort_key) of the documents in range that have the key."""
    value = F.element_at(F.col("meta"), page.key)
    rows = metadata(docs.filter(within(F.col("doctype"), page.source))).select("doctype", "docid", value.alias("value"))
    return rows.filter(F.col("value").isNotNull()).withColumn("sort_key", sort_key(F.col("value")))


def _from(cursor: str, descending: bool) -> Column:
    """Rows at or after a cursor value:doctype:docid. A bare value, descending, leaves out rows with just that value."""
    if not cursor:
        return F.lit(True)
    parts = cursor.split(":")
    value = python_sort_key(unquote_plus(parts[0]))
    ids = [int(p) if p.isdigit() else 0 for p in parts[1:3]]
    ids = ids[: 2 if all(ids) else ids.index(0)] if ids else []
    mine = [F.col("sort_key"), F.col("doctype"), F.col("docid")]
    bound = [F.lit(value), *map(F.lit, ids)]
    n = len(bound)
    after, same = F.lit(False), F.lit(True)
    for a, b in zip(mine, bound, strict=False):
        after = after | (same & (a < b if descending else a > b))
        same = same & (a == b)
    # A shorter key comes before all that it begins, so descending it ends before them.
    return after | same if n == 3 or not descending else after


def _sorted(rows: DataFrame, descending: bool) -> list[Column]:
    return [F.desc(c) if descending else F.asc(c) for c in ("sort_key", "doctype", "docid")]


def page(docs: DataFrame, what: Page) -> DataFrame:
    """One page: (place, doctype, docid, value). The order and the limit become one bounded sort."""
    from pyspark.sql import Window

    rows = _ordered(docs, what).filter(_from(what.cursor, what.descending)).orderBy(*_sorted(docs, what.descending)).limit(what.limit)
    order = _sorted(rows, what.descending)
    return rows.select(F.row_number().over(Window.orderBy(*order)).alias("place"), "doctype", "docid", "value")


def cursor_of(row) -> str:
    return f"{quote_plus(row['value']).replace('+', '%20')}:{row['doctype']}:{row['docid']}"


def cursors(docs: DataFrame, what: Page) -> dict[str, str]:
    """first, previous, next and last cursors of a page; each is a bounded sort."""
    rows = _ordered(docs, what)

    def take(cursor: str, limit: int, descending: bool) -> list:
        return rows.filter(_from(cursor, descending)).orderBy(*_sorted(rows, descending)).limit(limit).collect()

    here = take(what.cursor, what.limit, what.descending)
    out = {"first": "", "previous": "", "next": "", "last": ""}
    last = take("", what.limit, not what.descending)
    if last:
        out["last"] = cursor_of(last[-1])
    if here:
        after = take(cursor_of(here[-1]), 2, what.descending)
        out["next"] = cursor_of(after[-1]) if len(after) > 1 else ""
        before = take(cursor_of(here[0]), what.limit + 1, not what.descending)
        out["previous"] = cursor_of(before[-1]) if before else ""
    return out
