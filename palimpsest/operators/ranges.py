"""Ranges of document types, such as 1-2:5:7-9."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(spec: str | None) -> list[tuple[int, int]]:
    """Inclusive (low, high) sections; none for an empty text, which means every type. Zero, a second dash or an
    empty section is an error."""
    if not spec:
        return []
    out = []
    for part in spec.split(":"):
        ends = part.split("-")
        if len(ends) > 2 or not all(e.isdigit() and int(e) > 0 for e in ends):
            raise ValueError(f"not a range of document types: {spec}")
        a, b = int(ends[0]), int(ends[-1])
        out.append((min(a, b), max(a, b)))
    return out


def size(spec: str | None) -> int:
    """How many types a range names."""
    return len({n for a, b in parse(spec) for n in range(a, b + 1)})


def within(column: Column, spec: str | None) -> Column:
    """Predicate that Catalyst can push to the scan."""
    sections = parse(spec)
    if not sections:
        return F.lit(True)
    out = F.lit(False)
    for a, b in sections:
        out = out | column.between(a, b)
    return out
