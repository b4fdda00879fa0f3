"""Hashing, normal form and clean text against literal definitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as tx


def literal(data: bytes, width: int, blank: int) -> list[int]:
    """Window hashes by the plain definition, one window at a time."""
    norm = [max(b - 32 if 97 <= b <= 122 else b, 0x2F) for b in data]
    out = []
    for i in range(len(data) - width + 1):
        w = norm[i : i + width]
        h = 0
        for b in [0x2F] * width if w.count(0x2F) >= blank else w:
            h = (h * 37 + b) % 2**64
        h ^= h >> 33
        h = h * 0xFF51AFD7ED558CCD % 2**64
        h ^= h >> 33
        h = h * 0xC4CEB9FE1A85EC53 % 2**64
        out.append((h ^ (h >> 33)) % 2**32)
    return out


def test_known_values():
    assert tx.blank_hash(30) == 2905303729
    assert tx.blank_hash(24) == 3178085751
    assert int(tx.folded(np.array([3178085751], np.uint64), 26)[0]) == 23969112
    assert tx.narrow_hashes(b"abcdefghij", 4, 4)[:3].tolist() == [1359962131, 3708660080, 3622021219]
    assert tx.passage_hash(b"This") == 1264629399


@pytest.mark.parametrize("width,blank", [(4, 4), (24, 15), (30, 15)])
def test_hashes_match_the_definition(width, blank):
    rng = random.Random(width)
    for _ in range(20):
        data = bytes(rng.choice([32, 47, 65, 97, rng.randrange(256)]) for _ in range(rng.randrange(120)))
        assert tx.narrow_hashes(data, width, blank).tolist() == literal(data, width, blank)


def test_window_counts_and_equalities():
    assert len(tx.narrow_hashes(b"x" * 24, 4, 4)) == 21
    a, b = tx.narrow_hashes(b"the\nfirst", 3, 3), tx.narrow_hashes(b"THE first", 3, 3)
    assert a.tolist() == b.tolist()
    assert len(np.unique(tx.narrow_hashes(b"This is a test", 2, 2))) <= 13
    assert len(tx.narrow_hashes(b"ab", 3, 3)) == 0


def test_wide_hashes_tell_neighbouring_bytes_apart():
    a, b = tx.window_hashes(b"\xc4\xa0", 2, None)[0], tx.window_hashes(b"\xc5\x7b", 2, None)[0]
    assert a[0] == b[0]  # base 37: +1 and -37 cancel
    assert tx.window_hashes(b"\xc4\xa0", 2, None, tx.WIDE_BASE)[0][0] != tx.window_hashes(b"\xc5\x7b", 2, None, tx.WIDE_BASE)[0][0]


def test_clean_and_normal_text(spark):
    rows = ["Hello, World! 12-3\\x", "ünï日本", "", "a:b;c~"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = df.select(tx.clean_text(F.col("t")), F.encode(tx.normal_octets(F.col("t")), "ISO-8859-1")).collect()
    for r, (clean, normal) in zip(rows, got, strict=True):
        data = np.frombuffer(r.encode(), np.uint8)
        assert bytes(clean) == tx.CLEAN[data].tobytes()
        assert bytes(normal) == tx.NORMAL[data].tobytes()


def test_codepoints():
    data = "a日ш".encode()
    assert tx.codepoints(data).tolist() == [0, 1, 2, 2, 2, 3, 3]


@pytest.mark.parametrize("value,number,key", [
    ("1", True, "0000000001"), ("0", False, "0"), ("0.5", False, "0.5"), ("007", False, "007"), ("-12", True, "0000000-12"), ("3.75", True, "0000000003"),
    ("12345678901", True, "12345678901"), ("-", True, "0000000000"), ("x1", False, "x1"), ("", False, ""), ("1.", False, "1."),
])
def test_numbers(spark, value, number, key):
    assert tx.python_is_number(value) is number
    assert tx.python_sort_key(value) == key
    got = spark.createDataFrame([(value,)], "v string").select(tx.is_number(F.col("v")), tx.sort_key(F.col("v"))).first()
    assert tuple(got) == (number, key)
