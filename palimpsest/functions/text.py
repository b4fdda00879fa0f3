"""Byte-level text functions: normal form, window hashes, clean text, numbers."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = 0x2F
BASE = 37
#: With base 37, windows that differ in neighbouring bytes by 1 and -37 share a hash; with this base they do not.
WIDE_BASE = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1

#: Normal form of each byte: a-z become A-Z, all up to / become /, the rest stays.
NORMAL = np.arange(256, dtype=np.uint8)
NORMAL[97:123] -= 32
NORMAL = np.maximum(NORMAL, BLANK).astype(np.uint8)

#: Bytes that clean text keeps: digits, capitals, backslash, and the high bytes that share their low six bits' places.
KEPT = np.zeros(256, bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x5C, 0x5C), (0x81, 0x9A), (0x9C, 0x9C), (0xB0, 0xB9), (0xC1, 0xDA), (0xDC, 0xDC), (0xF0, 0xF9)):
    KEPT[_low : _high + 1] = True
CLEAN = np.arange(256, dtype=np.uint8)
CLEAN[97:123] -= 32
CLEAN = np.where(KEPT[CLEAN], CLEAN, 32).astype(np.uint8)

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NUMBER = r"^[-1-9][0-9]*(\.[0-9]+)?$"


def octets(text: Column) -> Column:
    """A string with one character, U+0000 to U+00FF, for each UTF-8 byte: string functions then count bytes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def normal_octets(text: Column) -> Column:
    return F.regexp_replace(F.translate(octets(text), _LOWER, _UPPER), r"[\x00-\x2F]", "/")


def clean_text(text: Column) -> Column:
    """Upper-cased text with a blank for every byte that is neither digit, letter nor kept high byte, as binary of
    the same length."""
    kept = "[^" + "".join(rf"\x{a:02X}-\x{b:02X}" for a, b in ((0x30, 0x39), (0x41, 0x5A), (0x5C, 0x5C), (0x81, 0x9A), (0x9C, 0x9C), (0xB0, 0xB9), (0xC1, 0xDA), (0xDC, 0xDC), (0xF0, 0xF9))) + "]"
    return F.encode(F.regexp_replace(F.translate(octets(text), _LOWER, _UPPER), kept, " "), "ISO-8859-1")


def fmix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser of MurmurHash3."""
    s = np.uint64(33)
    h = (h ^ (h >> s)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> s)) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> s)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def window_hashes(data: bytes, width: int, blank: int | None, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Mixed 64-bit hash of every `width`-byte window and whether it has `blank` blank bytes or more.

    Hashes are differences of prefix sums modulo 2^64, so the whole text is done at once; low 32 bits are the
    narrow hash."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    norm = NORMAL[np.frombuffer(data, np.uint8)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(norm.astype(np.uint64) * _powers(len(data), pow(base, -1, 1 << 64)), dtype=np.uint64)])
    up = np.uint64(pow(base, width - 1, 1 << 64))
    raw = (sums[width:] - sums[:-width]) * (_powers(len(data), base)[:n] * up)
    empty = np.concatenate([[0], np.cumsum(norm == BLANK)])
    many = (empty[width:] - empty[:-width]) >= blank if blank is not None else np.zeros(n, bool)
    return fmix(raw), many


def blank_hash(width: int) -> int:
    """Low 32 bits of the hash of a window of blanks."""
    h = sum(BLANK * pow(BASE, i, 1 << 64) for i in range(width)) & _M64
    return int(fmix(np.array([h], np.uint64))[0]) & 0xFFFFFFFF


def narrow_hashes(data: bytes, width: int, blank: int) -> np.ndarray:
    """32-bit hashes, those of blank windows replaced by the hash of blanks."""
    h, many = window_hashes(data, width, blank)
    return np.where(many, np.uint64(blank_hash(width)), h & np.uint64(0xFFFFFFFF))


def folded(h: np.ndarray, bits: int) -> np.ndarray:
    """A 32-bit hash folded to `bits` bits."""
    return (h >> np.uint64(bits)) ^ (h & np.uint64((1 << bits) - 1))


def passage_hash(data: bytes) -> int:
    """32-bit hash of a passage's own bytes, by the 64-bit MurmurHash2 with a fixed seed."""
    mul, mask = 0xC6A4A7935BD1E995, _M64
    h = 19780211 ^ (len(data) * mul & mask)
    whole = len(data) // 8 * 8
    k = np.frombuffer(data, "<u8", whole // 8) * np.uint64(mul)
    k = (k ^ (k >> np.uint64(47))) * np.uint64(mul)
    for x in k.tolist():
        h = (h * mul & mask) ^ x
    if whole < len(data):
        h = (h ^ int.from_bytes(data[whole:], "little")) * mul & mask
    h = (h ^ (h >> 47)) * mul & mask
    return (h ^ (h >> 47)) & 0xFFFFFFFF


def codepoints(data: bytes) -> np.ndarray:
    """For each byte offset, how many code points begin before it."""
    lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    return np.concatenate([[0], np.cumsum(lead)])


def is_number(value: Column) -> Column:
    """Whether a metadata value is shown as a number: no leading zero; a lone minus counts."""
    return value.rlike(_NUMBER)


def python_is_number(value: str) -> bool:
    return re.match(_NUMBER, value) is not None


def sort_key(value: Column) -> Column:
    """Numbers become their integer part padded with zeros to ten places, longer ones stay whole; others stay."""
    whole = F.regexp_extract(value, r"^(-?[0-9]*)", 1)
    whole = F.when(whole == "-", "0").otherwise(whole)
    return F.when(is_number(value), F.lpad(whole, F.greatest(F.lit(10), F.length(whole)), F.lit("0"))).otherwise(value)


def python_sort_key(value: str) -> str:
    if not python_is_number(value):
        return value
    whole = re.match(r"-?[0-9]*", value).group(0)
    return ("0" if whole == "-" else whole).rjust(10, "0")
