"""Byte-level BPE through sentencepiece.

A sentencepiece BPE model is serialised directly from a rank file: every byte is mapped to one printable
character, every token becomes a piece of such characters scored by its negative rank, and normalisation is the
identity. Texts are cut into pre-tokens by the vocabulary's pattern, each encoded by itself; decoding maps pieces
back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens that a worker remembers; it forgets all of them when there are more, so memory is bounded.
CACHE = 200_000


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes with their length, an int as a varint, a float in 32 bits."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def byte_characters() -> list[str]:
    """A distinct printable character for each byte: letters of a block that no normaliser touches."""
    return [chr(0x4E00 + b) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised model. Piece 0 is the unknown piece; token r is piece r + 1 for gapless ranks."""
    chars = byte_characters()
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        pieces.append(_field(1, "".join(chars[b] for b in token).encode()) + _field(2, -float(rank)) + _field(3, 1))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBPE:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.order = [r for _, r in sorted(ranks.items(), key=lambda x: x[1])]
        self.tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.by_rank = {r: t for t, r in ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.pattern = regex.compile(pattern)
        self.table = {b: c for b, c in enumerate(byte_characters())}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.cache: dict[str, tuple[int, str, bytes]] = {}

    def encode_piece(self, piece: bytes) -> list[int]:
        """A pre-token's ids. One that is itself in the vocabulary is one token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        mapped = piece.decode("latin-1").translate(self.table)
        return [self.order[i - 1] for i in self.model.encode(mapped)]

    def decode(self, ids: list[int]) -> bytes:
        """Inverse mapping of ids to bytes."""
        by_rank = self.by_rank
        return b"".join([by_rank[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        return [i for m in self.pattern.findall(text) for i in self.encode_piece(m.encode("utf-8", "surrogatepass"))]

    def summary(self, text: str) -> tuple[int, str, str]:
        """(number of ids, sha256 of the ids in decimal joined by commas, sha256 of the decoded bytes)."""
        cache = self.cache
        ids, back = hashlib.sha256(), hashlib.sha256()
        n, first = 0, True
        found = self.pattern.findall(text)
        for at in range(0, len(found), 1 << 16):  # very long texts in slices
            got = []
            for word in found[at : at + (1 << 16)]:
                x = cache.get(word)
                if x is None:
                    if len(cache) >= CACHE:
                        cache.clear()
                    own = self.encode_piece(word.encode("utf-8", "surrogatepass"))
                    x = (len(own), ",".join(map(str, own)), self.decode(own))
                    if len(word) <= 64:
                        cache[word] = x
                got.append(x)
            n += sum([x[0] for x in got])
            ids.update((b"" if first else b",") + ",".join([x[1] for x in got]).encode())
            back.update(b"".join([x[2] for x in got]))
            first = False
        return n, ids.hexdigest(), back.hexdigest()


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def loaded(path: str, pattern: str) -> ByteBPE:
    """The vocabulary of `path`, read once by each worker process."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBPE(load_ranks(path), pattern)
    return _LOADED[path, pattern]


def encode_documents(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row; null texts count as empty and have no ids."""
    picked = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = picked.select(F.col("k").alias(key), F.array(F.lit(0)).alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for b in batches:
            ids = [bpe.encode(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return picked.mapInArrow(run, schema)


def decode_documents(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, data binary): the bytes of every row's ids; null ids count as none."""
    picked = df.select(F.col(key).alias("k"), F.col(ids).alias("i"))
    schema = picked.select(F.col("k").alias(key), F.lit(b"").alias("data")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for b in batches:
            data = [bpe.decode(x.as_py() or []) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=[key, "data"])

    return picked.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, ids_sha256, decoded_sha256 after encoding the whole text and decoding its ids.

    Null texts count as empty: no tokens, and the digests of nothing. Very long texts are encoded whole, in slices of
    pre-tokens. Repeated rows are encoded alike, null keys are passed on, other columns are ignored, and an empty table gives an empty one.
    """
    picked = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
    schema = picked.select(F.col("k").alias(key), F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for b in batches:
            got = [bpe.summary(t.as_py() or "") for t in b.column(1)]
            cols = [pa.array([x[i] for x in got], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=names)

    return picked.mapInArrow(run, schema)
