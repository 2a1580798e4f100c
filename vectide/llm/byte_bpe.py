"""Byte-level BPE by sentencepiece: a BPE model is serialised directly from the vocabulary's ranks. Each byte is a
character of its own, each piece's score its negative rank, and normalisation is the identity."""

from __future__ import annotations

import base64
import functools
import hashlib
import struct

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, pick, read

#: Byte b is the character of this code point plus b: no letter of these is white space or means anything to sentencepiece.
FIRST = 0x100
#: Bytes of pre-tokens and their ids that a task remembers, at most; longer pre-tokens than this many characters aren't remembered.
REMEMBERED, LONG = 64 << 20, 64


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer: bytes, int or 32-bit float."""
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def as_chars(token: bytes) -> str:
    return "".join(chr(FIRST + b) for b in token)


def serialise(tokens: list[bytes]) -> bytes:
    """The model: piece i is tokens[i] with score -i; the unknown piece comes last, as sentencepiece wants one."""
    pieces = b"".join(_field(1, _field(1, as_chars(t).encode()) + _field(2, float(-i)) + _field(3, 1)) for i, t in enumerate(tokens))
    pieces += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    none = (1 << 64) - 1  # -1
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + _field(41, none) + _field(42, none) + _field(43, none)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes with the ranks in a file of ``base64 rank`` lines, ranks from 0 without gaps, every byte among them."""

    def __init__(self, ranks: bytes, pattern: str):
        pairs = [line.split() for line in ranks.splitlines() if line]
        self.tokens: list[bytes] = [b""] * len(pairs)
        for token, rank in pairs:
            self.tokens[int(rank)] = base64.b64decode(token)
        if len({*self.tokens}) != len(self.tokens) or not {bytes([i]) for i in range(256)} <= {*self.tokens}:
            raise ValueError("ranks must be 0 to n - 1, of different tokens, all single bytes included")
        self.ids = {t: struct.pack("<I", i) for i, t in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.tokens))
        self.find = regex.compile(pattern).findall
        self.map = {i: FIRST + i for i in range(256)}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.held = 0

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Each match of the pattern is encoded separately; one that is a token as a whole is that token."""
        words = self.find(text)
        known = self.known
        now: dict[str, bytes] = {}  # this text's own: new words
        rest = []
        for w in dict.fromkeys(words):
            if w not in known:
                raw = w.encode()
                now[w] = self.ids.get(raw, b"")
                if not now[w]:
                    rest.append((w, raw))
        if rest:
            coded = self.model.encode([raw.decode("latin-1").translate(self.map) for _, raw in rest], out_type=int, num_threads=1)
            for (w, _), ids in zip(rest, coded):
                now[w] = np.array(ids, "<u4").tobytes()
        out = b"".join([known.get(w) or now[w] for w in words])
        for w, ids in now.items():
            size = 250 + len(w) + len(ids)
            if len(w) <= LONG and self.held + size <= REMEMBERED:
                self.held += size
                known[w] = ids
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One for each worker; the vocabulary file lies at the same path on every machine, installed with the tokenizers."""
    with open(path, "rb") as f:
        return Codec(f.read(), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of each row's whole text; null as empty, which has no ids. Repeated rows are encoded alike; other columns aren't read; an empty table gives no rows."""
    def run(batches):
        c = codec(path, pattern)
        c.forget()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.encode(t or "") for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "ids"])

    return map_arrow(pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids binary")


def decode_ids(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes that the ids of encode_documents stand for; null ids as none. Bytes, as ids cut anywhere needn't be whole characters."""
    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(i or b"") for i in b.column(1).to_pylist()], pa.binary())], ["doc_id", "decoded"])

    return map_arrow(pick(coded, "doc_id", "ids"), run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: both ways in one pass."""
    def run(batches):
        c = codec(path, pattern)
        c.forget()
        for b in batches:
            ids = [c.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()), pa.array([hashlib.sha256(c.decode(i)).hexdigest() for i in ids], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_arrow(pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
