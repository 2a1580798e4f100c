"""Readers of model files, on the driver: wire format, vocabularies, character maps, tensor archives, manifests."""

from __future__ import annotations

import collections
import hashlib
import io
import pickle
import pickletools
import struct
import zipfile
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Wire types of protocol buffers, piece types and fields of a unigram vocabulary file.
VARINT, FIXED64, LENGTH, FIXED32 = 0, 1, 2, 5
NORMAL, UNKNOWN, CONTROL, USER_DEFINED = 1, 2, 3, 4
PIECES, TRAINER, NORMALIZER = 1, 2, 3
UNIGRAM = 1
#: Storage kinds of tensor archives.
STORAGE = {
    "FloatStorage": "<f4", "DoubleStorage": "<f8", "HalfStorage": "<f2", "LongStorage": "<i8", "IntStorage": "<i4",
    "ShortStorage": "<i2", "CharStorage": "<i1", "ByteStorage": "<u1", "BoolStorage": "?",
}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    for n in range(10):
        if at + n >= len(data):
            raise ValueError("a varint is cut off")
        value |= (data[at + n] & 127) << 7 * n
        if data[at + n] < 128:
            return value, at + n + 1
    raise ValueError("a varint is longer than 70 bits")


def wire_fields(data: bytes) -> dict[int, list]:
    """Values of each field in order: int for varints and fixed widths (as raw little-endian bytes for these), bytes for the rest."""
    out: dict[int, list] = collections.defaultdict(list)
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, kind = tag >> 3, tag & 7
        if kind == VARINT:
            value, at = _varint(data, at)
        elif kind in (FIXED64, FIXED32, LENGTH):
            n = {FIXED64: 8, FIXED32: 4}.get(kind, 0)
            if kind == LENGTH:
                n, at = _varint(data, at)
            value = data[at : at + n]
            if len(value) < n:
                raise ValueError("a field is cut off")
            at += n
        else:
            raise ValueError(f"wire type {kind} is not supported")
        out[number].append(value)
    return dict(out)


def first(fields: dict[int, list], number: int, kind: type, default=None):
    """The field's last value, as protocol buffers have it; of the given kind, float being 4 bytes."""
    if number not in fields:
        return default
    value = fields[number][-1]
    if kind is float:
        if not isinstance(value, bytes) or len(value) != 4:
            raise TypeError(f"field {number} is not a float")
        return struct.unpack("<f", value)[0]
    if not isinstance(value, bytes if kind is str else kind):
        raise TypeError(f"field {number} is not a {kind.__name__}")
    return value.decode() if kind is str else value


class CharMap:
    """A normaliser's character map: a double-array trie of UTF-8 keys, and replacements that each end in a zero byte.

    A unit of the trie has a label in its low byte, a bit that says whether a value follows, and an offset in the
    rest, in steps of 256 if bit 9 is set; a value unit has the sign bit.
    """

    def __init__(self, blob: bytes = b""):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        if n % 4 or len(blob) < 4 + n and blob:
            raise ValueError("the trie's size is wrong")
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist() if blob else []
        self.texts = blob[4 + n :]
        self.seen: dict[str, str | None] = {}

    def lookup(self, text: str) -> str | None:
        """The replacement of the shortest key that ``text`` begins with; it stands for the whole of ``text``."""
        if text not in self.seen:
            if len(self.seen) > 65_536:
                self.seen.clear()
            self.seen[text] = self._find(text.encode())
        return self.seen[text]

    def _find(self, key: bytes) -> str | None:
        if not self.units:
            return None
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        at = offset(self.units[0])
        for b in key:
            at ^= b
            if at >= len(self.units) or self.units[at] & 0x800000FF != b:
                return None
            unit = self.units[at]
            at ^= offset(unit)
            if unit >> 8 & 1:
                start = self.units[at] & 0x7FFFFFFF
                return self.texts[start : self.texts.index(0, start)].decode()
        return None


@dataclass
class Vocabulary:
    """Pieces of a unigram model with scores and types; position is the piece's number."""

    pieces: list[str]
    scores: list[float]
    types: list[int]
    unknown: int
    charmap: CharMap = field(default_factory=CharMap)

    @classmethod
    def from_bytes(cls, data: bytes) -> Vocabulary:
        top = wire_fields(data)
        if first(wire_fields(first(top, TRAINER, bytes, b"")), 3, int, UNIGRAM) != UNIGRAM:
            raise ValueError("only unigram models are supported")
        rows = [wire_fields(p) for p in top.get(PIECES, [])]
        types = [first(r, 3, int, NORMAL) for r in rows]
        if types.count(UNKNOWN) != 1:
            raise ValueError("a vocabulary has exactly one unknown piece")
        normalizer = wire_fields(first(top, NORMALIZER, bytes, b""))
        return cls([first(r, 1, str, "") for r in rows], [first(r, 2, float, 0.0) for r in rows], types, types.index(UNKNOWN), CharMap(first(normalizer, 2, bytes, b"")))

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """(spm_id, piece, score, type): the dimension table that ids are looked up in."""
        return spark.createDataFrame(list(zip(range(len(self.pieces)), self.pieces, self.scores, self.types)), "spm_id int, piece string, score double, type int")


def cached_vocabulary(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """The vocabulary table of the model file at ``path`` (anything Spark reads), kept as Parquet under its SHA-256 in ``folder``; a changed file has another name, so nothing stale is read."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    kept = f"{folder}/{hashlib.sha256(data).hexdigest()}.parquet"
    try:
        return spark.read.parquet(kept)
    except Exception as e:  # not there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    Vocabulary.from_bytes(data).to_frame(spark).write.mode("overwrite").parquet(kept)
    return spark.read.parquet(kept)


@dataclass(frozen=True)
class Reference:
    """What a pickle names but a reader of manifests doesn't build: a global by its module and name, or a call of one."""

    what: str
    args: tuple = ()


#: Opcodes that put their own argument on the stack, constants, and those that take so many values off it into a tuple.
PLAIN = {"BININT", "BININT1", "BININT2", "LONG1", "BINUNICODE", "SHORT_BINUNICODE", "BINUNICODE8", "BINFLOAT"}
CONSTANT = {"NONE": None, "NEWTRUE": True, "NEWFALSE": False, "EMPTY_TUPLE": ()}
TUPLES = {"TUPLE1": 1, "TUPLE2": 2, "TUPLE3": 3}


def described(pickled: bytes) -> object:
    """The object that a pickle describes, as plain values and References: its opcodes are read, nothing is imported or called. Opcodes that named tensors don't need are refused."""
    stack: list = []
    marks: list[int] = []
    memo: dict[int, object] = {}

    def since_mark() -> list:
        at = marks.pop()
        out = stack[at:]
        del stack[at:]
        return out

    def pairs(flat: list) -> None:
        if not isinstance(stack[-1], dict):
            raise pickle.UnpicklingError("items of something that isn't a dict")
        stack[-1].update(zip(flat[::2], flat[1::2]))

    for opcode, value, _ in pickletools.genops(pickled):
        name = opcode.name
        if name in PLAIN:
            stack.append(value)
        elif name in CONSTANT:
            stack.append(CONSTANT[name])
        elif name in TUPLES:
            n = TUPLES[name]
            stack[-n:] = [tuple(stack[-n:])]
        elif name == "MARK":
            marks.append(len(stack))
        elif name == "TUPLE":
            stack.append(tuple(since_mark()))
        elif name in ("EMPTY_DICT", "EMPTY_LIST"):
            stack.append({} if name == "EMPTY_DICT" else [])
        elif name == "GLOBAL":
            stack.append(Reference(value.replace(" ", ".")))
        elif name == "STACK_GLOBAL":
            stack[-2:] = [Reference(f"{stack[-2]}.{stack[-1]}")]
        elif name == "BINPERSID":
            stack[-1] = Reference("stored", tuple(stack[-1]))
        elif name == "REDUCE":
            args = stack.pop()
            called = stack[-1].what if isinstance(stack[-1], Reference) else "a value"
            stack[-1] = {} if called == "collections.OrderedDict" else Reference(called, args)
        elif name in ("SETITEM", "SETITEMS"):
            flat = since_mark() if name == "SETITEMS" else [stack.pop() for _ in range(2)][::-1]
            pairs(flat)
        elif name in ("BINPUT", "LONG_BINPUT", "MEMOIZE"):
            memo[len(memo) if value is None else value] = stack[-1]
        elif name in ("BINGET", "LONG_BINGET"):
            stack.append(memo[value])
        elif name == "BUILD":
            stack.pop()  # attributes of the dict, which tensors don't need
        elif name == "STOP":
            return stack[-1]
        elif name not in ("PROTO", "FRAME"):
            raise pickle.UnpicklingError(f"opcode {name} is not allowed")
    raise pickle.UnpicklingError("the pickle has no end")


def tensor_table(data: bytes) -> list[tuple[str, str, str, int, list[int], list[int]]]:
    """(name, dtype, member, offset, shape, strides) of each tensor of a zipped archive, offset and strides in values. The member is the archive's file that holds the values."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if n.endswith("/data.pkl")]
        if len(names) != 1:
            raise ValueError("not a tensor archive")
        top = described(z.read(names[0]))
    if not isinstance(top, dict):
        raise pickle.UnpicklingError("the archive holds no named tensors")
    rows = []
    for name, tensor in top.items():
        if not isinstance(tensor, Reference) or tensor.what != "torch._utils._rebuild_tensor_v2":
            raise pickle.UnpicklingError(f"{name} is {getattr(tensor, 'what', type(tensor).__name__)}, not a tensor")
        stored, offset, shape, strides = tensor.args[:4]
        kind = stored.args[1].what.rpartition(".")[2]
        if kind not in STORAGE:
            raise pickle.UnpicklingError(f"storage {kind} is not known")
        sizes = shape.args[0] if isinstance(shape, Reference) else shape
        rows.append((str(name), STORAGE[kind], f"{names[0].removesuffix('data.pkl')}data/{stored.args[2]}", offset, list(sizes), list(strides)))
    return rows


def tensors(data: bytes) -> dict[str, np.ndarray]:
    """The arrays of a zipped tensor archive, by its table."""
    out = {}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name, kind, member, offset, shape, strides in tensor_table(data):
            values = np.frombuffer(z.read(member), kind)
            last = offset + sum((n - 1) * s for n, s in zip(shape, strides))
            if min([0, offset, *strides]) < 0 or all(shape) and last >= len(values):
                raise ValueError(f"{name} reaches beyond its storage")
            steps = [s * values.itemsize for s in strides]
            out[name] = np.lib.stride_tricks.as_strided(values[offset:], shape, steps).copy() if all(shape) else np.zeros(shape, kind)
    return out


def verify_manifest(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """(name, size, sha256, status) of a manifest (name, size, sha256) against the files in ``folder``: ok, missing, size or digest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    have = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("have_size"), F.sha2("content", 256).alias("have_sha"))
    status = F.when(F.col("have_size").isNull(), "missing").when(F.col("have_size") != F.col("size"), "size").when(F.col("have_sha") != F.lower("sha256"), "digest").otherwise("ok")
    return manifest.join(have, "name", "left").select("name", "size", "sha256", status.alias("status"))


def tensor_layout(manifest: DataFrame, small: int = 1024, alignment: int = 64) -> DataFrame:
    """(name, bytes, digest, inline, offset) for tensors (name, content): those of ``small`` bytes or fewer are stored inline, equal ones share a place, the others lie aligned in order of name. A model's tensors are few."""
    own = manifest.select("name", F.octet_length("content").cast("long").alias("bytes"), F.sha1("content").alias("digest"))
    large = own.where(F.col("bytes") > small).groupBy("digest", "bytes").agg(F.min("name").alias("first"))
    size = (F.ceil(F.col("bytes") / alignment) * alignment).cast("long")
    placed = large.withColumn("offset", F.coalesce(F.sum(size).over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own.join(placed.select("digest", "bytes", "offset"), ["digest", "bytes"], "left").select("name", "bytes", "digest", (F.col("bytes") <= small).alias("inline"), "offset")


def text_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines of UTF-8 files without blank ones, the files one after the other."""
    from ..functions.text import WHITE_SPACE

    lines = spark.read.text(list(paths)).select(F.regexp_replace("value", r"\r$", "").alias("text"))
    return lines.where(F.regexp_replace("text", f"[{WHITE_SPACE}]+", "") != "")


def write_results(encoded: DataFrame, path: str) -> None:
    """One JSON object a line, characters as they are; columns that are null are left out."""
    encoded.select(F.to_json(F.struct(*encoded.columns)).alias("value")).write.text(path)


def _captured(pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract("value", pattern, group), F.lit(""))


def benchmark_log(lines: DataFrame) -> DataFrame:
    """A row for each model of a report (value, line), line being its number: name, MiB, tok/s at 128 tokens, dense cosines, top-5, short-query times, idle CPU.

    A line ``##### name`` renames the model that follows, ``== path (n MiB)[ low-memory]`` begins one; what follows up
    to the next belongs to it. A log is one ordered file, so its lines are numbered and taken in one window.
    """
    order = Window.orderBy("line")
    head = _captured(r"^== (\S+) \(\d+ MiB\)")
    marked = lines.select("line", "value", head.alias("path"), _captured(r"^##### (.*)").alias("variant"))
    marked = marked.withColumn("model", F.sum(F.col("path").isNotNull().cast("int")).over(order))
    marked = marked.withColumn("section", F.sum(F.col("variant").isNotNull().cast("int")).over(order))
    # a variant's name is for the first model after it
    marked = marked.withColumn("title", F.last("variant", ignorenulls=True).over(order))
    marked = marked.withColumn("nth", F.when(F.col("path").isNotNull(), F.row_number().over(Window.partitionBy("section", F.col("path").isNotNull()).orderBy("line"))))
    own = marked.where("model > 0").groupBy("model")
    pick = lambda c: F.first(c, ignorenulls=True)
    plain = F.element_at(F.split("path", "/"), -1)
    name = F.concat(F.when(F.col("title").isNotNull() & (F.col("nth") == 1), F.trim("title")).otherwise(plain), F.when(F.col("value").rlike(r"MiB\) low-memory"), " low-memory").otherwise(""))
    return own.agg(
        pick(F.when(F.col("path").isNotNull(), name)).alias("name"),
        pick(_captured(r"^== \S+ \((\d+) MiB\)").cast("int")).alias("mib"),
        pick(_captured(r"^128tok x\d+\s+(\d+) tok/s").cast("int")).alias("tokens_per_second"),
        pick(_captured(r"^dense cos: min (\S+) mean").cast("double")).alias("dense_min"),
        pick(_captured(r"^dense cos: min \S+ mean (\S+)").cast("double")).alias("dense_mean"),
        pick(_captured(r"^(?!\[)sparse:.*top-5 identical (\d+/\d+)")).alias("top5"),
        pick(_captured(r"^short query\s+(\S+) ms wall").cast("double")).alias("wall_ms"),
        pick(_captured(r"^short query\s+\S+ ms wall\s+(\S+) ms cpu").cast("double")).alias("cpu_ms"),
        pick(_captured(r"^idle cpu (\d+) ms/s").cast("int")).alias("idle_ms"),
    )
