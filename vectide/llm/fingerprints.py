"""Document fingerprints: SimHash. The hashes of a text's terms, weighted, vote on each bit's sign; tables of
blocks, probed with few bits flipped, find all fingerprints within a Hamming radius."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, join_hot, map_arrow, pick, read, saved, width

#: Bits of a fingerprint, and the weights of a word and of a pair of consecutive words.
BITS, WORD_WEIGHT, PAIR_WEIGHT = 128, 1, 2


def _votes(terms: list[bytes]) -> np.ndarray:
    """For each bit, how many of the terms' hashes have it, less those that don't; in blocks, so memory doesn't follow the text's length."""
    total, n = np.zeros(BITS, np.int64), len(terms)
    for i in range(0, n, 20_000):
        raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, terms[i : i + 20_000])), np.uint8).reshape(-1, BITS // 8)
        total += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return 2 * total - n


def fingerprint(text: bytes) -> bytes:
    """SimHash of the words and pairs of words, A-Z lower-cased, each counted as often as it stands there. Bits without a majority, and so all bits of an empty text, are 0."""
    words = text.lower().split()
    pairs = list(map(b" ".join, zip(words, words[1:])))
    return np.packbits(WORD_WEIGHT * _votes(words) + PAIR_WEIGHT * _votes(pairs) > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """1 less the share of bits that differ."""
    return 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hex) of each row's whole text, null as empty. Equal texts have equal fingerprints; other columns aren't read; an empty table gives no rows."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint((t or "").encode()).hex() for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return map_arrow(pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fingerprint string")


def blocks(radius: int) -> tuple[list[tuple[int, int]], int]:
    """The blocks as bit ranges, and how many bits of its nearest block a pair within the radius differs in at most: with n blocks, radius // n. Five blocks or, for that to stay at two bits, more."""
    n = max(5, radius // 3 + 1)
    edge = [BITS * i // n for i in range(n + 1)]
    return list(zip(edge, edge[1:])), radius // n


def keys(marks: DataFrame, radius: int, probes: bool) -> DataFrame:
    """(hi, lo, block, key): the fingerprint's halves and the bits of each of its blocks; for ``probes`` also each value that these become if as many of them as blocks() says are flipped."""
    ranges, slack = blocks(radius)

    def run(batches):
        flips = [np.array([sum(1 << i for i in c) for k in range((slack if probes else 0) + 1) for c in itertools.combinations(range(e - a), k)], np.int64) for a, e in ranges]
        for b in batches:
            marks_ = b.column(0).to_pylist()
            for at in range(0, len(marks_), 200):
                raw = np.frombuffer(bytes.fromhex("".join(marks_[at : at + 200])), np.uint8).reshape(-1, BITS // 8)
                halves, bits = raw.view(">i8").astype(np.int64), np.unpackbits(raw, axis=1).astype(np.int64)
                for j, ((a, e), flip) in enumerate(zip(ranges, flips)):
                    key = ((bits[:, a:e] << np.arange(e - a - 1, -1, -1)).sum(axis=1)[:, None] ^ flip).ravel()
                    own = np.repeat(halves, len(flip), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(np.full(len(key), j, np.int32)), pa.array(key)], ["hi", "lo", "block", "key"])

    return map_arrow(marks.select("fingerprint"), run, "hi long, lo long, block int, key long")


def within(queries: DataFrame, all_marks: DataFrame, radius: int) -> DataFrame:
    """(fingerprint, other, distance): for each distinct fingerprint of ``queries`` all distinct other ones of ``all_marks`` within the radius.

    Both are tables with a column fingerprint; copies are one fingerprint, to which rows belong by it. Nulls are left
    out. Complete: no bucket is capped, and that some block of a pair is a probe of the query's follows from the
    distance. A pair is given once, by the first such block.
    """
    ranges, slack = blocks(radius)
    # a query has some 1,700 probes, so even few queries are dealt out before
    mine = keys(queries.select("fingerprint").dropna().distinct().repartition(width(queries.sparkSession)), radius, True)
    theirs = keys(all_marks.select("fingerprint").dropna().distinct(), radius, False).toDF("hi2", "lo2", "block", "key")
    hi, lo = F.col("hi").bitwiseXOR(F.col("hi2")), F.col("lo").bitwiseXOR(F.col("lo2"))

    def differ(a: int, e: int):
        """Bits of the range that differ."""
        masks = [sum(1 << (63 - i % 64) for i in range(a, e) if i // 64 == half) for half in (0, 1)]
        return sum((F.bit_count(x.bitwiseAND(F.lit(m - (m >> 63 << 64)))) for x, m in zip((hi, lo), masks) if m), F.lit(0))

    distance = F.bit_count(hi) + F.bit_count(lo)
    first = F.lit(True)
    for j, (a, e) in enumerate(ranges[:-1]):
        first = first & ((F.col("block") <= j) | (differ(a, e) > slack))
    # by merging: Spark takes the probes for as small as the queries that they are made from, and would broadcast them
    found = mine.hint("merge").join(theirs, ["block", "key"]).where((distance > 0) & (distance <= radius) & first)

    def text(*halves: str):
        return F.concat(*[F.lower(F.lpad(F.hex(h), 16, "0")) for h in halves])

    return found.select(text("hi", "lo").alias("fingerprint"), text("hi2", "lo2").alias("other"), distance.alias("distance"))


def edited_text(text: str, following: str) -> str:
    """The last floor(n / 3) code points replaced by the first as many of the following text, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


#: Where a null id stands among ids, and the largest double below 2 ** 63.
NO_ID, NEARLY_2_63 = -(2**63), 2**63 - 1024


class Ranges:
    """Ranges of (id, hash) in descending order, from ids that part a table evenly: an id that is named k times begins k ranges, at even steps of the hash."""

    def __init__(self, cuts: list[int]):
        self.ids, self.times = np.unique(np.array(cuts, np.int64), return_counts=True)
        self.upto = np.concatenate([[0], np.cumsum(self.times)])

    def part(self, o: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The range of each row: how many beginnings lie above it."""
        at = np.searchsorted(self.ids, o, side="right")
        below = self.upto[at]
        for j in np.flatnonzero(self.times > 1):
            same = np.flatnonzero((at == j + 1) & (o == self.ids[j]))
            steps = [-(2**63) + (k << 64) // int(self.times[j]) for k in range(1, self.times[j])]
            below[same] = self.upto[j] + 1 + np.searchsorted(np.array(steps, np.int64), h[same], side="right")
        return (self.upto[-1] - below).astype(np.int32)


def edits(docs: DataFrame) -> DataFrame:
    """For each row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one that follows in descending doc_id, the first after the last; rows of one id stand in an order of their own that
    is the same in each run, null ids come last. A table of one row follows itself. Null texts are empty; other columns aren't
    read; an empty table gives no rows.

    Ranges of ids are dealt out by bounds from Spark's quantile sketch; an id that takes several ranges, as null may, is
    divided by its texts' hashes, so only rows equal in id and text are never parted. Each range's first row is also dealt to
    the range before it, and each range is read once in order, so a text is shuffled once and only two are held at a time.
    """
    spark = docs.sparkSession
    id_, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    base = pick(docs, "doc_id", "text").select(id_.alias("doc_id"), F.coalesce(id_, F.lit(NO_ID)).alias("o"), F.xxhash64(text).alias("h"), text.alias("text"))
    n = width(spark)
    found = base.select("o").approxQuantile("o", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    ranges = Ranges([int(min(x, NEARLY_2_63)) for x in found])
    split = [int(i) for i in ranges.ids[ranges.times > 1]]
    bounds = spark.sparkContext.broadcast(ranges)
    # ids that are not divided need no hash here, so mostly no text is read
    places = base.select("o", (F.when(F.col("o").isin(split), F.col("h")).otherwise(F.lit(0)) if split else F.lit(0)).cast("long").alias("h"))

    def first_of(batches):
        for b in batches:
            own = pd.DataFrame({"o": np.array(b.column(0)), "h": np.array(b.column(1))})
            own["part"] = bounds.value.part(own["o"].to_numpy(), own["h"].to_numpy())
            yield pa.RecordBatch.from_pandas(own.sort_values(["o", "h"]).drop_duplicates("part", keep="last")[["part", "o", "h"]], preserve_index=False)

    firsts = map_arrow(places, first_of, "part int, o long, h long").groupBy("part").agg(F.max(F.struct("o", "h")).alias("x")).orderBy("part").collect()  # a row a range
    present = [r["part"] for r in firsts]
    before = {(r["x"]["o"], r["x"]["h"]): present[i - 1] for i, r in enumerate(firsts)}  # a range's first row -> the range before it; the last before the first

    def deal(batches):
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            o, h = np.array(b.column(1)), np.array(b.column(2))
            packed = [press.compress(t.encode()) for t in b.column(3).to_pylist()]
            guests: dict[tuple, int] = {}  # of several rows in a first row's place the first in order is that row
            for i, place in enumerate(zip(o.tolist(), np.where(np.isin(o, split), h, 0).tolist())):
                if place in before and (place not in guests or (~h[i], packed[i]) < (~h[guests[place]], packed[guests[place]])):
                    guests[place] = i
            at = np.concatenate([np.arange(b.num_rows), np.array(list(guests.values()), np.int64)])
            parts = np.concatenate([bounds.value.part(o, h), np.array([before[x] for x in guests], np.int32)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts), pa.array(np.arange(len(at)) >= b.num_rows), b.column(0).take(pa.array(at)), pa.array(o[at]), pa.array(h[at]), pa.array([packed[i] for i in at], pa.binary())],
                ["part", "guest", "doc_id", "o", "h", "packed"],
            )

    dealt = map_arrow(base, deal, "part int, guest boolean, doc_id long, o long, h long, packed binary").repartition(n, "part")
    dealt = dealt.sortWithinPartitions("part", "guest", F.desc("o"), F.desc("h"), "packed").select("part", "guest", "doc_id", "packed")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def follow(batches):
        unpack = zstandard.ZstdDecompressor()
        held = None  # (part, doc_id, text, fingerprint) of a row that waits for the next one
        for b in batches:
            out: list[tuple] = []
            for part, guest, doc_id, packed in zip(*(b.column(i).to_pylist() for i in range(4))):
                if held is None and guest:
                    continue  # of several rows with the first id the first has been taken
                text = unpack.decompress(packed).decode()
                mark = fingerprint(text.encode())
                if held is not None:
                    edited = edited_text(held[2], text)
                    raw = edited.encode()
                    other = fingerprint(raw)
                    out.append((held[1], len(held[2]), hashlib.sha256(raw).hexdigest(), held[3].hex(), other.hex(), likeness(held[3], other), likeness(held[3], mark)))
                held = None if guest else (part, doc_id, text, mark)
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")]), schema=kinds, preserve_index=False)

    kinds = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(x, pa.string()) for x in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return map_arrow(dealt, follow, schema)


def near_counts(marked: DataFrame, asked, radius: int) -> DataFrame:
    """``marked``, a table with a column fingerprint, and ``n_near``: for rows where ``asked`` holds, how many other rows have a fingerprint within the radius, equal ones included; null for the rest.

    Fingerprints stand for the rows that share them, so copies are counted and never paired.
    """
    marked = saved(marked)
    sizes = saved(marked.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("rows_of"), F.max(asked).alias("is_asked")))
    queries = sizes.where("is_asked").select("fingerprint")
    others = within(queries, sizes, radius).join(sizes.select(F.col("fingerprint").alias("other"), F.col("rows_of").alias("n")), "other")
    more = others.groupBy("fingerprint").agg(F.sum("n").alias("more"))
    counts = sizes.where("is_asked").join(more, "fingerprint", "left").select("fingerprint", (F.col("rows_of") - 1 + F.coalesce("more", F.lit(0))).alias("found"))
    hot = [r[0] for r in sizes.where(F.col("rows_of") * HOT > marked.n_rows).select("fingerprint").collect()]
    return join_hot(marked, counts, "fingerprint", hot, "left").select(*marked.columns, F.when(asked, F.col("found")).alias("n_near"))


#: Bits in which near fingerprints may differ, in the query: measured on near copies, see README; the most that five blocks find.
RADIUS = 14


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_counts(edits(read(spark, sf_dir, "documents")), F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False)), RADIUS)
