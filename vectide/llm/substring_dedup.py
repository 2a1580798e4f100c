"""Substring dedup: words covered by a window of so many words whose sequence also starts anywhere else go.

First pass: a count-min sketch with counters that stop at two. A window is counted by its minimizer, the smallest hash
of its short word runs, once for each place the minimizer stands at, which takes some fourteenth of the counts that
windows would. Equal windows have equal minimizers at different places, so the merged sketches of all partitions never
underestimate a window's count: one whose estimate is one occurs once. Second pass: the windows left, and only they,
are grouped exactly, dealt out by their minimizer, so that a passage's windows come in few pieces; those of a minimizer
that holds a thousandth of all places are dealt out by their own hash. Two windows are equal if two independent 64-bit polynomial hashes of
their words' hashes are: 128 bits, by which two different ones among 10^12 meet with a chance of some 10^-15. Within a
task repeats are settled at once, so a passage in a third of all documents sends one entry a task to its group, not one
a document.
"""

from __future__ import annotations

import collections
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROWS_AT_ONCE, map_arrow, mix, numbered, pick, read, saved, width
from .exact_dedup import Filter

WINDOW = 35
#: Words of the runs that minimizers are chosen from.
RUN = 8
#: The sketch has two rows of at most 2^MOST_BITS cells; only a bit a cell, counted more than once or not, is sent to every task: 2 x 64 MB at most. Beyond that it lets more windows pass to the exact grouping.
LEAST_BITS, MOST_BITS, SLICE_BITS = 16, 29, 20
#: Windows grouped at once by a task, about; words hashed at once.
BUCKET, CHUNK = 4_000_000, 150_000
#: Anchors and windows that a task holds before it sends them on.
ANCHORS_HELD, WINDOWS_HELD = 1_000_000, 500_000

#: A minimizer is hot that holds more than one in HOT of the places.
HOT = 1000

ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
INVERSE = np.array([pow(int(x), -1, 1 << 64) for x in ODD], np.uint64)
ENTRY = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("pos", "<u4"), ("ref", "<u4")])
NOBODY = np.uint32(0xFFFFFFFF)


class Powers:
    """Powers of the two bases and of their inverses modulo 2^64, as far as asked for."""

    def __init__(self):
        self.of = np.ones((4, 1), np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if self.of.shape[1] < n:
            with np.errstate(over="ignore"):
                steps = np.repeat(np.concatenate([ODD, INVERSE])[:, None], n, axis=1)
                steps[:, 0] = 1
                self.of = np.multiply.accumulate(steps, axis=1)
        return self.of[:, :n]


def rolling(words: np.ndarray, size: int, lane: int, powers: np.ndarray) -> np.ndarray:
    """A hash of each run of ``size`` words: a polynomial of their hashes modulo 2^64, by differences of prefix sums."""
    n = len(words)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(words * powers[lane, :n], out=total[1:])
        return mix((total[size:] - total[:-size]) * powers[lane + 2, : n - size + 1])


def smallest(values: np.ndarray, size: int) -> np.ndarray:
    """The place of the first smallest value in each run of ``size`` values, by doubling."""
    v, at, have = values, np.arange(len(values)), 1
    while have < size:
        step = min(have, size - have)
        right = v[step:] < v[:-step]
        v, at = np.where(right, v[step:], v[:-step]), np.where(right, at[step:], at[:-step])
        have += step
    return at


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """A column's texts as UTF-8, null as empty, ROWS_AT_ONCE copied out of Arrow at a time."""
    for at in range(0, len(column), ROWS_AT_ONCE):
        for t in column.slice(at, ROWS_AT_ONCE).cast(pa.binary()).to_pylist():
            yield t or b""


def chunks(texts: Iterable[bytes]):
    """(first text's number, word lists) of consecutive texts with CHUNK words or so."""
    first, held, n = 0, [], 0
    for i, t in enumerate(texts):
        w = t.split()
        held.append(w)
        n += len(w)
        if n >= CHUNK:
            yield first, held
            first, held, n = i + 1, [], 0
    if held:
        yield first, held


def hashes_of(words: list[bytes] | list[str]) -> np.ndarray:
    """The first halves of the words' 128-bit hashes."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in words), ">u8")[::2].astype(np.uint64)


class Windows:
    """The windows of some texts, one after the other: for each, its text, its start there, its place and its minimizer's hash and place."""

    def __init__(self, lists: list[list[bytes]], size: int, powers: Powers):
        lengths = np.array([len(w) for w in lists], np.int64)
        self.n, self.size, self.run = int(lengths.sum()), size, min(RUN, size)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        text = np.repeat(np.arange(len(lists)), lengths)
        at = np.arange(max(self.n - size + 1, 0))
        own = at + size <= ends[text[: len(at)]] if len(at) else np.zeros(0, bool)
        self.at = at[own]
        self.text = text[self.at]
        self.start = self.at - starts[self.text]
        if not len(self.at):
            return
        raw = b"".join(xxhash.xxh3_128_digest(w) for ws in lists for w in ws)
        self.words = np.frombuffer(raw, ">u8").reshape(-1, 2).astype(np.uint64)
        self.powers = powers(self.n + 1)
        runs = rolling(np.ascontiguousarray(self.words[:, 0]), self.run, 0, self.powers)
        self.place = smallest(runs, size - self.run + 1)[self.at]
        self.minimizer = runs[self.place]

    def hashes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(rolling(np.ascontiguousarray(self.words[:, k]), self.size, k, self.powers)[self.at[which]] for k in (0, 1))


def cells(minimizers: np.ndarray, row: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(minimizers + np.uint64(row + 1) * ODD[0]) >> np.uint64(64 - bits)


def sketch(docs: DataFrame, size: int, bits: int) -> tuple[list[bytearray], int, np.ndarray]:
    """For each row of the sketch a bit a cell: whether all partitions together counted it more than once; the number of words; and the hot minimizers, ascending, fewer than 2 * HOT.

    One that holds so many of all places holds as many of some part's, so every part names its own hot ones, fewer
    than HOT; of more than 20,000 named ones the most frequent half is kept, which can change only where windows go.
    """
    cut = min(SLICE_BITS, bits)

    def count(batches):
        powers, held, n, words = Powers(), [], 0, 0

        def flush():
            got = np.concatenate(held) if held else np.zeros(0, np.uint64)
            values, counts = np.unique(got, return_counts=True)
            often = counts * HOT > len(got)
            named = np.column_stack([values[often], counts[often].astype(np.uint64)])
            out = [(-1, 0, np.array([words, len(got)], "<u8").tobytes() + named.astype("<u8").tobytes())]
            for row in (0, 1):
                cell, times = np.unique(cells(got, row, bits), return_counts=True)
                coded = ((cell & np.uint64((1 << cut) - 1)) << np.uint64(1)).astype(np.uint32) | (times > 1)
                slices, first = np.unique(cell >> np.uint64(cut), return_index=True)
                out += [(row, int(s), x.astype("<u4").tobytes()) for s, x in zip(slices, np.split(coded, first[1:]))]
            a, b, c = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], ["row", "slice", "cells"])

        for b in batches:
            for _, lists in chunks(texts_of(b.column(0))):
                w = Windows(lists, size, powers)
                words += w.n
                if len(w.at):
                    new = np.append(True, w.place[1:] != w.place[:-1])  # places ascend, so each counts once
                    held.append(w.minimizer[new])
                    n += int(new.sum())
                if n > ANCHORS_HELD:
                    yield flush()
                    held, n, words = [], 0, 0
        if words:
            yield flush()

    def merge(batches):
        """One slice after the other: what has been seen, and what more than once."""
        key = once = twice = None
        words, places, named = 0, 0, collections.Counter()
        for b in batches:
            for row, s, packed in zip(*(b.column(i).to_pylist() for i in range(3))):
                if row < 0:
                    told = np.frombuffer(packed, "<u8").tolist()
                    words, places = words + told[0], places + told[1]
                    for value, n in zip(told[2::2], told[3::2]):
                        named[value] += n
                    if len(named) > 20_000:
                        named = collections.Counter(dict(named.most_common(10_000)))
                    continue
                if key != (row, s):
                    if key is not None:
                        yield done(key, twice)
                    key, once, twice = (row, s), np.zeros(1 << cut, bool), np.zeros(1 << cut, bool)
                x = np.frombuffer(packed, "<u4")
                at = x >> 1
                twice[at] |= once[at] | (x & 1).astype(bool)
                once[at] = True
        if key is not None:
            yield done(key, twice)
        if words:
            hot = [v for v, n in named.items() if n * 2 * HOT > places]
            yield made(-1, 0, np.array([words, *hot], "<u8").tobytes())

    def done(key, twice):
        return made(*key, np.packbits(twice).tobytes())

    def made(row: int, s: int, packed: bytes):
        return pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([s], pa.int32()), pa.array([packed], pa.binary())], ["row", "slice", "bits"])

    parts = map_arrow(docs.select("text"), count, "row int, slice int, cells binary")
    n = width(docs.sparkSession)
    merged = map_arrow(parts.repartition(n, "row", "slice").sortWithinPartitions("row", "slice"), merge, "row int, slice int, bits binary")
    out = [bytearray((1 << bits) // 8) for _ in (0, 1)]
    step, words, hot = (1 << cut) // 8, 0, np.zeros(0, np.uint64)
    for r in merged.toLocalIterator():  # 2^MOST_BITS bits a row of the sketch at most
        if r["row"] < 0:
            told = np.frombuffer(r["bits"], "<u8")
            words, hot = int(told[0]), np.sort(told[1:].astype(np.uint64))
            continue
        out[r["row"]][r["slice"] * step : (r["slice"] + 1) * step] = r["bits"]
    return out, words, hot


def as_runs(ref: np.ndarray, pos: np.ndarray) -> list[tuple[int, bytes]]:
    """(text, its window starts as pairs of first and number), from pairs in any order."""
    if not len(ref):
        return []
    order = np.lexsort((pos, ref))
    ref, pos = ref[order].astype(np.int64), pos[order].astype(np.int64)
    first = np.flatnonzero(np.append(True, (ref[1:] != ref[:-1]) | (pos[1:] != pos[:-1] + 1)))
    runs = np.column_stack([pos[first], np.diff(np.append(first, len(ref)))]).astype("<u4")
    owner = ref[first]
    cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    return [(int(owner[c]), r.tobytes()) for c, r in zip(cut, np.split(runs, cut[1:]))]


REPLY = "key long, mark long, runs binary"


def repeated(docs: DataFrame, size: int, bits: int, buckets: int, filled: list[bytearray], hot: np.ndarray) -> DataFrame:
    """(key, mark, runs): for each text, window starts whose sequence starts elsewhere too. A text's rows may be several; ``docs`` has key, mark and text."""
    shared = docs.sparkSession.sparkContext.broadcast([bytes(x) for x in filled])

    def send(batches):
        powers = Powers()
        rows = [np.frombuffer(x, np.uint8) for x in shared.value]
        turn = 0

        def flush(held, keys):
            """Settles what repeats within these windows; the rest, and one of each that repeats, goes to its bucket."""
            nonlocal turn
            e = np.concatenate([h for h, _ in held])
            lot = np.concatenate([x for _, x in held])
            order = np.lexsort((e["h2"], e["h1"]))
            e, lot = e[order], lot[order]
            new = np.append(True, (e["h1"][1:] != e["h1"][:-1]) | (e["h2"][1:] != e["h2"][:-1]))
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(e)))
            again = np.repeat(times > 1, times)
            out, names = [], np.array(keys, np.int64)
            for ref, runs in as_runs(e["ref"][again], e["pos"][again]):
                out.append((turn % buckets, None, names[ref].tobytes(), runs))
                turn += 1
            e, lot = e[first].copy(), lot[first]
            e["ref"][times > 1] = NOBODY
            order = np.argsort(lot, kind="stable")
            e, lot = e[order], lot[order]
            cut = np.flatnonzero(np.append(True, lot[1:] != lot[:-1]))
            for c, x in zip(lot[cut], np.split(e, cut[1:])):
                asks = x["ref"] != NOBODY
                used, x["ref"][asks] = np.unique(x["ref"][asks], return_inverse=True)
                out.append((int(c), x.tobytes(), names[used].tobytes(), None))
            columns = list(zip(*out))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["bucket", "entries", "names", "runs"])

        for b in batches:
            held, n = [], 0
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            for first, lists in chunks(texts_of(b.column(2))):
                w = Windows(lists, size, powers)
                if not len(w.at):
                    continue
                good = np.ones(len(w.at), bool)
                for row in (0, 1):
                    c = cells(w.minimizer, row, bits)
                    good &= (rows[row][(c >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (c & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                which = np.flatnonzero(good)
                if not len(which):
                    continue
                e = np.zeros(len(which), ENTRY)
                e["h1"], e["h2"] = w.hashes(which)
                e["pos"], e["ref"] = w.start[which], w.text[which] + first
                by = np.where(np.isin(w.minimizer[which], hot), e["h1"], w.minimizer[which])  # equal windows have equal minimizers
                held.append((e, (mix(by) % np.uint64(buckets)).astype(np.int64)))
                n += len(which)
                if n > WINDOWS_HELD:
                    yield flush(held, keys)
                    held, n = [], 0
            if n:
                yield flush(held, keys)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        """All entries of a bucket: those that stand with another one, or for several, are repeated."""
        known = pdf.loc[pdf["entries"].isna()]
        out = [(*np.frombuffer(x, np.int64).tolist(), runs) for x, runs in zip(known["names"], known["runs"])]
        rows = pdf.loc[pdf["entries"].notna()]
        if len(rows):
            parts = [np.frombuffer(x, ENTRY) for x in rows["entries"]]
            names = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in rows["names"]]
            base = np.cumsum([0, *[len(x) for x in names]])
            e = np.concatenate(parts)
            asks = e["ref"] != NOBODY
            ref = np.where(asks, e["ref"].astype(np.int64) + np.repeat(base[:-1], [len(x) for x in parts]), -1)
            order = np.lexsort((e["h2"], e["h1"]))
            e, ref = e[order], ref[order]
            first = np.flatnonzero(np.append(True, (e["h1"][1:] != e["h1"][:-1]) | (e["h2"][1:] != e["h2"][:-1])))
            times = np.diff(np.append(first, len(e)))
            good = np.repeat(times > 1, times) & (ref >= 0)
            every = np.concatenate(names)
            out += [(int(every[r, 0]), int(every[r, 1]), runs) for r, runs in as_runs(ref[good], e["pos"][good])]
        return pd.DataFrame(out, columns=["key", "mark", "runs"]).astype({"key": "int64", "mark": "int64"})

    sent = map_arrow(docs.select("key", "mark", "text"), send, "bucket int, entries binary, names binary, runs binary", rows=1 << 30)  # what one batch holds is settled together
    return sent.groupBy("bucket").applyInPandas(settle, REPLY)


def keep(text: bytes, runs: list[bytes], size: int) -> tuple[int, list[bytes]]:
    """(number of words, words kept) of a text."""
    words = text.split()
    if not runs:
        return len(words), words
    change = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        for start, n in np.frombuffer(r, "<u4").reshape(-1, 2).astype(np.int64).tolist():
            change[start] += 1
            change[start + n + size - 1] -= 1
    stays = np.cumsum(change[:-1]) == 0
    return len(words), [w for w, s in zip(words, stays.tolist()) if s]


def with_runs(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` under the columns 0, 1, ..., then its text and the list of its repeated windows' runs (null without any)."""
    own, (id_at, text_at) = numbered(docs, "doc_id", "text")
    base = own.withColumn("text", F.col(f"c{text_at}")).withColumn("key", F.coalesce(F.col(f"c{id_at}").cast("long"), F.lit(-(1 << 63)))).withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    size_of = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    places = max(2 * (size_of // 5) // (size - min(RUN, size) + 2), 1)
    bits = min(MOST_BITS, max(LEAST_BITS, int(4 * places).bit_length()))
    filled, words, hot = sketch(base, size, bits)
    found = repeated(base, size, bits, max(1, -(-words // BUCKET)) * 4, filled, hot)
    runs = saved(found.groupBy("key", "mark").agg(F.collect_list("runs").alias("runs")))
    # texts without repeats aren't shuffled, but for the few that a filter lets pass
    over = Filter(runs.n_rows)
    marked = over.passing(base, "mark", over.table(runs, "mark"))
    few = marked.where("maybe").join(runs, ["key", "mark"], "left").select(*own.columns, "text", "runs")
    return marked.where("NOT maybe").select(*own.columns, "text", F.lit(None).cast("array<binary>").alias("runs")).union(few)


def removals(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of ``docs``.

    Words are runs without ASCII white space, unchanged. All occurrences of a repeated window go, the first too, and
    windows are judged on the input. Null texts and texts shorter than a window lose nothing. Repeated rows repeat
    each other's windows; a null id is an id like others; other columns aren't read; an empty table gives no rows.
    """
    out = with_runs(pick(docs, "doc_id", "text"), size)

    def run(batches):
        for b in batches:
            got = [keep(t or b"", r or [], size) for t, r in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([n - len(w) for n, w in got], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for _, w in got], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return map_arrow(out.select(F.col("c0").cast("long").alias("doc_id"), "text", "runs"), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cleaned(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated words gone from text, n_chars (where there is such a column) counted anew.

    A text that loses words is what is left of its words joined by single spaces, perhaps nothing; others stay as they
    are, null ones too. All rows and columns stay.
    """
    out = with_runs(docs, size)
    _, (at,) = numbered(docs, "text")
    schema = T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema.fields)])

    def run(batches):
        for b in batches:
            texts = [t if not r else b" ".join(keep(t or b"", r, size)[1]) for t, r in zip(b.column(b.num_columns - 2).cast(pa.binary()).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
            columns = [b.column(i) for i in range(b.num_columns - 2)]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    new = map_arrow(out, run, schema)
    fresh = [F.char_length(f"c{at}").cast(f.dataType).alias(f"c{i}") if f.name.lower() == "n_chars" else F.col(f"c{i}") for i, f in enumerate(docs.schema.fields)]
    return new.select(*fresh).toDF(*docs.columns)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(read(spark, sf_dir, "documents"))
