"""Best-fit packing of tokenised documents into sequences by bin completion.

Documents are cut into pieces of at most a sequence's capacity. What must be packed is fully described by how many
pieces there are of each length, a table no longer than the capacity whatever the corpus, so the search runs on that
histogram: the largest length left is completed by an undominated filling from the lengths left, and a filling is used
as often at once as the counts allow. The search is branch and bound over fillings with the best-fit solution as its
first incumbent; a branch is pruned when its waste makes fewer sequences than the incumbent's impossible. The plan
(at most a few rows a length) is then applied to all pieces in parallel by their rank within their length.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, pick, read, remembered, saved

CAPACITY = 2048
#: Fillings of one largest length that are tried, looked at on the way to them, and turns back to one not tried yet; beyond the last the best solution so far stands. The way down after a turn is never cut short.
WIDTH, LOOKED, NODES = 4, 400, 2_000
#: Bytes that a worker remembers of words, and of their parts, at most; it keeps them for its next task of this operator.
REMEMBERED = 40 << 20


# --- tokens -------------------------------------------------------------------------------------------------------

PRINTABLE = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: The split of this vocabulary's pre-tokenizer for such characters; for all others the tokenizer itself is asked.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def byte_chars() -> dict[int, str]:
    """The usual characters of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others, in order, for those from 256 on."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in same}
    for i, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + i)
    return out


class Words:
    """Token ids of whole texts, found word by word: no token of this vocabulary crosses ASCII white space, so each distinct word is encoded once.

    A special token's literal may swallow the white space beside it, so a text that holds one is given to the tokenizer
    whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.specials = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.chars = byte_chars()
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.room = {id(self.known): REMEMBERED, id(self.parts): REMEMBERED}

    def keep(self, table: dict, key: bytes | str, ids: bytes) -> bytes:
        """Remembers an entry, some 130 bytes beside its own, while there is room: what is frequent comes early."""
        left = self.room[id(table)] - 130 - len(key) - len(ids)
        if left >= 0:
            self.room[id(table)] = left
            table[key] = ids
        return ids

    def part(self, p: str) -> bytes:
        got = self.parts.get(p)
        if got is None:
            q = p if p.isascii() else "".join(self.chars[b] for b in p.encode())
            got = self.keep(self.parts, p, b"".join([struct.pack("<I", t.id) for t in self.model.tokenize(q)]))
        return got

    def asked(self, s: str) -> bytes:
        return np.array(self.whole.encode(s, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, w: bytes) -> bytes:
        s = w.decode()
        return self.keep(self.known, w, b"".join(map(self.part, SPLIT.findall(s.lower()))) if PRINTABLE.fullmatch(s) else self.asked(s))

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if any(x in text for x in self.specials):
            return self.asked(text.decode())
        found = text.split()
        out = list(map(self.known.get, found))
        if None in out:
            out = [ids or self.known.get(w) or self.word(w) for w, ids in zip(found, out)]
        return b"".join(out)


def words(path: str) -> Words:
    """One for each worker, until that has a task of another operator."""
    return remembered(("words", path), lambda: Words(path))


# --- the plan -----------------------------------------------------------------------------------------------------


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that no packing can do without: by the total, and for each k by the pieces above capacity - k, which share with none of those of at least k (Martello and Toth's L2)."""
    lengths = sorted(counts)
    best = -(-sum(x * n for x, n in counts.items()) // capacity)
    for k in [x for x in lengths if x <= capacity // 2]:
        big = sum(n for x, n in counts.items() if x > capacity - k)
        half = [(x, n) for x, n in counts.items() if capacity // 2 < x <= capacity - k]
        small = sum(x * n for x, n in counts.items() if k <= x <= capacity // 2)
        room = sum((capacity - x) * n for x, n in half)
        best = max(best, big + sum(n for _, n in half) + max(0, -(-(small - room) // capacity)))
    return best


def dominates(a: tuple[int, ...], b: tuple[int, ...], steps: int = 200) -> bool:
    """Whether filling ``a`` is no worse than ``b``, both descending (Martello and Toth): b's pieces can be parted into groups that fit within a piece of a each. After so many steps without an answer b counts as not dominated, which loses nothing."""
    if sum(b) > sum(a) or b[:1] > a[:1]:
        return False
    rooms, left = list(a), steps

    def place(i: int) -> bool:
        nonlocal left
        if i == len(b):
            return True
        for j, room in enumerate(rooms):
            if room >= b[i] and room not in rooms[:j] and left > 0:
                left -= 1
                rooms[j] -= b[i]
                if place(i + 1):
                    return True
                rooms[j] += b[i]
        return False

    return place(0)


def fillings(room: int, counts: dict[int, int], lengths: list[int]) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` from the lengths left (ascending), by waste and then by fewer, larger pieces; WIDTH of them.

    A piece that fills the room alone dominates all else. Otherwise pairs that leave nothing and the fillings of a
    search of LOOKED steps are compared; were there WIDTH such pairs, the search could add none that comes before them.
    """
    if counts.get(room, 0):
        return [(room,)]
    out: list[tuple[int, tuple[int, ...]]] = []
    looked = 0
    smallest = lengths[0] if lengths else room + 1

    def completed(left: int, below: int, chosen: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
        """The filling by the largest that fits, and so on."""
        i = bisect.bisect_right(lengths, min(left, below)) - 1
        while i >= 0:
            x = lengths[i]
            take = min(left // x, counts[x] - chosen.count(x))
            left, chosen = left - x * take, chosen + (x,) * take
            i = min(i, bisect.bisect_right(lengths, left)) - 1
        return left, chosen

    def search(left: int, below: int, chosen: tuple[int, ...]) -> bool:
        nonlocal looked
        i = bisect.bisect_right(lengths, min(left, below)) - 1
        if i < 0:
            out.append((left, chosen))
            return left == 0
        tried = 0
        while i >= 0 and tried < WIDTH:
            x = lengths[i]
            i -= 1
            if chosen.count(x) >= counts[x]:
                continue
            looked += 1
            tried += 1
            if left - x < smallest:
                out.append((left - x, (*chosen, x)))
                if left == x:
                    return True  # no filling with the same beginning wastes less
            elif looked < LOOKED:
                search(left - x, x, (*chosen, x))
            else:
                out.append(completed(left - x, x, (*chosen, x)))
            if looked > LOOKED:
                return False
        if not tried:
            out.append((left, chosen))
        return False

    # pairs that leave nothing are looked for first: for each larger piece the one that completes it
    for x in reversed(lengths[: bisect.bisect_right(lengths, room)]):
        y = room - x
        if 0 < y <= x and counts.get(y, 0) > (y == x):
            out.append((0, (x, y)))
            if len(out) >= WIDTH:
                break
    if len(out) < WIDTH:
        search(room, room, ())
    kept: list[tuple[int, tuple[int, ...]]] = []
    for w, f in sorted(set(out), key=lambda o: (o[0], len(o[1]), [-x for x in o[1]])):
        if not any(dominates(g, f) for _, g in kept):
            kept.append((w, f))
        if len(kept) == WIDTH:
            break
    return [f for _, f in kept]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, times): the largest piece left, then the largest that fits, and so on; as often at once as the counts allow."""
    left, out = dict(counts), []
    lengths = sorted(left)
    while lengths:
        room, chosen, i = capacity, [], len(lengths) - 1
        while i >= 0 and room > 0:
            i = min(i, bisect.bisect_right(lengths, room) - 1)
            if i < 0:
                break
            x = lengths[i]
            take = min(room // x, left[x])
            chosen += [x] * take
            room -= x * take
            i -= 1
        out.append((tuple(chosen), _use(left, lengths, tuple(chosen))))
    return out


def _use(left: dict[int, int], lengths: list[int], chosen: tuple[int, ...]) -> int:
    """Takes a sequence's pieces from the counts as often as they allow, and returns how often."""
    need = {x: chosen.count(x) for x in set(chosen)}
    times = min(left[x] // n for x, n in need.items())
    for x, n in need.items():
        left[x] -= n * times
        if not left[x]:
            del left[x]
            lengths.pop(bisect.bisect_left(lengths, x))
    return times


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, times) that use every piece once. ``counts``: pieces of each length from 1 to capacity."""
    counts = {x: n for x, n in counts.items() if n > 0}
    if any(not 1 <= x <= capacity for x in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    if not counts:
        return []
    least = lower_bound(counts, capacity)
    total = sum(x * n for x, n in counts.items())
    best = best_fit(counts, capacity)
    fewest = sum(n for _, n in best)
    # depth first; a level holds the fillings still to try and the step taken, which is undone on the way back
    left, lengths, rest, used, waste, turns = dict(counts), sorted(counts), total, 0, 0, 0
    levels: list[tuple[int, list[tuple[int, ...]], list[tuple[tuple[int, ...], int]]]] = []
    while fewest > least:
        if not left and used < fewest:
            fewest, best = used, [step for *_, taken in levels for step in taken]
        # the waste an improvement may still make: one sequence fewer than the incumbent's, less the pieces
        elif left and waste <= (fewest - 1) * capacity - total and used + max(1, -(-rest // capacity)) < fewest:
            largest = lengths[-1]
            left[largest] -= 1
            options = fillings(capacity - largest, left, lengths if left[largest] else lengths[:-1])
            left[largest] += 1
            levels.append((largest, options[::-1], []))
        while levels:
            largest, options, taken = levels[-1]
            if taken:
                step, times = taken.pop()
                turns += bool(options)
                for x in step:
                    if x not in left:
                        bisect.insort(lengths, x)
                    left[x] = left.get(x, 0) + times
                rest, used, waste = rest + sum(step) * times, used - times, waste - (capacity - sum(step)) * times
            if options:
                break
            levels.pop()
        if not levels or turns > NODES:
            break
        step = (largest, *options.pop())
        times = _use(left, lengths, step)
        taken.append((step, times))
        rest, used, waste = rest - sum(step) * times, used + times, waste + (capacity - sum(step)) * times
    return best


def slots(found: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """The plan by length: pieces of ranks start to start + times * each - 1 within ``length`` go to sequences from ``sequence`` on, ``each`` to one, the first at ``offset``. A few rows a length."""
    rows, rank, sequence = [], {}, 0
    for lengths, times in found:
        offset = 0
        for x in dict.fromkeys(lengths):
            each = lengths.count(x)
            rows.append((x, rank.get(x, 0), each, sequence, offset))
            rank[x] = rank.get(x, 0) + each * times
            offset += each * x
        sequence += times
    return pd.DataFrame(rows, columns=["length", "start", "each", "sequence", "offset"]).sort_values(["length", "start"])


# --- the operator -------------------------------------------------------------------------------------------------

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """Each row's ids and the id ``end``, cut at every ``capacity`` ids: a row for each piece with its length, checksum, the task that made it and its place among that task's pieces of its length. Null texts are empty: one piece, ``end`` alone."""
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        coder, task, seen = words(path), TaskContext.get().partitionId(), {}
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                ids = coder.encode(text or b"") + last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    out.append((doc_id, k, at // 4, n, zlib.crc32(part), task, seen.get(n, 0)))
                    seen[n] = seen.get(n, 0) + 1
            columns = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], [x.split()[0] for x in PIECES.split(", ")])

    return map_arrow(pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text"), run, PIECES, uses=("words", path))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """For each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of ``docs`` is packed, repeated ones each for itself; a null id stays null; other columns aren't read; an
    empty table gives no rows. Sequences are filled without gaps from offset 0.
    """
    cut = saved(pieces(docs, path, capacity))
    per_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))  # at most capacity rows a task
    per_task = saved(per_task)
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    where = slots(plan(counts, capacity))
    shared = docs.sparkSession.sparkContext.broadcast({x: g.to_numpy().T.copy() for x, g in where.groupby("length")})

    # where each task's pieces of a length begin among all of that length; a length has a row a task
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    first = per_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("first"))

    def place(batches):
        for b in batches:
            t = pa.Table.from_batches([b]).to_pandas()
            length, rank = t["length"].to_numpy(), (t["first"] + t["place"]).to_numpy()
            sequence, offset = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                _, start, each, seq, off = shared.value[int(x)]
                i = np.searchsorted(start, rank[at], side="right") - 1
                k = rank[at] - start[i]
                sequence[at], offset[at] = seq[i] + k // each[i], off[i] + k % each[i] * x
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(5)], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    joined = cut.join(first, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", "first", "place")
    return map_arrow(joined, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", uses=("words", path))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
