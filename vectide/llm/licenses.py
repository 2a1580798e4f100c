"""License scans: exact phrases, and short notices with edits.

A notice of m letters may differ by up to m // EDIT_EVERY edits. Split into one piece more than that, some piece must
occur unchanged in any such match (pigeonhole), so an Aho-Corasick automaton over the pieces finds every place worth
a look, and the regex library's bounded-error matching of the whole notice around it verifies the edits and gives the
span. Both searches run over the words of the whole text joined by single spaces.
"""

from __future__ import annotations

import bisect
import functools

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, map_arrow, pick, read

#: Fixed values of the contract: phrases whose words stand consecutively, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: The notices searched for with edits, as words joined by single spaces, and their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the gnu general public license version 3": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}

#: One edit for so many letters of a notice.
EDIT_EVERY = 10

#: Bytes of words as they are, A-Z lower-cased, all others a space.
TABLE = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 97 <= i <= 122 or 48 <= i <= 57 else 32 for i in range(256))


@functools.lru_cache(4)
def machine(notices: tuple[tuple[str, str], ...]):
    """(automaton over seeds, patterns, edits): a seed leads to (notice's number, the seed's start in it)."""
    seeds: dict[str, list[tuple[int, int]]] = {}
    patterns, edits = [], []
    for i, (notice, _) in enumerate(notices):
        k = len(notice) // EDIT_EVERY
        cut = np.linspace(0, len(notice), k + 2).astype(int)
        for a, b in zip(cut[:-1], cut[1:]):
            seeds.setdefault(notice[a:b], []).append((i, int(a)))
        patterns.append(regex.compile(rf"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}"))
        edits.append(k)
    found = ahocorasick.Automaton()
    for s, at in seeds.items():
        found.add_word(s, (len(s), at))
    found.make_automaton()
    return found, patterns, edits


def fuzzy(words: str, notices: tuple[tuple[str, str], ...]) -> list[tuple[str, int, int, int]]:
    """(label, start, end, edits) of the places in ``words`` that a notice fits within its edits, in order; of overlapping places the closest match, then the longest, then the first.

    Each seed's own window is searched, a notice's length and its edits on either side, so a text's cost grows with its
    seeds whatever stands between them.
    """
    found, patterns, edits = machine(notices)
    windows = set()
    for end, (n, places) in found.iter(words):
        for i, at in places:
            start = end + 1 - n - at
            windows.add((i, max(0, start - edits[i]), min(len(words), start + len(notices[i][0]) + edits[i])))
    out = set()
    for i, a, b in windows:
        least = len(notices[i][0]) - edits[i]
        left = [(a, b)]
        while left:  # a pattern finds the closest match of a part; what stands before and behind it is searched again
            a, b = left.pop()
            m = patterns[i].search(words, a, b) if b - a >= least else None
            if m:
                out.add((notices[i][1], m.start(), m.end(), sum(m.fuzzy_counts)))
                left += [(a, m.start()), (m.end(), b)]
    best: list[tuple[int, int, str, int]] = []  # in order of starts; none overlap
    for label, a, b, e in sorted(out, key=lambda x: (x[3], x[1] - x[2], x[1], x[0])):
        i = bisect.bisect_left(best, (a,))
        if (i == 0 or best[i - 1][1] <= a) and (i == len(best) or b <= best[i][0]):
            best.insert(i, (a, b, label, e))
    return [(label, a, b, e) for a, b, label, e in best]


def blanks(codes: np.ndarray) -> np.ndarray:
    """Places of blanks, in order; how many stand before a place is found among them."""
    return np.flatnonzero(codes == 32)


def scan_text(text: bytes, phrases: dict[str, str], notices: tuple[tuple[str, str], ...]) -> dict:
    words = text.translate(TABLE).split()
    joined = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in phrases.items():
        p = f" {phrase} ".encode()
        at = joined.find(p)
        while at >= 0:
            places.append(at)
            base.add(label)
            at = joined.find(p, at + 1)
    starts = np.searchsorted(blanks(np.frombuffer(joined, np.uint8)), places).tolist() if places else []
    decoded = joined[1:-1].decode()
    near = fuzzy(decoded, notices)
    spans = []
    if near:
        gaps = blanks(np.frombuffer(decoded.encode("utf-32-le"), "<u4"))
        for n, a, b, e in near:
            a += decoded[a : a + 1] == " "
            spans.append({"label": n, "first_word": int(np.searchsorted(gaps, a)), "last_word": int(np.searchsorted(gaps, b)), "edits": e})
    share = [1 - e / max(b - a, 1) for _, a, b, e in near]
    return {
        "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {s["label"] for s in spans})),
        "score": 1.0 if base else min(max([0.0, *share]), 1.0), "spans": spans,
    }


SPANS = "array<struct<label:string,first_word:long,last_word:long,edits:int>>"


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """For each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. n_base counts all places of the exact
    phrases, first_word and last_word their smallest and largest start. ``spans`` has the notices found with edits:
    label, first and last word and the number of edits; ``labels`` has theirs too. The score is 1 where a phrase
    stands, else the best notice's share of unedited letters, else 0. Null and empty texts have no words, no places and
    empty labels. Repeated rows are scanned alike; other columns aren't read; an empty table gives no rows.
    """
    listed = tuple(notices.items())
    kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())])))]

    def run(batches):
        for b in batches:
            found = [scan_text(t, phrases, listed) for t in byte_texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([x[n] for x in found], t) for n, t in kinds]], ["doc_id", *[n for n, _ in kinds]])

    base = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return map_arrow(base, run, f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).withColumn("n_spans", F.size("spans").cast("long")).drop("spans")
