"""A unigram tokenizer: special tokens, character map by grapheme, words, best segmentation, ids."""

from __future__ import annotations

import functools
import math
import re
import uuid

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import BEGIN, END, MARK, MAX_LENGTH, PAD, UNKNOWN, WHITE_SPACE
from ..sources.model_files import NORMAL, USER_DEFINED, Vocabulary

#: How far below the lowest piece an unknown character scores; UTF-8 bytes from which a cluster is mapped by character; least printable ASCII text.
UNKNOWN_PENALTY = 10.0
WHOLE_BELOW = 6
PLAIN = re.compile(r"[ -~]*")
_SPACE = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{m[1]}", WHITE_SPACE)
SPECIAL = re.compile(f"(<s>|<pad>|</s>|<unk>|[{_SPACE}]*<mask>)")
NAMES = {"<s>": BEGIN, "<pad>": PAD, "</s>": END, "<unk>": UNKNOWN}


def graphemes(text: str) -> list[str]:
    """Extended grapheme clusters."""
    return regex.findall(r"\X", text)


class Unigram:
    """Token ids by a vocabulary: begin 0, pad 1, end 2, unknown 3, the other pieces one above their number, mask the last."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = v = vocabulary
        usable = [i for i, t in enumerate(v.types) if t in (NORMAL, USER_DEFINED)]
        self.number = {v.pieces[i]: i for i in usable}
        self.score = {v.pieces[i]: v.scores[i] for i in usable}
        self.longest = max(map(len, self.number), default=1)
        self.unknown_score = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.mask = len(v.pieces) + 1

    def normalize(self, text: str) -> str:
        if PLAIN.fullmatch(text):
            return text
        look = self.vocabulary.charmap.lookup

        def mapped(cluster: str) -> str:
            if len(cluster) == 1 or len(cluster.encode()) < WHOLE_BELOW:
                whole = look(cluster)
                if whole is not None:
                    return whole
            return "".join(c if (m := look(c)) is None else m for c in cluster)

        return "".join(map(mapped, graphemes(text)))

    def segment(self, word: str) -> list[str | None]:
        """The word's best pieces, None for a run of unknown characters. Of equal scores the piece that begins earlier wins.

        best[e] is the best score of the first e characters, and cut[e] where its last piece begins. A character that
        is no piece by itself may be unknown.
        """
        best, cut = [0.0], [0]
        for e in range(1, len(word) + 1):
            top, at = -math.inf, e - 1
            for s in range(max(0, e - self.longest), e):
                own = self.score.get(word[s:e])
                if own is None and s == e - 1:
                    own = self.unknown_score
                if own is not None and best[s] + own > top:
                    top, at = best[s] + own, s
            best.append(top)
            cut.append(at)
        pieces: list[str | None] = []
        e = len(word)
        while e:
            piece = word[cut[e] : e]
            known = piece if piece in self.score else None
            if known is not None or not pieces or pieces[-1] is not None:
                pieces.append(known)
            e = cut[e]
        return pieces[::-1]

    @functools.cached_property
    def word_ids(self):
        @functools.lru_cache(200_000)
        def ids(word: str) -> tuple[int, ...]:
            return tuple(UNKNOWN if p is None else self.number[p] + 1 for p in self.segment(word))

        return ids

    def body(self, text: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(SPECIAL.split(text)):
            if k % 2:
                out.append(NAMES.get(part, self.mask))
                continue
            for word in re.split(f"[{_SPACE}]+", self.normalize(part)):
                if word:
                    out += self.word_ids(word if word.startswith(MARK) else MARK + word)
        return out

    def encode(self, text: str, max_length: int = MAX_LENGTH) -> list[int]:
        if max_length < 2:
            raise ValueError("max_length must be 2 at least")
        return [BEGIN, *self.body(text)[: max_length - 2], END]

    def token(self, i: int) -> str:
        """The piece of an id; ids out of range are an error."""
        names = {v: k for k, v in NAMES.items()} | {self.mask: "<mask>"}
        if i in names:
            return names[i]
        if not 1 <= i <= len(self.vocabulary.pieces):
            raise IndexError(f"no token has the id {i}")
        return self.vocabulary.pieces[i - 1]

    def decode(self, tokens: list[str]) -> str:
        return "".join(tokens).replace(MARK, " ").strip()


def token_ids(docs: DataFrame, key: str, text: str, vocabulary: Vocabulary, max_length: int = MAX_LENGTH) -> DataFrame:
    """(key, ids) of whole texts, null as empty. The vocabulary is sent to each worker once; distinct words are segmented once a worker."""
    if max_length < 2:
        raise ValueError("max_length must be 2 at least")
    v = vocabulary
    shared = docs.sparkSession.sparkContext.broadcast((v.pieces, v.scores, v.types, v.unknown, v.charmap))
    name = uuid.uuid4().hex

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        own = _worker_tokenizer(name, shared)
        return texts.map(lambda t: own.encode(t or "", max_length))

    return docs.select(key, ids(F.col(text)).alias("ids"))


def token_names(tokens: DataFrame, vocabulary: Vocabulary, id_: str = "id") -> DataFrame:
    """``tokens`` with ``token``, the piece of each id, by a join with the vocabulary, which is of bounded size; null where no token has the id."""
    mask = len(vocabulary.pieces) + 1
    names = {i + 1: p for i, p in enumerate(vocabulary.pieces)} | {v: k for k, v in NAMES.items()} | {mask: "<mask>"}
    table = tokens.sparkSession.createDataFrame(list(names.items()), f"{id_} int, token string")
    return tokens.join(F.broadcast(table), id_, "left")


def grapheme_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_clusters, n_chars): extended grapheme clusters and code points of whole texts; plain ASCII without a carriage return is counted where it is."""
    @F.pandas_udf("long")
    def clusters(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sum(1 for _ in regex.finditer(r"\X", t)))

    t = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(key, t.alias("_t"), F.char_length(t).cast("long").alias("n_chars"))
    hard = F.when(~F.col("_t").rlike("^[\\x00-\\x0C\\x0E-\\x7E]*\\z"), F.col("_t")).otherwise("")
    counted = own.select(key, "n_chars", hard.alias("_hard")).withColumn("_n", clusters("_hard"))
    return counted.select(key, F.when(F.col("_hard") == "", F.col("n_chars")).otherwise(F.col("_n")).alias("n_clusters"), "n_chars")


_held: dict[str, Unigram] = {}


def _worker_tokenizer(name: str, shared) -> Unigram:
    """The worker's tokenizer of that name; one is held at a time."""
    if name not in _held:
        _held.clear()
        _held[name] = Unigram(Vocabulary(*shared.value))
    return _held[name]


def derived_vocabulary(docs: DataFrame, text: str, least: int = 50, longest: int = 4) -> Vocabulary:
    """A stand-in vocabulary: every character of the words and every run of up to ``longest`` that occurs ``least`` times or more, scored by the log of its share. Its size follows the alphabet and ``least``, not the corpus."""
    from ..functions.text import metaspace, words

    counted = docs.select(F.explode(words(F.col(text))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    own = counted.select(metaspace(F.col("w")).alias("w"), "n")
    n = F.char_length("w")
    runs = None
    for k in range(1, longest + 1):
        pieces = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.substring("w", i, F.lit(k)))  # noqa: B023
        part = own.where(n >= k).select(F.explode(pieces).alias("piece"), "n")
        runs = part if runs is None else runs.union(part)
    sums = runs.groupBy("piece").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.char_length("piece") == 1)).collect()
    sums.sort(key=lambda r: (-r["n"], r["piece"]))
    total = sum(r["n"] for r in sums)
    pieces = ["<unk>", "<s>", "</s>", *[r["piece"] for r in sums]]
    return Vocabulary(pieces, [0.0, 0.0, 0.0, *[math.log(r["n"] / total) for r in sums]], [2, 3, 3, *[NORMAL] * len(sums)], 0)
