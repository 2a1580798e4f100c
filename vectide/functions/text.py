"""Column functions over texts and token ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Unicode White_Space characters, the word mark, special tokens and their ids, bounds of length buckets, greatest lengths.
WHITE_SPACE = r"\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
MARK = "▁"
SPECIALS = {"<s>": 0, "<pad>": 1, "</s>": 2, "<unk>": 3, "<mask>": 250001}
BEGIN, PAD, END, UNKNOWN, MASK = 0, 1, 2, 3, 250001
BUCKET_BOUNDS = (128, 512, 2048)
MAX_LENGTH, QUERY_MAX_LENGTH = 8192, 512


def words(text: Column) -> Column:
    """Words between runs of Unicode white space; none for null or blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{WHITE_SPACE}]+"), lambda w: w != "")


def metaspace(word: Column) -> Column:
    """The word with the mark before it unless it stands there."""
    return F.when(F.startswith(word, F.lit(MARK)), word).otherwise(F.concat(F.lit(MARK), word))


def is_plain_ascii(text: Column) -> Column:
    """Whether normalisation leaves the text as it is: printable ASCII only."""
    return F.coalesce(text, F.lit("")).rlike(r"^[ -~]*\z")


def special_literals(text: Column) -> Column:
    """The special tokens that stand in a text, ``<mask>`` with the white space before it."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"<s>|<pad>|</s>|<unk>|[{WHITE_SPACE}]*<mask>"), F.lit(0))


def length_bucket(n: Column) -> Column:
    """How many bounds the length in code points exceeds."""
    return sum((n > b).cast("int") for b in BUCKET_BOUNDS)


def framed(ids: Column, max_length: int = MAX_LENGTH) -> Column:
    """Begin, the first max_length - 2 ids, end."""
    if max_length < 2:
        raise ValueError("max_length must be 2 at least")
    return F.concat(F.array(F.lit(BEGIN)), F.slice(ids, 1, max_length - 2) if max_length > 2 else F.slice(ids, 1, 0), F.array(F.lit(END)))


def padded(ids: Column, width: Column) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(PAD), (width - F.size(ids)).cast("int")))


def detokenized(tokens: Column) -> Column:
    """Tokens joined, marks as blanks, without blanks at the ends."""
    return F.regexp_replace(F.replace(F.array_join(tokens, ""), F.lit(MARK), F.lit(" ")), f"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+$", "")


def hashed_id(word: Column) -> Column:
    """A stand-in for a vocabulary: an id from 4 on by the word's digest."""
    return (F.conv(F.substring(F.md5(word), 1, 6), 16, 10).cast("int") % 250000 + 4).cast("int")
