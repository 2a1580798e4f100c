"""A training corpus from documents: quality, exact copies, near copies, repeated passages, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of documents, whichever
these are. In every stage a null text counts as empty, an empty table gives an empty table, texts are taken whole, and
repeated rows are judged alike.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vectide.llm import exact_dedup, near_dedup, packing, quality, substring_dedup
from vectide.llm.common import read, remove, shared_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels of those that may be learnt from, does not reject. Null and empty texts have the bias alone; without labels nothing is rejected."""
    return quality.accepted(docs, quality.learn(docs, read(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that with the largest id, one without an id only where no other has the text. Rows that repeat an id and a text are one document and all stay."""
    return exact_dedup.distinct_texts(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of their five-word shingles: that with the smallest id. Texts without words, and rows without an id, are linked with nothing and stay."""
    return near_dedup.one_of_each(docs, size=5, percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the words that a repeated 35-word window covers; one may be left with no words. Null texts stay null."""
    return substring_dedup.cleaned(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its place in a sequence of at most 2048 tokens; a null or empty text is one token, the end."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]

#: The stages learn a model, verify sets of shingles and tokenise, which SQL cannot express; tests hold run() against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result but the last is written as Parquet in the shared folder and read again. A stage's table is deleted when the next one's is written; the last stays, as the result is read from it."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")
    return docs
