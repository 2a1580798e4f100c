"""Commands: ``encode`` texts to JSON lines, ``score`` pairs, ``info`` about model files against a manifest.

Run with spark-submit or ``python -m vectide.cli``. Without ``--model`` a closed-form test backbone stands in, whose
vectors have no meaning.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import MAX_LENGTH, QUERY_MAX_LENGTH
from .operators import encoding, scoring, tokenizer
from .sources.model_files import Vocabulary, text_lines, verify_manifest


def _texts(spark: SparkSession, args) -> DataFrame:
    """Arguments if there are any, else the lines of the input or of standard input, blank ones left out; numbered in order."""
    if args.texts:
        lines = args.texts
    elif args.input:
        return text_lines(spark, args.input).select(F.monotonically_increasing_id().alias("id"), "text")
    else:
        lines = [x.rstrip("\n") for x in sys.stdin if x.strip()]
    return spark.createDataFrame(list(enumerate(lines)), "id long, text string")


def _vocabulary(spark: SparkSession, args, texts: DataFrame) -> Vocabulary:
    if args.vocabulary:
        return Vocabulary.from_bytes(bytes(spark.read.format("binaryFile").load(args.vocabulary).select("content").first()[0]))
    return tokenizer.derived_vocabulary(texts, "text", least=2)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vectide", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("encode", "score"):
        p = commands.add_parser(name)
        p.add_argument("texts", nargs="*", help="texts; for score, query and passage in turn")
        p.add_argument("--input", help="a text file, a line each")
        p.add_argument("--vocabulary", help="a unigram vocabulary file")
        p.add_argument("--model", help="an ONNX backbone")
        p.add_argument("--max-length", type=int, default=MAX_LENGTH)
        p.add_argument("--sparse", action="store_true")
        p.add_argument("--colbert", action="store_true")
        p.add_argument("--weights", type=float, nargs=3, default=(1.0, 1.0, 1.0))
        p.add_argument("--output", help="a folder for JSON lines; standard output without it")
    p = commands.add_parser("info")
    p.add_argument("manifest", help="a CSV file with name, size and sha256")
    p.add_argument("folder")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if args.command == "info":
        manifest = spark.read.csv(args.manifest, header=True, schema="name string, size long, sha256 string")
        out = verify_manifest(spark, manifest, args.folder).orderBy("name").toJSON()
    else:
        texts = _texts(spark, args)
        v = _vocabulary(spark, args, texts)
        backbone = encoding.onnx_backbone(args.model) if args.model else encoding.test_backbone
        if args.command == "encode":
            ids = tokenizer.token_ids(texts, "id", "text", v, args.max_length)
            got = encoding.encode(ids, backbone, encoding.TEST_HEADS, key="id", dense=True, sparse=args.sparse, colbert=args.colbert)
            out = texts.join(got, "id").orderBy("id").drop("id")
            if args.output:
                from .sources.model_files import write_results

                write_results(out, args.output)
                return []
            out = out.toJSON()
        else:
            pairs = texts.groupBy(F.floor(F.col("id") / 2).alias("pair_id")).agg(F.max_by("text", -F.col("id")).alias("query"), F.max_by("text", "id").alias("passage"))
            out = scoring.compute_score(pairs, v, backbone, encoding.TEST_HEADS, tuple(args.weights), min(args.max_length, QUERY_MAX_LENGTH), args.max_length).orderBy("pair_id").toJSON()
    lines = out.collect()  # for the terminal: what is too much for it goes to --output
    for line in lines:
        print(line)
    return lines


if __name__ == "__main__":
    main()
