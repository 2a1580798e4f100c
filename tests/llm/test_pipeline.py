"""run() against the stages done plainly in Python on the smallest tables."""

import collections
import itertools
import zlib

import numpy as np
import pytest

from vectide.llm import near_dedup, quality
from vectide.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def test_stages(pipeline):
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)


def test_run(spark, pipeline):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in quality.score(docs, model).where("predicted = 1").collect()}
    assert 0 < len(good) < len(text)
    last = {text[i]: i for i in sorted(good)}
    left = {i: t for t, i in last.items()}
    sets = {i: near_dedup.exact_set(t.encode(), 5) for i, t in left.items()}
    label = {i: i for i in left}
    for _ in left:
        before = dict(label)
        for a, b in itertools.combinations(sorted(left), 2):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    left = {i: t for i, t in left.items() if label[i] == i}
    words = {i: t.encode().split() for i, t in left.items()}
    count = collections.Counter(tuple(w[a : a + 35]) for w in words.values() for a in range(len(w) - 34))
    t = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    want = []
    for i, w in words.items():
        gone = {p for a in range(len(w) - 34) if count[tuple(w[a : a + 35])] > 1 for p in range(a, a + 35)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone).decode() if gone else left[i]
        ids = np.array([*t.encode(kept, add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    got = pipeline.run(spark, SF)
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got.collect()) == sorted(want)


def test_stages_take_hard_tables(spark, tmp_path):
    """Nulls, empty texts, repeated rows, no rows, and columns whose names clash with those the stages use."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    kind = "doc_id long, text string, lang string, source string, n_chars long, Text_2 string, n long, key string, mark long, runs string, bucket int"
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words), (2, words), (2, words), (3, None), (4, ""), (None, "alone here"), (None, None), (5, words + " more"), (6, "other words " + words), (7, "q " * 30_000), (8, "w" * 50_000)]
    full = spark.createDataFrame([(i, t, "en", None, len(t or ""), "x", 1, "k", None, "r", 0) for i, t in rows], kind)
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (full, full.limit(0)):
        empty = not docs.count()
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES[1:], 1):
            out = stage(spark, docs, str(tmp_path))
            got = out.collect()
            assert bool(got) != empty, name
            if k < 4:
                assert out.columns == docs.columns
                docs = out
                kept = [r["doc_id"] for r in got]
                if not empty and k < 3:  # 1 and 2 are one text, 3 and 4 and a row without an id are empty; 2, 5 and 6 are near copies
                    assert sorted(kept, key=str) == sorted([[2, 2, None, 4, 5, 6, 7, 8], [2, 2, None, 4, 7, 8]][k - 1], key=str)
        out = corpus_pipeline.STAGES[0][1](spark, full if not empty else full.limit(0), str(tmp_path))
        assert out.columns == full.columns and (not empty or out.count() == 0)
