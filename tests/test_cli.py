"""Commands and pair scores."""

import hashlib
import json

import pytest

from vectide import cli
from vectide.operators import encoding, scoring, tokenizer


def test_encode(spark, tmp_path):
    got = [json.loads(x) for x in cli.main(["encode", "one two", "zwei é", "--sparse"], spark)]
    assert [g["text"] for g in got] == ["one two", "zwei é"] and all(set(g) == {"text", "dense_vecs", "lexical_weights"} for g in got)
    (tmp_path / "in.txt").write_text("a b\n\nc\n")
    assert len(cli.main(["encode", "--input", str(tmp_path / "in.txt")], spark)) == 2


def test_info(spark, tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files/x").write_bytes(b"hello")
    (tmp_path / "m.csv").write_text(f"name,size,sha256\nx,5,{hashlib.sha256(b'hello').hexdigest()}\ny,1,00\n")
    assert [json.loads(x)["status"] for x in cli.main(["info", str(tmp_path / "m.csv"), str(tmp_path / "files")], spark)] == ["ok", "missing"]


def test_scores(spark):
    pairs = spark.createDataFrame([(0, "a b", "a b"), (1, "a b", "zz"), (2, "", None)], "pair_id long, query string, passage string")
    v = tokenizer.derived_vocabulary(spark.createDataFrame([("a b zz",)] * 3, "text string"), "text", least=2)
    got = {r["pair_id"]: r for r in scoring.compute_score(pairs, v, encoding.test_backbone, encoding.TEST_HEADS, (2.0, 1.0, 1.0)).collect()}
    assert got[0]["dense"] == pytest.approx(1) and got[0]["colbert"] == pytest.approx(1) and got[0]["sparse"] > 0
    assert got[1]["sparse"] == 0 and got[2]["sparse"] == 0 and got[2]["colbert"] == pytest.approx(1)
    r = got[0]
    assert r["colbert_sparse_dense"] == pytest.approx((r["colbert"] + r["sparse"] + 2 * r["dense"]) / 4)
    with pytest.raises(ValueError):
        scoring.compute_score(pairs, v, encoding.test_backbone, encoding.TEST_HEADS, (1.0, 1.0))
