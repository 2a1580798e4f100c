"""Every registered query against its SQL on the smallest tables, and worked examples of the operators."""

import datetime
import math
import statistics

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vectide.functions import text as X
from vectide.functions import vectors as V
from vectide.operators import batching, encoding, evaluate, integrity, lexical, retrieval
from vectide.plans import queries as plans
from vectide.streaming import microbatch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark", "embeddings", "conversations", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_is_its_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    q = duck.execute(plans.SQL[name])
    have = [x[0] for x in q.description]
    assert sorted(have) == names
    theirs = sorted((tuple(plain(r[have.index(c)]) for c in names) for r in q.fetchall()), key=repr)
    assert mine == theirs and mine


def test_whole_documents_are_encoded(spark, tmp_path):
    n = {1: 3, 2: 600, 3: 9000}
    spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(x))) for i, x in n.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    d, width = str(tmp_path), {i: min(x + 2, X.MAX_LENGTH) for i, x in n.items()}
    ids = {r["doc_id"]: r["ids"] for r in plans.framed_ids(spark, d, X.MAX_LENGTH).collect()}
    assert {i: len(x) for i, x in ids.items()} == width
    assert {r["doc_id"]: (r["width"], r["real_ids"]) for r in plans.QUERIES["pad_mask"](spark, d).collect()} == {i: (X.MAX_LENGTH, x) for i, x in width.items()}
    assert {r["doc_id"]: r["n_vectors"] for r in plans.QUERIES["encode_colbert"](spark, d).collect()} == {i: x - 1 for i, x in width.items()}
    want = {}
    for i, own in ids.items():
        for pos, t in enumerate(own):
            w = max(0.5 + 0.25 * (t % 7) - 0.125 * (pos % 5) - 0.5, 0)
            if w > 0 and t > 3:
                want[i, t] = max(w, want.get((i, t), 0))
    assert {(r["doc_id"], r["tid"]): r["w"] for r in plans.QUERIES["encode_sparse"](spark, d).collect()} == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_partitioning_changes_nothing(spark):
    rows = plans.vectors(spark, SF).select(F.col("vec_id").alias("id"), F.col("v").alias("vector"))
    q = rows.where("id % 100 = 0")
    one = sorted(map(tuple, retrieval.top_k(q, rows.coalesce(1), 7).collect()))
    assert one == sorted(map(tuple, retrieval.top_k(q, rows.repartition(9), 7).collect()))
    assert retrieval.top_k(q.limit(0), rows, 3).count() == 0


def test_query_blocks(spark, monkeypatch):
    rows = plans.vectors(spark, SF).select(F.col("vec_id").alias("id"), F.lit(0).alias("pos"), F.col("v").alias("vector"))
    q = rows.where("id % 100 = 0")
    want = sorted(map(tuple, retrieval.top_k(q, rows, 4).collect())), sorted(map(tuple, retrieval.max_sim(q, rows).collect()))
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 1024)
    assert want == (sorted(map(tuple, retrieval.top_k(q, rows, 4).collect())), sorted(map(tuple, retrieval.max_sim(q, rows).collect())))


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_late_interaction(spark):
    r = 1 / math.sqrt(2)
    q = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.0, 1.0])], "id long, pos long, vector array<double>")
    p = spark.createDataFrame([(5, 0, [r, r]), (5, 1, [1.0, 0.0])], "id long, pos long, vector array<double>")
    assert retrieval.max_sim(q, p).first()["score"] == pytest.approx((1 + r) / 2)


def test_lexical(spark):
    w = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.25), (2, 2, 2.0), (2, 3, 9.0), (3, 7, 1.0)], "id long, tid int, w double")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert {r["b"]: r["score"] for r in lexical.match(pairs, w, w).collect()} == {2: 0.5, 3: 0.0}
    tokens = spark.createDataFrame(zip([1] * 6, [0, 42, 42, 43, 2, 250001], [9.0, 0.5, 0.7, 0.0, 9.0, 0.1]), "id long, tid int, w double")
    assert sorted((r["tid"], r["w"]) for r in lexical.max_pool(tokens, "id").collect()) == [(42, 0.7), (250001, 0.1)]


@pytest.mark.parametrize(("size", "budget", "want"), [(12, 128, [[1], [3, 4], [5, 0, 2]]), (2, 10**6, [[1, 3], [4, 5], [0, 2]]), (12, 1, [[1], [3], [4], [5], [0], [2]])])
def test_batches(spark, size, budget, want):
    n = [5, 100, 3, 60, 60, 8]
    assert encoding.batches_of(n, size, budget) == want
    items = spark.createDataFrame([(0, i, x) for i, x in enumerate(n)], "call long, idx long, n long")
    rows = sorted(batching.batch_plan(items, "call", size, budget).collect(), key=lambda r: (r["batch"], r["place"]))
    assert [[r["idx"] for r in rows if r["batch"] == b] for b in range(len(want))] == want
    assert batching.batch_plan(items.limit(0), "call").count() == 0 and encoding.batches_of([], 1, 1) == []
    for bad in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            batching.batch_plan(items, "call", *bad)


def test_vectors(spark):
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert value(spark, V.l2_normalize(zero)) == [0.0, 0.0]
    v = F.array(*[F.lit(x) for x in (2.5, -127.0, 0.5, 126.5)])
    assert value(spark, V.symmetric_codes(v, V.symmetric_scale(v))) == [2, -127, 0, 126]
    s = V.asymmetric_scale(v)
    assert value(spark, V.asymmetric_codes(v, s, V.zero_point(v, s)))[1] == 0
    assert value(spark, V.hybrid(F.lit(0.5), F.lit(0.2), F.lit(0.9), (2, 1, 1))[1]) == pytest.approx((0.9 + 0.2 + 1.0) / 4)
    with pytest.raises(ValueError):
        V.hybrid(F.lit(0.5), F.lit(0.2), F.lit(0.9), (2, 1))
    assert value(spark, V.smoothing_scale(F.lit(0.0), F.lit(1e9))) == 0.01


def test_texts(spark):
    lengths = [0, 128, 129, 3000]
    assert [value(spark, X.length_bucket(F.lit(n))) for n in lengths] == [0, 0, 1, 3]
    assert value(spark, X.words(F.lit(" a　b\x1cc\n"))) == ["a", "b\x1cc"]
    assert value(spark, X.special_literals(F.lit("x <s><mask>y  <mask>"))) == ["<s>", "<mask>", "  <mask>"]
    ids = F.array(*[F.lit(i) for i in range(5, 25)])
    assert value(spark, X.framed(ids, 16)) == [0, *range(5, 19), 2] and value(spark, X.framed(ids, 2)) == [0, 2]
    with pytest.raises(ValueError):
        X.framed(ids, 1)
    assert value(spark, X.padded(F.array(F.lit(0), F.lit(2)), F.lit(3))) == [0, 2, 1]
    assert not value(spark, X.is_plain_ascii(F.lit("abc\n"))) and value(spark, X.is_plain_ascii(F.lit(None).cast("string")))
    assert value(spark, X.detokenized(F.array(*[F.lit(t) for t in ("▁a", "b", "▁c")]))) == "ab c"


def test_encoding_does_not_depend_on_batches(spark):
    ids = [[0, *range(10, 10 + n), 2] for n in (0, 3, 40, 7, 7)]
    df = spark.createDataFrame(list(enumerate(ids)), "doc_id long, ids array<int>")
    both = [sorted(map(tuple, encoding.encode(df, encoding.test_backbone, encoding.TEST_HEADS, dense=True, sparse=True, colbert=True, batch_size=b, budget=m).collect())) for b, m in ((12, 16384), (1, 1), (2, 50))]
    assert both[0] == both[1] == both[2]
    assert [len(r[3]) for r in both[0]] == [len(i) - 1 for i in ids] and both[0][0][2] == {}
    assert encoding.encode(df, encoding.test_backbone, encoding.TEST_HEADS, dense=True).columns == ["doc_id", "dense_vecs"]


def test_quantiles(spark):
    rng = np.random.default_rng(0)
    groups = {"one": [3.0], "two": [1.0, 5.0], "ties": [2.0] * 30, "many": rng.lognormal(size=501).tolist()}
    df = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v] + [("many", None)], "k string, x double")
    got = {r["k"]: r for r in evaluate.quantiles(df, "k", "x", (0.5, 0.95)).collect()}
    for k, v in groups.items():
        want = (v[0], v[0]) if len(v) == 1 else tuple(statistics.quantiles(v, n=20)[i] for i in (9, 18))
        if k == "two":  # within the ends, where the library extrapolates
            want = (3.0, 5.0)
        assert (got[k]["0.5"], got[k]["0.95"]) == pytest.approx(want)


def test_spearman(spark):
    df = spark.createDataFrame([(1, t, w, u) for t, w, u in ((1, 3.0, 1.0), (2, 2.0, 2.0), (3, 1.0, 3.0))] + [(2, 1, 1.0, None), (2, 2, 2.0, 1.0)], "id long, tid int, w1 double, w2 double")
    assert {r["id"]: r["rho"] for r in evaluate.spearman(df).collect()} == {1: -1.0, 2: 1.0}


def test_offsets(spark):
    df = spark.createDataFrame([("s", i, i % 130) for i in range(3000)], "k string, i long, n long")
    got = {r["i"]: r["offset"] for r in integrity.running_offsets(df, "k", "i", F.col("n")).collect()}
    at = 0
    for i in range(3000):
        assert got[i] == at
        at += -(-(i % 130) // 64) * 64


def test_stream(spark, tmp_path):
    rows = [(0, "o", ["a"]), (1, "o", ["bb", "ccc"]), (2, "o", ["dddd"]), (3, "sparse", ["eeeee"]), (4, "o", None), (5, "o", ["x" * 600, "s"])]
    spark.createDataFrame(rows, "req_id long, options string, texts array<string>").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("req_id long, options string, texts array<string>").parquet(str(tmp_path / "in"))
    q = microbatch.flush_full(stream, 4).writeStream.format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {r["req_id"]: r for r in spark.table("answers").collect()}
    assert [got[i]["offset"] for i in (0, 1, 2)] == [0, 1, 3] and len({got[i]["batch"] for i in (0, 1, 2)}) == 1
    assert got[4]["error"] == "texts is null" and got[5]["bucket"] == 2 and got[3]["options"] == "sparse"


def test_requests_wait_across_triggers(spark, tmp_path):
    """The first trigger leaves three texts waiting, a later one fills the batch and leaves one."""
    import time

    from vectide.streaming import microbatch

    kind = "req_id long, options string, texts array<string>"

    def write(rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    write([(0, "dense", ["a"]), (1, "dense", ["b", "c"])])
    q = microbatch.flush_full(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), 4, window_ms=3_600_000)
    q = q.writeStream.format("memory").queryName("waiting").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(120):
            if any(p["numInputRows"] for p in q.recentProgress):
                break
            time.sleep(0.5)
        assert not spark.table("waiting").count()
        write([(2, "dense", ["d"]), (3, "dense", ["e"]), (4, "dense", None)])
        for _ in range(120):
            if spark.table("waiting").count():
                break
            time.sleep(0.5)
        got = {r["req_id"]: r for r in spark.table("waiting").collect()}
    finally:
        q.stop()
    assert [(got[j]["batch"], got[j]["offset"]) for j in (0, 1, 2)] == [(0, 0), (0, 1), (0, 3)] and 3 not in got and got[4]["error"]


def test_requests_leave_when_the_window_ends(spark, tmp_path):
    import time

    from vectide.streaming import microbatch

    kind = "req_id long, options string, texts array<string>"
    spark.createDataFrame([(0, "dense", ["a"])], kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = microbatch.flush_full(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), 4, window_ms=1_000)
    q = q.writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(80):
            if spark.table("late").count():
                break
            time.sleep(0.5)
        assert [(r["req_id"], r["batch"], r["offset"]) for r in spark.table("late").collect()] == [(0, 0, 0)]
    finally:
        q.stop()


def test_quantiles_with_an_outlier(spark):
    import numpy as np

    from vectide.operators import evaluate

    x = [*np.random.default_rng(3).exponential(1.0, 500).tolist(), *[2.5] * 200, 1e12, -1e9]
    df = spark.createDataFrame([("a", v) for v in x] + [("b", 7.0)], "k string, x double")
    got = {r["k"]: r for r in evaluate.quantiles(df, "k", "x", (0.01, 0.5, 0.95), inclusive=True).collect()}
    assert np.allclose([got["a"][str(p)] for p in (0.01, 0.5, 0.95)], np.quantile(x, [0.01, 0.5, 0.95]))
    assert got["b"]["0.5"] == 7.0 and got["b"]["n"] == 1


def test_held_out_texts_must_not_be_seen(spark):
    from vectide.operators import integrity

    seen = spark.createDataFrame([("a",), ("b",), (" ",), (None,)], "text string")
    integrity.require_disjoint(spark.createDataFrame([("c",), (" ",), (None,)], "text string"), seen)
    with pytest.raises(ValueError, match="1 "):
        integrity.require_disjoint(spark.createDataFrame([("c",), ("b",)], "text string"), seen)


def test_calibration_chunks(spark):
    lengths = [5] * 3000 + [9, 2, 9, 7, 2] + [5] * 40
    items = spark.createDataFrame(list(enumerate(lengths)), "idx long, n long").repartition(7)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    want = {i: (r // 8, r % 8) for r, i in enumerate(order)}
    assert {r["idx"]: (r["chunk"], r["place"]) for r in batching.calibration_chunks(items).collect()} == want
    assert batching.calibration_chunks(items.limit(0)).count() == 0
    with pytest.raises(ValueError):
        batching.calibration_chunks(items, 0)
