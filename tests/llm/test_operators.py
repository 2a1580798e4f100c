"""Each operator against a plain version on a small table of hard cases: nulls, empty and long texts, copies, ties."""

import collections
import gc
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from vectide.llm import byte_bpe, common, exact_dedup, fingerprints, licenses, near_dedup, packing, quality, substring_dedup, toxicity, url_filter
from vectide.llm import components as module_of_components
from vectide.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, Key string, component_id long"


def texts():
    r = random.Random(5)
    words = [f"w{i}é" if i % 7 == 0 else f"w{i}," for i in range(400)]
    out = [" ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 3, 30, 90]))) for _ in range(40)]
    base = [r.choice(words) for _ in range(120)]
    for i in range(12):  # near copies of one text
        w = list(base)
        w[(i * 9) % 120] = f"edit{i}"
        out.append(" ".join(w))
    passage = " ".join(r.choice(words) for _ in range(60))
    out += [f"{' '.join(r.choice(words) for _ in range(40))} {passage} {i}" for i in range(5)]
    out += [out[3], out[3], out[45], "same same same " * 30, "a b", "A B", " \n\t", "x" * 30_000, "Ünïcode 日本語 \U0001f600 idiot"]
    return out


def rows():
    own = [(i * 3 + 1, t, "en", "s", len(t), True, "k", 9) for i, t in enumerate(texts())]
    own += [(500, None, None, None, None, None, None, None), (501, None, "en", "s", 0, False, "k", 1), (502, "", "en", "s", 0, False, "k", 1)]
    own += [own[30], own[30]]  # the same row again
    return own


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain():
    return [(r[0], r[1] or "") for r in rows()]


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def same(a, b):
    assert a == sorted(b, key=repr)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups(docs, empty, keep):
    groups = collections.defaultdict(list)
    for i, t in plain():
        groups[t].append(i)
    best = max if keep == "largest" else min
    want = [(i, best(groups[t]), len(groups[t]), i == best(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in plain()]
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    same(got(exact_dedup.exact_groups(docs, keep=keep), *columns), want)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_groups_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (4, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    same(got(exact_dedup.exact_groups(df), "doc_id", "keep_id", "group_size", "kept"), [(None, 4, 2, False), (4, 4, 2, True), (None, None, 2, True), (None, None, 2, True)])


def test_distinct_texts_keeps_columns(docs, empty):
    out = exact_dedup.distinct_texts(docs)
    assert out.columns == docs.columns
    latest = {}
    for i, t in plain():
        latest[t] = max(i, latest.get(t, -1))
    same(got(out, "doc_id"), [(i,) for i, t in plain() if latest[t] == i])
    assert exact_dedup.distinct_texts(empty).count() == 0


def brute_components(size, percent):
    own = collections.defaultdict(list)
    for i, t in plain():
        own[frozenset(near_dedup.exact_set(t.encode(), size))].append(i)
    sets = [(min(m), s) for s, m in own.items() if s]
    label = {i: i for m in own.values() for i in m}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)

    for s, m in own.items():
        if s:
            for x in m:
                join(x, min(m))
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if 100 * len(x & y) >= percent * len(x | y):
            join(a, b)
    return {i: find(i) for i in label}, {i: len(s) for s, m in own.items() for i in m}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_groups(docs, empty, size, percent):
    label, n = brute_components(size, percent)
    assert len({label[i] for i, _ in plain()}) < len({t for _, t in plain()})
    same(got(near_dedup.near_groups(docs, size, percent), "doc_id", "n_shingles", "component_id", "kept"), [(i, n[i], label[i], i == label[i]) for i, _ in plain()])
    assert near_dedup.near_groups(empty).count() == 0


def test_near_groups_without_chance(docs):
    """The exact option against the sketches' way."""
    for size, percent in ((3, 85), (5, 80)):
        names = ("doc_id", "n_shingles", "component_id", "kept")
        same(got(near_dedup.near_groups(docs, size, percent, sure=True), *names), got(near_dedup.near_groups(docs, size, percent), *names))


def test_texts_of_one_digest_are_told_apart(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "aa"), (4, "cc"), (5, "d"), (6, "d"), (7, "eee")], "doc_id long, text string")
    weak = (lambda t: F.lit(b"x"), lambda t: F.char_length(t).cast("long"))
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    same(got(exact_dedup.exact_groups(df, digests=weak), *names), got(exact_dedup.exact_groups(df), *names))


def test_special_tokens_are_the_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, plain_ = packing.Words(path), Tokenizer.from_file(path)
    for t in ("<|endoftext|>", "a<|endoftext|>b", " <|startoftext|> don't \n<|endoftext|>", "<|endof text|>"):
        assert np.frombuffer(own.encode(t.encode()), "<u4").tolist() == plain_.encode(t, add_special_tokens=False).ids


def test_packing_stays_near_the_bound():
    for low, high, share in ((300, 1000, 1.03), (500, 1100, 1.09), (30, 700, 1.0)):
        r = random.Random(low)
        counts = collections.Counter(r.randint(low, high) for _ in range(400))
        found = packing.plan(counts)
        assert collections.Counter(x for lengths, n in found for x in lengths for _ in range(n)) == counts
        used = sum(n for _, n in found)
        assert used <= sum(n for _, n in packing.best_fit(counts, 2048)) and used <= share * packing.lower_bound(counts, 2048) + 1


def test_licenses_are_the_plain_ones_and_linear(spark):
    """Base places by a loop over words; every notice of a text with several; time in proportion to the text."""
    r = random.Random(4)
    words = "gnu general public license apache cc by mit the x".split()
    for _ in range(300):
        t = " ".join(r.choice(words) for _ in range(r.randint(0, 60))) + r.choice(["", "!", "É"])
        out = licenses.scan_text(t.encode(), licenses.PHRASES, tuple(licenses.NOTICES.items()))
        w = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (out["n_words"], out["n_base"]) == (len(w), len(places))
        assert (out["first_word"], out["last_word"]) == (min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))
        assert out["base_labels"] == ",".join(sorted({label for _, label in places}))
    notices = tuple(licenses.NOTICES.items())
    for gap in ("", "lorem ipsum dolor sit amet "):
        planted = [f"released under the mit {x} {gap}" for x in ("licence", "license", "licens", "license")]
        spans = licenses.scan_text("".join(planted).encode(), licenses.PHRASES, notices)["spans"]
        assert [s["first_word"] for s in spans] == [i * (5 + len(gap.split())) for i in range(4)] and all(s["label"] == "mit" for s in spans)
    took = []
    for n in (4_000, 16_000):
        began = time.process_time()
        assert len(licenses.scan_text(b"all rights reserved " * n, licenses.PHRASES, notices)["spans"]) == n
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5


def test_segments_are_linear():
    x = np.random.default_rng(1).normal(-0.3, 1, 800_000).astype(np.float32)
    took = []
    for n in (100_000, 800_000):
        began = time.process_time()
        toxicity.segments(x[:n])
        took.append(time.process_time() - began)
    assert took[1] < 16 * took[0] + 0.5


def test_quality_scores_are_the_plain_ones(spark):
    """FTRL-proximal and the dot product against dictionaries."""
    texts = [("good words stand here in order", 1), ("!!! ### 111 !!! ###", 0), ("more good words in order", 1), ("### !!! 222", 0), ("", 0)]
    examples = [(*quality.features(t.encode()), y) for t, y in texts]
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= quality.L1 else -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for places, values, y in examples:
            x = dict(zip(places.tolist(), values.tolist())) | {1 << quality.BITS: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += g * g
    weights = quality.fit(examples)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    out = {r["doc_id"]: r["score"] for r in quality.score(df, weights).collect()}
    for i, (places, values, _) in enumerate(examples):
        s = sum(weight(j) * v for j, v in zip(places.tolist(), values.tolist())) + weight(1 << quality.BITS)
        assert math.isclose(out[i], 1 / (1 + math.exp(-s)), abs_tol=1e-9)


def test_one_id_with_two_texts_is_learnt_alike(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int").withColumn("toxic", F.col("quality"))
    rows_ = [(i, f"{w} text number {i} of {w}") for i in range(30) for w in ("one", "other")]
    first = spark.createDataFrame(rows_, "doc_id long, text string").repartition(5, "text")
    second = spark.createDataFrame(rows_[::-1], "doc_id long, text string").repartition(3)
    assert np.array_equal(quality.learn(first, labels), quality.learn(second, labels))
    assert np.array_equal(toxicity.learn(first, labels)["scores"], toxicity.learn(second, labels)["scores"])


def test_windows_of_a_hot_run_are_dealt_out(spark):
    """Texts that share one short run with the smallest hash and differ elsewhere: its windows don't meet in one bucket, and a passage in two of them is still found."""
    r = random.Random(8)
    powers = substring_dedup.Powers()

    def least(words):
        h = substring_dedup.hashes_of(words)
        return int(substring_dedup.rolling(h, substring_dedup.RUN, 0, powers(len(h) + 1)).min())

    run = min(([f"r{i}x{j}" for j in range(8)] for i in range(3000)), key=least)
    rows_ = []
    for i in range(400):
        w = [f"u{i}y{j}" for j in range(80)]
        rows_.append((i, " ".join([*w[:40], *run, *w[40:]])))
    rows_ += [(400 + i, rows_[7][1]) for i in range(2)]
    df = spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)
    _, words, hot = substring_dedup.sketch(df, 35, 16)
    assert words == 402 * 88 and len(hot)
    out = {x["doc_id"]: x["n_removed"] for x in substring_dedup.removals(df).collect()}
    assert {i for i, n in out.items() if n} == {7, 400, 401}


def test_near_groups_of_mixed_lists(spark):
    """Copies near each other but not near their list's first: the second pass joins components, and nothing is lost."""
    r = random.Random(1)
    own = []
    for g in range(4):
        base = [f"g{r.randrange(4000)}" for _ in range(80)]
        for k in range(14):
            w = list(base)
            for _ in range(k % 7):
                w[r.randrange(80)] = f"e{r.randrange(10**6)}"
            own.append((len(own), " ".join(w)))
    sets = {i: near_dedup.exact_set(t.encode(), 3) for i, t in own}
    label = {i: i for i in sets}
    for _ in range(len(own)):
        for a, b in itertools.combinations(sets, 2):
            if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    out = near_dedup.near_groups(spark.createDataFrame(own, "doc_id long, text string"), 3, 85)
    same(got(out, "doc_id", "component_id"), list(label.items()))


def test_near_rows_without_id(spark):
    df = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (2, "A b c d"), (7, "")], "doc_id long, text string")
    same(got(near_dedup.near_groups(df, 3, 85), "doc_id", "component_id", "kept"), [(None, None, True), (3, 2, False), (2, 2, True), (7, 7, True)])


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 60), (60, 100), (7, 7)]
    same(got(components(spark.createDataFrame(edges, "a long, b long")), "node", "label"), [(i, 0) for i in range(31)] + [(50, 50), (60, 50), (100, 50)])


def test_components_of_several_partitions(spark, monkeypatch):
    """Long paths whose edges lie in many partitions, and pieces of them that are joined a few edges at a time."""
    r = random.Random(3)
    names = r.sample(range(10**6), 600)
    edges = [(names[i], names[i + 1]) for i in range(599) if i % 200 != 199]
    r.shuffle(edges)
    want = [(n, min(names[i // 200 * 200 : i // 200 * 200 + 200])) for i, n in enumerate(names)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    same(got(components(df), "node", "label"), want)
    monkeypatch.setattr(common, "ROWS_A_PART", 100)
    monkeypatch.setattr(module_of_components, "ROWS_A_PART", 100)
    same(got(components(df), "node", "label"), want)


def test_small_components_take_few_queries(spark):
    """Of a table of one partition's size: no rounds of joins, each of which the driver would plan and compile anew."""
    tracker = spark.sparkContext.statusTracker()
    df = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    spark.sparkContext.setJobGroup("few-queries", "components of a path")
    try:
        found = got(components(df), "node", "label")
        jobs = len(tracker.getJobIdsForGroup("few-queries"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    same(found, [(i, 0) for i in range(301)])
    assert 0 < jobs <= 15


def test_workers_drop_words_of_another_operator(spark, word_bpe):
    """What packing remembers stays for packing's own tasks; the next operator's tasks don't have it beside their own memory."""
    docs = spark.createDataFrame([(i, f"some words {i} of a text") for i in range(64)], "doc_id long, text string").repartition(8)
    kinds = "n long"

    def words_held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(type(x).__name__ == "Words" for x in gc.get_objects())], pa.int64())], ["n"])

    packing.pack(docs, word_bpe).collect()
    held = sum(r["n"] for r in docs.mapInArrow(words_held, kinds).collect())
    assert held > 0
    left = sum(r["n"] for r in common.map_arrow(docs, words_held, kinds).collect())
    assert left == 0


@pytest.mark.parametrize("size", [35, 3])
def test_removals(docs, empty, size):
    own = [(i, t.encode().split()) for i, t in plain()]
    count = collections.Counter(tuple(w[a : a + size]) for _, w in own for a in range(len(w) - size + 1))
    want = []
    for i, w in own:
        gone = {p for a in range(len(w) - size + 1) if count[tuple(w[a : a + size])] > 1 for p in range(a, a + size)}
        want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    assert any(n for _, _, n, _ in want)
    same(got(substring_dedup.removals(docs, size), "doc_id", "n_words", "n_removed", "kept_sha256"), want)
    assert substring_dedup.removals(empty).count() == 0


def test_cleaned_keeps_columns(docs, empty):
    out = substring_dedup.cleaned(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("text IS NULL").count() == 2
    assert out.where("n_chars != char_length(text)").count() == 0
    assert substring_dedup.cleaned(empty).count() == 0


@pytest.fixture(scope="module")
def word_bpe():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.mark.parametrize("capacity", [2048, 50])
def test_pack(docs, empty, word_bpe, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_bpe)
    want = []
    for i, text in plain():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    out = packing.pack(docs, word_bpe, capacity).persist()
    same(got(out, "doc_id", "piece", "start", "length", "ids_crc32"), want)
    bins = collections.defaultdict(list)
    for r in out.collect():
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= capacity
    assert packing.pack(empty, word_bpe).count() == 0


def test_plan_is_best_on_small_cases():
    def fewest(items, capacity):
        best = len(items)

        def go(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= capacity:
                    go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best

    r = random.Random(3)
    for _ in range(60):
        items = sorted((r.randrange(1, 21) for _ in range(r.randrange(1, 11))), reverse=True)
        found = packing.plan(collections.Counter(items), 20)
        used = collections.Counter(x for s, n in found for x in s * n)
        assert used == collections.Counter(items) and all(sum(s) <= 20 for s, _ in found)
        assert sum(n for _, n in found) == fewest(items, 20) >= packing.lower_bound(collections.Counter(items), 20)
    assert packing.plan({}) == []
    with pytest.raises(ValueError):
        packing.plan({21: 1}, 20)


def test_byte_bpe(docs, empty):
    import base64

    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in plain():
        ids = np.array(own.encode_ordinary(t), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    same(got(byte_bpe.round_trip(docs, path, public.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), want)
    coded = byte_bpe.encode_documents(docs, path, public.PATTERN)
    same([(i, bytes(x)) for i, x in got(byte_bpe.decode_ids(coded, path, public.PATTERN), "doc_id", "decoded")], [(i, t.encode()) for i, t in plain()])
    assert byte_bpe.round_trip(empty, path, public.PATTERN).count() == 0


def test_packing_of_all_lengths(monkeypatch):
    r = random.Random(0)
    counts = {x: r.randrange(1000, 20000) if 400 <= x <= 900 else r.randrange(1, 50) for x in range(1, 2049)}
    monkeypatch.setattr(packing, "NODES", 5)
    found = packing.plan(counts)
    used = collections.Counter()
    for lengths, n in found:
        assert sum(lengths) <= packing.CAPACITY
        for x in lengths:
            used[x] += n
    assert used == counts
    assert sum(n for _, n in found) < 0.98 * sum(n for _, n in packing.best_fit(counts, packing.CAPACITY))


def test_fillings_of_many_small_pieces():
    counts = {1: 3000, 7: 20}
    assert max(map(sum, packing.fillings(2000, counts, [1, 7]))) == 2000
    assert max(map(sum, packing.fillings(2000, {1: 3000}, [1]))) == 2000


def test_edits(docs, empty, spark):
    own = sorted(plain(), key=lambda r: -r[0])
    out = fingerprints.edits(docs)
    assert out.count() == len(own)
    single = [(i, t) for i, t in own if sum(j == i for j, _ in own) == 1]
    by = {r["doc_id"]: r for r in out.collect()}
    for k, (i, t) in enumerate(own):
        if (i, t) in single:
            edited = fingerprints.edited_text(t, own[(k + 1) % len(own)][1])
            assert (by[i]["n_chars"], by[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert by[i]["fingerprint"] == fingerprints.fingerprint(t.encode()).hex()
    assert fingerprints.edits(empty).count() == 0
    one = fingerprints.edits(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1
    assert fingerprints.edits(spark.createDataFrame([(None, "abc"), (2, "xyz")], "doc_id long, text string")).count() == 2


def test_edits_where_an_id_takes_several_ranges(spark):
    r = random.Random(6)
    shared = [(i, f"{r.getrandbits(60)} {k}") for i in (None, 7) for k in range(150)] + [(7, "again")] * 20
    own = [(i, f"text {i}") for i in range(100) if i != 7] + shared + [(2**62 + 3, "far"), (-(2**63), "least")]
    r.shuffle(own)
    found = fingerprints.edits(spark.createDataFrame(own, "doc_id long, text string").repartition(9)).collect()
    assert len(found) == len(own)
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0, x["n_chars"]) for x in found) == sorted((i is None, i or 0, len(t)) for i, t in own)
    # every row follows exactly one other: the edited texts are those of one round through all texts, ids descending
    digest = lambda a, b: hashlib.sha256(fingerprints.edited_text(a, b).encode()).hexdigest()
    signed = lambda t: (xxhash.xxh64(t.encode(), seed=42).intdigest() + 2**63) % 2**64 - 2**63
    order = sorted(own, key=lambda x: (-(2**63) if x[0] is None else x[0], signed(x[1])), reverse=True)
    want = sorted(digest(t, order[(k + 1) % len(order)][1]) for k, (_, t) in enumerate(order))
    assert sorted(x["edited_sha256"] for x in found) == want


def test_ranges_divide_an_id():
    own = fingerprints.Ranges([3, 7, 7, 7, 9])
    o, h = np.array([2, 3, 7, 7, 7, 8, 9, 10]), np.array([0, 0, -(2**63), 0, 2**63 - 1, -5, 5, 0])
    assert own.part(o, h).tolist() == [5, 4, 3, 2, 1, 1, 0, 0]


def test_fingerprints_within(spark):
    r = random.Random(2)
    base = [r.getrandbits(128) for _ in range(30)]
    own = base + [b ^ sum(1 << k for k in r.sample(range(128), d)) for b, d in zip(base, itertools.cycle(range(1, 7)))]
    marks = spark.createDataFrame([(f"{x:032x}",) for x in own] + [(None,)], "fingerprint string")
    want = [(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in base for b in own if 0 < (a ^ b).bit_count() <= 4]
    found = fingerprints.within(spark.createDataFrame([(f"{x:032x}",) for x in base], "fingerprint string"), marks, 4)
    same(got(found, "fingerprint", "other", "distance"), want)


def test_near_counts(spark):
    r = random.Random(3)
    base = [r.getrandbits(128) for _ in range(8)]
    own = base + base[:3] + [b ^ (1 << r.randrange(128)) for b in base for _ in range(3)] + [base[0] ^ 0b1111]
    df = spark.createDataFrame([(i, f"{x:032x}") for i, x in enumerate(own)], "doc_id long, fingerprint string")
    want = [(i, sum((x ^ y).bit_count() <= 3 for y in own) - 1 if i % 2 == 0 else None) for i, x in enumerate(own)]
    same(got(fingerprints.near_counts(df, F.col("doc_id") % 2 == 0, 3), "doc_id", "n_near"), want)


def test_fingerprints_within_the_query_radius(spark):
    r = random.Random(4)
    base = [r.getrandbits(128) for _ in range(20)]
    own = base + [b ^ sum(1 << k for k in r.sample(range(128), d)) for b in base for d in range(1, 19)]
    for radius in (0, 7, fingerprints.RADIUS, 17):
        want = [(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in base for b in own if 0 < (a ^ b).bit_count() <= radius]
        found = fingerprints.within(*[spark.createDataFrame([(f"{x:032x}",) for x in xs], "fingerprint string") for xs in (base, own)], radius)
        same(got(found, "fingerprint", "other", "distance"), want)


def test_edited_texts_are_near(spark, tmp_path):
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(800)]
    docs = []
    for i in range(4):
        words = r.choices(vocabulary, k=300)
        docs.append((100 * i, " ".join(words)))
        for k in range(6):
            edited = list(words)
            for at in r.sample(range(300), 1 + k % 3):
                edited[at] = r.choice(vocabulary)
            docs.append((100 * i + 1 + k, " ".join(edited)))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = got(fingerprints.op10_fingerprints(spark, str(tmp_path)).where("doc_id % 100 = 0"), "doc_id", "n_near")
    same(found, [(100 * i, 6) for i in range(4)])


def test_licenses(docs, empty, spark):
    assert licenses.scan(docs).count() == len(rows()) and licenses.scan(empty).count() == 0
    cases = [
        ("Licensed under the Apache Licence, Version 2.0.", 0, None, None, "", "apache"),
        ("x CC-BY y cc by the MIT\nLicense", 3, 1, 7, "cc-by,mit", "cc-by,mit"),
        ("GNU General Public License gnu general public licenses", 1, 0, 0, "gpl", "gpl"),
        (None, 0, None, None, "", ""), ("", 0, None, None, "", ""), ("summit license", 0, None, None, "", ""),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string")
    same(got(licenses.scan(df), "doc_id", "n_base", "first_word", "last_word", "base_labels", "labels"), [(i, *c[1:]) for i, c in enumerate(cases)])


def test_fuzzy_finds_every_edit():
    notice = "released under the mit license"
    r = random.Random(4)
    for _ in range(200):
        s = list(notice)
        for _ in range(r.randrange(len(notice) // licenses.EDIT_EVERY + 1)):
            k = r.randrange(len(s))
            s[k : k + 1] = r.choice([[], ["q"], [s[k], "q"]])
        found = licenses.fuzzy(f"some words {''.join(s)} and more", ((notice, "mit"),))
        assert [x[0] for x in found] == ["mit"]


def test_fuzzy_finds_adjacent_notices():
    edited, exact, other = "released under the mit licence", "released under the mit license", "released undr the mit license"
    for texts in ([edited, exact], [edited, other, exact], [edited, exact, other], [exact, exact, edited]):
        words, spans = "", []
        for t in texts:
            spans.append((len(words), len(words) + len(t)))
            words += f"{t} "
        found = licenses.fuzzy(words[:-1], ((exact, "mit"),))
        assert len(found) == len(texts) and all(abs(a - c) <= 1 and abs(b - d) <= 1 for (_, a, b, _), (c, d) in zip(found, spans))


def labelled(spark, n=400):
    r = random.Random(0)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(60)]
        bad, toxic = i % 3 == 0, i % 5 == 0
        if toxic:
            for k in r.sample(range(60), 4):
                w[k] = r.choice(["vile", "nasty", "awful"])
        docs.append((i, " ".join(x + "$$$" if bad else x for x in w)))
        labels.append((i, int(not bad), int(toxic)))
    labels += [(7, 0, 1), (None, 1, 1), (8, None, None), (10**6, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifiers(spark, docs, empty, kind):
    own, labels = labelled(spark)
    learn, score = (quality.learn, quality.score) if kind == "quality" else (toxicity.learn, toxicity.passages)
    model = learn(own, labels)
    truth = {r["doc_id"]: r[kind] for r in labels.collect() if r["doc_id"] not in (7, None)}
    out = [r for r in score(own, model).collect() if r["held_out"] and r["doc_id"] != 7]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in out]) > 0.97
    every = score(docs, model)
    assert every.count() == len(rows()) and every.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert score(empty, model).count() == 0
    assert score(own, learn(empty, labels)).where("score IS NULL").count() == 0


def test_accepted_keeps_columns(spark, docs, empty):
    model = quality.learn(*labelled(spark))
    out = quality.accepted(docs, model)
    assert out.columns == docs.columns
    same(got(out, "doc_id"), [(r["doc_id"],) for r in quality.score(docs, model).where("predicted = 1").collect()])


def test_segments_are_all_maximal():
    """Against the definition: every maximal segment is a best one of some stretch that no better one crosses."""
    def brute(s):
        if not len(s):
            return []
        best, at = 0.0, None
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                t = sum(s[i:j])
                if t > best + 1e-9:
                    best, at = t, (i, j)
        if at is None:
            return []
        i, j = at
        return brute(s[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute(s[j:])]

    r = random.Random(6)
    for _ in range(200):
        s = np.array([r.uniform(-3, 2.5) for _ in range(r.randrange(0, 14))])
        assert [(a, b) for _, a, b in toxicity.segments(s, 0.0)] == brute(list(s))


def test_url_filter(spark):
    urls = [
        "https://a.b.COM/en/1", "http://example.com/en/7?x", "http://notexample.com/en/7", "ftp://www.example.com/en/70/y#z", "http://example.net/de/8", "http://x.net/de/9",
        "http://org/es/", "http://org/esx", "no scheme", None, "", "x://h?p/q", "http://casino-win.example.org/x", "http://blog.thegarden.example.org/fr/1", "HTTP://U:80/ü ü?q",
    ]
    pages = spark.createDataFrame([(i, u, "", "h") for i, u in enumerate(urls)], "page_id long, url string, html string, HOST string")
    weights = url_filter.train(url_filter.seeds(spark))
    out = {r["page_id"]: r for r in url_filter.judge(pages, url_filter.RULES, weights).collect()}
    assert [out[i]["rule"] for i in range(8)] == ["com/en/", "example.com/en/7", "com/en/", "example.com/en/7", "example.net/de/8", "net/de/", "org/es/", None]
    assert [out[i]["verdict"] for i in range(7)] == ["block", "allow", "block", "allow", "block", "allow", "block"]
    assert [(out[i]["host"], out[i]["path"]) for i in (0, 8, 9, 10, 11, 14)] == [("a.b.com", "/en/1"), ("", ""), ("", ""), ("", ""), ("h", ""), ("u:80", "/ü ü")]
    assert (out[12]["verdict"], out[13]["verdict"]) == ("block", "allow")
    many = [*url_filter.RULES, *[(True, f"h{i}.test/p") for i in range(100)]]
    again = {r["page_id"]: r for r in url_filter.judge(pages, many, weights).collect()}
    assert again == out
    # of rules of one length the first of the list wins, however many there are
    tie = spark.createDataFrame([(1, "http://a.b.com/xy/1")], "page_id long, url string")
    for more in (0, 100):
        others = [(True, f"h{i}.test/p") for i in range(more)]
        for rules in ([(True, "b.com/xy"), (False, "a.b.com/")], [(False, "a.b.com/"), (True, "b.com/xy")]):
            assert url_filter.judge(tie, [*others, *rules], weights).first()["rule"] == rules[0][1]
    assert url_filter.judge(tie, [], weights).first()["rule"] is None
    assert url_filter.judge(pages.limit(0), url_filter.RULES, weights).count() == 0
    assert set(url_filter.train(url_filter.seeds(spark).limit(0)) or [0.0]) == {0.0}


def test_url_model_knows_words_it_learnt_in_other_urls(spark):
    """Every word is learnt from three of its urls and judged in the fourth."""
    for i in range(4):
        rows_ = [(u, y) for k, (y, u) in enumerate(url_filter.SEEDS)]
        learnt = [r for k, r in enumerate(rows_) if k % 4 != i]
        weights = url_filter.train(spark.createDataFrame(learnt, "url string, label int"))
        asked = spark.createDataFrame([(k, u, y) for k, (u, y) in enumerate(rows_) if k % 4 == i], "page_id long, url string, y int")
        out = {r["page_id"]: r["verdict"] == "block" for r in url_filter.judge(asked, [], weights).collect()}
        right = sum(out[r["page_id"]] == bool(r["y"]) for r in asked.collect())
        assert right >= 0.95 * len(out)


def test_url_verdicts_are_the_plain_ones(spark):
    """Every url of the smallest table against a loop in Python: host, path, the longest rule, and the model's sum."""
    weights = url_filter.train(url_filter.seeds(spark))
    rows_ = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url").collect()
    out = {r["page_id"]: r for r in url_filter.op5_url_filter(spark, "/root/testdata/sf0.001").collect()}
    assert len(out) == len(rows_)
    for r in rows_:
        url = r["url"] or ""
        rest = url.partition("://")[2] if "://" in url else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
        best = None
        for block, rule in url_filter.RULES:
            h, _, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
                best = (block, rule)
        f = [zlib.crc32(f"{tag}{n}{x[i:i + n]}".encode()) % (len(weights) - 1) for tag, t in (("h", host), ("p", path)) for x in [f"^{t}$"] for n in (3, 4) for i in range(max(len(x) - n + 1, 1))]
        z = sum(weights[i] for i in f) / len(f) ** 0.5 + weights[-1]
        got_ = out[r["page_id"]]
        assert (got_["host"], got_["path"], got_["rule"]) == (host, path, best and best[1])
        assert math.isclose(got_["probability"], 1 / (1 + math.exp(-z)), abs_tol=1e-9)
        assert got_["verdict"] == ("block" if (best[0] if best else got_["probability"] >= 0.5) else "allow")


def test_url_model_is_the_plain_one(spark):
    """The folded training against a loop in Python."""
    rows_ = [(u, y) for y, u in url_filter.SEEDS[:6] + url_filter.SEEDS[-6:]]
    size = (1 << url_filter.BITS) + 1

    def feats(url):
        host, path = url.split("://")[1].partition("/")[::2]
        out = []
        for tag, t in (("h", host), ("p", "/" + path)):
            for n in (3, 4):
                m = f"^{t}$"
                out += [zlib.crc32(f"{tag}{n}{m[i:i + n]}".encode()) & (size - 2) for i in range(max(len(m) - n + 1, 1))]
        return out

    examples = []
    for u, y in sorted(rows_, key=lambda r: hashlib.sha256(r[0].encode()).hexdigest()):
        x = np.bincount(feats(u), minlength=size) / np.sqrt(len(feats(u)))
        x[-1] = 1
        examples.append((x, y))
    w = np.zeros(size)
    for _ in range(url_filter.EPOCHS):
        for x, y in examples:
            w = w * (1 - url_filter.DECAY) + (y - 1 / (1 + np.exp(-(w @ x)))) * x * url_filter.RATE
    assert np.allclose(w, url_filter.train(url_filter.rows_of(spark, rows_, "url", "label")), atol=1e-9)
