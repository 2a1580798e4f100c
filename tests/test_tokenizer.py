"""Model files and the unigram tokenizer on small made-up vocabularies."""

import itertools
import math
import pickle
import random
import struct
import zipfile

import numpy as np
import pytest

from vectide.operators import tokenizer as T
from vectide.sources import model_files as M


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def model(pieces, kind=1, charmap=b""):
    return b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, t)) for p, s, t in pieces) + field(2, field(3, kind)) + field(3, field(2, charmap))


PIECES = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("▁a", -2.5, 1), ("ab", -4.0, 1), ("▁ab", -4.25, 1), ("ba", -5.0, 1)]


def test_wire():
    assert M.wire_fields(field(1, 300) + field(1, 2) + field(3, b"x") + field(4, 1.5)) == {1: [300, 2], 3: [b"x"], 4: [struct.pack("<f", 1.5)]}
    for bad in (b"\x0b", b"\x08" + b"\xff" * 11, b"\x0a\x05ab", b"\x08\x80"):
        with pytest.raises(ValueError):
            M.wire_fields(bad)
    fields = M.wire_fields(field(2, 0.5) + field(3, 7))
    assert M.first(fields, 2, float) == 0.5 and M.first(fields, 9, int, 4) == 4
    with pytest.raises(TypeError):
        M.first(fields, 3, bytes)


def test_vocabulary():
    v = M.Vocabulary.from_bytes(model(PIECES))
    assert v.pieces[3] == "▁" and v.unknown == 0 and v.types[:3] == [2, 3, 3]
    with pytest.raises(ValueError):
        M.Vocabulary.from_bytes(model(PIECES, kind=2))
    with pytest.raises(ValueError):
        M.Vocabulary.from_bytes(model(PIECES[1:]))


def test_cached_vocabulary(spark, tmp_path):
    path = tmp_path / "m.model"
    path.write_bytes(model(PIECES))
    folder = str(tmp_path / "cache")
    first = M.cached_vocabulary(spark, str(path), folder)
    assert first.count() == len(PIECES) and M.cached_vocabulary(spark, str(path), folder).count() == len(PIECES)
    path.write_bytes(model(PIECES[:8]))
    assert M.cached_vocabulary(spark, str(path), folder).count() == 8


def enumerate_best(t, word):
    best = -math.inf
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        parts = [word[a:b] for a, b in zip(edges, edges[1:])]
        if all(p in t.score or len(p) == 1 for p in parts):
            best = max(best, sum(t.score.get(p, t.unknown_score) for p in parts))
    return best


def test_segmentation_is_best():
    t = T.Unigram(M.Vocabulary.from_bytes(model(PIECES)))
    r = random.Random(1)
    for _ in range(300):
        word = "▁" + "".join(r.choice("abz") for _ in range(r.randrange(1, 9)))
        pieces = t.segment(word)
        z = word.count("z")
        assert sum(t.score[p] for p in pieces if p) + z * t.unknown_score == pytest.approx(enumerate_best(t, word))
        assert not any(a is None and b is None for a, b in zip(pieces, pieces[1:]))


def test_against_the_library():
    spm = pytest.importorskip("sentencepiece")
    own = spm.SentencePieceProcessor(model_proto=model(PIECES))
    t = T.Unigram(M.Vocabulary.from_bytes(model(PIECES)))
    r = random.Random(2)
    for _ in range(200):
        word = "".join(r.choice("ab") for _ in range(r.randrange(1, 12)))
        mine = [t.token(i) for i in t.body(word)]
        assert sum(t.score[p] for p in mine) == pytest.approx(sum(t.score[p] for p in own.encode(word, out_type=str)))


def test_encode():
    t = T.Unigram(M.Vocabulary.from_bytes(model(PIECES)))
    assert t.encode("") == t.encode("   ") == [0, 2]
    assert t.body("<s></s><pad><unk>") == [0, 2, 1, 3]
    assert t.body("a  <mask>") == [*t.body("a"), t.mask]
    assert [t.token(i) for i in t.body("\U00013000\U00013001")] == ["▁", "<unk>"]
    assert len(t.encode("ab " * 50, 16)) == 16 and t.encode("ab", 2) == [0, 2]
    with pytest.raises(ValueError):
        t.encode("a", 1)
    with pytest.raises(IndexError):
        t.token(-1)
    assert t.decode(["▁a", "b", "▁c"]) == "ab c"


def trie(keys):
    """A double array of a map from bytes to numbers, for tests: nodes one after the other, each with 256 places."""
    nodes, children = [b""], {b"": {}}
    for k in keys:
        for i in range(len(k)):
            children.setdefault(k[:i], {})[k[i]] = k[: i + 1]
            if k[: i + 1] not in children:
                children[k[: i + 1]] = {}
                nodes.append(k[: i + 1])
    base = {n: (i + 1) * 256 for i, n in enumerate(nodes)}
    units = [0] * ((len(nodes) + 1) * 256)

    def unit(n, at, label):
        return ((base[n] ^ at) >> 8 << 10 | 512) | (256 if n in keys else 0) | label if (base[n] ^ at) % 256 == 0 else None

    place = {b"": 0}
    base[b""] = 256
    units[0] = unit(b"", 0, 0)
    for n in nodes:
        for b, c in children[n].items():
            at = base[n] ^ b
            place[c] = at
            base[c] = base[c] ^ (at & 255)
            units[at] = unit(c, at, b)
        if n in keys:
            units[base[n]] = keys[n] | 1 << 31
    return b"".join(struct.pack("<I", u) for u in units)


def charmap(pairs):
    texts, keys = b"", {}
    for k, v in pairs.items():
        keys[k.encode()] = len(texts)
        texts += v.encode() + b"\0"
    t = trie(keys)
    return struct.pack("<I", len(t)) + t + texts


def test_charmap():
    pairs = {"Ａ": "A", "ﾊ": "ハ", "é": "é", "ab": "x"}
    m = M.CharMap(charmap(pairs))
    assert [m.lookup(x) for x in ("Ａ", "ﾊ", "q", "a", "ab", "abz", "é")] == ["A", "ハ", None, None, "x", "x", "é"]
    assert M.CharMap().lookup("a") is None
    t = T.Unigram(M.Vocabulary.from_bytes(model(PIECES, charmap=charmap(pairs))))
    # a cluster of fewer than six bytes is mapped as a whole by its shortest key, a longer one by character
    assert t.normalize("Ａ́") == "A" and t.normalize("éx") == "éx"
    assert t.normalize("Ａ́̂") == "Á̂"


def test_graphemes():
    assert len(T.graphemes("\U0001f468‍\U0001f469‍\U0001f467\U0001f1e9\U0001f1ea")) == 2
    assert T.graphemes("éx") == ["é", "x"] and len(T.graphemes("क्षि")) == 1 and T.graphemes("\r\n") == ["\r\n"]


def test_token_ids(spark):
    v = M.Vocabulary.from_bytes(model(PIECES))
    df = spark.createDataFrame([(1, "ab a"), (2, None), (3, "")], "k long, t string")
    got = {r["k"]: r["ids"] for r in T.token_ids(df, "k", "t", v).collect()}
    assert got == {1: T.Unigram(v).encode("ab a"), 2: [0, 2], 3: [0, 2]}
    derived = T.derived_vocabulary(spark.createDataFrame([("ab ab abz",)] * 30, "t string"), "t")
    assert "▁ab" in derived.pieces and "z" in derived.pieces and derived.types.count(2) == 1


class _Storage:
    def __init__(self, kind, key):
        self.pid = ("storage", kind, key, "cpu", 0)


def archive(path, bad=False):
    class Pickler(pickle.Pickler):
        def persistent_id(self, x):
            return x.pid if isinstance(x, _Storage) else None

        def reducer_override(self, x):
            return x() if isinstance(x, type(lambda: 0)) and x.__name__ == "tensor" else NotImplemented

    data = np.arange(12, dtype="<f4")
    with zipfile.ZipFile(path, "w") as z:
        # a protocol-2 pickle written by hand: {"w": _rebuild_tensor_v2(storage, 2, (2, 3), (3, 1))}
        name = b"cos\nsystem\n" if bad else b"ctorch._utils\n_rebuild_tensor_v2\n"
        body = b"\x80\x02}X\x01\x00\x00\x00w" + name + b"((X\x07\x00\x00\x00storagectorch\nFloatStorage\nX\x01\x00\x00\x000X\x03\x00\x00\x00cpuK\x0ctQK\x02K\x02K\x03\x86K\x03K\x01\x86tRs."
        z.writestr("m/data.pkl", body)
        z.writestr("m/data/0", data.tobytes())


def test_tensors(tmp_path):
    archive(tmp_path / "a.pt")
    assert np.array_equal(M.tensors((tmp_path / "a.pt").read_bytes())["w"], np.arange(2, 8, dtype="f4").reshape(2, 3))
    archive(tmp_path / "b.pt", bad=True)
    with pytest.raises(pickle.UnpicklingError):
        M.tensors((tmp_path / "b.pt").read_bytes())


def test_manifest_and_layout(spark, tmp_path):
    import hashlib

    (tmp_path / "x").write_bytes(b"hello")
    (tmp_path / "y").write_bytes(b"olleh")
    sha = hashlib.sha256(b"hello").hexdigest()
    manifest = spark.createDataFrame([("x", 5, sha), ("y", 5, sha), ("z", 5, sha), ("x", 6, sha)], "name string, size long, sha256 string")
    assert sorted((r["name"], r["status"]) for r in M.verify_manifest(spark, manifest, str(tmp_path)).collect()) == [("x", "ok"), ("x", "size"), ("y", "digest"), ("z", "missing")]
    parts = spark.createDataFrame([("b", bytearray(1100)), ("a", bytearray(b"1" * 2000)), ("c", bytearray(1100)), ("d", bytearray(1024))], "name string, content binary")
    assert {r["name"]: r["offset"] for r in M.tensor_layout(parts).collect()} == {"a": 0, "b": 2048, "c": 2048, "d": None}


def test_lines_and_results(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\n\n 　\nbé\r\n", encoding="utf-8")
    lines = M.text_lines(spark, str(tmp_path / "t.txt"))
    assert sorted(r["text"] for r in lines.collect()) == ["a", "bé"]
    M.write_results(lines, str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"text":"a"}', '{"text":"bé"}']


def test_benchmark_log(spark):
    log = """noise
##### tuned
== /m/a.onnx (1000 MiB) low-memory session 0.3s rss 700 MiB
dense cos: min 0.99 mean 0.995
[held-out] dense cos: min 0.1 mean 0.2
sparse: top-5 identical 10/11
128tok x16   1500 tok/s  2.3 cpu-s/ktok
== /m/b.onnx (20 MiB)
short query  11 ms wall  29 ms cpu
idle cpu 3 ms/s peak rss 10 MiB""".split("\n")
    got = M.benchmark_log(spark.createDataFrame(list(enumerate(log)), "line long, value string")).orderBy("model").collect()
    assert [(r["name"], r["mib"], r["tokens_per_second"], r["dense_min"], r["top5"], r["cpu_ms"], r["idle_ms"]) for r in got] == [("tuned low-memory", 1000, 1500, 0.99, "10/11", None, None), ("b.onnx", 20, None, None, None, 29.0, 3)]


def test_grapheme_counts(spark):
    cases = {1: "abc", 2: "a\r\nb", 3: "क्षि", 4: "🇫🇷🇩🇪", 5: "éx", 6: "", 7: None, 8: "tab\tand\nline\x7f"}
    found = T.grapheme_counts(spark.createDataFrame(list(cases.items()), "doc_id long, text string"), "doc_id", "text").collect()
    want = {1: (3, 3), 2: (3, 4), 3: (1, 4), 4: (2, 4), 5: (2, 3), 6: (0, 0), 7: (0, 0), 8: (13, 13)}
    assert {r["doc_id"]: (r["n_clusters"], r["n_chars"]) for r in found} == want


def test_token_names_join(spark):
    v = M.Vocabulary(["<unk>", "<s>", "</s>", "▁", "a"], [0.0, 0.0, 0.0, -1.0, -2.0], [2, 3, 3, 1, 1], 0)
    ids = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 4, 5, 6, 7, -1)], "id int")
    found = {r["id"]: r["token"] for r in T.token_names(ids, v).collect()}
    assert found == {0: "<s>", 1: "<pad>", 2: "</s>", 3: "<unk>", 4: "▁", 5: "a", 6: "<mask>", 7: None, -1: None}
    own = T.Unigram(v)
    assert all(own.token(i) == t for i, t in found.items() if t is not None)
