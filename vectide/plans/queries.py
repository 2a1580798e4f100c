"""The registered queries: each a function of (spark, sf_dir), with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import batching, encoding, evaluate, integrity, lexical, retrieval

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v"), "label")


#: Vectors as SQL has them, and the query set that searches take: ids divisible by 100.
VECS = "vecs AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
SPACES = X.WHITE_SPACE
WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '[{SPACES}]+'), lambda w: w <> '')"
TID = "(('0x' || substr(md5(w), 1, 6))::INT % 250000 + 4)"
TOKENS = f"""
lists AS (SELECT doc_id AS id, {WORDS} AS ws FROM documents),
words AS (SELECT id, unnest(ws) AS w, unnest(range(0, len(ws))) AS pos FROM lists),
tokens AS (SELECT id, {TID}::INT AS tid, (({TID} * 31 + pos * 17) % 1000 - 250) / 1000.0::DOUBLE AS w FROM words),
pooled AS (SELECT id, tid, max(w)::DOUBLE AS w FROM tokens WHERE w > 0 GROUP BY id, tid)"""


def token_rows(df: DataFrame, id_: str, text: str = "text") -> DataFrame:
    """(id, tid, w): every word of every whole text with a stand-in id and a stand-in weight of word and position."""
    words = df.select(F.col(id_).alias("id"), F.posexplode(X.words(F.col(text))).alias("pos", "word"))
    own = words.select("id", "pos", X.hashed_id(F.col("word")).alias("tid"))
    return own.select("id", "tid", (((F.col("tid").cast("long") * 31 + F.col("pos") * 17) % 1000 - 250) / 1000.0).alias("w"))


def pooled(spark: SparkSession, d: str) -> DataFrame:
    return lexical.max_pool(token_rows(table(spark, d, "documents"), "doc_id"), "id")


def neighbours(df: DataFrame, id_: str, *columns: str) -> DataFrame:
    """Rows of id i beside those of i + 1, columns ending in _a and _b."""
    a = df.select(F.col(id_).alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    b = df.select((F.col(id_) - 1).alias("a"), F.col(id_).alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return a.join(b, "a")


# --- dense --------------------------------------------------------------------------------------------------------


@query(f"""WITH {VECS}, n AS (SELECT vec_id, v, greatest(sqrt(list_inner_product(v, v)), 1e-12) AS n FROM vecs)
SELECT vec_id, (unnest(range(0, len(v))))::INT AS pos, round(unnest(list_transform(v, lambda x: x / n)), 9) AS x FROM n""")
def dense_normalize(spark, d):
    own = vectors(spark, d).select("vec_id", F.posexplode(V.l2_normalize(F.col("v"))).alias("pos", "x"))
    return own.select("vec_id", "pos", F.round("x", 9).alias("x"))


@query(f"""WITH {VECS} SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.v, b.v), 6) AS cosine
FROM vecs a JOIN vecs b ON b.vec_id = a.vec_id + 1""")
def dense_cosine_pairs(spark, d):
    return neighbours(vectors(spark, d), "vec_id", "v").select("a", "b", F.round(V.dot(F.col("v_a"), F.col("v_b")), 6).alias("cosine"))


@query(f"""WITH {VECS}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS row_id, list_inner_product(a.v, b.v) AS s FROM vecs a, vecs b WHERE a.vec_id % 100 = 0)
SELECT query_id, row_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, row_id)::INT AS rank FROM s) WHERE rank <= 10""")
def dense_topk(spark, d):
    rows = vectors(spark, d).select(F.col("vec_id").alias("id"), F.col("v").alias("vector"))
    return retrieval.top_k(rows.where("id % 100 = 0"), rows, 10).withColumn("score", F.round("score", 6))


@query(f"""WITH {VECS}, e AS (SELECT label, unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM vecs),
m AS (SELECT label, pos, round(avg(x), 9) AS x FROM e GROUP BY label, pos), c AS (SELECT label, list(x ORDER BY pos) AS c FROM m GROUP BY label),
s AS (SELECT c.label::BIGINT AS query_id, vec_id AS row_id, list_inner_product(v, c) AS s FROM vecs, c)
SELECT query_id, row_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, row_id)::INT AS rank FROM s) WHERE rank <= 10""")
def dense_label_centroid_topk(spark, d):
    rows = vectors(spark, d)
    means = rows.select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.round(F.avg("x"), 9).alias("x"))
    centroids = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x")))["x"].alias("vector")).select(F.col("label").alias("id"), "vector")
    return retrieval.top_k(centroids, rows.select(F.col("vec_id").alias("id"), F.col("v").alias("vector")), 10).withColumn("score", F.round("score", 6))


# --- quantised ----------------------------------------------------------------------------------------------------

SYM = f"""{VECS}, s AS (SELECT vec_id, v, label, greatest(list_max(list_transform(v, lambda x: abs(x))) / 127, 1e-12) AS s FROM vecs),
q AS (SELECT vec_id, v, label, s, list_transform(v, lambda x: greatest(least(round_even(x / s, 0), 127), -127)::INT) AS q FROM s)"""


def symmetric(spark, d):
    scaled = vectors(spark, d).withColumn("s", V.symmetric_scale(F.col("v")))
    return scaled.withColumn("q", V.symmetric_codes(F.col("v"), F.col("s")))


@query(f"WITH {SYM} SELECT vec_id, round(s, 12) AS scale, unnest(range(0, len(q)))::INT AS pos, unnest(q) AS code FROM q")
def int8_symmetric_rows(spark, d):
    return symmetric(spark, d).select("vec_id", F.round("s", 12).alias("scale"), F.posexplode("q").alias("pos", "code"))


@query(f"""WITH {VECS}, r AS (SELECT vec_id, v, least(list_min(v), 0.0) AS lo, greatest(list_max(v), 0.0) AS hi FROM vecs),
s AS (SELECT vec_id, v, lo, greatest((hi - lo) / 255, 1e-10) AS s FROM r), z AS (SELECT vec_id, v, s, round_even(-lo / s, 0)::INT AS z FROM s),
q AS (SELECT vec_id, s, z, list_transform(v, lambda x: greatest(least(round_even(x / s, 0) + z, 255), 0)::INT) AS q FROM z)
SELECT vec_id, round(s, 12) AS scale, z AS zero_point, unnest(range(0, len(q)))::INT AS pos, unnest(q) AS code FROM q""")
def uint8_asymmetric_rows(spark, d):
    own = vectors(spark, d).withColumn("s", V.asymmetric_scale(F.col("v")))
    own = own.withColumn("z", V.zero_point(F.col("v"), F.col("s")))
    return own.select("vec_id", F.round("s", 12).alias("scale"), F.col("z").alias("zero_point"), F.posexplode(V.asymmetric_codes(F.col("v"), F.col("s"), F.col("z"))).alias("pos", "code"))


@query(f"""WITH {VECS}, s AS (SELECT vec_id, v, greatest(list_max(list_transform(v, lambda x: abs(x))) / 127, 1e-10) AS s FROM vecs)
SELECT vec_id, round(s, 12) AS scale, unnest(range(0, len(v)))::INT AS pos, unnest(list_transform(v, lambda x: greatest(least(round_even(x / s, 0) + 128, 255), 0)::INT)) AS code FROM s""")
def uint8_symmetric_rows(spark, d):
    own = vectors(spark, d).withColumn("s", V.row_symmetric_scale(F.col("v")))
    return own.select("vec_id", F.round("s", 12).alias("scale"), F.posexplode(V.asymmetric_codes(F.col("v"), F.col("s"), F.lit(128))).alias("pos", "code"))


LOSS = f"{SYM}, y AS (SELECT vec_id, label, v, list_transform(q, lambda x: x * s) AS y FROM q), c AS (SELECT vec_id, label, list_inner_product(v, y) / (greatest(sqrt(list_inner_product(v, v)), 1e-12) * greatest(sqrt(list_inner_product(y, y)), 1e-12)) AS c FROM y)"


def losses(spark, d):
    own = symmetric(spark, d).withColumn("y", V.dequantized(F.col("q"), F.col("s")))
    return own.select("vec_id", "label", (V.dot(F.col("v"), F.col("y")) / (F.greatest(V.norm(F.col("v")), F.lit(V.NORM_EPS)) * F.greatest(V.norm(F.col("y")), F.lit(V.NORM_EPS)))).alias("c"))


@query(f"WITH {LOSS} SELECT vec_id, round(c, 9) AS cosine FROM c")
def int8_cosine_loss(spark, d):
    return losses(spark, d).select("vec_id", F.round("c", 9).alias("cosine"))


@query(f"""WITH {LOSS} SELECT label, count(*) AS n, round(quantile_cont(c, 0.01), 9) AS p1, round(quantile_cont(c, 0.05), 9) AS p5, round(min(c), 9) AS least, round(avg(c), 9) AS mean FROM c GROUP BY label""")
def token_cos_percentiles(spark, d):
    own = losses(spark, d)
    low = evaluate.quantiles(own, "label", "c", (0.01, 0.05), inclusive=True).select("label", F.round("`0.01`", 9).alias("p1"), F.round("`0.05`", 9).alias("p5"))
    ends = own.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("c"), 9).alias("least"), F.round(F.avg("c"), 9).alias("mean"))
    return ends.join(low, "label")


@query(f"WITH {VECS}, e AS (SELECT unnest(range(0, len(v)))::INT AS pos, unnest(v) AS x FROM vecs) SELECT pos, max(abs(x)) AS amax, round(sum(x), 6) AS total, count(*) AS n FROM e GROUP BY pos")
def channel_absmax(spark, d):
    return vectors(spark, d).select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.max(F.abs("x")).alias("amax"), F.round(F.sum("x"), 6).alias("total"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {VECS}, e AS (SELECT label, unnest(range(0, len(v)))::INT AS pos, unnest(v) AS x FROM vecs), m AS (SELECT label, pos, avg(x) AS w, max(abs(x)) AS x FROM e GROUP BY label, pos),
c AS (SELECT pos, max(x) AS x, max(abs(w)) AS w FROM m GROUP BY pos)
SELECT pos, round(least(greatest(pow(greatest(x, 1e-5), 0.5) / pow(greatest(w, 1e-5), 0.5), 1e-2), 1e2), 6) AS scale FROM c""")
def smooth_scales(spark, d):
    e = vectors(spark, d).select("label", F.posexplode("v").alias("pos", "x"))
    m = e.groupBy("label", "pos").agg(F.avg("x").alias("w"), F.max(F.abs("x")).alias("x"))
    c = m.groupBy("pos").agg(F.max("x").alias("x"), F.max(F.abs("w")).alias("w"))
    return c.select("pos", F.round(V.smoothing_scale(F.col("x"), F.col("w")), 6).alias("scale"))


@query(f"WITH {SYM} SELECT a.vec_id AS a, b.vec_id AS b, round(a.s * b.s * list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[]), 6) AS product FROM q a JOIN q b ON b.vec_id = a.vec_id + 1")
def dequantized_products(spark, d):
    own = neighbours(symmetric(spark, d), "vec_id", "s", "q")
    return own.select("a", "b", F.round(F.col("s_a") * F.col("s_b") * V.dot(F.col("q_a"), F.col("q_b")), 6).alias("product"))


@query(f"""WITH {SYM}, r AS (SELECT vec_id, v, least(list_min(v), 0.0) AS lo, greatest(list_max(v), 0.0) AS hi FROM vecs),
t AS (SELECT vec_id, v, lo, greatest((hi - lo) / 255, 1e-10) AS s FROM r), z AS (SELECT vec_id, v, s, round_even(-lo / s, 0)::INT AS z FROM t),
u AS (SELECT vec_id, s, z, list_transform(v, lambda x: greatest(least(round_even(x / s, 0) + z, 255), 0)::INT) AS u FROM z)
SELECT u.vec_id AS a, q.vec_id AS b, z AS zero_point, list_sum(q.q)::BIGINT AS column_sum, list_inner_product(u.u::DOUBLE[], q.q::DOUBLE[])::BIGINT AS codes_product,
round(u.s * q.s * (list_inner_product(u.u::DOUBLE[], q.q::DOUBLE[]) - z * list_sum(q.q)), 6) AS product FROM u JOIN q ON q.vec_id = u.vec_id + 1""")
def zero_point_products(spark, d):
    """Activations in uint8 with a zero point times a column of weights in int8: the integer product less the zero point times the column's sum, scaled."""
    left = vectors(spark, d).withColumn("s", V.asymmetric_scale(F.col("v")))
    left = left.withColumn("z", V.zero_point(F.col("v"), F.col("s"))).select(F.col("vec_id").alias("a"), "s", "z", V.asymmetric_codes(F.col("v"), F.col("s"), F.col("z")).alias("u"))
    right = symmetric(spark, d).select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("s").alias("t"), "q")
    both = left.join(right, "a").withColumn("column_sum", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)).withColumn("codes_product", V.dot(F.col("u"), F.col("q")).cast("long"))
    return both.select("a", "b", F.col("z").cast("int").alias("zero_point"), "column_sum", "codes_product", F.round(V.zero_point_product(F.col("codes_product"), F.col("column_sum"), F.col("s"), F.col("t"), F.col("z")), 6).alias("product"))


@query(f"""WITH {SYM}, o AS (SELECT v AS v0 FROM vecs WHERE vec_id = 0), y AS (SELECT vec_id, v, list_transform(q, lambda x: x * s) AS y FROM q), o2 AS (SELECT y AS y0 FROM y WHERE vec_id = 0),
both_scores AS (SELECT vec_id, round(list_inner_product(v, v0), 9) AS s1, round(list_inner_product(y, y0), 9) AS s2 FROM y, o, o2 WHERE vec_id <> 0),
r AS (SELECT *, row_number() OVER (ORDER BY s1 DESC, vec_id) AS r1, row_number() OVER (ORDER BY s2 DESC, vec_id) AS r2 FROM both_scores)
SELECT vec_id, r1, r2 FROM r WHERE r1 <= 20 OR r2 <= 20""")
def ranking_agreement(spark, d):
    """The report on query 0 against all other vectors: where each stands by its floats and by its int8 codes, for those among the first twenty of either."""
    own = symmetric(spark, d).withColumn("y", V.dequantized(F.col("q"), F.col("s"))).select("vec_id", "v", "y")
    first = own.where("vec_id = 0").select(F.col("v").alias("v0"), F.col("y").alias("y0"))  # one row
    both = own.where("vec_id != 0").join(F.broadcast(first)).select("vec_id", F.round(V.dot(F.col("v"), F.col("v0")), 9).alias("s1"), F.round(V.dot(F.col("y"), F.col("y0")), 9).alias("s2"))
    return evaluate.places(both, "vec_id", ("s1", "s2"), 20).toDF("vec_id", "r1", "r2")


@query(f"WITH {SYM} SELECT l.doc_id, round(list_sum(list_transform(q, lambda x: x * s)), 6) AS total FROM labels l JOIN q ON q.vec_id = l.doc_id")
def embedding_gather(spark, d):
    rows = table(spark, d, "labels").select("doc_id").join(symmetric(spark, d).withColumnRenamed("vec_id", "doc_id"), "doc_id")
    return rows.select("doc_id", F.round(F.aggregate(V.dequantized(F.col("q"), F.col("s")), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


# --- texts --------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, len({WORDS})::INT AS n_words, len(list_distinct({WORDS}))::INT AS n_distinct, list_aggregate(list_transform({WORDS}, lambda w: length(w)), 'max')::INT AS longest FROM documents")
def word_split(spark, d):
    w = X.words(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"), F.array_max(F.transform(w, lambda x: F.char_length(x))).alias("longest"))


@query(f"WITH t AS (SELECT unnest({WORDS}) AS w FROM documents) SELECT CASE WHEN w LIKE '▁%' THEN w ELSE '▁' || w END AS piece, count(*) AS n FROM t GROUP BY ALL")
def metaspace_words(spark, d):
    words = table(spark, d, "documents").select(F.explode(X.words(F.col("text"))).alias("w"))
    return words.groupBy(X.metaspace(F.col("w")).alias("piece")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT page_id, len(regexp_extract_all(coalesce(html, ''), '<s>|<pad>|</s>|<unk>|[{SPACES}]*<mask>'))::INT AS n_specials, length(html) AS n_chars FROM pages")
def special_split(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(X.special_literals(F.col("html"))).alias("n_specials"), F.char_length("html").cast("long").alias("n_chars"))


@query("SELECT doc_id, regexp_full_match(coalesce(text, ''), '[ -~]*') AS plain FROM documents")
def ascii_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", X.is_plain_ascii(F.col("text")).alias("plain"))


BUCKET = "(({n} > 128)::INT + ({n} > 512)::INT + ({n} > 2048)::INT)"


@query(f"SELECT {BUCKET.format(n='length(text)')} AS bucket, count(*) AS n, sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY ALL")
def length_buckets(spark, d):
    own = table(spark, d, "documents").select(X.length_bucket(F.char_length("text")).alias("bucket"), F.char_length("text").alias("c"), F.octet_length("text").alias("o"))
    return own.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("chars"), F.sum("o").alias("bytes"))


IDS = f"ids AS (SELECT doc_id, list_transform({WORDS}, lambda w: {TID}::INT) AS ids FROM documents), framed AS (SELECT doc_id, list_concat([0], list_concat(ids[1:8190], [2])) AS ids FROM ids)"


def framed_ids(spark, d, max_length=X.MAX_LENGTH):
    return table(spark, d, "documents").select("doc_id", X.framed(F.transform(X.words(F.col("text")), X.hashed_id), max_length).alias("ids"))


@query(f"WITH {IDS.replace('8190', '510')} SELECT doc_id, len(ids)::INT AS n, ids[1]::INT AS first, ids[len(ids)]::INT AS last, list_sum(ids)::BIGINT AS total FROM framed")
def truncate_ids(spark, d):
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return framed_ids(spark, d, X.QUERY_MAX_LENGTH).select("doc_id", F.size("ids").alias("n"), F.element_at("ids", 1).alias("first"), F.element_at("ids", -1).alias("last"), total.alias("total"))


@query(f"WITH t AS (SELECT doc_id, {WORDS} AS ws FROM documents) SELECT doc_id, length(list_aggregate(ws, 'string_agg', ' '))::INT AS n_chars, md5(list_aggregate(ws, 'string_agg', ' ')) AS digest FROM t")
def decode_tokens(spark, d):
    back = X.detokenized(F.transform(X.words(F.col("text")), X.metaspace))
    return table(spark, d, "documents").select("doc_id", F.nullif(F.char_length(back), F.lit(0)).alias("n_chars"), F.when(back != "", F.md5(back)).alias("digest"))


#: Ranges of code points and their names: a small dimension that code points are looked up in, 0 and "other" outside.
RANGES = [(0x20, 0x7E, "ascii"), (0xA0, 0xFF, "latin-1"), (0x100, 0x24F, "latin extended"), (0x300, 0x36F, "marks"), (0x370, 0x3FF, "greek"), (0x400, 0x4FF, "cyrillic"), (0x2000, 0x206F, "punctuation"), (0x3040, 0x30FF, "kana"), (0x4E00, 0x9FFF, "han"), (0x1F300, 0x1FAFF, "pictographs")]


@query(f"""WITH c AS (SELECT unicode(unnest(string_split(text, ''))) AS c FROM documents), r AS (SELECT * FROM (VALUES {', '.join(f"({a}, {b}, '{n}')" for a, b, n in RANGES)}) AS t(a, b, name))
SELECT coalesce(name, 'other') AS name, count(*) AS n, count(DISTINCT c) AS n_distinct FROM c LEFT JOIN r ON c BETWEEN a AND b GROUP BY ALL""")
def code_point_ranges(spark, d):
    points = table(spark, d, "documents").select(F.explode(F.split("text", "")).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    own = points.where("ch != ''").select(F.ascii("ch").alias("c"), "n")
    name = F.coalesce(*[F.when(F.col("c").between(a, b), n) for a, b, n in RANGES], F.lit("other"))
    return own.groupBy(name.alias("name")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"))


# --- lexical ------------------------------------------------------------------------------------------------------


@query(f"WITH {TOKENS} SELECT id AS doc_id, tid, w FROM pooled")
def lexical_weights(spark, d):
    return pooled(spark, d).select(F.col("id").alias("doc_id"), "tid", "w")


@query(f"""WITH {TOKENS}, p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
s AS (SELECT p.a, p.b, sum(x.w * y.w) AS s FROM p JOIN pooled x ON x.id = p.a JOIN pooled y ON y.id = p.b AND y.tid = x.tid GROUP BY ALL)
SELECT p.a, p.b, round(coalesce(s, 0.0), 6) AS score FROM p LEFT JOIN s USING (a, b)""")
def lexical_match(spark, d):
    pairs = neighbours(table(spark, d, "documents"), "doc_id").select("a", "b")
    w = pooled(spark, d)
    return lexical.match(pairs, w, w).withColumn("score", F.round("score", 6))


@query(f"WITH {TOKENS} SELECT id AS doc_id, tid, w, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, tid)::INT AS rank FROM pooled) WHERE rank <= 5")
def lexical_top5(spark, d):
    return lexical.top_tokens(pooled(spark, d), 5).select(F.col("id").alias("doc_id"), "tid", "w", "rank")


@query(f"""WITH {TOKENS}, bl AS (SELECT item_id AS id, {WORDS} AS ws FROM benchmark), bw AS (SELECT id, unnest(ws) AS w, unnest(range(0, len(ws))) AS pos FROM bl),
bt AS (SELECT id, {TID}::INT AS tid, (({TID} * 31 + pos * 17) % 1000 - 250) / 1000.0::DOUBLE AS w FROM bw), bp AS (SELECT id, tid, max(w)::DOUBLE AS w FROM bt WHERE w > 0 GROUP BY id, tid),
s AS (SELECT q.id AS query_id, r.id AS row_id, round(sum(q.w * r.w), 9) AS s FROM bp q JOIN pooled r USING (tid) GROUP BY ALL)
SELECT query_id, row_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, row_id)::INT AS rank FROM s) WHERE rank <= 10""")
def lexical_topk_retrieval(spark, d):
    queries = lexical.max_pool(token_rows(table(spark, d, "benchmark"), "item_id"), "id")
    return lexical.retrieve(queries, pooled(spark, d), 10).withColumn("score", F.round("score", 6))


@query(f"""WITH {TOKENS} SELECT id AS doc_id, '{{' || string_agg('"' || tid || '":' || round(w * 1000)::INT, ',' ORDER BY tid) || '}}' AS weights FROM pooled GROUP BY id""")
def weights_json(spark, d):
    maps = lexical.as_map("id", pooled(spark, d), F.round(F.col("w") * 1000).cast("int"))
    return maps.select(F.col("id").alias("doc_id"), F.to_json("weights").alias("weights"))


# --- several vectors a text -----------------------------------------------------------------------------------------

#: Every vector as four of sixteen numbers, as a text has one for each token.
QUARTERS = f"""{VECS}, quarters AS (SELECT vec_id, unnest(range(0, 4))::INT AS pos, unnest([v[1:16], v[17:32], v[33:48], v[49:64]]) AS x FROM vecs),
tokens AS (SELECT vec_id, pos, list_transform(x, lambda y: y / greatest(sqrt(list_inner_product(x, x)), 1e-12)) AS x FROM quarters)"""
SIMS = f"""{QUARTERS}, best AS (SELECT a.vec_id AS query_id, a.pos, b.vec_id AS row_id, max(list_inner_product(a.x, b.x)) AS s FROM tokens a, tokens b WHERE a.vec_id % 100 = 0 GROUP BY ALL),
sims AS (SELECT query_id, row_id, sum(s) / count(*) AS s FROM best GROUP BY ALL)"""


def quarters(spark, d):
    parts = F.array(*[F.slice("v", 1 + 16 * i, 16) for i in range(4)])
    own = vectors(spark, d).select(F.col("vec_id").alias("id"), F.posexplode(parts).alias("pos", "x"))
    return own.select("id", "pos", V.l2_normalize(F.col("x")).alias("vector"))


@query(f"WITH {SIMS} SELECT query_id, row_id, round(s, 6) AS score FROM sims")
def maxsim_scores(spark, d):
    rows = quarters(spark, d)
    return retrieval.max_sim(rows.where("id % 100 = 0"), rows).withColumn("score", F.round("score", 6))


@query(f"WITH {SIMS} SELECT query_id, row_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, row_id)::INT AS rank FROM sims) WHERE rank <= 10")
def maxsim_topk(spark, d):
    rows = quarters(spark, d)
    return retrieval.max_sim(rows.where("id % 100 = 0"), rows, 10).withColumn("score", F.round("score", 6))


@query(f"""WITH {TOKENS.replace('tokens AS', 'word_tokens AS').replace('FROM tokens', 'FROM word_tokens')}, {QUARTERS}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_inner_product(a.v, b.v) AS dense FROM vecs a JOIN vecs b ON b.vec_id = a.vec_id + 1),
l AS (SELECT p.a, sum(x.w * y.w) AS s FROM p JOIN pooled x ON x.id = p.a JOIN pooled y ON y.id = p.b AND y.tid = x.tid GROUP BY ALL),
m AS (SELECT p.a, x.pos, max(list_inner_product(x.x, y.x)) AS s FROM p JOIN tokens x ON x.vec_id = p.a JOIN tokens y ON y.vec_id = p.b GROUP BY ALL),
c AS (SELECT a, sum(s) / count(*) AS s FROM m GROUP BY a), all3 AS (SELECT p.a, p.b, dense, coalesce(l.s, 0.0) AS sparse, c.s AS colbert FROM p LEFT JOIN l USING (a) JOIN c USING (a))
SELECT a, b, round(dense, 6) AS dense, round(sparse, 6) AS sparse, round(colbert, 6) AS colbert, round((sparse + dense) / 2, 6) AS sparse_dense, round((colbert + sparse + dense) / 3, 6) AS colbert_sparse_dense,
round((sparse + 2 * dense) / 3, 6) AS weighted_sparse_dense, round((colbert + sparse + 2 * dense) / 4, 6) AS weighted_all FROM all3""")
def hybrid_score(spark, d):
    dense = neighbours(vectors(spark, d), "vec_id", "v").select("a", "b", V.dot(F.col("v_a"), F.col("v_b")).alias("dense"))
    w = pooled(spark, d)
    sparse = lexical.match(dense.select("a", "b"), w, w).select("a", F.col("score").alias("sparse"))
    rows = quarters(spark, d)
    # positions of a pair's own tokens only: an equi-join on the pair
    q = dense.select("a", "b").join(rows.select(F.col("id").alias("a"), "pos", F.col("vector").alias("x")), "a")
    both = q.join(rows.select(F.col("id").alias("b"), F.col("vector").alias("y")), "b")
    best = both.groupBy("a", "pos").agg(F.max(V.dot(F.col("x"), F.col("y"))).alias("s"))
    colbert = best.groupBy("a").agg(F.avg("s").alias("colbert"))
    own = dense.join(sparse, "a").join(colbert, "a")
    columns = [F.col(c) for c in ("dense", "sparse", "colbert")]
    (sd, csd), (wsd, wall) = V.hybrid(*columns), V.hybrid(*columns, (2.0, 1.0, 1.0))
    named = zip(("dense", "sparse", "colbert", "sparse_dense", "colbert_sparse_dense", "weighted_sparse_dense", "weighted_all"), (*columns, sd, csd, wsd, wall))
    return own.select("a", "b", *[F.round(c, 6).alias(n) for n, c in named])


# --- batches ------------------------------------------------------------------------------------------------------

#: Texts come in calls of 64 consecutive ids; a text's tokens are its words with begin and end.
PLAN = f"""items AS (SELECT doc_id // 64 AS call, doc_id AS idx, len({WORDS}) + 2 AS n FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY call ORDER BY n DESC, idx) AS r FROM items),
plan AS (WITH RECURSIVE f AS (
  SELECT call, idx, n, r, 0 AS batch, 0 AS place, n AS width FROM o WHERE r = 1
  UNION ALL
  SELECT o.call, o.idx, o.n, o.r, CASE WHEN f.place + 1 >= 12 OR (f.place + 2) * f.width > 16384 THEN f.batch + 1 ELSE f.batch END,
         CASE WHEN f.place + 1 >= 12 OR (f.place + 2) * f.width > 16384 THEN 0 ELSE f.place + 1 END,
         CASE WHEN f.place + 1 >= 12 OR (f.place + 2) * f.width > 16384 THEN o.n ELSE f.width END
  FROM f JOIN o ON o.call = f.call AND o.r = f.r + 1) SELECT * FROM f)"""


def plan(spark, d):
    items = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 64).alias("call"), F.col("doc_id").alias("idx"), (F.size(X.words(F.col("text"))) + 2).cast("long").alias("n"))
    return batching.batch_plan(items, "call")


@query(f"WITH {PLAN} SELECT call, idx, n, batch::INT AS batch, place::INT AS place, width FROM plan")
def batch_plan(spark, d):
    return plan(spark, d)


@query(f"WITH {PLAN} SELECT call, count(DISTINCT batch) AS batches, count(*) AS texts, sum(n)::BIGINT AS tokens, sum(width)::BIGINT AS padded, (sum(width) - sum(n))::BIGINT AS waste FROM plan GROUP BY call")
def padding_waste(spark, d):
    own = plan(spark, d).groupBy("call").agg(F.count_distinct("batch").alias("batches"), F.count(F.lit(1)).alias("texts"), F.sum("n").alias("tokens"), F.sum("width").alias("padded"))
    return own.withColumn("waste", F.col("padded") - F.col("tokens"))


@query(f"""WITH {IDS}, w AS (SELECT doc_id // 64 AS call, max(len(ids)) AS width FROM framed GROUP BY ALL),
p AS (SELECT doc_id, list_concat(ids, list_resize([]::INT[], width - len(ids), 1)) AS ids, len(ids) AS n FROM framed JOIN w ON w.call = doc_id // 64)
SELECT doc_id, len(ids)::INT AS width, n::INT AS real_ids, list_sum(ids)::BIGINT AS total FROM p""")
def pad_mask(spark, d):
    ids = framed_ids(spark, d).withColumn("call", F.floor(F.col("doc_id") / 64))
    widths = ids.groupBy("call").agg(F.max(F.size("ids")).alias("w"))
    own = ids.join(widths, "call").select("doc_id", X.padded(F.col("ids"), F.col("w")).alias("p"), F.size("ids").alias("real_ids"))
    return own.select("doc_id", F.size("p").alias("width"), "real_ids", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


# --- encoding with the closed-form test backbone ------------------------------------------------------------------------

HIDDEN = f"""{IDS}, hid AS (SELECT doc_id, unnest(ids) AS tid, unnest(range(0, len(ids))) AS pos, len(ids) AS n FROM framed),
h AS (SELECT doc_id, tid, pos, n, 1.0::DOUBLE AS h0, (tid % 7)::DOUBLE AS h1, (pos % 5)::DOUBLE AS h2 FROM hid)"""


@query(f"WITH {HIDDEN} SELECT doc_id, round(h0 / sqrt(h0 * h0 + h1 * h1 + h2 * h2), 6) AS x0, round(h1 / sqrt(h0 * h0 + h1 * h1 + h2 * h2), 6) AS x1, round(h2 / sqrt(h0 * h0 + h1 * h1 + h2 * h2), 6) AS x2 FROM h WHERE pos = 0")
def encode_dense(spark, d):
    got = encoding.encode(framed_ids(spark, d), encoding.test_backbone, encoding.TEST_HEADS, dense=True)
    return got.select("doc_id", *[F.round(F.col("dense_vecs")[i].cast("double"), 6).alias(f"x{i}") for i in range(3)])


@query(f"""WITH {HIDDEN}, w AS (SELECT doc_id, tid, greatest(0.5 * h0 + 0.25 * h1 - 0.125 * h2 - 0.5, 0) AS w FROM h)
SELECT doc_id, tid, max(w) AS w FROM w WHERE w > 0 AND tid NOT IN (0, 1, 2, 3) GROUP BY ALL""")
def encode_sparse(spark, d):
    got = encoding.encode(framed_ids(spark, d), encoding.test_backbone, encoding.TEST_HEADS, sparse=True)
    return got.select("doc_id", F.explode("lexical_weights").alias("tid", "w")).select("doc_id", F.col("tid").cast("int").alias("tid"), F.col("w").cast("double").alias("w"))


@query(f"""WITH {HIDDEN}, c AS (SELECT doc_id, pos, h0 + h1 AS c0, h1 - h2 AS c1, h0 + h2 AS c2 FROM h WHERE pos > 0), n AS (SELECT *, sqrt(c0 * c0 + c1 * c1 + c2 * c2) AS n FROM c)
SELECT doc_id, count(*) AS n_vectors, round(sum(c0 / n), 3) AS s0, round(sum(c1 / n), 3) AS s1, round(sum(c2 / n), 3) AS s2 FROM n GROUP BY doc_id""")
def encode_colbert(spark, d):
    got = encoding.encode(framed_ids(spark, d), encoding.test_backbone, encoding.TEST_HEADS, colbert=True, wide=True)
    rows = got.select("doc_id", F.explode("colbert_vecs").alias("v"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_vectors"), *[F.round(F.sum(F.col("v")[i].cast("double")), 3).alias(f"s{i}") for i in range(3)])


# --- evaluation -----------------------------------------------------------------------------------------------------

#: The candidate's weights: rounded to tenths, and those below a tenth gone.
BOTH = f"{TOKENS}, candidate AS (SELECT id, tid, round_even(w * 10, 0)::DOUBLE / 10 AS w2 FROM pooled), two AS (SELECT p.id, p.tid, p.w AS w1, nullif(c.w2, 0) AS w2 FROM pooled p JOIN candidate c USING (id, tid))"


def both_weights(spark, d):
    return pooled(spark, d).select("id", "tid", F.col("w").alias("w1"), F.nullif(F.rint(F.col("w") * 10) / 10, F.lit(0.0)).alias("w2"))


@query(f"""WITH {BOTH}, r AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY w1 DESC, tid)::DOUBLE AS r1, row_number() OVER (PARTITION BY id ORDER BY coalesce(w2, 0.0) DESC, tid)::DOUBLE AS r2 FROM two)
SELECT id AS doc_id, round(CASE WHEN count(*) <= 2 THEN 1.0 ELSE corr(r1, r2) END, 6) AS rho FROM r GROUP BY id""")
def spearman(spark, d):
    return evaluate.spearman(both_weights(spark, d)).select(F.col("id").alias("doc_id"), F.round("rho", 6).alias("rho"))


@query(f"""WITH {BOTH}, r AS (SELECT id, tid, w2, row_number() OVER (PARTITION BY id ORDER BY w1 DESC, tid) AS r1, row_number() OVER (PARTITION BY id ORDER BY coalesce(w2, 0.0) DESC, tid) AS r2 FROM two)
SELECT id AS doc_id, count(*) FILTER (r1 <= 5 AND r2 <= 5) AS shared, count(*) FILTER (r1 <= 5 AND r1 = r2) AS same_place, count(*) FILTER (w2 IS NULL) AS missing FROM r GROUP BY id""")
def topk_agreement(spark, d):
    from pyspark.sql import Window

    r = [F.row_number().over(Window.partitionBy("id").orderBy(F.desc(w), "tid")).alias(n) for w, n in ((F.col("w1"), "r1"), (F.coalesce("w2", F.lit(0.0)), "r2"))]
    own = both_weights(spark, d).select("id", "w2", *r)
    return own.groupBy(F.col("id").alias("doc_id")).agg(F.count_if((F.col("r1") <= 5) & (F.col("r2") <= 5)).alias("shared"), F.count_if((F.col("r1") <= 5) & (F.col("r1") == F.col("r2"))).alias("same_place"), F.count_if(F.col("w2").isNull()).alias("missing"))


@query(f"""WITH {BOTH} SELECT coalesce(a.id, b.id) AS doc_id, count(*) FILTER (b.tid IS NULL) AS only_first, count(*) FILTER (a.tid IS NULL) AS only_second
FROM pooled a FULL JOIN (SELECT id, tid FROM two WHERE w2 IS NOT NULL) b ON a.id = b.id AND a.tid = b.tid GROUP BY 1""")
def key_set_differences(spark, d):
    # both weights of a token stand in one row, so the outer join is done: a side has a token where it has a weight
    one, two = F.col("w1").isNotNull(), F.col("w2").isNotNull()
    own = both_weights(spark, d).groupBy(F.col("id").alias("doc_id"))
    return own.agg(F.count_if(one & ~two).alias("only_first"), F.count_if(two & ~one).alias("only_second"))


@query("""WITH o AS (SELECT event_type, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
g AS (SELECT DISTINCT event_type, n, least(greatest(0.5 * (n + 1), 1), n)::DOUBLE AS a, least(greatest(0.95 * (n + 1), 1), n)::DOUBLE AS b FROM o)
SELECT g.event_type, g.n, round(max(x) FILTER (r = floor(a)) * (1 - (a - floor(a))) + coalesce(max(x) FILTER (r = floor(a) + 1), 0) * (a - floor(a)), 6) AS p50,
round(max(x) FILTER (r = floor(b)) * (1 - (b - floor(b))) + coalesce(max(x) FILTER (r = floor(b) + 1), 0) * (b - floor(b)), 6) AS p95 FROM g JOIN o USING (event_type) GROUP BY g.event_type, g.n, a, b""")
def latency_quantiles(spark, d):
    got = evaluate.quantiles(table(spark, d, "events"), "event_type", "value", (0.5, 0.95))
    return got.select("event_type", "n", F.round("`0.5`", 6).alias("p50"), F.round("`0.95`", 6).alias("p95"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 6) AS per_second FROM events GROUP BY event_type")
def throughput(spark, d):
    micros = [F.unix_micros(m("ts").cast("timestamp")) for m in (F.max, F.min)]
    span = micros[0] / 1e6 - micros[1] / 1e6
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.count(F.lit(1)) / span, 6).alias("per_second"))


# --- integrity ------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1, strlen(text) AS bytes FROM documents")
def content_digests(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.sha2(t, 256).alias("sha256"), F.sha1(t).alias("sha1"), F.octet_length(t).cast("long").alias("bytes"))


@query("SELECT sha1(text) AS digest, strlen(text) AS bytes, min(doc_id) AS first_id, count(*) AS copies, (count(*) - 1) * strlen(text) AS saved FROM documents GROUP BY 1, 2")
def content_sharing(spark, d):
    return integrity.shared_contents(table(spark, d, "documents"), "doc_id", F.col("text"))


@query("""SELECT doc_id, source, strlen(text) AS bytes, coalesce(sum(ceil(strlen(text) / 64.0)::BIGINT * 64) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM documents""")
def aligned_offsets(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("bytes"))
    return integrity.running_offsets(rows, "source", "doc_id", F.col("bytes"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT item_id, count(DISTINCT doc_id) AS n_docs FROM benchmark b LEFT JOIN l ON l.line = b.text GROUP BY item_id""")
def holdout_overlap(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    found = table(spark, d, "benchmark").withColumnRenamed("text", "line").join(lines, "line", "left")
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"))


# --- requests -------------------------------------------------------------------------------------------------------


@query(f"""WITH r AS (SELECT conv_id, count(*) AS texts, {BUCKET.format(n='max(length(text))')} AS bucket FROM conversations GROUP BY conv_id)
SELECT conv_id, bucket, conv_id // 16 AS batch, texts, coalesce(sum(texts) OVER (PARTITION BY bucket, conv_id // 16 ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM r""")
def microbatch_groups(spark, d):
    """A request has several texts and is never split; requests of one length bucket that come together share a batch, and each result is found by its offset there."""
    from ..streaming.microbatch import group_requests

    r = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("texts"), X.length_bucket(F.max(F.char_length("text"))).alias("bucket"))
    return group_requests(r.withColumn("batch", F.floor(F.col("conv_id") / 16)), "conv_id", ["bucket", "batch"], "texts")


@query("""SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS minute, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL""")
def microbatch_windows(spark, d):
    """Event-time tumbling windows, the deterministic stand-in for a flush by time."""
    own = table(spark, d, "events").groupBy(F.window("ts", "1 minute").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return own.select(F.col("w.start").alias("minute"), "event_type", "n", "total")


# --- tokens by a small vocabulary ------------------------------------------------------------------------------------

#: Pieces of a small vocabulary; scores are multiples of a quarter, so sums of them are exact. A piece's id is its place here and 4 more.
PIECES = ["▁", *"abcdefghijklmnopqrstuvwxyz", "th", "he", "in", "er", "an", "en", "on", "ou", "the", "and", "ion", "ing", "tion", "▁th", "▁an", "▁the", "."]
SCORES = [-5.0 + 0.25 * (k * 7 % 9) - 0.75 * len(p) for k, p in enumerate(PIECES)]

#: Segmentation in SQL: st holds the best ways to the last four places, the nearest first; of equal scores the longest last piece wins.
SEGMENTED = f"""pieces AS (SELECT MAP {{{', '.join(f"'{p}': {{'id': {k + 4}, 'score': {s}::DOUBLE}}" for k, (p, s) in enumerate(zip(PIECES, SCORES)))}}} AS pieces),
f AS (SELECT word, CASE WHEN word LIKE '▁%' THEN word ELSE '▁' || word END AS m, 0 AS e, [{{'score': 0.0::DOUBLE, 'ids': []::INT[]}}] AS st FROM distinct_words
  UNION ALL
  SELECT word, m, e + 1, list_prepend(ways[list_position(list_transform(ways, lambda w: w.score), list_max(list_transform(ways, lambda w: w.score)))], st[1:3])
  FROM (SELECT word, m, e, st, list_transform(tried, lambda t: {{'score': st[t.k].score + coalesce(t.p.score, {min(SCORES) - 10}::DOUBLE),
      'ids': CASE WHEN t.p.id IS NOT NULL THEN list_append(st[t.k].ids, t.p.id::INT) WHEN st[t.k].ids[-1] = 3 THEN st[t.k].ids ELSE list_append(st[t.k].ids, 3) END}}) AS ways
    FROM (SELECT word, m, e, st, list_filter(list_transform(range(least(4, e + 1), 0, -1), lambda k: {{'k': k, 'p': pieces[substr(m, e + 2 - k, k)]}}), lambda t: t.k = 1 OR t.p.id IS NOT NULL) AS tried
      FROM f, pieces WHERE e < length(m))))"""


def small_vocabulary():
    from ..sources.model_files import NORMAL, Vocabulary

    return Vocabulary(["<unk>", "<s>", "</s>", *PIECES], [0.0, 0.0, 0.0, *SCORES], [2, 3, 3, *[NORMAL] * len(PIECES)], 0)


@query(f"""WITH RECURSIVE distinct_words AS (SELECT DISTINCT unnest({WORDS}) AS word FROM documents), {SEGMENTED}
SELECT word, len(st[1].ids)::INT AS n_ids, array_to_string(st[1].ids, ',') AS ids FROM f WHERE e = length(m)""")
def unigram_words(spark, d):
    """The best segmentation of every distinct word."""
    from ..operators import tokenizer

    words = table(spark, d, "documents").select(F.explode(X.words(F.col("text"))).alias("word")).distinct().withColumn("w", F.col("word"))
    body = F.slice("ids", 2, F.size("ids") - 2)
    return tokenizer.token_ids(words, "word", "w", small_vocabulary(), 1 << 30).select("word", F.size(body).alias("n_ids"), F.array_join(body, ",").alias("ids"))


@query(f"""WITH RECURSIVE lists AS (SELECT doc_id, {WORDS} AS ws FROM documents), every AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM lists), distinct_words AS (SELECT DISTINCT word FROM every), {SEGMENTED},
done AS (SELECT word, st[1].ids AS ids FROM f WHERE e = length(m)), whole AS (SELECT doc_id, flatten(list(ids ORDER BY pos)) AS ids FROM every JOIN done USING (word) GROUP BY doc_id),
framed AS (SELECT doc_id, list_concat([0], list_concat(coalesce(ids, []::INT[])[1:8190], [2])) AS ids FROM documents LEFT JOIN whole USING (doc_id))
SELECT doc_id, len(ids)::INT AS n_ids, md5(array_to_string(ids, ',')) AS digest, len(list_filter(ids, lambda i: i = 3))::INT AS n_unknown FROM framed""")
def unigram_documents(spark, d):
    """Whole documents by a small vocabulary, framed, up to the encoder's limit."""
    from ..operators import tokenizer

    got = tokenizer.token_ids(table(spark, d, "documents"), "doc_id", "text", small_vocabulary())
    return got.select("doc_id", F.size("ids").alias("n_ids"), F.md5(F.array_join("ids", ",")).alias("digest"), F.size(F.filter("ids", lambda i: i == 3)).alias("n_unknown"))


#: Framed ids of the benchmark's texts.
ITEMS = f"""lists AS (SELECT item_id, {WORDS} AS ws FROM benchmark), every AS (SELECT item_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM lists), distinct_words AS (SELECT DISTINCT word FROM every), {SEGMENTED},
done AS (SELECT word, st[1].ids AS ids FROM f WHERE e = length(m)), whole AS (SELECT item_id, flatten(list(ids ORDER BY pos)) AS ids FROM every JOIN done USING (word) GROUP BY item_id),
framed AS (SELECT item_id, coalesce(ids, []::INT[]) AS ids FROM benchmark LEFT JOIN whole USING (item_id))"""


@query(f"""WITH RECURSIVE {ITEMS}, t AS (SELECT item_id, unnest(list_concat([0], list_concat(ids[1:8190], [2]))) AS id, unnest(range(0, len(ids[1:8190]) + 2))::INT AS pos FROM framed),
names AS (SELECT * FROM (VALUES (0, '<s>'), (2, '</s>'), (3, '<unk>'), {', '.join(f"({k + 4}, '{p}')" for k, p in enumerate(PIECES))}) AS n(id, token))
SELECT item_id, pos, id, token FROM t LEFT JOIN names USING (id)""")
def token_names(spark, d):
    """Every id of the benchmark's texts beside its token."""
    from ..operators import tokenizer

    v = small_vocabulary()
    ids = tokenizer.token_ids(table(spark, d, "benchmark"), "item_id", "text", v)
    return tokenizer.token_names(ids.select("item_id", F.posexplode("ids").alias("pos", "id")), v).select("item_id", "pos", "id", "token")


@query(f"""WITH RECURSIVE {ITEMS}, sides AS (SELECT item_id AS a, list_concat([0], list_concat(ids[1:510], [2])) AS ids, 1 AS side FROM framed UNION ALL SELECT item_id - 1, list_concat([0], list_concat(ids[1:8190], [2])), 2 FROM framed),
t AS (SELECT a, side, unnest(ids) AS tid, unnest(range(0, len(ids))) AS pos FROM sides), h AS (SELECT a, side, tid, pos, 1.0::DOUBLE AS h0, (tid % 7)::DOUBLE AS h1, (pos % 5)::DOUBLE AS h2 FROM t),
w AS (SELECT a, side, tid, max(0.5 * h0 + 0.25 * h1 - 0.125 * h2 - 0.5) AS w FROM h WHERE tid > 3 GROUP BY ALL HAVING w > 0),
s AS (SELECT x.a, sum(x.w * y.w) AS s FROM w x JOIN w y ON x.a = y.a AND x.tid = y.tid AND x.side = 1 AND y.side = 2 GROUP BY ALL),
c AS (SELECT a, side, pos, [(h0 + h1) / n, (h1 - h2) / n, (h0 + h2) / n] AS v FROM (SELECT *, sqrt((h0 + h1) ** 2 + (h1 - h2) ** 2 + (h0 + h2) ** 2) AS n FROM h WHERE pos > 0)),
m AS (SELECT x.a, x.pos, max(list_inner_product(x.v, y.v)) AS m FROM c x JOIN c y ON x.a = y.a AND x.side = 1 AND y.side = 2 GROUP BY ALL), l AS (SELECT a, avg(m) AS m FROM m GROUP BY a)
SELECT a AS pair_id, 1.0::DOUBLE AS dense, round(coalesce(s, 0), 6) AS sparse, round(m, 6) AS colbert, round((1 + coalesce(s, 0)) / 2, 6) AS sparse_dense, round((1 + coalesce(s, 0) + m) / 3, 6) AS colbert_sparse_dense FROM l LEFT JOIN s USING (a)""")
def pair_scores(spark, d):
    """Each text of the benchmark, as a query, against the next one, as a passage. The test backbone's first token is the same in all texts, so dense is 1."""
    from ..operators import scoring

    pairs = neighbours(table(spark, d, "benchmark"), "item_id", "text").select(F.col("a").alias("pair_id"), F.col("text_a").alias("query"), F.col("text_b").alias("passage"))
    got = scoring.compute_score(pairs, small_vocabulary(), encoding.test_backbone, encoding.TEST_HEADS, wide=True)
    return got.select("pair_id", *[F.round(c, 6).alias(c) for c in got.columns if c != "pair_id"])


@query("SELECT doc_id, length_grapheme(coalesce(text, '')) AS n_clusters, length(coalesce(text, '')) AS n_chars FROM documents")
def grapheme_counts(spark, d):
    from ..operators import tokenizer

    return tokenizer.grapheme_counts(table(spark, d, "documents"), "doc_id", "text")


@query(f"""WITH n AS (SELECT doc_id AS idx, least(len({WORDS}), 8190) + 2 AS n FROM documents), r AS (SELECT idx, n, row_number() OVER (ORDER BY n DESC, idx) - 1 AS r FROM n)
SELECT idx, n::BIGINT AS n, (r // 8)::BIGINT AS chunk, (r % 8)::INT AS place FROM r""")
def calibration_chunks(spark, d):
    """All documents in the order in which calibration takes them."""
    n = (F.least(F.size(X.words(F.col("text"))), F.lit(X.MAX_LENGTH - 2)) + 2).cast("long")
    return batching.calibration_chunks(table(spark, d, "documents").select(F.col("doc_id").alias("idx"), n.alias("n")))


@query()
def unigram_ids(spark, d):
    """Token ids of every whole document by a vocabulary derived from all of them; no SQL, tests hold the segmentation against enumeration."""
    from ..operators import tokenizer

    docs = table(spark, d, "documents")
    return tokenizer.token_ids(docs, "doc_id", "text", tokenizer.derived_vocabulary(docs, "text"))
