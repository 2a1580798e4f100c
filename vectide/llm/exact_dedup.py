"""Exact dedup by a log-structured merge index of digests. DataFrame operations only.

Rows arrive in ``memtables`` segments. A memtable is pre-aggregated where it is read (one entry a digest: the
smallest identifier in the order asked for and the number of rows) and flushed as a run sorted by digest, with a
bitmap filter over its digests. An entry that holds a single row and that no other run's filter may contain is
unique and leaves; compaction merges the rest by digest and keeps the smallest identifier. Digests found more than
once are hits, and hits receive byte verification: their whole texts are grouped by their bytes, not by the digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, join_hot, numbered, pick, read, saved

#: A filter has so many bits an entry, at least 2^16 and at most 2^27 in all, which are 16 MB. Where entries are so many
#: that they fill it, more rows go through compaction or verification; none is lost.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27
#: spark's bitmap functions deal out positions in buckets of so many bits
BUCKET_BITS = 32768


class Filter:
    """A bitmap over values of 64-bit hashes, sized for ``count`` entries: MOST_BITS / BUCKET_BITS rows of 4 kB at most."""

    def __init__(self, count: int):
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * count).bit_length()))

    def position(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.bits))

    def bucket(self, value: Column) -> Column:
        return F.floor(self.position(value) / BUCKET_BITS).cast("int")

    def table(self, entries: DataFrame, value: str, *keys: str) -> DataFrame:
        """(keys, bucket, mask): a row for each bucket with an entry, and key."""
        at = entries.select(*keys, self.position(F.col(value)).alias("at"))
        return at.groupBy(*keys, F.floor(F.col("at") / BUCKET_BITS).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.col("at") % BUCKET_BITS).alias("mask"))

    def may_contain(self, value: Column, mask: Column) -> Column:
        """Whether the mask of the value's bucket holds its position."""
        at = self.position(value) % BUCKET_BITS
        byte = F.conv(F.hex(F.substring(mask, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1, F.lit(False))

    def passing(self, rows: DataFrame, value: str, table: DataFrame, flag: str = "maybe") -> DataFrame:
        """``rows`` with ``flag``: whether the value may be among the table's entries."""
        marked = rows.withColumn("bucket", self.bucket(F.col(value))).join(F.broadcast(table), "bucket", "left")
        return marked.withColumn(flag, self.may_contain(F.col(value), F.col("mask"))).drop("bucket", "mask")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "smallest", memtables: int = 4, hashed: bool = False, digests: tuple[Callable[[Column], Column], Callable[[Column], Column]] = (sha256, F.xxhash64)) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty. Of equal texts the row with the smallest (or,
    with ``keep="largest"``, the largest) identifier stays. A null identifier stays only where its group has no
    other. Rows that repeat an identifier and a text are all in the group and are all kept, as one identifier names
    one document. An empty table gives no rows. Other columns of ``docs`` are not read. ``hashed``: the text's 64-bit hash
    besides, as second. Texts whose ``digests`` agree though they differ are told apart by their bytes.
    """
    best = F.max if keep == "largest" else F.min
    base = pick(docs, key, text).select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    base = base.select("id", "t", digests[0](F.col("t")).alias("digest"), digests[1](F.col("t")).alias("second"))
    rows = saved(base.select("id", "digest", "second", F.lower(F.sha2("t", 256)).alias("sha") if digests[0] is not sha256 else F.lit(None).cast("string").alias("sha"), F.pmod(F.spark_partition_id(), F.lit(memtables)).alias("run")))
    total = rows.n_rows
    runs = rows.groupBy("run", "digest").agg(best("id").alias("keep"), F.count(F.lit(1)).alias("n")).sortWithinPartitions("run", "digest")
    # which runs may hold a digest: a table of ``memtables`` filters
    held_by = Filter(-(-total // memtables))
    filters = held_by.table(runs, "digest", "run").groupBy("bucket").pivot("run", list(range(memtables))).agg(F.first("mask"))
    held = runs.select("*", held_by.bucket(F.col("digest")).alias("bucket")).join(F.broadcast(filters), "bucket", "left")
    elsewhere = F.lit(False)
    for r in range(memtables):
        elsewhere = elsewhere | ((F.col("run") != r) & held_by.may_contain(F.col("digest"), F.col(f"`{r}`")))
    maybe = held.where((F.col("n") > 1) | elsewhere).select("digest", "keep", "n")
    hits = maybe.groupBy("digest").agg(best("keep").alias("keep"), F.sum("n").alias("n")).where("n > 1")
    hits = saved(hits.select("digest", "n"))
    # texts of hits alone are carried on: a filter over the hits lets few others pass, and the bytes decide
    over = Filter(hits.n_rows)
    likely = over.passing(base, "digest", over.table(hits, "digest")).where("maybe")
    texts = likely.groupBy("digest", "second", "t").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    several = F.struct("keep_id", "group_size")
    texts = texts.groupBy("digest", "second").agg(F.max(several).alias("of"), F.sum("group_size").alias("n"), F.count(F.lit(1)).alias("kinds")).where("n > 1")
    texts = saved(texts.select("digest", "second", "of.keep_id", "of.group_size", "kinds"))
    # a digest that a thousandth of all rows have goes to the rows, of which there are too many for one task
    hot = [r[0] for r in hits.where(F.col("n") * HOT > total).select("digest").collect()]
    out = join_hot(rows.drop("run"), texts, ["digest", "second"], hot, "left")
    if texts.where("kinds > 1").limit(1).count():
        apart = texts.where("kinds > 1").select("digest", "second")
        odd = base.join(apart, ["digest", "second"])
        of = odd.groupBy("digest", "second", "t").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        odd = odd.join(of, ["digest", "second", "t"]).select("digest", "second", "id", F.lower(F.sha2("t", 256)).alias("sha"), "keep_id", "group_size", F.lit(2).alias("kinds"))
        out = out.where("kinds IS NULL OR kinds = 1").unionByName(odd)
    keep_id = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("id").alias("doc_id"),
        keep_id.alias("keep_id"),
        F.coalesce(F.col("group_size"), F.lit(1)).alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        F.coalesce("sha", F.lower(F.hex("digest"))).alias("text_sha256"),
        *[F.col("second")] * hashed,
    )


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows named in ``gone``: (id, second), the doc_id and the 64-bit hash of the text, or null in ``second`` for any text.

    All columns stay. A filter over ``gone`` lets most other rows pass at once; only rows it may hold are joined, so
    most texts that stay aren't shuffled.
    """
    own, (at, text) = numbered(docs, "doc_id", "text")
    nobody = F.lit(-(1 << 63))
    names = saved(gone.select(F.coalesce("id", nobody).alias("gid"), F.col("second").alias("gsecond")).distinct())
    over = Filter(names.n_rows)
    tagged = own.withColumn("gkey", F.coalesce(F.col(f"c{at}").cast("long"), nobody)).withColumn("ghash", F.xxhash64(F.coalesce(F.col(f"c{text}"), F.lit(""))))
    tagged = over.passing(tagged, "gkey", over.table(names, "gid"))
    doubt = tagged.where("maybe").join(names, (F.col("gkey") == F.col("gid")) & (F.col("gsecond").isNull() | (F.col("gsecond") == F.col("ghash"))), "left_anti")
    return tagged.where("NOT maybe").select(*own.columns).union(doubt.select(*own.columns)).toDF(*docs.columns)


def distinct_texts(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """``docs`` with one row of each group of equal texts; see exact_groups."""
    dropped = exact_groups(docs, keep=keep, hashed=True).where("NOT kept").select(F.col("doc_id").alias("id"), "second")
    return without(docs, dropped)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"), keep="largest")


OP8_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
