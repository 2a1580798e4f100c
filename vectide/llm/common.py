"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, whatever else ``df`` has, names that differ only by case included."""
    have = df.columns
    low = [c.lower() for c in have]
    at = [have.index(n) if n in have else low.index(n.lower()) for n in names]
    plain = df.toDF(*[f"_{i}" for i in range(len(have))])
    return plain.select(*[F.col(f"_{i}").alias(n) for i, n in zip(at, names)])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it names none a temporary one serves a local master, as in tests; on a cluster that is an error, as its machines share no such folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="vectide-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Rows of a saved table that a partition holds at least, if it has several.
ROWS_A_PART = 20_000


def saved(df: DataFrame, **more: Column) -> DataFrame:
    """``df`` computed once and kept, lineage cut, in the shared folder. Small tables come in fewer partitions: what is done with them writes a file a partition. The number of rows is its attribute ``n_rows``; ``seen`` has it and the aggregates ``more``, seen on the way without another query."""
    shared_folder(df.sparkSession)
    seen = Observation()
    kept = df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in more.items()]).checkpoint()
    n = seen.get["n"]
    out = kept.coalesce(max(1, -(-n // ROWS_A_PART)))
    out.n_rows, out.kept, out.seen = n, kept, dict(seen.get)
    return out


def numbered(df: DataFrame, *names: str) -> tuple[DataFrame, list[int]]:
    """``df`` with its columns named c0, c1, ... and the numbers of the named ones, so that no other column's name can clash."""
    have, low = df.columns, [c.lower() for c in df.columns]
    return df.toDF(*[f"c{i}" for i in range(len(have))]), [have.index(n) if n in have else low.index(n.lower()) for n in names]


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Returns memory that a finished task held to the machine; a worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: What this worker keeps for its next task, one thing at most.
_remembered: dict = {}


def remembered(name: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept for the worker's next tasks that name it in map_arrow(); the first task of another kind drops it."""
    if name not in _remembered:
        _remembered.clear()
        _remembered[name] = make()
    return _remembered[name]


def drop_remembered(but: tuple | None = None) -> None:
    """Drops what a task of another kind left in this worker, and gives its memory back."""
    gone = [name for name in _remembered if name != but]
    for name in gone:
        del _remembered[name]
    if gone:
        give_back()


#: Rows that a function gets at once: of a batch of 10,000 long texts a Python copy is too much.
ROWS_AT_ONCE = 1_000


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, rows: int = ROWS_AT_ONCE, uses: tuple | None = None) -> DataFrame:
    """mapInArrow of ``fn``, which gets batches of so many rows at most; what a task held is given back at its end, what earlier ones left for others at its start. ``uses``: the name of what it has remembered()."""
    def parts(batches):
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows)

    def run(batches):
        drop_remembered(uses)
        try:
            yield from fn(parts(batches))
        finally:
            give_back()

    return df.mapInArrow(run, schema)


#: A key is hot that holds more than this share of a table's rows, so there are at most HOT of them.
HOT = 1000


def hot_keys(rows: DataFrame, key: str) -> list:
    """The keys that hold more than one in HOT of the rows: fewer than HOT of them, whatever the table."""
    total = getattr(rows, "n_rows", None)
    total = rows.count() if total is None else total
    return [r[0] for r in rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") * HOT > total) & F.col(key).isNotNull()).select(key).collect()]


def join_hot(rows: DataFrame, one: DataFrame, key: str | list[str], hot: list, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``one``, which has one row a key, ``hot`` being values of the (first) key. Hot rows stay where they are and the keys' rows of ``one``, fewer than HOT, go to them; the others are dealt out by key."""
    if not hot:
        return rows.join(one, key, how)
    is_hot = F.coalesce(F.col(key if isinstance(key, str) else key[0]).isin(hot), F.lit(False))
    return rows.where(is_hot).join(F.broadcast(one.where(is_hot)), key, how).unionByName(rows.where(~is_hot).join(one.where(~is_hot), key, how))


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Deletes what saved() wrote for tables that nothing will read again."""
    for df in tables:
        plan = df.kept._jdf.queryExecution().logical()
        if plan.getClass().getSimpleName() == "LogicalRDD" and plan.rdd().getCheckpointFile().isDefined():
            remove(df.sparkSession, plan.rdd().getCheckpointFile().get())


def byte_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column as UTF-8, null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), dtype=">u8").astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def agreed_labels(labels: DataFrame, name: str, bound: int) -> DataFrame:
    """(doc_id, y) of at most ``bound`` labelled rows that may be learnt from: those not held out, with one label.

    A document whose rows in the table contradict each other is left out; so are null ids and labels.
    The rows with the smallest hash of the id are taken, the same ones whatever the partitioning.
    """
    rows = pick(labels, "doc_id", name).where(F.col("doc_id").isNotNull() & F.col(name).isNotNull() & ~held_out(F.col("doc_id")))
    one = rows.groupBy("doc_id").agg(F.min(name).alias("y"), F.max(name).alias("y2")).where("y = y2")
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).select("doc_id", F.col("y").cast("int").alias("y"))
