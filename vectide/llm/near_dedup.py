"""Near-dedup by bottom-k sketches of one hash function.

A document is the set of its distinct shingles; documents of the same words are a class, and classes are what is
compared. A sketch keeps the k smallest shingle hashes. Of two sets at least as alike as the threshold the sketches
share so many values (to six standard deviations of the hash's draw, exactly where a set has no more than k shingles)
that, by the prefix principle, they share one among each one's rarest few. Inverted lists of those rare values generate
candidates; the union's sketch estimates their likeness and filters; the whole sets of whole texts decide.

A list is not expanded into its pairs. First every member is compared with its list's hub, the member whose sketch
values are the most frequent, which links a group of copies as a star around a central one. Lists whose members are in
one component then have nothing left to say; in the others members are compared with a few more hubs of other
components. Of what still is in a list with others' components only documents stay that share as many sketch values as
a link needs with documents of other components, all those together; they are compared across components by a prefix
filter over their whole sets.

``sure=True`` does without the sketches' chance: the exact prefix filter runs over all documents.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, forget, hashes, hot_keys, join_hot, map_arrow, mix, pick, read, saved, width
from .components import components
from .exact_dedup import Filter, without

#: Values of a sketch; standard deviations of slack; texts compared with one hub by one task; hubs of a list's second round.
K, SIGMAS, HUB_SHARE, HUBS = 64, 6.0, 64, 4


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the shingles: ``size`` consecutive words each, or all of them where there are fewer; none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes(words)
    n = min(size, len(words))
    out = np.full(len(h) - n + 1, np.uint64(n))
    with np.errstate(over="ignore"):
        for i in range(n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """shingle_hashes of a text's words: A-Z lower-cased, without ASCII white space."""
    return shingle_hashes(text.lower().split(), size)


def exact_set(text: bytes, size: int) -> set:
    """The shingles themselves."""
    words = text.lower().split()
    return set(zip(*[words[i:] for i in range(size)])) if len(words) >= size else {tuple(words)} if words else set()


def needed(n: int, percent: int, k: int = K) -> int:
    """Values that the sketch of a set of ``n`` shingles shares with that of any set alike enough."""
    t = percent / 100
    return max(1, min(math.floor(k * t - SIGMAS * math.sqrt(k * t * (1 - t))), -(-n * percent // 100)))


def least_shared(n: Column, percent: int, k: int) -> Column:
    """needed() of a column of set sizes."""
    return F.greatest(F.lit(1), F.least(F.lit(needed(1 << 40, percent, k)), F.ceil(n * percent / 100))).cast("int")


def marks(docs: DataFrame, size: int, k: int) -> DataFrame:
    """(doc_id, n, d1, d2, sketch) for each row: set size, 128 bits of the SHA-256 of its words as two integers, and its sketch, ascending."""
    def run(batches):
        for b in batches:
            n, d1, d2, s = [], [], [], []
            for t in byte_texts(b):
                words = t.lower().split()
                x = shingle_hashes(words, size)
                n.append(len(x))
                low, high = np.frombuffer(hashlib.sha256(b" ".join(words)).digest()[:16], ">i8").tolist()
                d1.append(low)
                d2.append(high)
                s.append(x[:k].astype(np.int64) if len(x) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(s, pa.list_(pa.int64()))], ["doc_id", "n", "d1", "d2", "sketch"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n long, d1 long, d2 long, sketch array<long>")


def rare_values(classes: DataFrame, percent: int, k: int) -> DataFrame:
    """(v, node, n, far): for each class the values of its sketch's prefix, its rarest ones, that another class has too; far is the less the more other classes its sketch's values have."""
    values = classes.select("node", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    times = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = values.join(times, "v").groupBy("node", "n", "s").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    # values that no other class has are rarer than all others, so they come first in the prefix
    shared = shared.withColumn("own", F.col("s") - F.size("vs"))
    shared = shared.withColumn("far", -F.aggregate("vs", F.lit(0).cast("long"), lambda a, x: a + x["df"]) / F.col("s"))
    length = F.greatest(F.lit(0), F.col("s") - least_shared(F.col("n"), percent, k) + 1 - F.col("own"))
    kept = shared.select("node", "n", "far", F.col("vs.v").alias("vs"), F.least(length, F.size("vs")).alias("length")).where("length > 0")
    return kept.select(F.explode(F.slice("vs", F.lit(1), F.col("length"))).alias("v"), "node", "n", "far")


def sizes_fit(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of so many shingles can be as alike as asked for."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def likely(pairs: DataFrame, classes: DataFrame, percent: int, k: int) -> DataFrame:
    """Of pairs (a, b) those whose union's sketch does not rule the likeness out."""
    t = percent / 100
    one = classes.select(F.col("node").alias("a"), F.col("sketch").alias("x"))
    two = classes.select(F.col("node").alias("b"), F.col("sketch").alias("y"))
    # a hub stands in as many pairs as its group has members
    both = join_hot(pairs.join(two, "b"), one, "a", hot_keys(pairs, "a"))
    # the hash order is that of unsigned integers, so the sign bit is turned before sorting
    def turned(c):
        return F.transform(c, lambda v: v.bitwiseXOR(F.lit(-(1 << 63))))

    union = F.slice(F.array_sort(turned(F.array_union("x", "y"))), 1, k)
    common = F.array_intersect(union, turned(F.array_intersect("x", "y")))
    m = F.size(union)
    least = F.when(m < k, m * percent / 100).otherwise(F.lit(math.floor(k * t - SIGMAS * math.sqrt(k * t * (1 - t)))))
    return both.where(F.size(common) >= least).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those with 100 * intersection >= percent * union, by the shingles of the whole texts.

    ``docs``: node and text. A hub's text is sent once to each task that compares it, HUB_SHARE texts each, and each of
    those is sent once; only texts that pairs name are sent, but for the few that a filter of fixed size lets pass.
    """
    pairs = saved(pairs.distinct())
    shares = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB_SHARE).cast("int").alias("shares"))
    members = join_hot(pairs, shares, "a", hot_keys(pairs, "a")).select(F.col("b").alias("node"), F.col("a").alias("hub"), F.pmod(F.hash("b"), F.col("shares")).alias("share"), F.lit(1).alias("role"))
    hubs = shares.select(F.col("a").alias("node"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("role"))
    asked = saved(members.union(hubs))
    texts = some_texts(docs, asked).join(asked, "node").select("hub", "share", "role", "node", "text")
    spark = docs.sparkSession
    dealt = texts.repartition(width(spark), "hub", "share").sortWithinPartitions("hub", "share", "role")

    def compare(batches):
        key, mine = None, []
        for b in batches:
            a, c = [], []
            for hub, share, role, node, text in zip(*(b.column(i).to_pylist() for i in range(4)), byte_texts(b)):
                if key != (hub, share):
                    key, mine = (hub, share), []
                x = exact_set(text, size)
                if role == 0:
                    mine.append(x)
                    continue
                for y in mine:
                    inside = len(x & y) if min(len(x), len(y)) * 100 >= max(len(x), len(y)) * percent else 0
                    if inside and 100 * inside >= percent * (len(x) + len(y) - inside):
                        a.append(hub)
                        c.append(node)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return saved(map_arrow(dealt, compare, "a long, b long"))


def some_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``docs`` (node, text) whose node is among ``nodes``, and the few others that a filter lets pass: most texts are left before anything is shuffled."""
    names = saved(nodes.select("node").distinct())
    over = Filter(names.n_rows)
    return over.passing(docs, "node", over.table(names, "node")).where("maybe").select("node", "text")


def labelled(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """``entries`` with the component of each node, itself where ``labels`` has none."""
    return entries.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def so_far(labels: DataFrame) -> DataFrame:
    """Links (a, b) that have the components ``labels``, fewer than those that these were found from."""
    return labels.select(F.col("node").alias("a"), F.col("label").alias("b"))


def more_hubs(entries: DataFrame, hot: list, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a hub and a member of a list, in different components so far. Each list that has several has HUBS hubs, equally central ones in as many orders."""
    own = saved(labelled(entries, labels))
    ranks = [F.min(F.struct("far", F.xxhash64("node", F.lit(i)), "node", "n", "label")).alias(f"h{i}") for i in range(HUBS)]
    hubs = own.groupBy("v").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), *ranks).where("l1 != l2").select("v", F.array_distinct(F.array(*[F.struct(f"h{i}.node", f"h{i}.n", f"h{i}.label") for i in range(HUBS)])).alias("hubs"))
    both = join_hot(own, hubs, "v", hot).select("node", "n", "label", F.explode("hubs").alias("p"))
    out = saved(both.where((F.col("label") != F.col("p.label")) & sizes_fit(F.col("n"), F.col("p.n"), percent)).select(F.col("p.node").alias("a"), F.col("node").alias("b")).distinct())
    forget(own)
    return out


def contested(entries: DataFrame, hot: list, labels: DataFrame, classes: DataFrame, percent: int, k: int) -> DataFrame:
    """(node, label) of the documents that may have a link to another component, ``labels`` being the components so far, ``hot`` the hot values of ``entries``.

    Both ends of such a link stand in some list with two components, and share so many sketch values; so each has that
    many values that documents of another component have too, whichever they are. What has fewer goes, which leaves
    others with fewer: two rounds.
    """
    own = saved(labelled(entries, labels).select("v", "node", "label"))
    mixed = own.groupBy("v").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 != l2").select("v")
    nodes = saved(join_hot(own, mixed, "v", hot).select("node", "label").distinct())
    sketches = saved(classes.join(nodes, "node").select("node", "label", least_shared(F.col("n"), percent, k).alias("least"), F.explode("sketch").alias("v")))
    hot = hot_keys(sketches, "v")
    for _ in range(2):
        mixed = sketches.groupBy("v").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 != l2").select("v")
        both = join_hot(sketches, mixed, "v", hot)
        stay = both.groupBy("node", "least").agg(F.count(F.lit(1)).alias("c")).where("c >= least").select("node")
        last, sketches = sketches, saved(both.join(stay, "node").select("node", "label", "least", "v"))
        forget(last)
    forget(own, nodes)
    return saved(sketches.select("node", "label").distinct())


def across(nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, label) with different labels that may be alike enough.

    An exact prefix filter over their whole sets: in the order from rare to frequent two such sets share a value early
    enough in both that what is left after it still makes up the intersection that their sizes ask for. A copy too far
    from its group's other members has that many values of its own before all shared ones, so it meets none of them,
    and a list gives few pairs.
    """

    def whole(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = [shingle_set(t, size).astype(np.int64) for t in byte_texts(part)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "vs"])

    sets = saved(map_arrow(some_texts(docs, nodes).join(nodes.select("node"), "node"), whole, "node long, vs array<long>"))
    values = sets.select("node", F.size("vs").cast("long").alias("n"), F.explode("vs").alias("v"))
    times = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = values.join(times, "v").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    # values of no other set come first; a set's partners share a value among its first n - ceil(n * percent / 100) + 1
    early = F.floor(F.col("n") * (100 - percent) / 100) + 1 - (F.col("n") - F.size("vs"))
    kept = shared.where(early > 0).select("node", "n", (F.col("n") - F.size("vs")).alias("alone"), F.posexplode(F.slice("vs.v", F.lit(1), early.cast("int"))).alias("i", "v"))
    # the largest partner whose intersection, as its size and this one's ask for it, can still follow from here
    most = F.floor((F.col("n") - F.col("alone") - F.col("i")) * (100 + percent) / percent) - F.col("n")
    kept = saved(kept.select("v", "node", "n", most.alias("most")).where(F.col("most") * 100 >= F.col("n") * percent).join(nodes, "node"))
    kinds = kept.groupBy("v").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 != l2").select("v", "l1")
    parts = kept.join(kinds, "v")
    # one side leaves out the list's first component, so that a large one isn't set against itself
    left = parts.where("label != l1").select("v", "l1", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("most").alias("mx"), F.col("label").alias("lx"))
    right = kept.select("v", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("most").alias("my"), F.col("label").alias("ly"))
    pairs = left.join(right, "v").where((F.col("lx") != F.col("ly")) & ((F.col("ly") == F.col("l1")) | (F.col("x") < F.col("y"))) & (F.col("ny") <= F.col("mx")) & (F.col("nx") <= F.col("my")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, k: int = K, sure: bool = False) -> DataFrame:
    """For each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked where 100 times the shared shingles are at least ``percent`` times those of both;
    component_id is the smallest id that links lead to, the own one included, and the document with that id is kept.
    Null and empty texts, and texts without words, have no shingles and no links. Rows that share an id are one
    document: linked, and all kept if it is. A row without an id is in no component and is kept. Other columns aren't
    read; an empty table gives no rows. ``sure``: no link is left to the sketches' chance, at the cost of a shuffle of
    all sets.
    """
    base = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    rows = saved(marks(base, size, k))
    named = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = saved(named.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    texts = base.select(F.col("doc_id").alias("node"), "text").where("node IS NOT NULL")
    entries = saved(rare_values(classes, percent, k))
    hubs = entries.groupBy("v").agg(F.min(F.struct("far", "node", "n")).alias("p"))
    hot = hot_keys(entries, "v")
    star = join_hot(entries, hubs, "v", hot).where((F.col("node") != F.col("p.node")) & sizes_fit(F.col("n"), F.col("p.n"), percent))
    star = saved(star.select(F.col("p.node").alias("a"), F.col("node").alias("b")).distinct())
    links = verified(likely(star, classes, percent, k), texts, size, percent)
    labels = components(links)
    if sure:
        again = across(classes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label")).distinct(), texts, size, percent)
        links = so_far(labels).union(verified(again, texts, size, percent))
    else:
        stars = more_hubs(entries, hot, labels, percent)
        links = so_far(labels).union(verified(likely(stars.join(star, ["a", "b"], "left_anti"), classes, percent, k), texts, size, percent))
        labels = components(links)
        tried = star.union(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        again = across(contested(entries, hot, labels, classes, percent, k), texts, size, percent).join(tried, ["a", "b"], "left_anti")
        links = so_far(labels).union(verified(likely(again, classes, percent, k), texts, size, percent))
    # classes whose first document has one id are one document
    links = links.union(classes.groupBy("node").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("node").alias("a"), F.col("node").alias("b")))
    labels = components(links)
    of = saved(classes.join(labels, "node", "left").select("d1", "d2", F.coalesce("label", "node").alias("component_id")))
    forget(entries, star, classes)
    out = rows.select("doc_id", "n", "d1", "d2").join(of, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates; all columns. See near_groups."""
    gone = near_groups(docs, size, percent).where("NOT kept").select(F.col("doc_id").alias("id"), F.lit(None).cast("long").alias("second"))
    return without(docs, gone)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"), size=3, percent=85)
