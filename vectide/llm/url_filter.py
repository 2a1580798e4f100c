"""URL filters: an allow and block list of host suffix and path prefix, and logistic regression on hashed character
n-grams of host and path for the rest. DataFrame operations only, training included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, pick, read

#: The small labelled table that the query's model learns from, by words that a host's name is made of: urls that a filter
#: should block (1) or allow (0). Each word stands in four urls; prefixes, domains and paths go round alike for both kinds.
BLOCKED = "casino bets poker slots jackpot roulette lottery pills viagra meds pharma cams adult dates xxx porn escort loans payday credit cash crypto forex ads banner popup click track pixel warez torrent crack keygen phish replica".split()
ALLOWED = "news library garden weather university museum python recipes history science city school hospital theatre music travel football nature physics biology grammar poetry cooking painting maps railway castle harbour forest orchestra village journal archive college bakery".split()
PREFIXES, TAILS, DOMAINS, PATHS = ["www.", "", "m.my", "blog."], ["", "-site", "24"], [".example.com", ".example.net", ".example.org"], ["en/{}", "de/{}.html", "fr/{}/", "es/{}.php", ""]
SEEDS = [
    (y, f"https://{PREFIXES[(i + j) % 4]}{w}{TAILS[(i + 2 * j) % 3]}{DOMAINS[(i + j) % 3]}/{PATHS[(i + 3 * j) % 5].format(1000 + 37 * i + j)}")
    for y, words in ((1, BLOCKED), (0, ALLOWED)) for i, w in enumerate(words) for j in range(4)
]

#: (block, rule): the contract's rules; a rule is a host followed by the start of a path.
RULES = [(True, "com/en/"), (False, "example.com/en/7"), (False, "net/de/"), (True, "example.net/de/8"), (True, "org/es/")]

#: Width of the hashed features, epochs, rate and weight decay of training.
BITS, EPOCHS, RATE, DECAY = 11, 40, 2.0, 1e-4
#: A labelled table may have so many rows; it is gathered into one row of 16 kB each, 33 MB, so its size must be bounded.
MAX_LABELLED = 2_000


def rows_of(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    """A small table of literals, without an RDD."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])))


def seeds(spark: SparkSession) -> DataFrame:
    return rows_of(spark, [(u, y) for y, u in SEEDS], "url", "label")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path on up to ``?``, ``#`` or the end. Both empty for null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return tuple(F.coalesce(c, F.lit("")) for c in (ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)))


def features(host: Column, path: Column) -> Column:
    """Hashed positions, 0 to 2^BITS - 1, of the character 3- and 4-grams of host and path, each marked with its part; repeats stay."""
    def grams(text: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))

    def tagged(grams_: Column, tag: str) -> Column:
        return F.transform(grams_, lambda g: F.concat(F.lit(tag), g))

    parts = [tagged(grams(F.concat(F.lit("^"), text, F.lit("$")), n), f"{part}{n}") for part, text in (("h", host), ("p", path)) for n in (3, 4)]
    return F.transform(F.concat(*parts), lambda g: F.crc32(F.encode(g, "utf-8")).bitwiseAND((1 << BITS) - 1).cast("int"))


def train(labelled: DataFrame, url: str = "url", label: str = "label") -> list[float]:
    """Weights, the bias last, by stochastic gradient descent over the rows ordered by url and label.

    The table is bounded by MAX_LABELLED, so it is folded in one row: an ``aggregate`` over its examples within one
    over the epochs. Rows without a url or a label are left out; without rows all weights are 0 and nothing is blocked.
    """
    size = (1 << BITS) + 1
    rows = pick(labelled, url, label).where(F.col(url).isNotNull() & F.col(label).isNotNull())
    if rows.limit(MAX_LABELLED + 1).count() > MAX_LABELLED:
        raise ValueError(f"the labelled table may have {MAX_LABELLED} rows at most")
    host, path = split_url(F.col(url))
    rows = rows.select(F.col(url).alias("u"), F.col(label).cast("double").alias("y"), features(host, path).alias("f"))
    rows = rows.select(F.struct(F.sha2("u", 256).alias("by"), "u", "y", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == size - 1, F.lit(1.0)).otherwise(F.size(F.filter("f", lambda x: x == i)) / F.sqrt(F.size("f").cast("double")))).alias("x")).alias("e"))
    one = rows.agg(F.array_sort(F.collect_list("e")).alias("es"))

    def step(w: Column, e: Column) -> Column:
        z = F.aggregate(F.zip_with(w, e["x"], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        error = e["y"] - 1 / (1 + F.exp(-z))
        # the array of one holds the error, computed once an example
        return F.element_at(F.transform(F.array(error), lambda d: F.zip_with(w, e["x"], lambda a, b: a * (1 - DECAY) + d * b * RATE)), 1)

    epochs = F.aggregate(F.sequence(F.lit(1), F.lit(EPOCHS)), F.array_repeat(F.lit(0.0), size), lambda w, _: F.aggregate("es", w, step))
    return list(one.select(epochs.alias("w")).first()["w"])


def probability(weights: list[float], host: Column, path: Column) -> Column:
    """The model's probability that a url is to be blocked."""
    w = F.array(*[F.lit(float(x)) for x in weights[:-1]])
    f = features(host, path)
    z = F.aggregate(F.transform(f, lambda i: F.element_at(w, i + 1)), F.lit(0.0), lambda a, b: a + b) / F.sqrt(F.size(f).cast("double")) + weights[-1]
    return 1 / (1 + F.exp(-z))


def listed(spark: SparkSession, rules: list[tuple[bool, str]]) -> DataFrame:
    """One row: a map from a rule's host to its rules as (path, at, block, rule), ``at`` being the rule's place in the list."""
    rows = []
    for at, (block, rule) in enumerate(rules):
        host, _, path = rule.partition("/")
        rows.append((host.lower(), "/" + path, at, block, rule))
    if not rows:
        return spark.range(1).select(F.create_map().cast("map<string,array<struct<path:string,at:int,block:boolean,rule:string>>>").alias("m"))
    lists = rows_of(spark, rows, "h", "path", "at", "block", "rule").groupBy("h").agg(F.collect_list(F.struct("path", "at", "block", "rule")).alias("rs"))
    return lists.agg(F.map_from_entries(F.collect_list(F.struct("h", "rs"))).alias("m"))


def judge(pages: DataFrame, rules: list[tuple[bool, str]], weights: list[float], key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, probability for each row of ``pages``.

    ``rules``: (block, host followed by the start of a path). A rule fits its host and all subdomains where the path
    starts with the rule's; the longest rule wins, at a tie the one that comes first. Where none fits, rule is null
    and the verdict is the model's: block from a probability of 0.5. Null urls and urls without ``://`` have an empty
    host and path, which no rule fits, and are judged by the model like any other. Repeated rows are judged alike; an
    empty table gives no rows; other columns are not read.
    """
    base = pick(pages, key, url)
    host, path = split_url(F.col(url))
    base = base.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    # a host's rules and those of its parents are looked up in a map, so the work follows the host's labels, not the rules
    base = base.select("*", listed(pages.sparkSession, rules).scalar().alias("m"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    own = F.flatten(F.transform(parents, lambda h: F.coalesce(F.element_at("m", h), F.array().cast("array<struct<path:string,at:int,block:boolean,rule:string>>"))))
    fit = F.filter(own, lambda r: F.startswith(F.col("path"), r["path"]))
    order = F.transform(fit, lambda r: F.struct((-F.length(r["rule"])).alias("short"), r["at"].alias("at"), r["block"].alias("block"), r["rule"].alias("rule")))
    best = F.array_min(order)
    base = base.select("page_id", "host", "path", best.alias("best"), probability(weights, F.col("host"), F.col("path")).alias("probability"))
    block = F.coalesce(F.col("best.block"), F.col("probability") >= 0.5)
    return base.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.when(block, "block").otherwise("allow").alias("verdict"), "probability")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), RULES, train(seeds(spark)))
