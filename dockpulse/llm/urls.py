"""URL filters: host and path rules, and gradient-boosted trees on lexical features for what no rule covers. Built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockpulse.llm.workspace import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Labelled urls that the trees are trained on: those with the smallest hash.
SAMPLE_ROWS = 20_000
TREES, TREE_DEPTH, SEED = 20, 4, 7
# Weight, in urls, of the overall share of blocked urls in the share of a suffix.
SMOOTHING = 20.0
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_ratio", "entropy", "host_entropy",
    "parameters", "fragment", "suffix_blocked", "top_blocked",
)


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, where the path starts with the rule's."""

    place: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        name, slash, rest = self.place.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)


# The order does not matter: the longest that fits wins.
RULES = (
    Rule("net/", "block"),
    Rule("example.net/en/", "allow"),
    Rule("example.com/de/", "block"),
    Rule("org/fr/", "allow"),
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(urls: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows with `host`, `path`, and `rule` and `ruled` (its verdict) of the longest rule that fits, null without one."""
    host, path = parts(F.col("url"))
    rows = urls.withColumn("host", host).withColumn("path", path)
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.place), r.place)):
        fits = r.fits(F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, r.place).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rows.withColumn("rule", rule).withColumn("ruled", verdict)


def entropy(text: Column) -> Column:
    """Bits per character, 0 for an empty text: the characters are sorted into one array by splitting at every place."""
    n = F.char_length(text).cast("double")
    seen = F.array_distinct(F.split(text, ""))
    times = lambda c: F.char_length(text) - F.char_length(F.replace(text, c, F.lit("")))
    total = F.aggregate(seen, F.lit(0.0), lambda s, c: s + F.when(c != "", times(c) * F.log2(times(c) / n)).otherwise(0.0))
    return F.when(n > 0, -total / n).otherwise(0.0)


def lexical(rows: DataFrame) -> DataFrame:
    """Rows with the features of the url itself, and `suffix` and `top`: the last two labels and the last label of the host."""
    url = F.coalesce("url", F.lit(""))
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    length = F.char_length(url).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return rows.select(
        "*",
        length.alias("url_length"),
        F.char_length("host").cast("double").alias("host_length"),
        F.char_length("path").cast("double").alias("path_length"),
        count(F.col("path"), "/+[^/]").alias("depth"),
        count(F.col("host"), r"[^.]+").alias("labels"),
        count(F.col("host"), "-").alias("hyphens"),
        (count(url, "[0-9]") / F.greatest(length, F.lit(1.0))).alias("digit_ratio"),
        entropy(url).alias("entropy"),
        entropy(F.col("host")).alias("host_entropy"),
        count(query, "[^&]+").alias("parameters"),
        F.when(F.instr(url, "#") > 0, 1.0).otherwise(0.0).alias("fragment"),
        F.substring_index("host", ".", -2).alias("suffix"),
        F.substring_index("host", ".", -1).alias("top"),
    )


def suffix_shares(rows: DataFrame, share: float) -> DataFrame:
    """`host, suffix_blocked, top_blocked` of every host: what the labels say of the other hosts of its suffix, and of the other suffixes of its last label.

    Shares are smoothed towards the overall one, which stands alone where there are no others. A host's own labels never enter its features, in training or
    later: they would be the rules looked up again. Rows are summed by host before the exchange, so a host with a third of all urls is one row of the sums.
    """
    hosts = rows.groupBy("host", "suffix", "top").agg(F.coalesce(F.sum("blocked"), F.lit(0.0)).alias("b"), F.count("blocked").alias("n"))
    suffixes = hosts.groupBy("suffix", "top").agg(F.sum("b").alias("suffix_b"), F.sum("n").alias("suffix_n"))
    tops = suffixes.groupBy("top").agg(F.sum("suffix_b").alias("top_b"), F.sum("suffix_n").alias("top_n"))
    both = hosts.join(suffixes.drop("top"), "suffix").join(tops, "top")

    def others(all_: str, own: str) -> Column:
        blocked, n = (F.col(f"{all_}_{c}") - F.col(f"{own}_{c}" if own else c) for c in "bn")
        return (blocked + SMOOTHING * share) / (n + SMOOTHING)

    return both.select("host", others("suffix", "").alias("suffix_blocked"), others("top", "suffix").alias("top_blocked"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`page_id, host, path, rule, verdict, score` of every page: the rule's verdict, else that of the trees (`score`: chance of block).

    The trees learn from urls with a rule, whose verdict is their label; suffix shares count all of these, the trees see at most `SAMPLE_ROWS`.
    If those have one verdict only, it is everybody's; if there are none, all is allowed. Rows that repeat are judged each, urls of any length whole. A chance of
    exactly 0.5 is block. Null urls and those without a host share the empty host; no rows give no rows; further columns are not read.
    """
    rows = ruled(pages.select("page_id", "url"), rules)
    rows = stored(lexical(rows), "urls")
    rows = rows.withColumn("blocked", (F.col("ruled") == "block").cast("double"))
    labelled = rows.where("ruled is not null")
    sums = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("blocked"), F.lit(0.0)).alias("b")).first()
    share = sums["b"] / sums["n"] if sums["n"] else 0.0
    if 0 < share < 1:
        order = F.xxhash64("url", "page_id")
        sample = labelled.withColumn("order", order).orderBy("order", "url", "page_id").limit(SAMPLE_ROWS)
        shares = stored(suffix_shares(rows, share), "url-hosts")
        sample = sample.join(shares, "host")
        vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        learner = GBTClassifier(
            labelCol="blocked", maxIter=TREES, maxDepth=TREE_DEPTH, seed=SEED, stepSize=0.2, cacheNodeIds=False
        )
        model = learner.fit(vector.transform(stored(sample.select("blocked", *FEATURES), "url-sample")))
        judged = model.transform(vector.transform(rows.join(shares, "host")))
        chance = F.get(vector_to_array("probability"), F.lit(1))
    else:
        judged, chance = rows, F.lit(float(share))
    verdict = F.coalesce(F.col("ruled"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    judged = judged.withColumn("score", chance)
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
