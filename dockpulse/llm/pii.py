"""Personal data in texts: generators propose spans, boosted trees judge those that the strict forms leave open. Built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockpulse.llm.workspace import stored, text_or_empty

KINDS = ("email", "ip", "card", "phone")
# Characters of the text beside a span that the trees see.
CONTEXT = 24
# So many bins that the trees take the places of their splits from all of up to BINS_OF_TREES ** 2 descriptions; of more Spark looks at about so many for the places, and at all for the trees.
BINS_OF_TREES = 256
TREES, TREE_DEPTH, SEED = 20, 4, 7
# Parts that the labelled spans are dealt into by hash of their text. The chances that the thresholds come from are each given by trees that did not see the part.
FOLDS = 3
# A threshold is the least chance from which on this share of the labelled spans is right, by so many of them at least.
PRECISION, LEAST_SPANS, BINS = 0.99, 20, 50

_LOCAL = "A-Za-z0-9._%+-"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


@dataclass(frozen=True)
class Generator:
    """A pattern that proposes spans of a kind, leftmost and without overlaps; several generators of a kind may overlap."""

    kind: int
    pattern: str
    strict: bool = False


# The strict forms find what the plain patterns find: possessive repeats and the look behind only keep a long run from being tried from each of its places.
GENERATORS = (
    Generator(0, rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", strict=True),
    Generator(1, r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", strict=True),
    Generator(2, r"(?<![0-9])[0-9](?:[ -]?[0-9])++", strict=True),
    Generator(3, r"\+[0-9][ ().0-9-]+[0-9]", strict=True),
    # an address with spaces around its sign, or with the sign written out
    Generator(0, rf"(?<![{_LOCAL}])[{_LOCAL}]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++"),
    # the last four of a longer run of dotted numbers
    Generator(1, r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"),
    # a number next to other numbers, written in one or in groups of four
    Generator(2, r"(?<![0-9])[0-9]{16,19}(?![0-9])"),
    Generator(2, r"(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])"),
    # without the plus, national or international
    Generator(3, r"(?<![0-9])\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"),
    Generator(3, r"(?<![0-9])[0-9]{1,5}[ .-]\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"),
)

# Words before a span that speak for a kind or against all; fixed values.
WORDS = {
    "mail_word": "mail|contact|write to",
    "net_word": r"\bip\b|host|server|address|login",
    "card_word": "card|visa|credit|payment|account",
    "phone_word": "phone|tel|call|fax|mobile",
    "other_word": r"\bid\b|isbn|order|version|token|key|page|no\.",
}
SHAPE = (
    "is_email", "is_ip", "is_card", "is_phone", "chars", "digits", "letters", "spaces", "dashes", "dots", "brackets", "plus", "groups",
    "longest_group", "luhn", "octets", "ending", "left_digit", "left_letter", "left_joined", "right_digit", "right_letter", "right_joined",
)
FEATURES = (*SHAPE, *WORDS)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _octets(text: Column) -> Column:
    return text.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")


def _card(text: Column) -> Column:
    digits = _digits(text)
    return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)


def _ending(text: Column) -> Column:
    """Whether a host ends in a name of letters."""
    return text.rlike(r"[A-Za-z]{2}$")


def valid(kind: Column, text: Column) -> Column:
    """The check of a strict form."""
    phone = F.length(_digits(text)).between(8, 15)
    return F.when(kind == 0, True).when(kind == 1, _octets(text)).when(kind == 2, _card(text)).otherwise(phone)


def plausible(kind: Column, text: Column) -> Column:
    """What a span that no strict form covers has to have, so as not to be an example of the opposite."""
    phone = F.length(_digits(text)).between(10, 15) & (_count(text, "[ .()-]") >= 2)
    return F.when(kind == 0, _ending(text)).when(kind == 1, _octets(text)).when(kind == 2, _card(text)).otherwise(phone)


_PIECES = "array<struct<generator:int,i:int,n:bigint,match:string,head:string,tail:string>>"


def proposed(docs: DataFrame) -> DataFrame:
    """`uid, doc_id, kind, start, end, match, left, right, strict, kept`, stored: every span that a generator proposes, in code points, end exclusive.

    `strict` spans come from a strict form, `kept` of them pass its check. A document without spans has one row without kind. Each pattern marks its matches in one
    pass; the pieces between marks go through one exchange by document, as their lengths and the few characters beside a match, and running sums of these are the places.
    """
    mark, other = "\x01", "\x02"
    text = F.translate(text_or_empty(), mark, other)

    def pieces_of(number: int, pattern: str) -> Column:
        pieces = F.split(F.regexp_replace(text, pattern, f"{mark}$0{mark}"), mark, -1)
        rows = F.transform(
            pieces,
            lambda x, i: F.struct(
                F.lit(number).alias("generator"),
                i.alias("i"),
                F.length(x).cast("bigint").alias("n"),
                F.when(i % 2 == 1, x).alias("match"),
                F.when(i % 2 == 0, F.left(x, F.lit(CONTEXT))).alias("head"),
                F.when(i % 2 == 0, F.right(x, F.lit(CONTEXT))).alias("tail"),
            ),
        )
        return F.when(text.rlike(pattern), rows).otherwise(F.array().cast(_PIECES))

    found = [pieces_of(number, g.pattern) for number, g in enumerate(GENERATORS)]
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), F.concat(*found).alias("pieces"))
    pieces = rows.select("uid", "doc_id", F.explode_outer("pieces").alias("piece"))
    by = Window.partitionBy("uid", "generator").orderBy("i")
    rows = pieces.select("uid", "doc_id", "piece.*").repartition("uid")
    rows = rows.select(
        "uid",
        "doc_id",
        "generator",
        "match",
        F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        F.lag("tail").over(by).alias("left"),
        F.lead("head").over(by).alias("right"),
    ).where("generator is null or match is not null")
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("generator"))
    rows = rows.withColumn("kind", of([g.kind for g in GENERATORS])).withColumn("strict", of([g.strict for g in GENERATORS]))
    spans = rows.groupBy("uid", "doc_id", "kind", "start", (F.col("start") + F.length("match")).alias("end")).agg(
        F.first("match").alias("match"),
        F.max(F.coalesce("left", F.lit(""))).alias("left"),
        F.max(F.coalesce("right", F.lit(""))).alias("right"),
        F.max(F.coalesce("strict", F.lit(False))).alias("strict"),
    )
    kept = F.col("strict") & valid(F.col("kind"), F.col("match"))
    return stored(spans.withColumn("kept", F.coalesce(kept, F.lit(False))), "spans")


def covered(spans: DataFrame) -> DataFrame:
    """Spans with `inside` (a kept span of their kind holds them), `beside` (they overlap a kept span) and `open` (they overlap a strict span of their kind).

    By running extremes over the spans of a document in order of their start, not by pairs. `beside` and `open` are about other spans as well as the span itself.
    """

    def upto(value: Column, order: Column, *by: str) -> Column:
        return value.over(Window.partitionBy("uid", *by).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))

    def overlaps(which: Column, *by: str) -> Column:
        before = upto(F.max(F.when(which, F.col("end"))), F.col("start").asc(), *by)
        after = upto(F.min(F.when(which, F.col("start"))), F.col("start").desc(), *by)
        return F.coalesce((before > F.col("start")) | (after < F.col("end")), F.lit(False))

    holds = upto(F.max(F.when(F.col("kept"), F.col("end"))), F.col("start").asc(), "kind")
    return spans.select(
        "*",
        F.coalesce(holds >= F.col("end"), F.lit(False)).alias("inside"),
        overlaps(F.col("kept")).alias("beside"),
        overlaps(F.col("strict"), "kind").alias("open"),
    )


def described(spans: DataFrame) -> DataFrame:
    """Spans with FEATURES: the form of the match and what stands beside it."""
    match, left, right = F.col("match"), F.lower("left"), F.lower("right")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    digits = _digits(match)
    groups = F.filter(F.split(match, "[^0-9]+"), lambda g: g != "")
    shape = {
        **{f"is_{name}": flag(F.col("kind") == k) for k, name in enumerate(KINDS)},
        "chars": F.length(match).cast("double"),
        "digits": F.length(digits).cast("double"),
        "letters": _count(match, "[A-Za-z]"),
        "spaces": _count(match, " "),
        "dashes": _count(match, "-"),
        "dots": _count(match, "[.]"),
        "brackets": _count(match, r"[()\[\]]"),
        "plus": flag(match.startswith("+")),
        "groups": F.size(groups).cast("double"),
        "longest_group": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)).cast("double"),
        "luhn": flag(F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)),
        "octets": flag(_octets(match)),
        "ending": flag(_ending(match)),
        "left_digit": flag(left.rlike("[0-9]$")),
        "left_letter": flag(left.rlike(r"\p{L}$")),
        "left_joined": flag(left.rlike("[0-9][ .-]$")),
        "right_digit": flag(right.rlike("^[0-9]")),
        "right_letter": flag(right.rlike(r"^\p{L}")),
        "right_joined": flag(right.rlike("^[ .-][0-9]")),
    }
    words = {name: flag(left.rlike(words)) for name, words in WORDS.items()}
    return spans.select("*", *[c.alias(name) for name, c in (shape | words).items()])


def labelled(spans: DataFrame) -> DataFrame:
    """The spans whose label is clear, with `label`: 1 inside a kept span of their kind; 0 without overlap with kept ones, if implausible, and not part of a longer strict span.

    A strict span that fails its check is an example of the opposite itself, its parts are left open: they are what the trees are for.
    """
    against = ~F.col("beside") & ~plausible(F.col("kind"), F.col("match")) & (F.col("strict") | ~F.col("open"))
    label = F.when(F.col("inside"), 1.0).when(against, 0.0)
    return spans.withColumn("label", label).where("label is not null")


def examples(spans: DataFrame) -> DataFrame:
    """`kind, fold, label, FEATURES, n`, stored: all labelled spans, those that look alike to the trees as one row with their number `n`.

    Spans of one text and one description count once, so that copies of a document do not outweigh the others. What is written grows with the descriptions, not with the spans.
    """
    fold = F.pmod(F.xxhash64("match"), F.lit(FOLDS)).cast("int").alias("fold")
    once = described(labelled(spans)).select("kind", "match", fold, "label", *FEATURES).distinct()
    return stored(once.groupBy("kind", "fold", "label", *FEATURES).agg(F.count("*").cast("double").alias("n")), "examples")


def thresholds(judged: DataFrame) -> list[float]:
    """Per kind the least chance (a multiple of 1 / BINS) from which on the labelled spans are right in a share of PRECISION; 2 if there is none."""
    place = F.floor(F.col("chance") * BINS).cast("int").alias("bin")
    sums = judged.groupBy("kind", place).agg(F.sum(F.col("label") * F.col("n")).alias("right"), F.sum("n").alias("n")).collect()
    found = []
    for kind in range(len(KINDS)):
        right = n = 0
        least = 2.0
        for r in sorted((r for r in sums if r["kind"] == kind), key=lambda r: -r["bin"]):
            right, n = right + r["right"], n + r["n"]
            if n >= LEAST_SPANS and right >= PRECISION * n and r["bin"] * 2 >= BINS:
                least = r["bin"] / BINS
        found.append(least)
    return found


def chosen(spans: DataFrame) -> DataFrame:
    """`uid, kind, start, end` of the spans that the trees add: those from their kind's threshold on that overlap neither a kept span nor a better added one.

    The trees are fitted on all labelled spans. For the thresholds every fold is judged by trees fitted on the others, so all of them count there too, none by
    trees that knew it. Spans that overlap in a chain are taken from the likeliest on, of equal ones the longest, then the first.
    """
    nothing = spans.where("false").select("uid", "kind", "start", "end")
    known = examples(spans)
    folds: dict[int, set[float]] = {}
    for r in known.select("fold", "label").distinct().collect():
        folds.setdefault(r["fold"], set()).add(r["label"])
    if any(set().union(*(labels for other, labels in folds.items() if other != fold)) != {0.0, 1.0} for fold in range(FOLDS)):
        return nothing
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    learner = GBTClassifier(labelCol="label", weightCol="n", maxIter=TREES, maxDepth=TREE_DEPTH, maxBins=BINS_OF_TREES, seed=SEED, stepSize=0.2, cacheNodeIds=False)
    fitted = lambda rows: learner.fit(vector.transform(rows).select("label", "n", "features"))

    def judge(model, rows: DataFrame) -> DataFrame:
        return model.transform(vector.transform(rows)).withColumn("chance", F.get(vector_to_array("probability"), F.lit(1)))

    judged = [judge(fitted(known.where(F.col("fold") != fold)), known.where(F.col("fold") == fold)).select("kind", "label", "n", "chance") for fold in sorted(folds)]
    least = thresholds(reduce(DataFrame.unionByName, judged))
    likely = judge(fitted(known), described(spans.where("match is not null and not strict and not beside")))
    likely = likely.where(F.col("chance") >= F.get(F.array(*map(F.lit, least)), F.col("kind")))
    chain = Window.partitionBy("uid").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    likely = likely.select("uid", "kind", "start", "end", "chance", F.max("end").over(chain).alias("reached"))
    new = F.when(F.coalesce(F.col("reached") <= F.col("start"), F.lit(True)), 1).otherwise(0)
    likely = likely.withColumn("chain", F.sum(new).over(Window.partitionBy("uid").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, 0)))
    best = F.struct((-F.col("chance")).alias("a"), (F.col("start") - F.col("end")).alias("b"), "start", "kind", "end")
    chains = likely.groupBy("uid", "chain").agg(F.array_sort(F.collect_list(best)).alias("spans"))
    taken = F.aggregate(
        "spans",
        F.slice("spans", 1, 0),
        lambda have, s: F.when(F.exists(have, lambda h: (h["start"] < s["end"]) & (s["start"] < h["end"])), have).otherwise(F.concat(have, F.array(s))),
    )
    return chains.select("uid", F.explode(taken).alias("s")).select("uid", "s.kind", "s.start", "s.end")


def _listed(spans: Column) -> Column:
    name = lambda s: F.get(F.array(*map(F.lit, KINDS)), s["kind"])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """`doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added` of every row, null text as empty.

    The counts and the digest are of the strict spans that pass their checks, `spans` lists these and the `n_added` ones that the trees add. The trees and
    thresholds are fitted on all labelled spans of all rows; without examples of both labels nothing is added. Texts of any length are scanned whole;
    rows that repeat are scanned each; no rows give no rows; a null doc_id stays null. Other columns are not looked at.
    """
    spans = stored(covered(proposed(docs)), "covered-spans")
    added = chosen(spans).withColumn("added", F.lit(True))
    rows = spans.where("kept or kind is null").select("uid", "doc_id", "kind", "start", "end", F.lit(False).alias("added"))
    owners = spans.groupBy("uid").agg(F.first("doc_id").alias("doc_id"))
    rows = rows.select("uid", "kind", "start", "end", "added").unionByName(added)
    one = F.struct("kind", "start", "end")
    sums = rows.groupBy("uid").agg(
        *[F.count_if((F.col("kind") == k) & ~F.col("added")).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.collect_list(F.when(~F.col("added") & F.col("kind").isNotNull(), one)).alias("base"),
        F.collect_list(F.when(F.col("kind").isNotNull(), one)).alias("all"),
        F.count_if("added").alias("n_added"),
    )
    nothing = F.lit(0).cast("bigint")
    return owners.join(sums, "uid", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{name}", nothing).alias(f"n_{name}") for name in KINDS],
        F.sha2(F.coalesce(_listed(F.col("base")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(_listed(F.col("all")), F.lit("")).alias("spans"),
        F.coalesce("n_added", nothing).alias("n_added"),
    )
