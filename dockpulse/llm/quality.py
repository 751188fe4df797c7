"""Quality rules that vote or abstain, weighed by expectation-maximisation. Built-in functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockpulse.llm.workspace import SPACE, WORD, stored

SHINGLE_WORDS = 3
LEAST_WORDS = 50
SYMBOLS = "#*$%&|<>"

KEPT_FROM = 0.5


def signals(docs: DataFrame) -> DataFrame:
    """The frame with a struct column `signals` of counts over the whole `text`; null counts as empty.

    Arrays that a lambda looks into are columns of an earlier projection, so that they are made once per row. A repeated window is
    found by sorting hashed windows with their places: n log n for a text of n words. Texts without repeats skip the sort.
    """
    kept = F.struct(*docs.columns).alias("row")
    text = F.coalesce("text", F.lit(""))
    d = docs.select(kept, text.alias("t"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    d = d.select("*", F.size("words").alias("n"))
    start = F.slice("words", F.lit(1), F.greatest(F.col("n") - SHINGLE_WORDS + 1, F.lit(0)))
    window = F.transform(start, lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD))
    d = d.select("row", "t", "words", "n", window.alias("windows"), lines.alias("lines"))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.select("row", "t", "words", "n", "lines", F.when(repeats, placed).alias("placed"))

    def twice(x: Column, j: Column) -> Column:
        before = F.get("placed", j - 1)["h"] == x["h"]
        return F.coalesce(before, F.lit(False)) | F.coalesce(F.get("placed", j + 1)["h"] == x["h"], F.lit(False))

    places = F.sort_array(F.transform(F.filter("placed", twice), lambda x: x["i"]))
    d = d.select("row", "t", "words", "n", "lines", places.alias("places"))
    width = F.transform(
        "places",
        lambda p, j: F.least(F.lit(SHINGLE_WORDS), F.coalesce(F.get("places", j + 1) - p, F.lit(SHINGLE_WORDS))),
    )
    covered = F.aggregate(width, F.lit(0).cast("bigint"), lambda s, x: s + x)
    count = lambda pattern: F.regexp_count("t", F.lit(pattern)).cast("bigint")
    # the struct comes out of a generator: a filter on the verdict, pushed below, would repeat all of this for each rule
    return d.select(
        "row",
        F.explode(F.array(F.struct(
            F.col("n").cast("bigint").alias("n_words"),
            F.char_length(F.regexp_replace("t", f"[{SPACE}]+", "")).cast("bigint").alias("word_chars"),
            count(f"[{SYMBOLS}]").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0)).alias("n_repeat_words"),
            F.size("lines").cast("bigint").alias("n_lines"),
            count(r"\p{Lu}").alias("n_upper"),
            count("!!").alias("n_shouts"),
            count(rf"[.?!:;][\"')\]]*(?:[{SPACE}]|$)").alias("n_stops"),
        ))).alias("signals"),
    )


def base_failed() -> Column:
    s = F.col("signals")
    return (s.n_words < LEAST_WORDS) | (100 * s.n_repeat_words > 50 * s.n_words)


@dataclass(frozen=True)
class Rule:
    """A ratio of two counts that speaks against a text from `bad` on, for it up to `good`, and abstains between or without a divisor.

    `slack` is the share of good texts to which the rule may be believed to object: its threshold is set so that there are not more.
    """

    name: str
    over: str
    under: str
    good: float
    bad: float
    slack: float

    def vote(self) -> Column:
        over, under = F.col(f"signals.{self.over}"), F.col(f"signals.{self.under}")
        least, most = sorted((self.good, self.bad))
        high, low = (F.lit(-1), F.lit(1)) if self.good < self.bad else (F.lit(1), F.lit(-1))
        vote = F.when(over >= most * under, high).when(over <= least * under, low).otherwise(0)
        return F.when(under > 0, vote).otherwise(0).cast("tinyint").alias(self.name)


RULES = (
    Rule("symbols", "n_symbols", "n_words", good=0.02, bad=0.1, slack=0.001),
    Rule("repeats", "n_repeat_words", "n_words", good=0.1, bad=0.3, slack=0.001),
    Rule("lines", "n_dup_lines", "n_lines", good=0.05, bad=0.6, slack=0.01),
    Rule("capitals", "n_upper", "word_chars", good=0.15, bad=0.4, slack=0.001),
    Rule("shouts", "n_shouts", "n_words", good=0.01, bad=0.1, slack=0.001),
    Rule("stops", "n_stops", "n_words", good=0.02, bad=0.005, slack=0.02),
    Rule("short_words", "word_chars", "n_words", good=3.0, bad=2.0, slack=0.01),
    Rule("long_words", "word_chars", "n_words", good=10.0, bad=14.0, slack=0.01),
)
# A rule is believed to find at least this share of the bad texts it votes on.
LEAST_FOUND = 0.05


@dataclass(frozen=True)
class Model:
    """Share of good texts, and per rule and class (bad, good) the probability of each vote."""

    good: float
    chances: dict[str, tuple[dict[int, float], dict[int, float]]]

    def posterior(self) -> Column:
        """Probability that a row of votes is good. All weights are literals: one expression, nothing is joined or broadcast."""
        total = F.lit(math.log(self.good / (1 - self.good)))
        for name, (bad, good) in self.chances.items():
            weight = F.lit(0.0)
            for v in (-1, 1):
                weight = F.when(F.col(f"votes.{name}") == v, math.log(good[v] / bad[v])).otherwise(weight)
            total = total + weight
        return 1 / (1 + F.exp(-total))


def fit(patterns: list[tuple[tuple[int, ...], int]], rules: dict[str, float], rounds: int = 100) -> Model:
    """Expectation-maximisation over vote patterns and how many texts have each; no labels. `rules` has each rule's slack.

    Every rule has its own accuracy on good and on bad texts: a rule that finds one kind of junk is nearly always right when it objects, and
    says little when it approves. Abstaining says nothing. The start takes any objection as bad. Left alone, the bad class would
    shrink to the kind of junk that several rules find together, and single objections to other kinds would pass as errors; so the estimated
    share of objections to good texts stays within the rule's slack, and that to bad texts above `LEAST_FOUND`. Without texts,
    pseudo-counts alone answer.
    """
    belief = [0.05 if -1 in pattern else 0.95 for pattern, _ in patterns]
    total = sum(n for _, n in patterns)
    good, chances = 0.9, {}
    for _ in range(rounds):
        good = (9 + sum(b * n for b, (_, n) in zip(belief, patterns))) / (10 + total)
        for k, (name, slack) in enumerate(rules.items()):
            objections, votes_ = [1.5, 0.5 * slack], [3.0, 1.0]
            for b, (pattern, n) in zip(belief, patterns):
                for y, share in enumerate((1 - b, b)):
                    objections[y] += share * n * (pattern[k] == -1)
                    votes_[y] += share * n * (pattern[k] != 0)
            found = min(max(objections[0] / votes_[0], LEAST_FOUND), 0.999)
            wrong = min(objections[1] / votes_[1], slack)
            chances[name] = ({-1: found, 1: 1 - found}, {-1: wrong, 1: 1 - wrong})
        last, belief = belief, []
        for pattern, _ in patterns:
            odds = math.log(good / (1 - good))
            for vote, (on_bad, on_good) in zip(pattern, chances.values()):
                if vote:
                    odds += math.log(on_good[vote] / on_bad[vote])
            belief.append(1 / (1 + math.exp(-max(-500.0, min(500.0, odds)))))
        if max((abs(a - b) for a, b in zip(last, belief)), default=0) < 1e-9:
            break
    return Model(good, chances)


def learned(voted: DataFrame, rules: tuple[Rule, ...] = RULES) -> Model:
    """The model of all rows. At most 3 to the number of rules patterns reach the driver, however many texts there are."""
    names = [rule.name for rule in rules]
    counts = voted.groupBy(*[F.col(f"votes.{n}").alias(n) for n in names]).count().collect()
    return fit(sorted((tuple(r[n] for n in names), r["count"]) for r in counts), {rule.name: rule.slack for rule in rules})


def votes(rules: tuple[Rule, ...] = RULES) -> Column:
    return F.struct(*[rule.vote() for rule in rules])


def _verdict(model: Model) -> Column:
    return ~base_failed() & (model.posterior() >= KEPT_FROM)


def judge(docs: DataFrame) -> DataFrame:
    """`doc_id`, the counts, `base_failed`, `quality` (posterior probability) and `kept` of every document.

    Rows that repeat are judged each, alike. Null and empty texts and texts without words fail the base rule. Texts of any length are counted whole. An empty table
    gives no rows; without texts that pass the base rule there is nothing to weigh. A null doc_id stays null; other columns are not looked at.
    """
    voted = signals(docs.select("doc_id", "text")).select(F.col("row.doc_id").alias("doc_id"), "signals")
    voted = stored(voted, "signals").withColumn("votes", votes())
    model = learned(voted)
    return voted.select(
        "doc_id",
        "signals.*",
        base_failed().alias("base_failed"),
        model.posterior().alias("quality"),
        _verdict(model).alias("kept"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns only, whatever their names.

    Null, empty, repeated and very long texts as in `judge`; an empty table stays empty.

    Only the counts are stored for the fit; the texts are read, and counted, once more for the verdict instead of being written beside their counts.
    """
    model = learned(stored(signals(docs.select("text")).select("signals"), "signals").withColumn("votes", votes()))
    return signals(docs).withColumn("votes", votes()).where(_verdict(model)).select("row.*")
