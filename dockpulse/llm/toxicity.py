"""Severity of toxicity by cumulative-link ordinal regression over sparse word features."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockpulse.llm.workspace import ship, stored

# Labelled rows that the model is fitted on: those with the smallest hash of doc_id.
SAMPLE_ROWS = 20_000
# A key is a word or the first letters of one; a feature is a key that a text has, or has often: for this share of its words or more. It needs this many
# texts of the sample and this chi-square between its texts and the toxic ones.
OFTEN = 0.01
PREFIXES = (4, 5, 6)
LEAST_TEXTS = 5
LEAST_CHI = 40.0
MOST_FEATURES = 16_384
# A feature of which this share of texts is toxic marks toxicity, for the grading of toxic texts.
MARKER = 0.8
GRADES = 3
STEPS, RATE, RIDGE = 400, 0.1, 2e-4
# A text is called toxic from this chance on: to miss one counts four times as much as to accuse a clean one.
CALLED = 0.2
EDGES = ".,;:!?\"'`()[]{}<>*#$%&|~^=+-_/\\…«»“”„’‘"


def keys(word: str) -> list[str]:
    """The keys of a lower-cased word: itself, and `stem*` for each length that it exceeds."""
    word = word.strip(EDGES)
    return [word, *[f"{word[:n]}*" for n in PREFIXES if len(word) > n]] if word else []


def _pairs(texts: list[str | None], known: dict[str, int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
    """Text, key and count of every pair of them, the number of words of each text, and the numbers of the keys: the known ones, else all."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pa.array([t or "" for t in texts], pa.large_string())))
    coded = lists.values.dictionary_encode()
    words, place = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    # white space at the ends of a text leaves empty pieces
    full = np.array([w != "" for w in words], bool)[place] if len(words) else np.zeros(0, bool)
    text, place = text[full], place[full]
    lengths = np.bincount(text, minlength=len(texts))
    if known is None:
        known = {}
        of = [[known.setdefault(k, len(known)) for k in keys(w)] for w in words]
    else:
        of = [[known[k] for k in keys(w) if k in known] for w in words]
    size = np.array([len(h) for h in of], np.int64)
    flat = np.array([k for h in of for k in h], np.int64)
    start = np.cumsum(size) - size
    hit = np.flatnonzero(size[place] > 0) if len(place) else np.zeros(0, np.int64)
    word = place[hit]
    n = size[word] if len(word) else word
    key = flat[np.repeat(start[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())] if len(word) else word
    unit = len(known) + 1
    pair, count = np.unique(np.repeat(text[hit], n) * unit + key, return_counts=True)
    return pair // unit, pair % unit, count, lengths, known


def counted(texts: list[str | None], number: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of known features: text, feature and count of each pair, and the number of words of each text. `key %` is the feature of a key that is often there."""
    known: dict[str, int] = {}
    for name in number:
        known.setdefault(name.removesuffix(" %"), len(known))
    there = np.array([number.get(k, -1) for k in known] + [-1], np.int64)
    often = np.array([number.get(f"{k} %", -1) for k in known] + [-1], np.int64)
    text, key, count, words, _ = _pairs(texts, known)
    dense = count >= OFTEN * words[text]
    first, second = there[key] >= 0, dense & (often[key] >= 0)
    found = (np.concatenate((a[first], b[second])) for a, b in ((text, text), (there[key], often[key]), (count, count)))
    return *found, words


def values(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A feature counts for being there, and more the denser it is."""
    return 1 + np.log1p(50 * count / np.maximum(words, 1))


@dataclass
class Model:
    """Weights shared by all thresholds; the chance of a grade of at most k is logistic in `thresholds[k]` minus the weighted sum."""

    number: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(GRADES - 1))

    def chances(self, text: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """For each text the chance of each grade."""
        score = np.bincount(text, self.weights[feature] * value, n) if len(text) else np.zeros(n)
        most = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))
        return np.diff(np.concatenate((np.zeros((n, 1)), most, np.ones((n, 1))), axis=1), axis=1)


def fit(text: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least penalised deviance, by gradient steps with moments.

    The thresholds are the first one and logs of the gaps, so they stay in order. They start at the shares of the grades, with half an
    observation more on each side: grades that never occur, and no observations at all, have a place.
    """
    n = len(grade)
    share = np.array([((grade <= k).sum() + 0.5) / (n + 1) for k in range(GRADES - 1)])
    start = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(GRADES - 1))
    free = np.concatenate((np.zeros(features), start[:1], np.log(np.maximum(np.diff(start), 1e-3))))
    first, second = np.zeros_like(free), np.zeros_like(free)
    if not n:
        return free[:features], start
    for step in range(1, STEPS + 1):
        weights, raw = free[:features], free[features:]
        gaps = np.exp(raw[1:])
        edges = np.concatenate(([-np.inf], raw[0] + np.concatenate(([0], np.cumsum(gaps))), [np.inf]))
        score = np.bincount(text, weights[feature] * value, n)
        with np.errstate(over="ignore"):
            above = 1 / (1 + np.exp(-(edges[grade + 1] - score)))
            below = 1 / (1 + np.exp(-(edges[grade] - score)))
        chance = np.maximum(above - below, 1e-12)
        slope = np.zeros_like(free)
        slope[:features] = np.bincount(feature, ((1 - above - below)[text]) * value, features) / n + RIDGE * weights
        up, down = above * (1 - above) / chance, below * (1 - below) / chance
        edge = np.zeros(GRADES + 1)
        np.add.at(edge, grade + 1, -up)
        np.add.at(edge, grade, down)
        inner = edge[1:-1] / n
        slope[features] = inner.sum()
        slope[features + 1 :] = np.cumsum(inner[::-1])[::-1][1:] * gaps
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        free = free - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    raw = free[features:]
    return free[:features], raw[0] + np.concatenate(([0], np.cumsum(np.exp(raw[1:]))))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """`text, toxic` of at most `rows` labelled documents, stored. Labels that are null, or name no document, do not count; of several, the worse does.

    The sample's ids, 16 bytes each, are bounded by `rows`, so they are broadcast. Of repeated doc_ids the row with the least hash of its text
    counts, then the least text; copies are reduced before the exchange, so at most `rows` texts a task are exchanged.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"), F.max("toxic").alias("toxic"))
    return stored(one.select("least.text", F.col("toxic").cast("int").alias("toxic")), "labelled")


def chosen_features(sample: DataFrame) -> list[tuple[str, int, int]]:
    """(feature, texts, toxic texts) with the highest chi-square, `MOST_FEATURES` at most; counted in tasks, summed by Spark."""
    ship(__name__)

    def run(batches):
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False) > 0
            text, key, count, words, known = _pairs(batch.column("text").to_pylist(), None)
            dense = count >= OFTEN * words[text]
            for mark, rows in (("", np.ones(len(text), bool)), (" %", dense)):
                every = np.bincount(key[rows], minlength=len(known))
                bad = np.bincount(key[rows & toxic[text]], minlength=len(known))
                some = np.flatnonzero(every)
                names = list(known)
                columns = [pa.array([names[i] + mark for i in some], pa.string()), pa.array(every[some]), pa.array(bad[some])]
                yield pa.RecordBatch.from_arrays(columns, ["feature", "texts", "bad"])

    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("toxic") > 0).cast("int")), F.lit(0)).alias("bad")).first()
    n, bad = float(total["n"]), float(total["bad"])
    sums = sample.mapInArrow(run, "feature string, texts bigint, bad bigint").groupBy("feature")
    found = sums.agg(F.sum("texts").alias("texts"), F.sum("bad").alias("bad")).where(F.col("texts") >= LEAST_TEXTS)
    d, b = F.col("texts"), F.col("bad")
    chi = n * F.pow(b * n - d * bad, 2) / (d * (n - d) * bad * (n - bad))
    chi = F.when((d < n) & F.lit(0 < bad < n), chi).otherwise(0.0)
    best = found.withColumn("chi", chi).where(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "feature").limit(MOST_FEATURES)
    return [(r["feature"], r["texts"], r["bad"]) for r in best.collect()]


def grades(text: np.ndarray, feature: np.ndarray, count: np.ndarray, words: np.ndarray, toxic: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """0 for texts that are not toxic; the toxic ones 1, or 2 if the features that mark toxicity are denser than in half of the toxic texts."""
    dense = np.bincount(text, count * marks[feature], len(toxic)) / np.maximum(words, 1)
    bad = toxic > 0
    middle = np.median(dense[bad]) if bad.any() else 0.0
    return np.where(bad, np.where(dense > middle, 2, 1), 0)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of a bounded sample of labelled documents. Only its sparse rows of chosen features, not its texts, reach the driver."""
    ship(__name__)
    sample = labelled_sample(docs, labels)
    best = chosen_features(sample)
    number = {f: i for i, (f, _, _) in enumerate(best)}

    def run(batches):
        for batch in batches:
            text, feature, count, words = counted(batch.column("text").to_pylist(), number)
            order = np.argsort(text, kind="stable")
            feature, count = feature[order], count[order]
            sizes = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(words)))))
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(v, pa.int64())) for v in (feature, count)]
            names = ["toxic", "words", "feature", "count"]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(words.astype(np.int64)), *lists], names)

    schema = "toxic int, words bigint, feature array<bigint>, count array<bigint>"
    table = sample.mapInArrow(run, schema).toArrow().combine_chunks()
    if not table.num_rows:
        return Model()
    toxic, words = table.column("toxic").to_numpy(), table.column("words").to_numpy()
    lists = table.column("feature").combine_chunks()
    text = np.repeat(np.arange(len(toxic)), np.diff(lists.offsets.to_numpy()))
    feature, count = lists.flatten().to_numpy(), table.column("count").combine_chunks().flatten().to_numpy()
    marks = np.array([b >= MARKER * n for _, n, b in best], np.float64)
    grade = grades(text, feature, count, words, toxic, marks) if len(best) else (toxic > 0).astype(np.int64)
    weights, thresholds = fit(text, feature, values(count, words[text]), grade, len(best))
    return Model(number, weights, thresholds)


_SEVERITY = "doc_id bigint, grade int, severity double, p_toxic double, toxic boolean"


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id, grade` (the likeliest), `severity` (the expected grade), `p_toxic` (chance of grade 1 or more) and `toxic` (p_toxic of `CALLED` or more).

    The model has at most `MOST_FEATURES` features. Null and empty texts have none of them.
    """
    ship(__name__)
    shared = docs.sparkSession.sparkContext.broadcast((model.number, model.weights, model.thresholds))

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            text, feature, count, words = counted(batch.column("text").to_pylist(), own.number)
            chance = own.chances(text, feature, values(count, words[text]), batch.num_rows)
            expected, p = chance @ np.arange(GRADES), 1 - chance[:, 0]
            columns = [batch.column("doc_id"), *map(pa.array, (chance.argmax(axis=1).astype(np.int32), expected, p, p >= CALLED))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "grade", "severity", "p_toxic", "toxic"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _SEVERITY)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's severity by a model of the labelled ones; see `learn` and `severity`.

    Rows that repeat are judged each, alike. Null and empty texts have no features and get the severity of the model without any. Texts of any length are judged whole.
    Equal doc_ids share their label; of several texts of a chosen doc_id one is learned from. An empty table gives no rows; other columns are not looked at.
    """
    return severity(docs, learn(docs, labels))
