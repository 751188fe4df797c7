"""Importance resampling towards a target distribution: bucketed n-gram weights, and the highest noisy scores by a distributed quickselect."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockpulse.functions.ranking import ranked
from dockpulse.llm.workspace import ship, stored

BUCKETS = 10_000
GRAM_WORDS = 3
LEAST_WORDS = 20
# Documents drawn, in hundredths of those with enough words.
DRAWN = 5
SEED = 42
# Pivots of one round of the quickselect.
PIVOTS = 31
# Bytes of texts whose features are counted at once.
PART_BYTES = 1 << 22

# Bytes of words (digits, letters lower-cased, everything from 0x80 on); all others separate words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _shift_table(zeros: int) -> np.ndarray:
    """What appending so many bytes does to a crc32, apart from the bytes' own crc32: a linear map, as four tables of 256."""
    body = bytes(zeros)
    none, table, values = zlib.crc32(body, 0), np.zeros((4, 256), np.uint32), np.arange(256)
    for bit in range(32):
        column = np.uint32(zlib.crc32(body, 1 << bit) ^ none)
        table[bit // 8] ^= np.where(values >> (bit % 8) & 1, column, np.uint32(0))
    return table


class Features:
    """Buckets of all runs of 1 to GRAM_WORDS words of texts given as UTF-8, vectorised: the crc32 of a run is the shifted crc32 of its beginning, xor that of its last word."""

    def __init__(self) -> None:
        self.tables: dict[int, np.ndarray] = {}

    def _joined(self, head: np.ndarray, tail: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if not len(head):
            return head
        found = np.flatnonzero(np.bincount(lengths))
        for n in found.tolist():
            if n not in self.tables:
                self.tables[n] = _shift_table(n)
        table = np.concatenate([self.tables[n].ravel() for n in found.tolist()])
        place = np.zeros(found[-1] + 1, np.int64)
        place[found] = np.arange(len(found)) * 1024
        at = place[lengths]
        for byte in range(4):
            tail = tail ^ table[at + ((head >> np.uint32(8 * byte)) & np.uint32(255)) + 256 * byte]
        return tail

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The buckets of all features, the text of each, and the words of each text."""
        bodies = [(t or b"").translate(_WORD_BYTES) for t in texts]
        sizes = np.array([len(b) + 1 for b in bodies], np.int64)
        raw = np.frombuffer(b" ".join(bodies), np.uint8)
        inside = raw != 32
        steps = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
        text = np.searchsorted(np.cumsum(sizes) - sizes, starts, "right") - 1
        lengths = ends - starts
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[inside].tobytes())]
        ).dictionary_encode()
        distinct, at = words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False)
        run = np.array([zlib.crc32(w) for w in distinct], np.uint32)[at]
        spaced = np.array([zlib.crc32(b" " + w) for w in distinct], np.uint32)[at]
        found, where = [run], [text]
        for more in range(1, GRAM_WORDS):
            run = self._joined(run[: max(len(text) - more, 0)], spaced[more:], lengths[more:] + 1)
            same = text[: len(run)] == text[more:]
            found.append(run[same])
            where.append(text[more:][same])
        buckets = (np.concatenate(found) % np.uint32(BUCKETS)).astype(np.int64)
        return buckets, np.concatenate(where), np.bincount(text, minlength=len(texts))


def _parts(texts: list[bytes | None]):
    """Slices of about PART_BYTES; a text is never cut."""
    at = size = 0
    for i, text in enumerate(texts):
        size += len(text or b"")
        if size > PART_BYTES:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all texts by bucket. A task sends at most one row per bucket; the driver gets BUCKETS sums, whatever the corpus."""
    ship(__name__)

    def run(batches):
        features, total = Features(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            bodies = batch.column("text").to_pylist()
            for part in _parts(bodies):
                total += np.bincount(features.of(bodies[part])[0], minlength=BUCKETS)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    counts = np.zeros(BUCKETS, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 * log of the target's smoothed share over the source's)."""
    all_source, all_target = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    ratio = lambda s, t: (t + 1.0) * all_source / ((s + 1.0) * all_target)
    return np.array([math.floor(1000 * math.log(ratio(float(s), float(t)))) for s, t in zip(source, target)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from the digest of the seed and the id; a null id counts as the empty string."""
    name = "" if doc_id is None else str(doc_id)
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """`uid, doc_id, n_words, n_features, weight, score` of every row, stored. The gains travel as one array of BUCKETS numbers."""
    ship(__name__)
    schema = "uid bigint, doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        features, gained = Features(), gain.astype(np.float64)  # whole numbers far below 2 ** 53: sums are exact
        for batch in batches:
            bodies, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for part in _parts(bodies):
                buckets, text, words = features.of(bodies[part])
                n = np.bincount(text, minlength=len(words))
                weight = np.bincount(text, gained[buckets], len(words)).astype(np.int64)
                score = weight + np.array([noise(i, seed) for i in ids[part]], np.int64)
                columns = [batch.column(c).slice(part.start, part.stop - part.start) for c in ("uid", "doc_id")]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, (words, n, weight, score))], names)

    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
    )
    return stored(rows.mapInArrow(run, schema), "scored")


def _key(rows: DataFrame) -> DataFrame:
    """Rows with `key`: descending score, then ascending id (null last), then the row. No two are equal."""
    last = F.lit((1 << 63) - 1)
    return rows.withColumn("key", F.struct((-F.col("score")).alias("a"), F.coalesce("doc_id", last).alias("b"), F.col("uid").alias("c")))


def kth_key(keys: DataFrame, k: int, pivots: int = PIVOTS) -> tuple[int, int, int]:
    """The k-th smallest (from 1 on) of the keys `key`, which all differ and are k at least.

    Each round draws random keys of the open range as pivots, counts all its keys below, at and between them, and goes on with the interval that
    holds the k-th, written anew. The driver holds pivots and counts. With so many pivots a round leaves about one key in that many.
    """
    step = 0
    pool = keys.select("key")
    while True:
        order = F.xxhash64("key.c", F.lit(SEED + step))
        drawn = sorted(tuple(r["key"]) for r in pool.orderBy(order, "key").limit(pivots).collect())
        literals = F.array(*[_literal(p) for p in drawn])
        below = F.size(F.filter(literals, lambda p: p < F.col("key")))
        upto = F.size(F.filter(literals, lambda p: p <= F.col("key")))
        placed = pool.select("key", (below + upto).alias("place"))
        counts = dict(placed.groupBy("place").count().collect())
        place = -1
        while k > 0:  # even places lie between pivots, odd ones are pivots
            place += 1
            k -= counts.get(place, 0)
        if place % 2:
            return drawn[place // 2]
        k += counts[place]
        pool = stored(placed.where(F.col("place") == place).select("key"), "open-keys")
        step += 1


def _literal(key: tuple[int, int, int]) -> Column:
    return F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in zip("abc", key)])


def resample(docs: DataFrame, target: DataFrame, drawn: int = DRAWN, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """`doc_id, n_features, weight, score, rank` of every row of `docs`; `rank` is null for what is not drawn.

    Drawn are floor(drawn * n / 100) of the n rows with `least_words` words or more, those of the highest scores, ties to the smaller doc_id (null last),
    then to the earlier row. Null texts have no words and features and weigh 0; rows that repeat count, and can be drawn, each. Texts of any length count whole.
    Empty tables give no rows, an empty target equal odds. Other columns are not looked at.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = scored(docs, gain, seed)
    open_ = _key(rows.where(F.col("n_words") >= least_words)).select("uid", "key")
    k = drawn * open_.count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return rows.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    winners = open_.where(F.col("key") <= _literal(kth_key(open_, k)))
    places = ranked(winners, F.col("key").asc()).select("uid", "rank")
    return rows.join(places, "uid", "left").select(*columns, "rank")
