"""Near-duplicate documents by SimHash, with candidate pairs from Golay-code keys."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockpulse.llm.components import components, united
from dockpulse.llm.workspace import numbered, rows_of, ship, stored

SEED = 42
SHINGLE_WORDS = 3
DISTANCE = 2
# Widths of the three segments of a fingerprint. Each fits into a word of the code.
SEGMENTS = (22, 21, 21)
# Fingerprints of one key that are compared in one block; a larger bucket becomes pairs of blocks.
BLOCK = 4096
# The binary Golay code of length 23, dimension 12 and distance 7: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0xC75


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64 majority bits over the XXH64 of all shingles of a text, lower-cased in A-Z only. No words give 0."""
    body = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not body:
        return 0
    gaps = np.flatnonzero(np.frombuffer(body, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(body)]
    if len(starts) <= words:
        return _majority([xxhash.xxh64_intdigest(body, SEED)])
    of = xxhash.xxh64_intdigest
    return _majority([of(body[s:e], SEED) for s, e in zip(starts, ends[words - 1 :])])


def _majority(hashes: list[int]) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """`uid, doc_id, fp` (a signed long) of rows `uid, doc_id, text`."""
    ship(__name__)

    def run(batches):
        for batch in batches:
            values = [fingerprint(t) for t in batch.column("text").to_pylist()]
            fps = pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), fps], ["uid", "doc_id", "fp"])

    return docs.select("uid", F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "uid bigint, doc_id bigint, fp bigint"
    )


_TABLES: dict = {}


def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and the high 11 bits; per remainder the error of weight 3 or less, and the five of weight 4 if that is 3."""

    if _TABLES:
        return _TABLES["code"]

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << (bit - 11)
        return word

    single = [remainder(1 << bit) for bit in range(23)]
    low = np.zeros(1 << 12, np.int64)
    high = np.zeros(1 << 11, np.int64)
    for bit in range(12):
        low[1 << bit : 2 << bit] = low[: 1 << bit] ^ single[bit]
    for bit in range(11):
        high[1 << bit : 2 << bit] = high[: 1 << bit] ^ single[12 + bit]
    near, far, filled = np.zeros(1 << 11, np.int64), np.zeros((1 << 11, 5), np.int64), np.zeros(1 << 11, np.int64)
    for weight in range(1, 5):
        for bits in combinations(range(23), weight):
            error, rest = sum(1 << b for b in bits), 0
            for b in bits:
                rest ^= single[b]
            if weight < 4:
                near[rest] = error
            elif near[rest].bit_count() == 3:
                far[rest, filled[rest]] = error
                filled[rest] += 1
    _TABLES["code"] = low, high, near, far
    return _TABLES["code"]


def codewords(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in `segment` and the 12-bit indices of the code words near them: segments that differ in one bit at most share one.

    The code is perfect: every word has one code word within 3. Within 2, a neighbour decodes to the same one. At 3, a neighbour may
    decode to another, which is then at 4 from this word; there are five of those, and all are keys.
    """
    low, high, near, far = _code()
    rest = low[segment & 4095] ^ high[segment >> 12]
    error = near[rest]
    edge = np.flatnonzero(np.bitwise_count(error) == 3)
    at = np.concatenate((np.arange(len(segment)), np.repeat(edge, 5)))
    words = np.concatenate((segment ^ error, (segment[edge, None] ^ far[rest[edge]]).ravel()))
    return at, words >> 11


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in `fps` (unsigned) and their keys: fingerprints within two bits of each other share at least one.

    Two errors over three segments leave one segment exact whose next one, in a circle, has one error at most.
    Such a pair of segments is a key: the exact bits of the first, a near code word of the second.
    """
    parts, shift = [], 0
    for width in SEGMENTS:
        parts.append(((fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64))
        shift += width
    found = []
    for i in range(3):
        at, word = codewords(parts[(i + 1) % 3])
        found.append((at, (i << 34) | (parts[i][at] << 12) | word))
    return np.concatenate([a for a, _ in found]), np.concatenate([k for _, k in found])


def merged(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each the smallest position of its set) after joining the sets of every i and j."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def linked(bucket: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is within the distance inside each bucket (equal neighbours in `bucket`): one per node, not one per pair."""
    n = len(fps)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    ends = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
    labels, active, step = np.arange(n), np.arange(n), 1
    while True:
        active = active[active + step < ends[active]]
        if not len(active):
            break
        close = active[np.bitwise_count(fps[active] ^ fps[active + step]) <= DISTANCE]
        if len(close):
            labels = merged(labels, close, close + step)
        step += 1
    other = np.flatnonzero(labels != np.arange(n))
    return fps[other], fps[labels[other]]


def near_links(distinct: DataFrame) -> DataFrame:
    """Edges `a`, `b` between distinct fingerprints `fp`: enough of them to connect all that are within two bits.

    Only keys that occur twice go on. A bucket of more than `BLOCK` fingerprints is dealt into k parts and compared as
    all pairs of parts, each in a group of its own, so no group grows with the bucket and no pair is left out.
    """
    ship(__name__)

    def keyed(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            at, key = keys(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[at])], ["key", "fp"])

    def compare(batches):
        """Rows come sorted by bucket; the last bucket of a batch waits for the next batch."""
        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            left = table if left is None else pa.concat_tables([left, table])
            last = left.slice(left.num_rows - 1)
            names = ("key", "x", "y")
            columns = [left.column(c).to_numpy() for c in names]
            same = np.logical_and.reduce([v == last.column(c)[0].as_py() for c, v in zip(names, columns)])
            cut = left.num_rows - int(same.sum())
            yield from edges(left.slice(0, cut))
            left = left.slice(cut)
        if left is not None:
            yield from edges(left)

    def edges(table):
        if table.num_rows:
            key, x, y = (table.column(c).to_numpy() for c in ("key", "x", "y"))
            fps = table.column("fp").to_numpy().view(np.uint64)
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
            a, b = linked(np.cumsum(new), fps)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    rows = distinct.select("fp").mapInArrow(keyed, "key bigint, fp bigint")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    part = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    pair = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.col("k") - 1),
            lambda o: F.struct(F.least(F.col("p"), o).alias("x"), F.greatest(F.col("p"), o).alias("y")),
        )
    )
    dealt = rows.join(sizes, "key").withColumn("k", parts).withColumn("p", part)
    dealt = dealt.select("key", "fp", pair.alias("pair")).select("key", "fp", "pair.x", "pair.y")
    dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return dealt.mapInArrow(compare, "a bigint, b bigint")


def grouped(prints: DataFrame) -> DataFrame:
    """Rows `uid, doc_id, fp` with `component_id`, the smallest doc_id reachable over links of two bits or fewer.

    Equal fingerprints are one node, so a group of copies with a third of all rows costs one row here. A group whose doc_ids are
    all null has a null id.
    """
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(near_links(nodes)).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(ids, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """`doc_id, fingerprint` (16 hex digits), `component_id` of every document; null text counts as empty.

    Texts without words have fingerprint zero and are linked like any other. Texts of any length count whole; rows that repeat are documents of their own, in one
    component; an empty table gives no rows; other columns are not looked at.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    found = grouped(stored(fingerprints(rows), "prints"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One document of each group, the one with the smallest doc_id (null last, then the first row), with its own columns only. An empty table stays empty.

    `more` gives `uid, root` of rows `uid, text`, a grouping by other links: groups of either kind that share a document are one.
    """
    rows = numbered(docs, "near")
    texts = rows.select("uid", "row.doc_id", "row.text")
    found = grouped(stored(fingerprints(texts), "prints"))
    if more is not None:
        found = united(found, more(texts))
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("best")
    return rows_of(rows, found.groupBy("root").agg(best).select("best.uid"))
