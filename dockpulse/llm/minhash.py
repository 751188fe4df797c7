"""Near-duplicate documents by the Jaccard similarity of their word shingles: candidates from MinHash bands, confirmed by the shingles themselves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockpulse.llm.components import components
from dockpulse.llm.workspace import numbered, rows_of, ship, stored

SEED = 42
SHINGLE_WORDS = 5
# In hundredths, so that the comparison is one of whole numbers.
SIMILAR = 80
# A pair at a similarity of s shares a band with chance 1 - (1 - s ** BAND_ROWS) ** BANDS: 0.999997 at 0.8.
BANDS, BAND_ROWS = 32, 5
_CHUNK = 2048
# Nodes of a neighbourhood that are compared as one block, about; a larger one becomes pairs of blocks. A node counts once, and once more for so many shingles.
BLOCK = 512
# Bytes of texts whose shingles are held at once.
PART_BYTES = 1 << 22
# Shingles whose table of nodes is held at once.
COLUMNS = 8192


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles of a text, lower-cased in A-Z only; a shorter text is one shingle, no words are none."""
    body = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not body:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(body, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(body)]
    of = xxhash.xxh64_intdigest
    if len(starts) <= words:
        return np.array([of(body, SEED)], np.uint64)
    return np.unique(np.array([of(body[s:e], SEED) for s, e in zip(starts, ends[words - 1 :])], np.uint64))


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(SEED))
    draw = lambda: rng.integers(0, 1 << 64, n, np.uint64)
    return draw(), draw() | np.uint64(1)


def bands(found: np.ndarray, masks: np.ndarray, factors: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One key per band of the shingles of a text."""
    least = np.full(len(masks), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _CHUNK):
        part = (found[at : at + _CHUNK, None] ^ masks) * factors
        least = np.minimum(least, part.min(axis=0))
    body, size = least.tobytes(), 8 * rows
    return np.array([xxhash.xxh64_intdigest(body[i * size : (i + 1) * size], i) for i in range(len(masks) // rows)], np.uint64)


def _slices(batches):
    """Batches whose texts have about PART_BYTES at most; a text is never cut."""
    for batch in batches:
        part = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy().astype(np.int64)) // PART_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def sketches(rows: DataFrame, words: int, n_bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """`uid, node, size, keys` of rows `uid, text`: the node is a hash of all shingles, so equal sets of shingles are one node."""
    ship(__name__)

    def run(batches):
        constants = _constants(n_bands * band_rows)
        for batch in _slices(batches):
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            keys = [bands(s, *constants, band_rows).view(np.int64) if len(s) else [] for s in sets]
            columns = [batch.column("uid"), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "node", "size", "keys"])

    return rows.select("uid", "text").mapInArrow(run, "uid bigint, node bigint, size bigint, keys array<bigint>")


def sets_of(rows: DataFrame, words: int) -> DataFrame:
    """`node, found` of rows `node, text`."""
    ship(__name__)

    def run(batches):
        for batch in _slices(batches):
            found = [shingles(t, words).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "found"])

    return rows.select("node", "text").mapInArrow(run, "node bigint, found array<bigint>")


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share, exactly: a product of 0/1 tables over the shingles that several of them have, some columns at a time."""
    sizes = [len(s) for s in sets]
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    several = np.bincount(place, minlength=len(values)) > 1
    column = np.cumsum(several) - 1
    stay = several[place]
    owner, column = owner[stay], column[place[stay]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)  # exact for sets of up to 2 ** 24 shingles
    for first in range(0, int(several.sum()), COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        table = np.zeros((len(sets), COLUMNS), np.float32)
        table[owner[a:b], column[a:b] - first] = 1
        total += table @ table.T
    counts = total.astype(np.int64)
    np.fill_diagonal(counts, sizes)
    return counts


def spanning(nodes: np.ndarray, root: np.ndarray, sets: list[np.ndarray], similar: int) -> list[tuple[int, int]]:
    """Pairs of nodes that are similar, one less than there are nodes at most, which connect all that similar pairs connect. `root` tells what is connected already."""
    sizes = np.array([len(s) for s in sets])
    shared = common(sets)
    near = shared * 100 >= (sizes[:, None] + sizes[None, :] - shared) * similar
    group = np.unique(root, return_inverse=True)[1]
    found = []
    for i in range(len(nodes)):
        others = np.flatnonzero(near[i] & (group != group[i]))
        if len(others):
            for j in others[np.unique(group[others], return_index=True)[1]].tolist():
                found.append((int(nodes[i]), int(nodes[j])))
            group[np.isin(group, group[others])] = group[i]
    return found


def _with_roots(rows: DataFrame, links: DataFrame | None) -> DataFrame:
    """Rows `node, ...` with `root`, the least node that the links connect theirs with."""
    if links is None:
        return rows.withColumn("root", F.col("node"))
    roots = stored(components(links), "roots").select("node", F.col("root").alias("of"))
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("of", "node")).drop("of")


def _starred(buckets: DataFrame, sets: DataFrame, links: DataFrame | None, step, similar: int) -> DataFrame:
    """Links between the nodes of each band and its least or greatest (`step`), where these are not connected yet: a pair per node and band at most."""
    rooted = _with_roots(buckets, links)
    other = rooted.groupBy("key").agg(step(F.struct("node", "size", "root")).alias("o"))
    pairs = rooted.join(other, "key").where("root <> o.root")
    pairs = pairs.where(F.least("size", "o.size") * 100 >= F.greatest("size", "o.size") * similar)
    pairs = stored(pairs.select(F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b")).distinct(), "pairs")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("found").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("found").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    near = both.where(shared * 100 >= (F.size("x") + F.size("y") - shared) * similar).select("a", "b")
    near = stored(near, "links")
    return near if links is None else links.union(near)


def _blocked(buckets: DataFrame, sets: DataFrame, links: DataFrame, similar: int) -> DataFrame:
    """Links between all nodes of bands that are still not connected, found in blocks of shingle sets.

    Bands that share nodes make a neighbourhood (each node linked to the least of its band: a chain, not pairs), so a node and its shingles are sent once and not once a band.
    Nodes are sorted by what they are connected with and dealt into blocks of BLOCK; every two blocks of a neighbourhood are compared in one task, unless
    all their nodes are connected. A task sends links that span its nodes, so what is written never grows with the square of a group.
    """
    ship(__name__)
    rooted = _with_roots(buckets, links)
    open_ = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("node").alias("least")).where("x <> y")
    rooted = stored(rooted.join(open_.select("key", "least"), "key"), "open-bands")
    near = components(rooted.select(F.col("node").alias("a"), F.col("least").alias("b")).where("a <> b"))
    nodes = rooted.select("node", "size", "root").distinct().join(near.select("node", F.col("root").alias("area")), "node")
    dealt = _dealt(stored(nodes.withColumn("weight", 1 + F.col("size") / BLOCK), "open-nodes"))
    blocks = stored(dealt.groupBy("area", "block").agg(F.min("root").alias("x"), F.max("root").alias("y")), "blocks")
    first = blocks.select("area", *[F.col(c).alias(f"{c}1") for c in ("block", "x", "y")])
    tiles = first.join(blocks, "area").where("block1 <= block and (x <> y or x1 <> y1 or x <> x1)")
    tiles = stored(tiles.select("area", F.struct("area", "block1", "block").alias("tile"), F.array_distinct(F.array("block1", "block")).alias("blocks")), "tiles")
    ends = tiles.select("area", "tile", F.explode("blocks").alias("block"))
    rows = ends.join(dealt, ["area", "block"]).join(sets, "node").select("tile", "node", "root", "found")

    def run(table):
        table = table.take(pa.array(np.argsort(table.column("node").to_numpy(), kind="stable")))
        lists = table.column("found").combine_chunks()
        values = lists.flatten().to_numpy().view(np.uint64)
        found = np.split(values, np.cumsum(pc.list_value_length(lists).to_numpy())[:-1])
        pairs = spanning(table.column("node").to_numpy(), table.column("root").to_numpy(), found, similar)
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return links.union(stored(rows.groupBy("tile").applyInArrow(run, "a bigint, b bigint"), "block-links"))


def _dealt(nodes: DataFrame) -> DataFrame:
    """`area, block, node, root`, stored: blocks of a weight of about BLOCK. Roots of that weight have blocks of their own, by hash of the node; lighter ones share blocks by hash of the root."""
    by_root = nodes.groupBy("area", "root").agg(F.sum("weight").alias("of_root"))
    small = F.col("of_root") < BLOCK
    by_area = by_root.groupBy("area").agg(F.coalesce(F.sum(F.when(small, F.col("of_root"))), F.lit(0.0)).alias("of_small"))
    sized = nodes.join(by_root, ["area", "root"]).join(by_area, "area")
    part = lambda of, weight: F.pmod(F.xxhash64(of), F.greatest(F.ceil(weight / BLOCK), F.lit(1)))
    shared = F.struct(F.lit(0).cast("bigint").alias("of"), part("root", F.col("of_small")).alias("part"))
    own = F.struct(F.col("root").alias("of"), part("node", F.col("of_root")).alias("part"))
    return stored(sized.select("area", F.when(small, shared).otherwise(own).alias("block"), "node", "root"), "dealt")


def links(nodes: DataFrame, sets, similar: int) -> DataFrame:
    """Confirmed edges `a`, `b` between nodes `node, size, keys`: enough of them to connect all candidates that are similar.

    Two rounds compare each node of a band with the least and with the greatest node there, so a large group of near copies costs
    a pair per copy. What is still not connected is compared in blocks. `sets` gives the shingles of given nodes.
    """
    rows = nodes.select(F.explode("keys").alias("key"), "node", "size")
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = stored(rows.join(shared, "key"), "bands")
    known = stored(sets(buckets.select("node").distinct()), "shingles")
    found = _starred(buckets, known, None, F.min, similar)
    found = _starred(buckets, known, found, F.max, similar)
    return _blocked(buckets, known, found, similar)


def grouped(
    texts: DataFrame, words: int = SHINGLE_WORDS, similar: int = SIMILAR, n_bands: int = BANDS, band_rows: int = BAND_ROWS
) -> DataFrame:
    """`uid, root` of rows `uid, text`: rows have one root where links of a Jaccard similarity of `similar` hundredths or more connect them.

    The similarity is over distinct shingles of `words` words. Candidates share one of `n_bands` bands of `band_rows` MinHashes.
    """
    prints = stored(sketches(texts, words, n_bands, band_rows), "sketches")
    nodes = stored(prints.groupBy("node").agg(F.min(F.struct("uid", "size", "keys")).alias("o")).select("node", "o.*"), "nodes")

    def sets(wanted: DataFrame) -> DataFrame:
        owners = nodes.select("uid", "node").join(wanted, "node", "left_semi")
        return sets_of(texts.join(owners, "uid"), words)

    roots = components(links(nodes, sets, similar))
    return prints.select("uid", "node").join(roots, "node", "left").select("uid", F.coalesce("root", "node").alias("root"))


def drop_near_duplicates(
    docs: DataFrame, words: int = SHINGLE_WORDS, similar: int = SIMILAR, n_bands: int = BANDS, band_rows: int = BAND_ROWS
) -> DataFrame:
    """One document of each group of `grouped`, the one with the smallest doc_id (null last, then the first row), with its own columns only.

    Null texts are empty and, like all texts without words, one group; texts of the same shingles are always one. Texts
    of any length count whole; an empty table stays empty; rows that repeat are copies.
    """
    rows = numbered(docs, "near")
    texts = rows.select("uid", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    rooted = grouped(texts, words, similar, n_bands, band_rows)
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("best")
    return rows_of(rows, texts.select("uid", "doc_id").join(rooted, "uid").groupBy("root").agg(best).select("best.uid"))
