"""Packing tokenised documents into sequences: best-fit decreasing, certified by dual feasible functions."""

from __future__ import annotations

import base64
import re
import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockpulse.llm.workspace import numbered, ship, stored

CAPACITY = 2048
END = 0
RANKS = "byte_bpe_50k.tiktoken"
# Pieces packed together in one task, rounds of exchange, and what is encoded at once.
GROUP = 20_000
ROUNDS = 4
BATCH_BYTES = 1 << 22
# Words whose ids a worker remembers.
MEMORY = 600_000

PIECES = "uid bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_TWO_SPACES = re.compile(r"\s\s")
# Strings of the vocabulary's JSON file that are one id wherever they stand in a text; fixed values.
ADDED = {"<|endoftext|>": 50256}
_ADDED = re.compile("(" + "|".join(map(re.escape, ADDED)) + ")")


class Encoder:
    """Ids of texts under a byte-level vocabulary given as a file of ranks.

    The pattern that splits text never joins across a single space between two other characters, so such a text is a list of
    words, each with the space before it, that are encoded on their own. Each distinct word is encoded once and remembered; the ids of a
    text are then gathered by number. Texts with two white-space characters in a row, or with a space at the end, are encoded whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.plain = tiktoken.Encoding(
            "byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.width[rank] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.ids, self.starts = array("I"), array("q", [0, 0])

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of words with a space before them: one call for all, cut where the bytes of the words end."""
        if not words:
            return
        tokens = np.array(self.plain.encode_ordinary(" " + " ".join(words)), np.uint32)
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        cuts = np.searchsorted(bytes_done := np.cumsum(self.width[tokens]), ends)
        if len(tokens) <= cuts[-1] or (bytes_done[cuts] != ends).any():
            raise ValueError("a token spans two words")
        base, first = len(self.ids), len(self.starts) - 1
        self.ids.frombytes(tokens.tobytes())
        self.starts.frombytes((cuts.astype(np.int64) + 1 + base).tobytes())
        self.known.update(zip(words, range(first, first + len(words))))

    def _odd(self, text: str) -> bool:
        """Whether a text is more than words with a single space before each."""
        return text[-1:].isspace() or bool(_TWO_SPACES.search(text)) or any(a in text for a in ADDED)

    def _whole(self, text: str) -> list[int]:
        """Ids of a text that is cut at the added tokens first: nothing is joined across them."""
        ids: list[int] = []
        for part in _ADDED.split(text):
            ids.extend([ADDED[part]] if part in ADDED else self.plain.encode_ordinary(part))
        return ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        whole = [i for i, t in enumerate(texts) if self._odd(t)]
        apart = [self._whole(texts[i]) for i in whole]
        simple = pa.array(["" if self._odd(t) else t for t in texts], pa.large_string())
        lists = pc.split_pattern(simple, " ")
        offsets, words = lists.offsets.to_numpy(), lists.values
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > MEMORY:
            self._forget()
        self._learn([w for w in distinct if w not in self.known])
        number = np.array([self.known[w] for w in distinct], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        starts = np.frombuffer(self.starts, np.int64)
        first = [self.plain.encode_ordinary(t) if t else [] for t in words.take(pa.array(offsets[:-1])).to_pylist()]
        extra = np.array([i for ids in first for i in ids], np.uint32)
        sizes = np.array([len(ids) for ids in first], np.int64)
        begin, size = starts[number], starts[number + 1] - starts[number]
        begin[offsets[:-1]] = len(self.ids) + np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else 0
        size[offsets[:-1]] = sizes
        pool = np.concatenate((np.frombuffer(self.ids, np.uint32), extra)) if len(self.ids) else extra
        done = np.cumsum(size)
        flat = pool[np.repeat(begin - (done - size), size) + np.arange(done[-1] if len(done) else 0)]
        counts = np.add.reduceat(size, offsets[:-1]) if len(texts) else np.zeros(0, np.int64)
        if whole:
            parts = np.split(flat, np.cumsum(counts)[:-1])
            for i, ids in zip(whole, apart):
                parts[i] = np.array(ids, np.uint32)
            counts = np.array([len(p) for p in parts], np.int64)
            flat = np.concatenate(parts)
        return flat, counts


def encoder(path: str) -> Encoder:
    """The encoder of this worker process, kept between tasks."""
    kept = sys.modules.setdefault("_kept_encoders", types.ModuleType("_kept_encoders")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be short."""
    first = length % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size > BATCH_BYTES:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def token_pieces(docs: DataFrame, ranks: str | None = None, ids: bool = False) -> DataFrame:
    """Rows `uid, doc_id, text` as pieces `uid, doc_id, piece, start, length, ids_crc32`, with `ids` (array) on request.

    A null or empty text is one piece that holds only the end id. `ranks` is the vocabulary file, the same on all workers; by default
    that of the installed public vocabularies.
    """
    ship(__name__)
    schema = PIECES + (", ids array<int>" if ids else "")

    def run(batches):
        import public_tokenizers

        own = encoder(ranks or public_tokenizers.path(RANKS))
        for batch in batches:
            uids, doc_ids = batch.column("uid").to_pylist(), batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in _batches(texts):
                flat, counts = own.encode(texts[lo:hi])
                after = np.cumsum(counts + 1)
                out = np.full(after[-1], END, "<u4")
                inside = np.ones(len(out), bool)
                inside[after - 1] = False
                out[inside] = flat
                data, rows = memoryview(out).cast("B"), []
                for k, (end, n) in enumerate(zip(after.tolist(), counts.tolist())):
                    base = end - n - 1
                    for piece, (start, length) in enumerate(cut(n + 1)):
                        a = base + start
                        row = (uids[lo + k], doc_ids[lo + k], piece, start, length, zlib.crc32(data[4 * a : 4 * (a + length)]))
                        rows.append((*row, out[a : a + length].astype(np.int32)) if ids else row)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return docs.select("uid", F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: per item its bin and its place there, and the free room of each bin.

    Bins wait in stacks by free room; a bit mask over the rooms gives the smallest that fits in one step.
    """
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []
    mask = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fits = mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            stack = stacks[free]
            to = stack.pop()
            if not stack:
                mask ^= 1 << free
        else:
            to, free = len(rooms), capacity
            rooms.append(capacity)
        bins[i], places[i] = to, capacity - free
        left = free - length
        rooms[to] = left
        if left:
            stacks[left].append(to)
            mask |= 1 << left
    return bins, places, np.array(rooms, np.int64)


def bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """A number of bins that no packing can beat: the best of three families of dual feasible functions, in whole numbers.

    Such a function f keeps every set that fits into a bin at a sum of 1 or less, so the sum of f over all items bounds the bins from below.
    """
    count = np.bincount(lengths, minlength=capacity + 1)
    x = np.arange(capacity + 1)
    up = lambda total, unit: -(-int(total) // int(unit))
    best = up((count * x).sum(), capacity)
    total, weight = np.cumsum(count), np.cumsum(count * x)
    for e in range(1, capacity // 2 + 1):
        # items over capacity - e fill a bin, those under e vanish, the others stay as they are
        full = total[-1] - total[capacity - e]
        best = max(best, int(full) + up(weight[capacity - e] - weight[e - 1], capacity))
        # large items leave room for a number of small ones of size e; each of the middle ones takes one such room
        rooms = capacity // e
        large = x > capacity // 2 if capacity % 2 else 2 * x > capacity
        value = np.where(large, rooms - (capacity - x) // e, (x >= e).astype(np.int64))
        best = max(best, up((count * value).sum(), rooms))
    for k in range(1, 64):
        # rounding to multiples of 1/k
        parts = (k + 1) * x
        value = np.where(parts % capacity == 0, k * x, parts // capacity * capacity)
        best = max(best, up((count * value).sum(), k * capacity))
    return best


def released(rooms: np.ndarray, gap: int, capacity: int = CAPACITY) -> np.ndarray:
    """Which bins a partition with a gap gives up: the emptiest, until their free room is twice the bins to be saved. Full ones stay."""
    order = np.argsort(-rooms, kind="stable")
    before = np.cumsum(rooms[order]) - rooms[order]
    given = np.zeros(len(rooms), bool)
    given[order] = (before < 2 * gap * capacity) & (rooms[order] > 0)
    return given


_PACKED = PIECES + ", sequence_id bigint, offset bigint, open boolean, new_sequences bigint"


def _round(pieces: DataFrame, number: int) -> DataFrame:
    """Pieces dealt by hash to partitions of about `GROUP`, each packed and compared with its bound.

    `open` marks the pieces that a partition with a gap gives up; `new_sequences` counts the sequences behind them, once per partition.
    """
    groups = max(1, -(-pieces.count() // GROUP))
    part = F.pmod(F.xxhash64("uid", "piece", F.lit(number)), F.lit(groups))

    def pack(table):
        lengths = table.column("length").to_numpy()
        bins, places, rooms = best_fit(lengths)
        given = released(rooms, len(rooms) - bound(lengths))
        group = table.column("part")[0].as_py()
        ids = (number << 56) + (group << 20) + bins
        mark = np.zeros(len(bins), np.int64)
        mark[0] = len(rooms)
        columns = [table.column(c) for c in ("uid", "doc_id", "piece", "start", "length", "ids_crc32")]
        columns += [pa.array(ids), pa.array(places), pa.array(given[bins]), pa.array(mark)]
        return pa.Table.from_arrays(columns, [c.split()[0] for c in _PACKED.split(", ")])

    dealt = pieces.select(*[c.split()[0] for c in PIECES.split(", ")], part.alias("part"))
    return stored(dealt.groupBy("part").applyInArrow(pack, _PACKED), "packed")


def pack_pieces(pieces: DataFrame) -> DataFrame:
    """Stored pieces with `sequence_id` and `offset`: gapless, at most `CAPACITY` ids each.

    Partitions whose number of sequences equals their lower bound are certified and final. The others give up the documents of their
    emptiest sequences; those are mixed anew into fewer partitions and packed again. A round that does not save a sequence is dropped,
    and the places before it hold.
    """
    ship(__name__)
    done, kept = [], _round(pieces, 0)
    for number in range(1, ROUNDS):
        given = kept.where("open")
        before = given.select("sequence_id").distinct().count()
        if not before:
            break
        again = _round(given, number)
        after = again.agg(F.sum("new_sequences")).first()[0]
        if after >= before:
            break
        done.append(kept.where(~F.col("open")))
        kept = again
    out = kept
    for part in done:
        out = out.unionByName(part)
    return out.drop("open", "new_sequences")


def pack_documents(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """`uid, doc_id, piece, start, length, ids_crc32, sequence_id, offset` of every piece of every document.

    Rows that repeat are documents of their own, told apart by `uid`. A null or empty text is one piece with the end id alone. A text of any length is encoded whole by one
    task and cut into pieces. Pieces of equal length are interchangeable. No documents give no rows; other columns are not looked at.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    return pack_pieces(stored(token_pieces(rows, ranks), "pieces"))


def sequences(docs: DataFrame, into: str | None = None, ranks: str | None = None) -> DataFrame:
    """The packed sequences themselves: `sequence_id`, `ids`, and `parts` (doc_id, piece, offset, length) in order of offset."""
    rows = numbered(docs.select("doc_id", "text"), "packable")
    pieces = stored(token_pieces(rows.select("uid", "row.doc_id", "row.text"), ranks, ids=True), "pieces")
    places = pack_pieces(pieces.drop("ids")).select("uid", "piece", "sequence_id", "offset")
    part = F.struct("offset", "doc_id", "piece", "length", "ids")
    packed = pieces.join(places, ["uid", "piece"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("all"))
    slim = F.transform("all", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length")))
    found = packed.select("sequence_id", F.flatten(F.col("all.ids")).alias("ids"), slim.alias("parts"))
    if into is None:
        return found
    found.write.option("compression", "zstd").parquet(into)
    return docs.sparkSession.read.parquet(into)
