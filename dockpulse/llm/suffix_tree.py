"""A probabilistic suffix tree over words: contexts of variable length, learned and applied by Spark tasks."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockpulse.llm.workspace import Passing, ship

# Words of a context at most.
DEPTH = 3
# A context is a candidate from this many occurrences on, and a token after it counts from this many on: numbers from 1 on are counts, whatever
# the corpus, so the tree grows with it; numbers below 1 are shares of all tokens.
LEAST_CONTEXT = 2
LEAST_ENTRY = 2
# Nats that a context has to save per token, over its longest proper suffix, on the tokens seen after it.
LEAST_DIVERGENCE = 0.01
# Taken off each count after a context; what is taken goes to the shorter context.
DISCOUNT = 0.75
# A block ends after this many rows, or once its texts have this many bytes: what one task holds of texts and replies does not grow with the length of texts.
BLOCK_ROWS = 4096
BLOCK_BYTES = 16 << 20
# Places of a block that are scored at once, about.
PLACES = 1 << 17

# Words of the corpus for one shard of the grams of one length, about; the number of shards grows with the corpus.
SHARD_WORDS = 2_000_000
# Shards in a part. A task of the divergence test has the frequent grams of a part at once; parts ask each other, so with fewer shards in each there is more to send.
PART_SHARDS = 4
# The id of a frequent gram: its shard, then from this bit on its rank among the shard's frequent grams.
RANK_BITS = 32

# The start and end of a text, as hashes of what is no word.
START = np.uint64(xxhash.xxh64_intdigest(b" start"))
END = np.uint64(xxhash.xxh64_intdigest(b" end"))


def held_out() -> Column:
    """Whether a document is kept from learning; a null doc_id counts as the empty string, which is learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1


def normalised(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def _pack(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes, with their number; small or rising whole ones (as differences) take few planes."""
    if values.dtype.kind != "f":
        values = values.view(f"u{values.itemsize}")
        values = values.astype(np.min_scalar_type(values.max(initial=0)), copy=False)
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return len(values).to_bytes(7, "little") + bytes([values.itemsize]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(pack: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(pack[:7], "little"), pack[7]
    planes = np.frombuffer(pa.decompress(pack[8:], decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    values = np.ascontiguousarray(planes.reshape(width, n).T).reshape(-1)
    return values.view(kind) if width == np.dtype(kind).itemsize else values.view(f"u{width}").astype(kind)


def _rising(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=values.dtype.type(0)))


def _risen(pack: bytes, kind: type) -> np.ndarray:
    return np.cumsum(_unpack(pack, kind), dtype=kind)


def _words(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, the place in them of every word of all texts, and where each text's words start."""
    lists = pc.split_pattern(pa.array([b or None for b in bodies], pa.large_string()), " ")
    coded = lists.values.dictionary_encode()
    of = xxhash.xxh64_intdigest
    hashes = np.fromiter(map(of, coded.dictionary.to_numpy(zero_copy_only=False).tolist()), np.uint64, len(coded.dictionary)).view(np.int64)
    return hashes, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy()


_STATE = "block bigint, doc_id array<bigint>, held_out array<boolean>, size array<int>, words binary, place binary, total bigint, learned bigint, ends bigint"


def prepared(docs: DataFrame, tables: Passing) -> DataFrame:
    """A row per block, stored: its documents with their numbers of words, the hashes of its distinct words, the place in them of every word, and how many words and texts are learned.

    A block is a run of rows of one partition, cut by rows and bytes; it is written, so later jobs see the same blocks.
    """
    ship(__name__)

    def state(block, ids, held, bodies):
        hashes, place, offsets = _words(bodies)
        common = np.argsort(-np.bincount(place, minlength=len(hashes)), kind="stable")
        number = np.empty(len(hashes), np.uint32)
        number[common] = np.arange(len(hashes))
        size, learn = np.diff(offsets).astype(np.int32), ~np.array(held, bool)
        row = {"block": block, "doc_id": ids, "held_out": held, "size": size.tolist(), "words": _pack(hashes[common]), "place": _pack(number[place])}
        return row | {"total": len(place), "learned": int(size[learn].sum()), "ends": int(learn.sum())}

    def run(batches):
        block, size, ids, held, bodies = TaskContext.get().partitionId() << 33, 0, [], [], []
        for batch in batches:
            for doc, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text").to_pylist()):
                body = normalised(text)
                if bodies and (len(bodies) >= BLOCK_ROWS or size + len(body) > BLOCK_BYTES):
                    yield pa.RecordBatch.from_pylist([state(block, ids, held, bodies)], schema)
                    block, size, ids, held, bodies = block + 1, 0, [], [], []
                size += len(body)
                ids.append(doc), held.append(out), bodies.append(body)
        if bodies:
            yield pa.RecordBatch.from_pylist([state(block, ids, held, bodies)], schema)

    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _STATE.split(", ")])
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text")
    return tables.write(rows.mapInArrow(run, _STATE), "blocks")


def least(value: float, tokens: int) -> float:
    """A count from 1 on, or a share of all tokens."""
    return value if value >= 1 else max(value * tokens, 1)


@dataclass
class Grams:
    """The grams of one length in a block: the one that ends at each place (-1: none), and of each its two parts and shard, by shard and parts.

    A gram of one word is its hash; a longer one the ids of the grams without its last and without its first word. Only if both are frequent can it be.
    """

    of: np.ndarray
    a: np.ndarray
    b: np.ndarray
    shard: np.ndarray


def _alike(number: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs among those of the numbers at some places and the ones before: first and second of the distinct pairs, rising; all places, by pair; where each pair's places begin."""
    bits, places = int(number.max(initial=0)).bit_length(), len(number).bit_length()
    pair = number[at - 1].astype(np.int64)
    pair <<= bits
    pair |= number[at]
    if 2 * bits + places < 64:  # pair and place in one number: sorted as it is, which takes a fifth of the time of an order
        pair <<= places
        pair |= at
        del at
        pair.sort()
        at = (pair & ((1 << places) - 1)).astype(np.int32)
        pair >>= places
    else:
        order = np.argsort(pair)
        pair, at = pair[order], at[order]
    begins = np.append(np.zeros(min(len(pair), 1), np.int64), np.flatnonzero(pair[1:] != pair[:-1]) + 1)
    distinct = pair[begins]
    return distinct >> bits, distinct & ((1 << bits) - 1), at, begins


class Block:
    """All texts of a block in one row of words, each text as start, words, end."""

    def __init__(self, state: dict, shards: int):
        self.state, self.shards = state, shards
        size, hashes = np.array(state["size"], np.int64), _unpack(state["words"], np.uint64)
        lengths = size + 2
        starts = np.cumsum(lengths) - lengths
        total = int(lengths.sum())
        self.words, place = np.unique(np.concatenate((hashes, [START, END])), return_inverse=True)
        place = place.astype(np.int32)
        inside = np.ones(total, bool)
        inside[starts] = inside[starts + lengths - 1] = False
        self.tokens = np.empty(total, np.int32)
        self.tokens[inside] = place[_unpack(state["place"], np.uint32)]
        self.tokens[starts], self.tokens[starts + lengths - 1] = place[-2], place[-1]
        self.at = np.arange(total, dtype=np.int32) - np.repeat(starts.astype(np.int32), lengths)
        self.learn = np.repeat(~np.array(state["held_out"], bool), lengths)

    def single(self) -> Grams:
        shard = ((self.words >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)
        return Grams(self.tokens, self.words.view(np.int64), np.zeros(len(self.words), np.int64), shard)

    def longer(self, length: int, shorter: Grams, ids: np.ndarray) -> Grams:
        """The grams of a length both of whose parts are frequent; `ids` are those of the shorter ones, -1 for rare ones."""
        often = ids >= 0
        number = np.append(np.where(often, np.cumsum(often) - 1, -1), -1).astype(np.int32)[shorter.of]
        known = number >= 0
        known[1:] &= known[:-1] & (self.at[1:] >= length - 1)
        known[:1] = False
        first, second, at, begins = _alike(number, np.flatnonzero(known).astype(np.int32))
        del number, known
        a, b = ids[often][first], ids[often][second]
        del first, second
        mixed = (a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        shard = ((mixed >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)
        del mixed
        order = np.argsort(shard.astype(np.uint16) if self.shards < 1 << 16 else shard, kind="stable")  # ids rise with the places of their grams, so grams rise within a shard
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        of = np.full(len(self.tokens), -1, np.int32)
        of[at] = np.repeat(rank, np.diff(begins, append=len(at)))
        del at, begins, rank
        a = a[order]
        b = b[order]
        return Grams(of, a, b, shard[order])

    def asks(self, grams: Grams) -> pa.RecordBatch:
        """A row per shard with what the block asks of it: parts of grams, and how often the block has learned them."""
        n = np.bincount(grams.of[self.learn & (grams.of >= 0)], minlength=len(grams.a)).astype(np.uint32)
        cuts = np.flatnonzero(np.concatenate((grams.shard[:1] >= 0, grams.shard[1:] != grams.shard[:-1])))
        ends = [*cuts[1:], len(grams.shard)]
        columns = [pa.array(grams.shard[cuts], pa.int64()), pa.array(np.full(len(cuts), self.state["block"]), pa.int64())]
        for pack, values in ((_rising, grams.a), (_pack, grams.b), (_pack, n)):
            columns.append(pa.array([pack(values[i:j]) for i, j in zip(cuts, ends)], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, ["shard", "block", "a", "b", "n"])

    def answered(self, replies: pa.Table, lengths: int) -> Iterator[Grams]:
        """The grams of all lengths that were asked for, then those of the next one, if there is one. Two lengths are held at once."""
        grams = self.single()
        for length in range(1, lengths + 1):
            yield grams
            mine = _of(replies, "a", length)
            ids = [np.zeros(0, np.int64)]
            for shard, pack in zip(mine.column("shard").to_pylist(), mine.column("a").to_pylist()):
                steps = _unpack(pack, np.uint32).astype(np.int64)
                ids.append(np.where(steps > 0, (shard << RANK_BITS) + np.cumsum(steps) - 1, -1))
            ids = np.concatenate(ids)
            if len(ids) != len(grams.a):
                raise ValueError("a gram of a block has no reply")
            grams.a = grams.b = grams.shard = None  # only the places of shorter grams are still needed
            if length <= DEPTH:
                grams = self.longer(length + 1, grams, ids)
            del ids
        if lengths <= DEPTH:
            yield grams


def _of(replies: pa.Table, column: str, length: int) -> pa.Table:
    """The replies on grams of a length that have a column, in the order of the grams."""
    return replies.filter(pc.and_(pc.equal(replies.column("length"), length), pc.is_valid(replies.column(column)))).sort_by("shard")


def _numbers(replies: pa.Table, column: str, length: int, kind: type) -> np.ndarray:
    packs = _of(replies, column, length).column(column).to_pylist()
    return np.concatenate([np.zeros(0, kind), *(_unpack(p, kind) for p in packs)])


_REPLY = "length int, shard bigint, block bigint, a binary, n binary, total binary, entries binary"


def _replies(counted: DataFrame, length: int, n: bool) -> DataFrame:
    none = F.lit(None).cast("binary")
    found = counted.where("block is not null")
    return found.select(F.lit(length).alias("length"), "shard", "block", "a", F.col("n") if n else none.alias("n"), none.alias("total"), none.alias("entries"))


def _by_parts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of grams by their parts, and where in it another gram begins."""
    low = np.uint64((1 << RANK_BITS) - 1)
    ranks, shards = (int((b & low).max(initial=0)).bit_length(), int((b >> np.uint64(RANK_BITS)).max(initial=0)).bit_length())
    short = ranks + shards
    if int(a.max(initial=0)) >> RANK_BITS << RANK_BITS and short:
        most = int((a & low).max(initial=0)).bit_length()
        a = a >> np.uint64(RANK_BITS) << np.uint64(most) | a & np.uint64((1 << most) - 1)
    if int(a.max(initial=0)).bit_length() + short <= 64:
        one = a << np.uint64(short) | b >> np.uint64(RANK_BITS) << np.uint64(ranks) | b & low if short else a
        order = np.argsort(one)
        return order, np.append(True, np.diff(one[order]) != 0)
    order = np.lexsort((b, a))
    return order, np.append(True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0))


def grams(state: DataFrame, before: list[DataFrame], shards: int, tokens: int, tables: Passing) -> DataFrame:
    """The grams of the length after those in `before`, counted over all learned texts; stored.

    A gram can be frequent only if both its parts are, which the replies to the shorter lengths tell, so each block asks once for every gram of which that holds, by shard of the gram.
    A row with a block is the reply to it, in the order in which it asked: `a` ranks of frequent grams as steps (0: rare), `n` counts. A row without one is the shard's
    frequent grams by rank, parts `a` and `b`, with counts; `words` is how many grams any learned text has.
    """
    ship(__name__)
    length, lowest = len(before) + 1, min(least(LEAST_CONTEXT, tokens), least(LEAST_ENTRY, tokens))

    def first(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, shards)
                yield block.asks(block.single())

    def later(rows, replies):
        block = Block(rows.to_pylist()[0], shards)
        return pa.Table.from_batches([block.asks(deque(block.answered(replies, length - 1), maxlen=1).pop())])

    def count(table):
        a = [_risen(p, np.uint64) for p in table.column("a").to_pylist()]
        cuts = np.cumsum([len(x) for x in a])[:-1]
        a = np.concatenate(a)
        b = np.concatenate([_unpack(p, np.int64) for p in table.column("b").to_pylist()])
        n = np.concatenate([_unpack(p, np.uint32) for p in table.column("n").to_pylist()]).astype(np.int64)
        order, new = _by_parts(a, b.view(np.uint64))
        total = np.add.reduceat(n[order], np.flatnonzero(new))
        often = total >= lowest
        rank = np.where(often, np.cumsum(often), 0).astype(np.uint32)
        told = total if length == 1 else np.where(often, total, 0)
        group = np.empty(len(a), np.int64)
        group[order] = np.cumsum(new) - 1
        one = order[np.flatnonzero(new)[often]]
        rows = {"shard": table.column("shard")[:1].to_pylist() * (table.num_rows + 1), "block": [*table.column("block").to_pylist(), None]}
        rows |= {"a": [], "b": [None] * table.num_rows, "n": [], "words": [None] * table.num_rows}
        for mine in np.split(group, cuts):
            steps = rank[mine]
            steps[steps > 0] = np.diff(steps[steps > 0], prepend=np.uint32(0))
            rows["a"].append(_pack(steps))
            rows["n"].append(_pack(told[mine]))
        for name, value in (("a", _rising(a[one])), ("b", _pack(b[one])), ("n", _pack(total[often])), ("words", int((total > 0).sum()))):
            rows[name].append(value)
        return pa.table(rows, schema)

    schema = pa.schema([(c, pa.int64()) for c in ("shard", "block")] + [(c, pa.binary()) for c in ("a", "b", "n")] + [("words", pa.int64())])
    asked = "shard bigint, block bigint, a binary, b binary, n binary"
    if before:
        replies = reduce(DataFrame.union, [_replies(c, k + 1, False) for k, c in enumerate(before)])
        asks = state.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(later, asked)
    else:
        asks = state.mapInArrow(first, asked)
    return tables.write(asks.groupBy("shard").applyInArrow(count, asked + ", words bigint"), f"grams-{length}")


class Part:
    """The frequent grams of one length in the shards of a part, in the order of their ids, and what else is known of each."""

    def __init__(self, own: pa.Table):
        own = own.sort_by("shard")
        shards = own.column("shard").to_numpy()
        rows = [[_risen(a, np.uint64).view(np.int64) for a in own.column("a").to_pylist()], [_unpack(b, np.int64) for b in own.column("b").to_pylist()]]
        self.a, self.b, self.n = (np.concatenate(r) for r in [*rows, [_unpack(n, np.int64) for n in own.column("n").to_pylist()]])
        self.part, self.shards, self.starts = own.column("part")[0].as_py(), shards.tolist(), np.zeros(PART_SHARDS, np.int64)
        self.ends = np.cumsum([len(a) for a in rows[0]]).tolist()
        self.starts[shards - self.part * PART_SHARDS] = [0, *self.ends[:-1]]

    def at(self, ids: np.ndarray) -> np.ndarray:
        """The places of grams of this part."""
        return self.starts[(ids >> RANK_BITS) - self.part * PART_SHARDS] + (ids & ((1 << RANK_BITS) - 1))

    def entries(self, lowest: float) -> tuple[np.ndarray, ...]:
        """The places of grams that count as a token after a context; the distinct contexts and suffixes of these, by id, and which of them each has."""
        of = np.flatnonzero(self.n >= lowest)
        return of, *np.unique(self.a[of], return_inverse=True), *np.unique(self.b[of], return_inverse=True)

    def sums(self, told: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Of each gram, as a context, the sum of the counts after it and their number, from what the parts of its entries tell."""
        total, entries = np.zeros(len(self.n), np.int64), np.zeros(len(self.n), np.int64)
        for row in told:
            at = self.at(_risen(row["prefix"], np.int64))
            total[at] += _unpack(row["total"], np.int64)
            entries[at] += _unpack(row["entries"], np.int64)
        return total, entries


_TOLD = "kind string, part bigint, other bigint, prefix binary, suffix binary, seen binary, total binary, entries binary, value binary"


def _told(rows: list[dict]) -> pa.Table:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.Table.from_pylist(rows, pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _TOLD.split(", ")]))


def _kind(told: pa.Table, kind: str) -> list[dict]:
    """What is told of one kind, by the part that tells it."""
    return told.filter(pc.equal(told.column("kind"), kind)).sort_by("other").to_pylist()


def _by_owner(*ids: np.ndarray) -> Iterator[tuple[int, list[slice]]]:
    """Each part that has any of some rising ids, with which of them it has."""
    parts = [(i >> RANK_BITS) // PART_SHARDS for i in ids]
    for owner in np.unique(np.concatenate([p[np.flatnonzero(np.diff(p, prepend=-1))] for p in parts])).tolist():
        yield owner, [slice(*np.searchsorted(p, (owner, owner + 1)).tolist()) for p in parts]


def _rest(seen: np.ndarray, total: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The share that contexts leave to their suffixes; `seen` is 0 for what is no candidate."""
    return np.where(seen > 0, (seen - total + DISCOUNT * entries) / np.maximum(seen, 1), 1.0)


def tree(counted: list[DataFrame], tokens: int, distinct: int, tables: Passing) -> list[DataFrame]:
    """For each length of contexts `kind, other, total, entries`; those of kind `kept` have the shard as `other` and say of each of its frequent grams, by rank, 0 if it is not retained.

    `entries` is the number of tokens counted after a context, `total` the sum of their counts. A context's own share of a token is its discounted count; the rest goes to its
    suffix, so the chances of all tokens sum to one. Its divergence is what it saves against the suffix on the tokens counted after it. That is negative for contexts that say
    nothing new. What passes stays, with all its suffixes.

    From short to long, the part that has the entries asks the parts that have their contexts and suffixes, once for each of these; and tells what its entries save.
    """
    ship(__name__)
    least_context, least_entry = least(LEAST_CONTEXT, tokens), least(LEAST_ENTRY, tokens)

    def ask(own):
        part = Part(own)
        of, prefix, after, suffix, _ = part.entries(least_entry)
        entries = np.bincount(after, minlength=len(prefix))
        total = np.bincount(after, part.n[of], len(prefix)).astype(np.int64)
        rows = []
        for owner, (p, s) in _by_owner(prefix, suffix):
            row = {"kind": "ask", "part": owner, "other": part.part, "prefix": _rising(prefix[p]), "suffix": _rising(suffix[s])}
            rows.append(row | {"total": _pack(total[p]), "entries": _pack(entries[p])})
        return _told(rows)

    def answer(own, told):
        part, asks, chance = Part(own), _kind(told, "ask"), _kind(told, "chance")
        chance = _unpack(chance[0]["value"], np.float64) if chance else (part.n + 0.5) / (tokens + 0.5 * (distinct + 1))
        total, entries = part.sums(asks)
        seen = np.where((part.n >= least_context) & (entries > 0), part.n, 0)
        rows = []
        for row in asks:
            at, value = part.at(_risen(row["prefix"], np.int64)), chance[part.at(_risen(row["suffix"], np.int64))]
            row = {"kind": "answer", "part": row["other"], "other": part.part, "seen": _pack(seen[at]), "total": _pack(total[at])}
            rows.append(row | {"entries": _pack(entries[at]), "value": _pack(value)})
        return _told(rows)

    def learn(own, told):
        part, told = Part(own), _kind(told, "answer")
        of, prefix, after, suffix, shorter = part.entries(least_entry)
        seen, total, entries = (np.concatenate([np.zeros(0, np.int64), *(_unpack(r[c], np.int64) for r in told)]) for c in ("seen", "total", "entries"))
        old = np.concatenate([np.zeros(0), *(_unpack(r["value"], np.float64) for r in told)])
        if (len(seen), len(old)) != (len(prefix), len(suffix)):
            raise ValueError("an entry has no answer on its context or suffix")
        n, old, candidate = part.n[of], old[shorter], seen[after] > 0
        own_chance = np.where(candidate, (n - DISCOUNT) / np.maximum(seen, 1)[after] + _rest(seen, total, entries)[after] * old, np.nan)
        saved = np.bincount(after, np.where(candidate, n * np.log(own_chance / old), 0), len(prefix))
        chance = np.full(len(part.n), np.nan)
        chance[of] = own_chance
        total, entries = np.bincount(after, n, len(prefix)).astype(np.int64), np.bincount(after, minlength=len(prefix))
        rows = [{"kind": "chance", "part": part.part, "value": _pack(chance)}]
        for owner, (p,) in _by_owner(prefix):
            row = {"kind": "saved", "part": owner, "other": part.part, "prefix": _rising(prefix[p]), "value": _pack(saved[p])}
            rows.append(row | {"total": _pack(total[p]), "entries": _pack(entries[p])})
        return _told(rows)

    def keep(own, told):
        part, saves = Part(own), _kind(told, "saved")
        total, entries = part.sums(saves)
        seen, saved = np.where((part.n >= least_context) & (entries > 0), part.n, 0), np.zeros(len(part.n))
        for row in saves:
            saved[part.at(_risen(row["prefix"], np.int64))] += _unpack(row["value"], np.float64)
        other = np.maximum(1 - total / np.maximum(seen, 1), 0)
        good = saved / np.maximum(seen, 1) + other * np.log(_rest(seen, total, entries)) >= LEAST_DIVERGENCE
        for row in _kind(told, "needed"):
            good[part.at(_risen(row["prefix"], np.int64))] = True
        total[(seen == 0) | ~good] = entries[(seen == 0) | ~good] = 0
        rows = []
        for shard, i, j in zip(part.shards, [0, *part.ends], part.ends):
            rows.append({"kind": "kept", "part": part.part, "other": shard, "total": _pack(total[i:j]), "entries": _pack(entries[i:j])})
        suffix = np.unique(part.b[entries > 0])
        rows += [{"kind": "needed", "part": owner, "other": part.part, "prefix": _rising(suffix[s])} for owner, (s,) in _by_owner(suffix)]
        return _told(rows)

    def together(length, told, run, name):
        return tables.write(own[length - 1].groupBy("part").cogroup(told.groupBy("part")).applyInArrow(run, _TOLD), name)

    own = [c.where("block is null").select(F.floor(F.col("shard") / PART_SHARDS).alias("part"), "shard", "a", "b", "n") for c in counted]
    chances, kept = [], []
    for depth in range(1, DEPTH + 1):
        asks = own[depth].groupBy("part").applyInArrow(ask, _TOLD)
        answers = together(depth, asks.union(chances[-1].where("kind = 'chance'")) if chances else asks, answer, f"answers-{depth}")
        chances.append(together(depth + 1, answers, learn, f"chances-{depth}"))
        tables.drop(answers)
    for depth in range(DEPTH, 0, -1):
        told = chances[depth - 1].where("kind = 'saved'")
        kept.insert(0, together(depth, told.union(kept[0].where("kind = 'needed'")) if kept else told, keep, f"tree-{depth}"))
    tables.drop(*chances)
    return kept


def rests(counted: DataFrame, kept: DataFrame, length: int) -> DataFrame:
    """To every block that asked for grams of a length, `total` and `entries` of those that are retained contexts (0: not retained), in the order in which it asked."""
    ship(__name__)

    def run(asked, given):
        known = [np.concatenate([np.zeros(0, np.int64), *(_unpack(p, np.int64) for p in given.column(c).to_pylist())]) for c in ("total", "entries")]
        found = []
        for shard, block, pack in zip(*(asked.column(c).to_pylist() for c in ("shard", "block", "a"))):
            steps = _unpack(pack, np.uint32)
            there = steps > 0
            mine = np.cumsum(steps, dtype=np.int64)[there] - 1
            row = [length, shard, block, None, None]
            for of in known:
                told = np.zeros(len(steps), np.int64)
                told[there] = of[mine]
                row.append(_pack(told))
            found.append(row)
        names = [c.split()[0] for c in _REPLY.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
        return pa.Table.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names)

    asked = counted.where("block is not null").select("shard", "block", "a")
    given = kept.where("kind = 'kept'").select(F.col("other").alias("shard"), "total", "entries")
    return asked.groupBy("shard").cogroup(given.groupBy("shard")).applyInArrow(run, _REPLY)


def chances(block: Block, replies: pa.Table, of_words: Callable[[np.ndarray], np.ndarray], lowest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of a block the learned count and the chance without context (by counts, given); for each place the chance after its longest retained context."""
    depth, context = 0, None
    for grams in block.answered(replies, DEPTH + 1):
        own, n = grams.of, _numbers(replies, "n", depth + 1, np.int64)
        if not depth:
            seen, base = n, of_words(n)
            chance, open_ = base[own], np.flatnonzero(block.at > 0).astype(np.int32)
        else:
            total, entries = (_numbers(replies, c, depth, np.int64) for c in ("total", "entries"))
            retained, left = np.append(entries > 0, False), (times - total + DISCOUNT * entries) / np.maximum(times, 1)
            del total, entries
            counted, still = np.append(np.where(n >= lowest, n - DISCOUNT, 0), 0), []
            for some in np.array_split(open_, max(1, len(open_) // PLACES)):
                before = context[some - 1]
                kept = np.flatnonzero(retained[before])
                some, before = some[kept], before[kept]
                chance[some] = chance[some] * left[before] + counted[own[some]] / times[before]
                still.append(some)
            open_ = np.concatenate(still)
            del retained, left, counted, still
        depth, context, times = depth + 1, own, n
        del grams, own, n
    return seen, base, chance


_SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def score(docs: DataFrame) -> DataFrame:
    """`doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score` of every document, null text as empty.

    `base_score` is the log10 probability of a text's words and its end by smoothed counts of the learned documents alone, `score` that by the
    tree, whose root they are. Repeated rows are scored, and learned from, each. Without learned documents all tokens are unknown.
    """
    tables = Passing(docs.sparkSession)
    state = prepared(docs, tables)
    sums = state.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "learned", "ends"))).first()
    ends, tokens = sums["ends"], sums["learned"] + sums["ends"]
    shards = max(1, math.ceil(sums["total"] / SHARD_WORDS))
    counted = []
    for _ in range(DEPTH + 1):
        counted.append(grams(state, counted, shards, tokens, tables))
    distinct = (counted[0].agg(F.sum("words")).first()[0] or 0) - int(ends > 0)  # the start is no token
    kept = tree(counted, tokens, distinct, tables)
    told = [tables.write(rests(counted[k], kept[k], k + 1), f"rests-{k + 1}") for k in range(DEPTH)]
    tables.drop(*kept)
    lowest = least(LEAST_ENTRY, tokens)

    def run(rows, replies):
        block = Block(rows.to_pylist()[0], shards)
        seen, base, chance = chances(block, replies, lambda c: (c + 0.5) / (tokens + 0.5 * (distinct + 1)), lowest)
        starts = np.flatnonzero(block.at == 0)
        seen[block.tokens[starts]], base[block.tokens[starts]], chance[starts] = 0, 1.0, 1.0  # the start is no token
        size = np.array(block.state["size"], np.int64)
        columns = [
            pa.array(block.state["doc_id"], pa.int64()),
            pa.array(block.state["held_out"], pa.bool_()),
            pa.array(size + 1),
            pa.array(np.add.reduceat((seen > 0)[block.tokens], starts, dtype=np.int64)),
            pa.array(np.add.reduceat(np.log10(base)[block.tokens], starts)),
            pa.array(np.add.reduceat(np.log10(chance), starts)),
        ]
        return pa.Table.from_arrays(columns, [c.split()[0] for c in _SCORED.split(", ")])

    replies = reduce(DataFrame.union, [*(_replies(c, k + 1, True) for k, c in enumerate(counted)), *told])
    together = state.groupBy("block").cogroup(replies.groupBy("block"))
    return together.applyInArrow(run, _SCORED).withColumn("train_tokens", F.lit(tokens).cast("bigint"))
