"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

A size-aware heavy-light join.  Light sets, of at most x shingles, enumerate their subsets of the fixed size
that two sets of their sizes must share, so that a common subset is nearly a link.  Heavy sets,
and light ones against heavy ones, meet in inverted lists; a set of n need only enter the lists of
its n/5 + 1 first shingles in one order common to all.  The boundary x is chosen by cost: numbers of
subsets against list entries and the candidates they make, from the sets' actual sizes and lists.

The common order is by document frequency, counted over all documents: tasks gather their documents in chunks, send
the distinct shingles of each chunk to the task that counts that part of the hash space, and get back those that
other sets have too (beyond ``RELAY_PARTS`` parts through relays, so that rows don't dwindle).  Shingles of one set alone come first in the order and lie in no list but their own, so
they are never listed: a set with more than n/5 of them links with nothing and is done with.

Lists hold, per chunk and run of compatible sizes, one entry; entries of a list whose sizes are compatible are
candidates, which is linear in a list's length however many sets it has, and every pair that can link lies in one
connected block of candidates.  Equal sets are one.  A block's whole sets meet in one task if they are few.  There an exact
search walks from set to set over shared shingles and counts overlaps with sets not reached yet, so a group of g
near copies costs about g, not g squared, comparisons.

A larger block is dealt to many tasks.  First each slice of it meets the same few sets of the block, its hubs, drawn by hash; the
sets that link with the hubs that hang together most are one component and need not be compared with each other.  The
others are compared with everything in the block, each part of them with each slice.  So a large group of near copies
costs in proportion to its size; a block that no hubs hold together costs the square of its number of parts.
Sets that link are joined; components follow from those links.

Shingles are 64-bit hashes of word sequences (lower-cased A-Z).

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing.  Rows
repeated with one ``doc_id`` get a row each.  A null ``doc_id`` is linked with nothing and is its own (null) component.  Other columns are not read.
Nearly all jobs run while the query is built.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations, groupby
from math import ceil, comb, isqrt
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantry.llm.common import memory_returned, partitions_for, written
from gantry.llm.components import Forest, components
from gantry.llm.payloads import Block, pack, relayed, rows_of, unpack
from gantry.llm.textbytes import MIX, U64, lowered_bytes, mixed, slices, word_hashes

WORDS = 5
MAX_LIGHT = 16
VERIFY = 12  # what a candidate costs, in list entries, as its whole text is sent and read
CHUNK_SHINGLES = 1_000_000
PART_BYTES = 8 << 20  # of text per part of the hash space
RELAY_PARTS = 1024
BLOCK_SHINGLES = 2_000_000
LEAST_BLOCK = 20_000
HUBS = 8
BROADCAST_NODES = 2_000_000
Batches = Iterator[pa.RecordBatch]


def shingles(text: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the 5-word sequences; of the whole sequence if there are fewer words."""
    words = word_hashes(text)
    n = max(1, len(words) - WORDS + 1)
    if not len(words):
        return words
    found = words[:n].copy()
    for k in range(1, min(len(words), WORDS)):
        found = (found ^ (found >> U64(29))) * MIX[k] + words[k : k + n]
    return np.unique(mixed(found))


def links(o: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
    """Whether overlap ``o`` of sets of ``a`` and ``b`` links them: o / (a + b - o) >= 0.8."""
    return 100 * o >= 80 * (a + b - o)


# Steps 1 to 3: document frequencies.  Rows of chunks go to parts of the hash space and back.

ROW = "unit long, other long, payload binary"  # documents have other -1


def _batched(rows: Iterator[tuple[int, int, bytes]], limit: int = 2 << 20) -> Batches:
    held, size = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({name: pa.array(x, kind) for name, x, kind in zip(("unit", "other", "payload"), zip(*held, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)})

    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > limit or len(held) >= 1000:
            yield out()
            held, size = [], 0
    if held:
        yield out()


@dataclass(frozen=True)
class Routes:
    """Parts of the hash space, and how rows get to them and back: straight, or beyond ``RELAY_PARTS`` through relays.

    A relay serves a group of receivers and a band of senders, so that it holds about as much as a chunk.
    """

    parts: int
    part_groups: int
    chunk_bands: int
    chunk_groups: int
    part_bands: int
    relays: bool

    @staticmethod
    def of(parts: int, chunks: int, straight: int) -> Routes:
        """``straight``: up to so many parts without relays."""
        groups, back = isqrt(parts), max(1, isqrt(chunks))
        return Routes(parts, groups, max(1, chunks // groups), back, max(1, parts // back), parts > straight)

    def to_parts(self, parts: np.ndarray, chunk: int) -> np.ndarray:
        if not self.relays:
            return parts
        return parts * self.part_groups // self.parts * self.chunk_bands + _banded(np.array([chunk]), self.chunk_bands)

    def to_chunks(self, chunks: np.ndarray, part: int) -> np.ndarray:
        return _banded(chunks, self.chunk_groups) * self.part_bands + part % self.part_bands if self.relays else chunks


def _banded(numbers: np.ndarray, bands: int) -> np.ndarray:
    return (mixed(numbers.astype(U64)) % U64(bands)).astype(np.int64)


def _chunks(routes: Routes):
    """Per chunk its documents, and per part the shingles with the sets that have them.

    Equal sets of a chunk enter once.  Within a part shingles are known by 32 of their bits; sets that
    meet by chance in those become candidates and no more.
    """

    def chunk(number: int, ids: list, sizes: list[int], keys: list, same: list[int], sets: list[np.ndarray]) -> Iterator[tuple]:
        known = [i is not None for i in ids]
        yield number, -1, pack(
            np.array([i or 0 for i in ids], np.int64), np.array(known, np.uint8), np.array(sizes, np.int32),
            np.array(same, np.int32), np.array(keys, U64).reshape(-1, 2).T.copy().reshape(-1),
        )
        if not sets:
            return
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
        part_of = ((flat >> U64(32)) * U64(routes.parts) >> U64(32)).astype(np.int32)
        # By part, then by the other 32 bits, then by set: the stable sort keeps sets in order.
        order = np.argsort(part_of.astype(np.int64) << 32 | (flat & U64(0xFFFFFFFF)).astype(np.int64), kind="stable")
        part_of, low, owner = part_of[order], flat[order].astype(np.uint32), owner[order]
        del flat, order
        parts, first = np.unique(part_of, return_index=True)
        block = Block(parts.astype(np.int64), np.full(len(parts), number), np.diff(first, append=len(part_of)), [low, owner])
        for unit, own in block.dealt(routes.to_parts(block.targets, number)):
            yield unit, number, own.pack()

    def rows(batches: Batches) -> Iterator[tuple[int, int, bytes]]:
        number, total = TaskContext.get().partitionId() << 32, 0
        ids, sizes, keys, same, sets, seen = [], [], [], [], [], {}
        for batch in (part for whole in batches for part in slices(whole)):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), lowered_bytes(batch.column("text")), strict=True):
                found = shingles(text)
                ids.append(doc_id)
                sizes.append(len(found))
                key = (int(np.bitwise_xor.reduce(mixed(found))), int(found.sum())) if len(found) else (0, 0)
                keys.append(key)
                if doc_id is None or not len(found):
                    same.append(-1)
                    continue
                place = seen.setdefault((len(found), *key), len(sets))
                same.append(place)
                if place == len(sets):
                    sets.append(found)
                    total += len(found)
                if total >= CHUNK_SHINGLES or len(ids) >= CHUNK_SHINGLES // 8:
                    yield from chunk(number, ids, sizes, keys, same, sets)
                    number, total = number + 1, 0
                    ids, sizes, keys, same, sets, seen = [], [], [], [], [], {}
        if ids:
            yield from chunk(number, ids, sizes, keys, same, sets)

    def run(batches: Batches) -> Batches:
        with memory_returned():
            yield from _batched(rows(batches))

    return run


def _relayed(batches: Batches) -> Batches:
    with memory_returned():
        yield from _batched(relayed(rows_of(batches, "unit", "other", "payload")))


def _frequencies(routes: Routes):
    def run(batches: Batches) -> Batches:
        with memory_returned():
            yield from _batched(_counted(batches, routes))

    return run


ALONE = 0


def _counted(batches: Batches, routes: Routes) -> Iterator[tuple[int, int, bytes]]:
    """To each chunk its shingles of a part that other sets have too, with the level of their frequency; and by set how many are not, with the level ``ALONE``."""
    for part, rows in groupby(rows_of(batches, "unit", "other", "payload"), itemgetter(0)):
        held = []
        for unit, other, payload in rows:
            if other < 0:
                yield unit, other, payload
            else:
                held.append(payload)
        if not held:
            continue
        block = Block.joined(held)
        del held
        (low, owner), entry = block.values, block.entries()
        _, place, frequency = np.unique(low, return_inverse=True, return_counts=True)
        df = frequency[place]
        del place, frequency
        common = df > 1
        levels = np.minimum(np.ceil(np.log2(df[common])), 255).astype(np.uint8)
        sets, alone = np.unique(entry[~common] << 32 | owner[~common].astype(np.int64), return_counts=True)
        entry = np.concatenate((entry[common], sets >> 32))
        order = np.argsort(entry, kind="stable")
        values = [
            np.concatenate((low[common], alone.astype(np.uint32)))[order],
            np.concatenate((levels, np.full(len(sets), ALONE, np.uint8)))[order],
            np.concatenate((owner[common], sets.astype(np.uint32)))[order],
        ]
        back = Block(block.sources, np.full(len(block.sources), part), np.bincount(entry, minlength=len(block.sources)), values)
        for unit, own in back.dealt(routes.to_chunks(back.targets, part)):
            yield unit, part, own.pack()


def _runs(key: np.ndarray, n: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of compatible sizes in lists: key, least size, largest size, one owner; and the pairs that tie owners together."""
    order = np.lexsort((who, n, key))
    key, n, who = key[order], n[order], who[order]
    near = (key[1:] == key[:-1]) & (5 * n[:-1] >= 4 * n[1:])
    starts = np.flatnonzero(np.concatenate(([True], ~near)))
    ends = np.append(starts[1:], len(key)) - 1
    return key[starts], n[starts], n[ends], who[starts], who[:-1][near], who[1:][near]


DOCUMENT, LISTED, TIED, SMALL = range(4)
GATHERED = "kind int, a long, b long, c long, d long, e long"


def _gathered(kind: int, **columns: np.ndarray) -> pa.RecordBatch:
    size = len(columns["a"])
    arrays = {"kind": pa.array(np.full(size, kind, np.int32))}
    for name in "abcde":
        arrays[name] = columns.get(name, pa.nulls(size, pa.int64()))
    return pa.RecordBatch.from_pydict({k: x if isinstance(x, pa.Array) else pa.array(x) for k, x in arrays.items()})


def _together(batches: Batches) -> Batches:
    """Of each chunk: documents (id, n, the set's key in two parts, smallest document of the chunk with this set), list
    entries (key, least and largest n, document), tied documents, and small sets by shingle (id, n, key, place in the order)."""
    with memory_returned():
        for _, rows in groupby(rows_of(batches, "unit", "other", "payload"), itemgetter(0)):
            yield from _of_chunk(rows)


def _of_chunk(rows: Iterator[tuple]) -> Batches:
    _, _, payload = next(rows)
    ids, known, sizes, same, keys = unpack(payload)
    keys = keys.view(np.int64).reshape(2, -1)
    mine = np.flatnonzero(same >= 0)
    first = mine[np.unique(same[mine], return_index=True)[1]]  # of each set the first document that has it
    lowest = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(lowest, same[mine], ids[mine])
    yield _gathered(
        DOCUMENT, a=pa.array(ids, mask=known == 0), b=sizes.astype(np.int64), c=keys[0], d=keys[1],
        e=pa.array(np.where(same >= 0, lowest[same] if len(lowest) else 0, 0), mask=same < 0),
    )
    if not len(first):
        return
    block = Block.joined([payload for _, _, payload in rows])
    (low, level, owner), part = block.values, np.repeat(block.sources, block.sizes)
    counted = level == ALONE
    alone = np.bincount(owner[counted], low[counted], minlength=len(first)).astype(np.int64)
    low, level, owner = low[~counted].astype(np.int64) | part[~counted] << 32, level[~counted], owner[~counted].astype(np.int64)
    del block, part, counted
    n = sizes[first].astype(np.int64)
    # Places in the order: those of one set alone come first.
    order = np.lexsort((low, level, owner))
    low, owner = low[order], owner[order]
    begins = np.searchsorted(owner, np.arange(len(first)))
    place = np.arange(len(owner)) - begins[owner] + alone[owner]
    small = n[owner] <= MAX_LIGHT
    early = place <= n[owner] // 5
    rest = (alone <= n // 5)[owner]
    yield from _listings(low, owner, early & rest & ~small, n, lowest)
    at = np.flatnonzero(small & rest)
    if len(at):
        # Small sets whole, in order: how they are listed depends on the boundary.
        yield _gathered(SMALL, a=lowest[owner[at]], b=n[owner[at]], c=low[at], d=place[at])


def _listings(low: np.ndarray, owner: np.ndarray, chosen: np.ndarray, n: np.ndarray, ids: np.ndarray) -> Batches:
    key, who = low[chosen], owner[chosen]
    if len(key):
        key, least, largest, one, left, right = _runs(key, n[who], ids[who])
        yield _gathered(LISTED, a=key, b=least, c=largest, d=one)
        forest = Forest()
        for a, b in set(zip(left.tolist(), right.tolist(), strict=True)):
            forest.join(a, b)
        nodes, roots = forest.edges()
        yield _gathered(TIED, a=np.array(nodes, np.int64), b=np.array(roots, np.int64))


# Step 4: small sets, by the boundary that costs least.


def subset_sizes(n: int, light: int) -> list[tuple[int, int]]:
    """For a set of n: (size b of the larger set, shingles that two such sets share at least), b up to ``light``."""
    return [(b, ceil(4 * b / 5)) for b in range(n, min(5 * n // 4, light) + 1)]


def boundary(small: DataFrame) -> int:
    """The size up to which enumerating subsets costs less than scanning lists and verifying what meets there; ``small`` has a row for each set and shingle."""
    counts = {r["n"]: r["c"] for r in small.groupBy("n").agg(F.count_distinct("doc_id").alias("c")).collect()}
    keys = small.filter(F.col("place") <= F.expr("n div 5"))
    lists = keys.groupBy("key").agg(*(F.count_if(F.col("n") <= x).cast("double").alias(f"c{x}") for x in range(1, MAX_LIGHT + 1)))
    # Entries are scanned once; those that are not alone in their list make candidates.
    entries = lambda c: F.sum(c + F.when(c > 1, VERIFY * c).otherwise(0.0))
    scans = lists.agg(*(entries(F.col(f"c{x}")).alias(f"c{x}") for x in range(1, MAX_LIGHT + 1))).first()
    cost = {0: 0.0}
    for x in range(1, MAX_LIGHT + 1):
        subsets = sum(c * sum(comb(n, k) for _, k in subset_sizes(n, x)) for n, c in counts.items() if n <= x)
        cost[x] = subsets - (scans[f"c{x}"] or 0.0)
    return min(cost, key=lambda x: (cost[x], x))


def _small_keys(light: int):
    """List entries of small sets: of subsets up to the boundary, of first shingles beyond it or against sets beyond it."""

    def entries(rows: Iterator[tuple]) -> Iterator[tuple[int, int, int]]:
        for (doc_id, n), own in groupby(rows, itemgetter(0, 1)):
            found = [(key, place) for _, _, key, place in own]
            if n <= light:
                each = mixed(np.array([key for key, _ in found], np.int64).view(U64)).tolist()
                for b, size in subset_sizes(n, light):
                    for subset in combinations(each, size):
                        yield (sum(subset) + b & (1 << 64) - 1) - (1 << 63), n, doc_id
            if n > light or 5 * n >= 4 * (light + 1):
                yield from ((key, n, doc_id) for key, place in found if place <= n // 5)

    def run(batches: Batches) -> Batches:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "key", "place")), strict=True))
        held = []
        for entry in entries(rows):
            held.append(entry)
            if len(held) >= 50_000:
                yield _entry_batch(held)
                held = []
        if held:
            yield _entry_batch(held)

    return run


def _entry_batch(entries: list[tuple[int, int, int]]) -> pa.RecordBatch:
    key, n, doc_id = zip(*entries, strict=True)
    return pa.RecordBatch.from_pydict({"key": pa.array(key, pa.int64()), "least": pa.array(n, pa.int64()), "largest": pa.array(n, pa.int64()), "doc_id": pa.array(doc_id, pa.int64())})


def _neighbours(batches: Batches) -> Batches:
    """Of lists sorted by key and least size: neighbours that hold compatible sizes."""
    last, forest = None, Forest()
    for batch in batches:
        for key, least, largest, doc_id in zip(*(batch.column(c).to_pylist() for c in ("key", "least", "largest", "doc_id")), strict=True):
            if last is not None and last[0] == key and 5 * last[1] >= 4 * least:
                forest.join(last[2], doc_id)
                last = key, max(largest, last[1]), doc_id
            else:
                last = key, largest, doc_id
        if len(forest.parent) > 200_000:
            yield _edge_batch(forest)
            forest = Forest()
    yield _edge_batch(forest)


def _edge_batch(forest: Forest) -> pa.RecordBatch:
    a, b = forest.edges()
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


# Step 5: whole sets of blocks.


def walk(ids: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links that connect whatever is connected: a search over shared shingles, against sets not reached yet."""
    first: dict[bytes, int] = {}
    own, whose = [], []
    for doc_id, found in zip(ids, sets, strict=True):
        known = first.setdefault(found.tobytes(), len(own))
        if known < len(own):
            yield whose[known], doc_id
        else:
            own.append(found)
            whose.append(doc_id)
    sizes = np.array([len(s) for s in own])
    left = np.ones(len(own), bool)
    n_left = len(own)

    def lists() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shingles, and by shingle the sets not reached yet."""
        at = np.flatnonzero(left)
        flat, owner = np.concatenate([own[i] for i in at]), np.repeat(at, sizes[at])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        return flat[starts], np.append(starts, len(flat)), owner

    if not own:
        return
    keys, starts, owners = lists()
    listed = n_left
    for seed in range(len(own)):
        if not left[seed]:
            continue
        left[seed] = False
        n_left -= 1
        queue = [seed]
        while queue and n_left:
            if 2 * n_left < listed:
                keys, starts, owners = lists()
                listed = n_left
            x = queue.pop()
            at = np.minimum(np.searchsorted(keys, own[x]), len(keys) - 1)
            at = at[keys[at] == own[x]]
            if not len(at):
                continue
            lengths = starts[at + 1] - starts[at]
            places = np.repeat(starts[at] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
            reached = owners[places]
            shared = np.bincount(reached[left[reached]], minlength=len(own))
            for y in np.flatnonzero((shared > 0) & links(shared, len(own[x]), sizes)).tolist():
                left[y] = False
                n_left -= 1
                queue.append(y)
                yield whose[x], whose[y]


def across(ids: list[int], sets: list[np.ndarray], joined: list[int], joined_sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Of each set a link with one of ``joined``, which are known to hang together, if it has any."""
    flat, owner = np.concatenate(joined_sets), np.repeat(np.arange(len(joined)), [len(s) for s in joined_sets])
    order = np.argsort(flat, kind="stable")
    flat, owner, sizes = flat[order], owner[order], np.array([len(s) for s in joined_sets])
    for x, found in zip(ids, sets, strict=True):
        first, after = np.searchsorted(flat, found, "left"), np.searchsorted(flat, found, "right")
        lengths = after - first
        places = np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        shared = np.bincount(owner[places], minlength=len(joined))
        hit = np.flatnonzero((shared > 0) & links(shared, len(found), sizes))
        if len(hit):
            yield x, joined[int(hit[0])]


def _groups(batches: Batches, keys: list[str], *columns: str) -> Iterator[tuple[list, list[tuple], list[np.ndarray]]]:
    """Of texts sorted by ``keys``: each group's key, its other columns by row, and its sets."""
    now, rows, sets = None, [], []
    for batch in batches:
        for part in slices(batch):
            named = [list(zip(*(part.column(c).to_pylist() for c in names), strict=True)) for names in (keys, columns)]
            for key, row, text in zip(*named, lowered_bytes(part.column("text")), strict=True):
                if key != now:
                    if rows:
                        yield now, rows, sets
                    now, rows, sets = key, [], []
                rows.append(row)
                sets.append(shingles(text))
    if rows:
        yield now, rows, sets


def _linked(batches: Batches) -> Batches:
    """Whole texts sorted by (block, low, high): links of each group, in which sets that are ``joined`` aren't compared with each other."""
    with memory_returned():
        forest = Forest()
        for _, rows, sets in _groups(batches, ["block", "low", "high"], "doc_id", "joined"):
            apart, joined = ([k for k, (_, j) in enumerate(rows) if j == which] for which in (False, True))
            of = lambda which: ([rows[k][0] for k in which], [sets[k] for k in which])  # noqa: B023, E731
            for a, b in across(*of(apart), *of(joined)) if joined else walk(*of(apart)):
                forest.join(a, b)
            if len(forest.parent) > 10_000:
                yield _edge_batch(forest)
                forest = Forest()
        yield _edge_batch(forest)


def _with_hubs(batches: Batches) -> Batches:
    """Texts sorted by (block, slice, hub), hubs first: each other set's links with them, as ids and as bits."""
    with memory_returned():
        for (block, _), rows, sets in _groups(batches, ["block", "slice"], "hub", "doc_id"):
            hubs = [(hub, doc_id, found) for (hub, doc_id), found in zip(rows, sets, strict=True) if hub >= 0]
            ids, masks, linked = [], [], []
            for (hub, doc_id), found in zip(rows, sets, strict=True):
                if hub < 0:
                    shared = [(h, i, len(np.intersect1d(found, other, assume_unique=True)), len(other)) for h, i, other in hubs]
                    hit = [(h, i) for h, i, o, n in shared if o and links(o, len(found), n)]
                    ids.append(doc_id)
                    masks.append(sum(1 << h for h, _ in hit))
                    linked.append([i for _, i in hit])
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "block": pa.array([block] * len(ids), pa.int64()), "mask": pa.array(masks, pa.int64()), "hubs": pa.array(linked, pa.list_(pa.int64()))})


def _main(batches: Batches) -> Batches:
    """Of each block, from the numbers of sets by mask: the hubs that hang together with the most sets."""
    for batch in batches:
        mains = []
        for counts in batch.column("counts").to_pylist():
            whole = [c["mask"] for c in counts]
            for _ in range(HUBS):  # unions of masks that share a hub
                whole = [_union(m, whole) for m in whole]
            size = {m: sum(c["n"] for c in counts if c["mask"] & m) for m in whole}
            mains.append(max(whole, key=lambda m: (size[m], m), default=0))
        yield pa.RecordBatch.from_pydict({"block": batch.column("block"), "main": pa.array(mains, pa.int64())})


def _union(mask: int, masks: list[int]) -> int:
    for other in masks:
        if other & mask:
            mask |= other
    return mask


def gathered(docs: DataFrame) -> DataFrame:
    """Documents, list entries and ties of all chunks, once written."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions_for(docs, size // PART_BYTES + 1)
    routes = Routes.of(n, size // (6 * CHUNK_SHINGLES) + 1, RELAY_PARTS)  # a word and the blank after it are some six bytes
    dealt = lambda rows: rows.repartition(n, "unit").sortWithinPartitions("unit", "other")
    through = lambda rows: dealt(rows).mapInArrow(_relayed, ROW) if routes.relays else rows
    counted = dealt(through(docs.mapInArrow(_chunks(routes), ROW))).mapInArrow(_frequencies(routes), ROW)
    return written(dealt(through(counted)).mapInArrow(_together, GATHERED), "sets")


def _hash_of(ids: str, parts: Column | int) -> Column:
    return F.pmod(F.xxhash64(ids), F.lit(parts) if isinstance(parts, int) else parts).cast("int")


def _held_together(texts: DataFrame, large: DataFrame, n: int, marked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Of the sets of ``large`` blocks (``block, slices``) their hubs: ``doc_id, block, hubs, joined``.  Tables of a few rows a block go through ``marked``."""
    members = texts.join(marked(large), "block")
    hubs = members.groupBy("block", _hash_of("doc_id", HUBS).alias("hub")).agg(F.min(F.struct(F.xxhash64("doc_id", F.lit("hub")), "doc_id"))["doc_id"].alias("doc_id"))
    hubs = marked(hubs)
    of_hubs = members.join(hubs, ["block", "doc_id"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = members.withColumn("hub", F.lit(-1)).withColumn("slice", _hash_of("doc_id", F.col("slices")))
    columns = ["block", "slice", "hub", "doc_id", "text"]
    dealt = rows.select(columns).unionByName(of_hubs.select(columns)).repartition(n, "block", "slice").sortWithinPartitions("block", "slice", F.desc("hub"), "doc_id")
    met = written(dealt.mapInArrow(_with_hubs, "doc_id long, block long, mask long, hubs array<long>"), "hubs")
    counts = met.filter("mask > 0").groupBy("block", "mask").agg(F.count("*").alias("n"))
    counts = counts.groupBy("block").agg(F.collect_list(F.struct("mask", "n")).alias("counts"))  # at most 2^HUBS of a block
    mains = marked(counts.mapInArrow(_main, "block long, main long"))
    return met.join(mains, "block", "left").select("doc_id", "block", "hubs", (F.col("mask").bitwiseAND(F.coalesce("main", F.lit(0))) != 0).alias("joined"))


def _links_of(docs: DataFrame, nodes: DataFrame, block_shingles: int | None, broadcast_nodes: int) -> DataFrame:
    """Links (``a, b``) that connect whatever is connected among ``nodes`` (``doc_id, block, n``), block by block."""
    n = partitions_for(docs)
    total, sets = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    block_shingles = block_shingles or min(BLOCK_SHINGLES, max(LEAST_BLOCK, total // (4 * n)))
    n = max(n, total // BLOCK_SHINGLES + 1)
    with_text = lambda chosen: docs.join(F.broadcast(chosen) if sets <= broadcast_nodes else chosen, "doc_id")
    slices_of = F.ceil(F.sum("n") / block_shingles).cast("int")
    large = written(nodes.groupBy("block").agg(slices_of.alias("slices")).filter("slices > 1"), "large")
    # There are more large blocks the larger the corpus, so they are counted before they are broadcast: at most HUBS rows each.
    blocks = large.count()
    marked = F.broadcast if blocks * HUBS <= broadcast_nodes else lambda few: few
    columns = ["block", "low", "high", "joined", "doc_id", "text"]
    zero = F.lit(0)
    meeting = with_text(nodes.join(marked(large), "block", "left_anti")).select("block", zero.alias("low"), zero.alias("high"), F.lit(False).alias("joined"), "doc_id", "text")
    if not blocks:
        found = None
    else:
        held = written(_held_together(with_text(nodes.join(marked(large), "block", "left_semi")), large, n, marked), "held")
        found = held.select(F.col("doc_id").alias("a"), F.explode("hubs").alias("b"))
        apart = held.filter("NOT joined").join(nodes.select("doc_id", "n"), "doc_id").groupBy("block").agg(slices_of.alias("apart"))
        sides = marked(large.join(apart, "block"))  # blocks without sets apart are done with
        rest = with_text(held.select("doc_id", "block", "joined").join(sides, "block"))
        # Parts of the sets apart are numbered first, then the slices of those joined.
        part = F.when(F.col("joined"), F.col("apart") + _hash_of("doc_id", F.col("slices"))).otherwise(_hash_of("doc_id", F.col("apart")))
        others = F.sequence(zero, F.when(F.col("joined"), F.col("apart")).otherwise(F.col("apart") + F.col("slices")) - 1)
        rest = rest.withColumn("part", part).withColumn("other", F.explode(others))
        meeting = meeting.unionByName(rest.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")}).select(columns))
    grouped = meeting.repartition(n, "block", "low", "high").sortWithinPartitions("block", "low", "high", "doc_id")
    edges = grouped.mapInArrow(_linked, "a long, b long")
    return edges if found is None else edges.unionByName(found)


def ngram_join(docs: DataFrame, block_shingles: int | None = None, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Blocks of more than ``block_shingles`` are dealt to many tasks; by default a quarter of a partition's share, within bounds.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    table = gathered(docs)
    n = partitions_for(docs)
    rows = lambda kind, **names: table.filter(F.col("kind") == kind).select(*(F.col(c).alias(name) for c, name in names.items()))
    documents = rows(DOCUMENT, a="doc_id", b="n", c="xored", d="added", e="same_as")
    # Equal sets of different chunks: the smallest document stands for all.
    chunk_sets = documents.filter("doc_id = same_as").distinct()
    least = chunk_sets.groupBy("n", "xored", "added").agg(F.min("doc_id").alias("stands"))
    standing = written(chunk_sets.join(least, ["n", "xored", "added"]).select("doc_id", "n", "stands"), "standing")
    small = rows(SMALL, a="doc_id", b="n", c="key", d="place").repartition(n, "doc_id").distinct().sortWithinPartitions("doc_id", "n", "key", "place")
    entries = "key long, least long, largest long, doc_id long"
    lists = rows(LISTED, a="key", b="least", c="largest", d="doc_id").unionByName(small.mapInArrow(_small_keys(boundary(small)), entries))
    lists = lists.repartition(n, "key").sortWithinPartitions("key", "least", "doc_id")
    same = standing.filter("doc_id > stands").select(F.col("doc_id").alias("a"), F.col("stands").alias("b"))
    ties = lists.mapInArrow(_neighbours, "a long, b long").unionByName(rows(TIED, a="a", b="b")).unionByName(same)
    blocks = components(ties)
    # The smallest node of each block belongs to it too; then only what stands for others, in blocks that have two or more.
    nodes = blocks.unionByName(blocks.select(F.col("component").alias("node"), "component").distinct())
    nodes = nodes.join(standing.filter("doc_id = stands").select(F.col("doc_id").alias("node"), "n"), "node")
    several = nodes.groupBy("component").agg(F.count("*").alias("sets")).filter("sets > 1")
    nodes = written(nodes.join(several, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("block"), "n"), "dealt")
    found = components(_links_of(docs, nodes, block_shingles, broadcast_nodes))
    labels = standing.join(found.withColumnRenamed("node", "stands"), "stands", "left")
    labels = labels.groupBy(F.col("doc_id").alias("same_as")).agg(F.min(F.coalesce("component", "stands")).alias("label"))
    labelled = documents.join(labels, "same_as", "left")
    return labelled.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(2, len(w) - 3))) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
