"""LM scoring: a hierarchical Pitman-Yor model of words, learnt from all training documents.

The root restaurant holds every word; each word that is followed by another in training (and a text's start) has a context
restaurant whose parent is the root, so all contexts share it.  A context restaurant's customers are the
words seen after its word; its tables are customers of the root.  After a word that is not in training the root
answers.  Seating is sampled by Gibbs sweeps over the numbers of tables: the customers of a dish are taken out of their
restaurant and seated again given all the rest.  The law of their number of tables then is
S(n, t) p^t (strength + discount T) ... (strength + discount (T + t - 1)), where S are the generalised Stirling numbers of the discount,
T the restaurant's other tables and p the parent's probability without them; it is drawn from exactly for the first ``EXACT``
customers of a dish, and those beyond are added in blocks of an eighth.  All dishes of a sweep are reseated at once, given the seating after
the sweep before.  Predictive probabilities are averaged over the sweeps after ``BURN_IN``; the
score of a text is the sum of their log10 over its tokens.

How it is spread:

1. One pass counts the training tokens of every word.  Heavy words, of more than ``HEAVY_TOKENS`` (and a 2^18th of all), have their
   customers dealt by context to shards, which are dishes of their own in buckets of their own: the pairs of the most frequent word are the
   work of many tasks.  A shard's share of the word's customers at the root is added up over all shards in each sweep, and the word's tables at the
   root, one number for each of at most 2^18 words, are drawn on the driver.
2. One pass turns texts into chunks: the documents as numbers of the chunk's own vocabulary, and per bucket of the
   hash space the chunk's distinct (word, context) pairs with training counts.  Per bucket the counts of all chunks are summed.
   A dish with one customer has one table for good, so only pairs met more often are kept as such; each chunk's pairs
   are marked as unseen, single, or the number of such a pair.
3. A context's restaurant is owned by its word's bucket.  Owners sum customers and tables over all buckets and tell those that
   have repeated pairs.  So a sweep is a pass over the buckets and one over the owners, over repeated pairs alone; seatings
   are written, not drawn again.  Only the root's totals, and those of heavy words, go through the driver.
4. Per bucket, each chunk's words are answered with counts, root probabilities and restaurants' totals, and its repeated pairs with their
   tables; per chunk, these are put together and summed by document.

Buckets and chunks have bounded sizes; their number grows with the corpus.  Words are known by 64-bit hashes, contexts by 40 bits of
these.  The number of buckets and all random numbers follow from the corpus alone, so neither the layout of the files nor the
number of partitions changes a score.  Jobs run while the query is built, as each sweep needs the root's totals.

Defined cases: a null or empty text is the end token alone.  Rows repeated with one ``doc_id`` all count and
are scored alike.  A null ``doc_id`` is not held out.  Other columns are not read.  Without
training tokens every word has the same probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gantry.llm.common import discarded, memory_returned, partitions_for, written
from gantry.llm.payloads import pack, rows_of, unpack
from gantry.llm.textbytes import BASE, U64, lowered_bytes, mixed, slices, word_hashes

HELD_OUT = (7, 2)  # held out where crc32(doc_id) mod 7 is 2
CHUNK_TOKENS = 1_500_000
BUCKET_TOKENS = 2_000_000
LEAST_BUCKETS = 64
HEAVY_TOKENS = 1_000_000
HEAVY_WORDS = 1 << 18
SWEEPS = 4
BURN_IN = 1
STRENGTH = 1.0
ROOT_STRENGTH = 10.0
EXACT = 32
END = U64(0x5DEECE66D1234567)
START = U64(0x2545F4914F6CDD1D)  # the context at a text's start
CONTEXT_BITS = 40
Batches = Iterator[pa.RecordBatch]


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % HELD_OUT[0] == HELD_OUT[1]


def tokens(text: np.ndarray) -> np.ndarray:
    return np.append(word_hashes(text), END)


def context_of(words: np.ndarray) -> np.ndarray:
    return words >> U64(64 - CONTEXT_BITS)


def bucket_of(contexts: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes, so that they follow each other in sorted words; a context has its word's bucket."""
    return ((contexts >> U64(CONTEXT_BITS - 32)) * U64(buckets) >> U64(32)).astype(np.int64)


def buckets_for(training: int) -> int:
    """A power of two, so that it follows from the corpus alone."""
    return max(LEAST_BUCKETS, 1 << max(0, training // BUCKET_TOKENS).bit_length())


COUNTED_WORDS = 1_000_000  # of a task, before they are handed on


def _counted(parts: int):
    """Of each part of the hash space the words of training texts, with counts."""

    def out(words: np.ndarray, counts: np.ndarray) -> Batches:
        of = bucket_of(context_of(words), parts)
        for part in np.unique(of).tolist():
            a, b = np.searchsorted(of, [part, part + 1])
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "payload": pa.array([pack(words[a:b], counts[a:b])], pa.binary())})

    def run(batches: Batches) -> Batches:
        with memory_returned():
            words, counts = np.empty(0, U64), np.empty(0, np.int64)
            for batch in batches:
                for part in slices(batch):
                    pairs = zip(part.column("doc_id").to_pylist(), lowered_bytes(part.column("text")), strict=True)
                    new, times = np.unique(np.concatenate([np.empty(0, U64), *(tokens(t) for i, t in pairs if not held_out(i))]), return_counts=True)
                    words, where = np.unique(np.concatenate((words, new)), return_inverse=True)
                    counts = np.bincount(where, np.concatenate((counts, times)), len(words)).astype(np.int64)
                    if len(words) > COUNTED_WORDS:
                        yield from out(words, counts)
                        words, counts = words[:0], counts[:0]
            yield from out(words, counts)

    return run


def _frequent(least: int):
    """Of each part the number of tokens (as word null), and its words with more than ``least``."""

    def run(batches: Batches) -> Batches:
        with memory_returned():
            for _, rows in groupby(rows_of(batches, "part", "payload"), itemgetter(0)):
                words, where, counts = np.empty(0, U64), None, np.empty(0, np.int64)
                for _, payload in rows:
                    new, times = unpack(payload)
                    words, where = np.unique(np.concatenate((words, new)), return_inverse=True)
                    counts = np.bincount(where, np.concatenate((counts, times)), len(words)).astype(np.int64)
                many = counts > least
                yield pa.RecordBatch.from_pydict({
                    "word": pa.array([None, *words[many].view(np.int64).tolist()], pa.int64()), "n": pa.array([int(counts.sum()), *counts[many].tolist()], pa.int64()),
                })

    return run


@dataclass
class Heavy:
    """Words whose customers are dealt to shards, ascending, with their counts and numbers of shards."""

    words: np.ndarray
    counts: np.ndarray
    shards: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int, int]], tokens_each: int) -> Heavy:
        words = np.array([w for w, _ in rows], np.int64).view(U64)
        counts = np.array([n for _, n in rows], np.int64)
        order = np.argsort(words)
        shards = np.array([1 << int(n // max(1, tokens_each)).bit_length() for n in counts.tolist()], np.int64)
        return Heavy(words[order], counts[order], shards[order])

    def index(self, words: np.ndarray) -> np.ndarray:
        """Which of the heavy words each is, -1 for others."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)

    def dishes(self, which: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Names of the shards that customers of these heavy words go to, by their contexts."""
        shard = mixed(contexts) % self.shards[which].astype(U64)
        return mixed(self.words[which] + (shard + U64(1)) * U64(BASE))


NO_HEAVY = Heavy(np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64))


# Rows of all steps: ``bucket`` says who gets them, ``kind`` and ``other`` in which order.
DOCUMENTS, BUCKET, PARTIAL, OWNED, TOLD, SEATED, EXTRA, ANSWER = range(8)
ROW = "bucket long, kind int, other long, payload binary, pairs binary, ids array<long>, chunks array<long>, marks array<binary>, sums array<long>"
TYPES = {"payload": pa.binary(), "pairs": pa.binary(), "ids": pa.list_(pa.int64()), "chunks": pa.list_(pa.int64()), "marks": pa.list_(pa.binary()), "sums": pa.list_(pa.int64())}


def _row(bucket: int, kind: int, other: int, **columns) -> pa.RecordBatch:
    own = {"bucket": pa.array([bucket], pa.int64()), "kind": pa.array([kind], pa.int32()), "other": pa.array([other], pa.int64())}
    return pa.RecordBatch.from_pydict(own | {name: pa.array([columns.get(name)], kind) for name, kind in TYPES.items()})


def _grouped(run):
    """``run`` over each bucket's rows, sorted by kind and other, as (kind, other, payload, pairs, ids, chunks, marks)."""

    def over(batches: Batches) -> Batches:
        with memory_returned():
            names = ["bucket", "kind", "other", "payload", "pairs", "ids", "chunks", "marks"]
            for bucket, rows in groupby(rows_of(batches, *names), itemgetter(0)):
                yield from run(bucket, (r[1:] for r in rows))

    return over


# Step 2: chunks, and their sums.


def pairs_of(place: np.ndarray, start: int, lengths: np.ndarray) -> np.ndarray:
    """Of each token its word (high half) and the word before it (low half), ``start`` at the start of a text."""
    before = np.empty(len(place), np.int64)
    before[1:] = place[:-1]
    before[np.cumsum(lengths) - lengths] = start
    return place.astype(np.int64) << 32 | before


LOW = 0xFFFFFFFF


def _chunks(buckets: int, heavy):
    def chunk(ids: list[int | None], texts: list[np.ndarray], number: int) -> Batches:
        lengths = np.array([len(t) for t in texts], np.int64)
        flat = np.concatenate([*texts, [START]])
        texts.clear()
        words, place = np.unique(flat, return_inverse=True)
        del flat
        start, place = int(place[-1]), place[:-1].astype(np.int32)
        pairs, where = np.unique(pairs_of(place, start, lengths), return_inverse=True)
        counts = np.bincount(where, np.repeat(np.array([not held_out(i) for i in ids]), lengths), len(pairs)).astype(np.uint32)
        del where
        # Shards of heavy words stand among the words; their pairs are the shards'.
        which = heavy.value.index(words)
        of_heavy = np.flatnonzero(which[pairs >> 32] >= 0)
        names = heavy.value.dishes(which[pairs[of_heavy] >> 32], context_of(words)[pairs[of_heavy] & LOW])
        every = np.union1d(words, names)
        at = np.searchsorted(every, words)
        dish = at[pairs >> 32]
        dish[of_heavy] = np.searchsorted(every, names)
        whose = np.full(len(every), -1, np.int32)
        whose[dish[of_heavy]] = which[pairs[of_heavy] >> 32]
        # Frequent words get small numbers, which compress well.
        order = np.argsort(-np.bincount(place, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        shards = np.setdiff1d(np.arange(len(every)), at, assume_unique=True)
        asked = pack(
            rank[place], lengths, order.astype(np.uint32), np.array([len(words), start]), shards.astype(np.uint32),
            np.flatnonzero(which >= 0).astype(np.uint32), dish[of_heavy].astype(np.uint32),
        )
        yield _row(-1 - number, DOCUMENTS, number, payload=asked, ids=ids)
        del rank, place, asked
        pairs = dish.astype(np.int64) << 32 | at[pairs & LOW]
        if len(shards):
            by_dish = np.argsort(pairs, kind="stable")
            pairs, counts = pairs[by_dish], counts[by_dish]
        contexts = context_of(every)
        of_word = bucket_of(contexts, buckets)
        of_pair = of_word[pairs >> 32]
        for bucket in np.unique(of_word).tolist():
            a, b = np.searchsorted(of_word, [bucket, bucket + 1])
            c, d = np.searchsorted(of_pair, [bucket, bucket + 1])
            each = np.bincount((pairs[c:d] >> 32) - a, minlength=b - a).astype(np.uint32)
            yield _row(bucket, BUCKET, number, payload=pack(every[a:b], each, contexts[pairs[c:d] & LOW], counts[c:d], whose[a:b]))

    def run(batches: Batches) -> Batches:
        with memory_returned():
            ids, texts, size, number = [], [], 0, TaskContext.get().partitionId() << 32
            for batch in batches:
                for part in slices(batch):
                    for doc_id, text in zip(part.column("doc_id").to_pylist(), lowered_bytes(part.column("text")), strict=True):
                        ids.append(doc_id)
                        texts.append(tokens(text))
                        size += len(texts[-1])
                        if size >= CHUNK_TOKENS:
                            yield from chunk(ids, texts, number)
                            ids, texts, size, number = [], [], 0, number + 1
            if ids:
                yield from chunk(ids, texts, number)

    return run


UNSEEN, SINGLE, REPEATED = range(3)


def _shares(whose: np.ndarray, customers: np.ndarray) -> list[int]:
    """Heavy words and their shards' customers at the root, one after the other."""
    here = np.flatnonzero(whose >= 0)
    return np.stack((whose[here], customers[here]), 1).reshape(-1).astype(np.int64).tolist()


def _summed(buckets: int, heavy):
    """Of each bucket: all words asked for, with counts and single pairs; repeated pairs; each chunk's marks; and, for their owners, customers and dishes by context."""

    def run(bucket: int, rows: Iterator[tuple]) -> Batches:
        if bucket < 0:  # documents of a chunk
            for kind, other, payload, _, ids, *_ in rows:
                yield _row(other, kind, other, payload=payload, ids=ids)
            return
        held = [(other, unpack(payload)) for _, other, payload, *_ in rows]
        words, first = np.unique(np.concatenate([own for _, (own, *_) in held]), return_index=True)
        whose = np.concatenate([of for *_, (*_, of) in held])[first].astype(np.int64)
        if len(words) >> 63 - CONTEXT_BITS:
            raise ValueError("a bucket has too many words")
        places = [np.searchsorted(words, own) for _, (own, *_) in held]
        keys = np.concatenate([np.repeat(at, each) << CONTEXT_BITS | ctx.astype(np.int64) for at, (_, (_, each, ctx, *_)) in zip(places, held, strict=True)])
        ends = np.cumsum([len(ctx) for _, (_, _, ctx, *_) in held]).tolist()
        pairs, where = np.unique(keys, return_inverse=True)
        del keys
        total = np.bincount(where, np.concatenate([count for _, (*_, count, _) in held]), len(pairs)).astype(np.int64)
        chunks = [other for other, _ in held]
        del held
        mark = np.minimum(total, 2).astype(np.uint8)
        number = np.cumsum(mark == REPEATED) - 1
        marks = []
        for at, a, b in zip(places, [0, *ends[:-1]], ends, strict=True):
            own = where[a:b]
            repeated = number[own[mark[own] == REPEATED]]
            marks.append(pack(np.diff(at, prepend=0).astype(np.uint32), mark[own], np.diff(repeated, prepend=0).astype(np.int32)))
        del where
        word, context = pairs >> CONTEXT_BITS, (pairs & (1 << CONTEXT_BITS) - 1).astype(U64)
        counts = np.where(whose < 0, np.bincount(word, total, len(words)), 0).astype(np.int64)
        which = heavy.value.index(words)
        counts[which >= 0] = heavy.value.counts[which[which >= 0]]
        single, repeated = mark == SINGLE, mark == REPEATED
        singles = np.bincount(word[single], minlength=len(words))
        sums = [total.sum(), len(pairs[total > 0]), (counts > 0).sum(), single.sum(), (total == 2).sum(), (counts == 1).sum(), (counts == 2).sum()]
        here, at = np.unique(context[repeated], return_inverse=True)  # contexts of repeated pairs
        kept = pack(word[repeated].astype(np.uint32), at.astype(np.uint32), total[repeated].astype(np.uint32), here, singles.astype(np.uint32), whose.astype(np.int32))
        at_root = singles + np.bincount(word[repeated], minlength=len(words))
        yield _row(
            bucket, BUCKET, 0, payload=pack(words, counts, singles.astype(np.uint32)), pairs=kept,
            ids=_shares(whose, at_root), chunks=chunks, marks=marks, sums=[int(x) for x in sums],
        )
        seen = total > 0
        every, at = np.unique(context[seen], return_inverse=True)
        customers, dishes = np.bincount(at, total[seen]).astype(np.int64), np.bincount(at)
        yield from _to_owners(PARTIAL, bucket, buckets, every, customers.astype(np.uint32), dishes.astype(np.uint32), np.isin(every, here))

    return _grouped(run)


def _to_owners(kind: int, bucket: int, buckets: int, contexts: np.ndarray, *arrays: np.ndarray) -> Batches:
    of = bucket_of(contexts, buckets)
    for owner in np.unique(of).tolist():
        a, b = np.searchsorted(of, [owner, owner + 1])
        yield _row(owner, kind, bucket, payload=pack(contexts[a:b], *(x[a:b] for x in arrays)))


# Step 3: sweeps.


def _owners(bucket: int, rows: Iterator[tuple]) -> Batches:
    """Of each context a bucket owns customers and dishes; and these to the buckets that have repeated pairs of it."""
    held = [(other, *unpack(payload)) for _, other, payload, *_ in rows]
    contexts, at = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True)
    customers, dishes = (np.bincount(at, np.concatenate([h[k] for h in held])).astype(np.int64) for k in (2, 3))
    yield _row(bucket, OWNED, 0, payload=pack(contexts, customers, dishes))
    for other, own, _, _, asks in held:
        if asks.any():
            mine = np.searchsorted(contexts, own[asks])
            yield _row(other, TOLD, bucket, payload=pack(dishes[mine]))


def _extras(step: int):
    def run(bucket: int, rows: Iterator[tuple]) -> Batches:
        """Of each context the tables beyond one a dish; to its owner itself, and to all buckets that have repeated pairs of it."""
        held = [(other, *unpack(payload)) for _, other, payload, *_ in rows]
        contexts, at = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True)
        more = np.bincount(at, np.concatenate([h[2] for h in held])).astype(np.int64)
        yield _row(bucket, EXTRA, step, payload=pack(contexts, more))
        for other, own, _ in held:
            yield _row(other, TOLD, bucket, payload=pack(more[np.searchsorted(contexts, own)]))

    return _grouped(run)


@dataclass
class Settings:
    """``customers`` and ``tables`` are the root's, after each sweep, those of heavy words apart too."""

    training: int
    types: int
    discount: float
    root_discount: float
    customers: list[int]
    tables: list[int]
    heavy: Heavy = field(default_factory=lambda: NO_HEAVY)
    heavy_customers: list[np.ndarray] = field(default_factory=list)
    heavy_tables: list[np.ndarray] = field(default_factory=list)

    def reseat_heavy(self, customers: np.ndarray, step: int) -> None:
        """After sweep ``step`` (0 before all) the heavy words have so many customers at the root; draws their tables there."""
        tables = np.minimum(customers, 1)
        if step:
            others = self.tables[step - 1] - self.heavy_tables[step - 1]
            tables = reseated(customers, np.full(len(customers), self.base()), others, ROOT_STRENGTH, self.root_discount, np.random.default_rng((1 << 40, step)))
        self.heavy_customers.append(customers)
        self.heavy_tables.append(tables)

    def base(self) -> float:
        return 1.0 / (self.types + 1)

    def root(self, customers, tables, step: int, out=0):
        """The root's probability of a word with so many customers and tables; with ``out`` customers of it taken out."""
        d, rest = self.root_discount, self.customers[step] - out
        return (customers - d * tables + (ROOT_STRENGTH + d * self.tables[step]) * self.base()) / (ROOT_STRENGTH + rest)


def stirling(discount: float, size: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(n, t), n and t up to ``size``."""
    out = np.full((size + 1, size + 2), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(size + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for n in range(size):
            stay = np.where(t <= n, out[n, :-1] + np.log(np.maximum(n - discount * t, 0.0)), -np.inf)
            stay[0] = -np.inf
            out[n + 1, 1:] = np.logaddexp(out[n, :-1], np.append(stay[1:], -np.inf))
    return out[:, : size + 1]


def reseated(customers: np.ndarray, p: np.ndarray, others: np.ndarray, strength: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with so many customers, given the parent's probabilities and the other tables of their restaurants."""
    log_s, tables = stirling(discount), np.minimum(customers, 1).astype(np.int64)
    exact = np.minimum(customers, EXACT)
    order = np.argsort(exact, kind="stable")
    cuts = np.searchsorted(exact[order], np.arange(2, EXACT + 2))
    for n, a, b in zip(range(2, EXACT + 1), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        t = np.arange(1, n + 1)
        for k in range(a, b, 50_000):
            rows = order[k : min(b, k + 50_000)]
            weight = log_s[n, 1 : n + 1] + np.log(p[rows])[:, None] * t + np.cumsum(np.log(strength + discount * (others[rows][:, None] + t - 1)), 1)
            weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
            tables[rows] = 1 + (rng.random(len(rows))[:, None] * weight[:, -1:] > weight).sum(1)
    active = np.flatnonzero(customers > EXACT)
    seen = np.full(len(active), EXACT)
    while len(active):
        more = np.minimum(customers[active] - seen, seen >> 3)
        pull = (strength + discount * (others[active] + tables[active])) * p[active]
        new = pull / (pull + seen - discount * tables[active])
        tables[active] += rng.binomial(more, np.clip(new, 0.0, 1.0))
        seen = seen + more
        going = seen < customers[active]
        active, seen = active[going], seen[going]
    return tables


class Seating:
    """The repeated pairs of a bucket's words and its words at the root, with their tables."""

    def __init__(self, payload: bytes) -> None:
        self.word, self.at, self.customers, self.contexts, self.singles, self.whose = (x.astype(np.int64) if x.dtype != U64 else x for x in unpack(payload))
        self.tables = np.ones(len(self.word), np.int64)
        self.root_tables = np.minimum(self.root_customers(), 1)

    def root_customers(self) -> np.ndarray:
        return self.singles + np.bincount(self.word, self.tables, len(self.singles)).astype(np.int64)

    def sweep(self, settings: Settings, all_tables: np.ndarray, step: int, rng: np.random.Generator) -> None:
        """Every dish taken out and seated again; ``all_tables`` of the restaurants ``contexts``, after sweep ``step``."""
        out, shard = self.tables, self.whose >= 0
        customers, root_tables = self.root_customers(), self.root_tables.copy()
        if shard.any():
            customers[shard] = settings.heavy_customers[step][self.whose[shard]]
            root_tables[shard] = settings.heavy_tables[step][self.whose[shard]]
        left = customers[self.word] - out
        p = settings.root(left, np.minimum(root_tables[self.word], left), step, out)
        self.tables = reseated(self.customers, p, all_tables[self.at] - out, STRENGTH, settings.discount, rng)
        others = settings.tables[step] - self.root_tables
        customers = self.root_customers()
        self.root_tables = reseated(customers, np.full(len(customers), settings.base()), others, ROOT_STRENGTH, settings.root_discount, rng)
        self.root_tables[shard] = 0  # these are the heavy word's

    def extras(self) -> np.ndarray:
        return np.bincount(self.at, self.tables - 1, len(self.contexts)).astype(np.int64)


def _swept(settings, step: int, buckets: int):
    """Sweep ``step`` (from 1) of each bucket, from its pairs, what owners told, and its seating after the sweep before."""

    def run(bucket: int, rows: Iterator[tuple]) -> Batches:
        told: dict[int, list[np.ndarray]] = {0: [], 1: []}
        seating = dishes = None
        for kind, other, payload, pairs, *_ in rows:
            if kind == BUCKET:
                seating = Seating(pairs)
            elif kind == SEATED:
                seating.tables, seating.root_tables, dishes = (x.astype(np.int64) for x in unpack(payload))
            else:
                told[kind == TOLD].append(unpack(payload)[0])
        if seating is None:
            return
        known = np.concatenate([*told[True], np.empty(0, np.int64)])
        dishes, more = (known, 0) if dishes is None else (dishes, known)
        seating.sweep(settings.value, dishes + more, step - 1, np.random.default_rng((bucket, step)))
        sums = [int(seating.root_customers().sum()), int(seating.root_tables.sum())]
        shares = _shares(seating.whose, seating.root_customers())
        yield _row(bucket, SEATED, step, payload=pack(seating.tables.astype(np.uint32), seating.root_tables.astype(np.uint32), dishes.astype(np.uint32)), ids=shares, sums=sums)
        yield from _to_owners(PARTIAL, bucket, buckets, seating.contexts, seating.extras().astype(np.uint32))

    return _grouped(run)


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / max(1, once + 2 * twice)))


# Step 4: answers.


def _answered(settings):
    """To each chunk: of its words the counts, the root's probabilities, the customers and tables of their restaurants; of its pairs the marks, customers and tables."""

    def run(bucket: int, rows: Iterator[tuple]) -> Batches:
        s: Settings = settings.value
        words = seating = None
        owned = [np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)]
        tables, roots, totals = [], [], []
        for kind, other, payload, pairs, _, own_chunks, own_marks in rows:
            if kind == BUCKET:
                words, counts, _ = unpack(payload)
                seating, chunks, marks = Seating(pairs), own_chunks, own_marks
                which = s.heavy.index(words)
            elif kind == OWNED:
                owned = unpack(payload)
            elif kind == SEATED and other > BURN_IN:
                seating.tables, root_tables, _ = (x.astype(np.int64) for x in unpack(payload))
                tables.append(seating.tables.astype(np.uint32))
                at_root = seating.root_customers()
                if (which >= 0).any():
                    at_root[which >= 0] = s.heavy_customers[other][which[which >= 0]]
                    root_tables[which >= 0] = s.heavy_tables[other][which[which >= 0]]
                roots.append(s.root(at_root, root_tables, other).astype(np.float32))
            elif kind == EXTRA and other > BURN_IN:
                at, more = unpack(payload)
                totals.append((other, np.searchsorted(owned[0], at), more))
        if words is None:
            return
        place = np.minimum(np.searchsorted(owned[0], context_of(words)), max(len(owned[0]) - 1, 0))
        has = owned[0][place] == context_of(words) if len(owned[0]) else np.zeros(len(words), bool)
        of_word = lambda x: np.where(has, x[place], 0).astype(np.uint32) if len(x) else np.zeros(len(words), np.uint32)
        each = {k: owned[2].copy() for k in range(BURN_IN + 1, SWEEPS + 1)}
        for k, at, more in totals:
            each[k][at] += more
        customers, each = of_word(owned[1]), [of_word(each[k]) for k in sorted(each)]
        for number, payload in zip(chunks, marks, strict=True):
            own, mark, repeated = unpack(payload)
            own, repeated = np.cumsum(own.astype(np.int64)), np.cumsum(repeated.astype(np.int64))
            columns = [counts[own], customers[own], *(x[own] for x in each), *(r[own] for r in roots)]
            yield _row(number, ANSWER, bucket, payload=pack(*columns, mark, seating.customers[repeated].astype(np.uint32), *(t[repeated] for t in tables)))

    return _grouped(run)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SAMPLES = SWEEPS - BURN_IN


def probabilities(s: Settings, word: np.ndarray, context: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """Of pairs (word, context), as places in the columns of words: predictive probabilities, averaged over the samples."""
    _, customers, *rest = columns
    restaurants, roots = rest[:SAMPLES], rest[SAMPLES : 2 * SAMPLES]
    mark, repeated, *tables = rest[2 * SAMPLES :]
    total = np.zeros(len(word))
    own = np.where(mark == SINGLE, 1 - s.discount, 0.0)
    many = mark == REPEATED
    for k in range(SAMPLES):
        own[many] = repeated - s.discount * tables[k]
        total += (own + (STRENGTH + s.discount * restaurants[k][context]) * roots[k][word]) / (STRENGTH + customers[context])
    return total / SAMPLES


def _scored(settings):
    """Rows of a chunk, its documents first, then its buckets in order."""

    def run(number: int, rows: Iterator[tuple]) -> Batches:
        s: Settings = settings.value
        _, _, payload, _, ids, *_ = next(rows)
        ranks, lengths, order, (n_words, start), shards, heavy, dishes = unpack(payload)
        columns = [np.concatenate(x) for x in zip(*(unpack(p) for _, _, p, *_ in rows), strict=True)]
        place = order[ranks].astype(np.int64)
        pairs, each = np.unique(pairs_of(place, int(start), lengths), return_inverse=True)
        at = np.delete(np.arange(n_words + len(shards)), shards)  # places of the words among words and shards
        word, context = at[pairs >> 32], at[pairs & LOW]
        dish = word.copy()
        dish[np.isin(pairs >> 32, heavy)] = dishes
        asked = np.argsort(dish << 32 | context, kind="stable") if len(shards) else slice(None)  # the order in which the pairs were asked
        logs = np.empty(len(pairs))
        logs[asked] = np.log10(probabilities(s, word[asked], context[asked], columns))
        starts, counts = np.cumsum(lengths) - lengths, columns[0][at]
        base = np.log10((counts.astype(np.int64) + 1) / (s.training + s.types + 1))
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([held_out(i) for i in ids]), "n_tokens": pa.array(lengths),
            "n_known": pa.array(np.add.reduceat((counts > 0)[place].astype(np.int64), starts)),
            "train_tokens": pa.array(np.full(len(ids), s.training, np.int64)),
            "base_score": pa.array(np.add.reduceat(base[place], starts)), "score": pa.array(np.add.reduceat(logs[each], starts)),
        })

    return _grouped(run)


def _heavy_customers(rows: DataFrame, n: int) -> np.ndarray:
    """Customers of the heavy words at the root, added up over their shards."""
    out = np.zeros(n, np.int64)
    if n:
        each = F.explode(F.expr("transform(sequence(0, size(ids) div 2 - 1), k -> struct(ids[2 * k] AS word, ids[2 * k + 1] AS n))")).alias("share")
        for word, customers in rows.filter("size(ids) > 0").select(each).groupBy("share.word").agg(F.sum("share.n")).collect():
            out[word] = customers
    return out


def lm_scores(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    n = partitions_for(docs)
    counted = docs.mapInArrow(_counted(n), "part long, payload binary").repartition(n, "part").sortWithinPartitions("part").mapInArrow(_frequent(HEAVY_TOKENS), "word long, n long")
    counted = written(counted, "frequent")
    training = counted.filter("word IS NULL").agg(F.sum("n")).first()[0] or 0
    buckets = buckets_for(training)
    # At most HEAVY_WORDS words can have more than that share of all tokens.
    heavy = Heavy.of([tuple(r) for r in counted.filter((F.col("word").isNotNull()) & (F.col("n") > training // HEAVY_WORDS)).collect()], HEAVY_TOKENS)
    sharded = spark.sparkContext.broadcast(heavy)
    parts = max(partitions_for(docs), training // BUCKET_TOKENS + 1)
    dealt = lambda rows: rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind", "other")
    only = lambda rows, *kinds: rows.filter(F.col("kind").isin(*kinds))
    table = written(dealt(docs.mapInArrow(_chunks(buckets, sharded), ROW)).mapInArrow(_summed(buckets, sharded), ROW), "buckets")
    names = ["training", "dishes", "types", "once", "twice", "word_once", "word_twice"]
    sums = only(table, BUCKET).agg(*(F.coalesce(F.sum(F.col("sums")[k]), F.lit(0)).alias(n) for k, n in enumerate(names))).first()
    settings = Settings(training, sums.types, _discount(sums.once, sums.twice), _discount(sums.word_once, sums.word_twice), [sums.dishes], [sums.types], heavy)
    settings.reseat_heavy(_heavy_customers(only(table, BUCKET), len(heavy.words)), 0)
    owned = written(dealt(only(table, PARTIAL)).mapInArrow(_grouped(_owners), ROW), "owned")
    empty = F.lit(None)
    pairs = only(table, BUCKET).select("bucket", "kind", "other", empty.cast("binary").alias("payload"), "pairs", *(empty.cast(t).alias(c) for c, t in (("ids", "array<long>"), ("chunks", "array<long>"), ("marks", "array<binary>"), ("sums", "array<long>"))))
    told, seatings, extras = only(owned, TOLD), [], []
    for step in range(1, SWEEPS + 1):
        now = pairs.unionByName(told)
        if seatings:
            now = now.unionByName(only(seatings[-1], SEATED))
        swept = written(dealt(now).mapInArrow(_swept(spark.sparkContext.broadcast(settings), step, buckets), ROW), "seated")
        root = only(swept, SEATED).agg(*(F.coalesce(F.sum(F.col("sums")[k]), F.lit(0)) for k in range(2))).first()
        settings.reseat_heavy(_heavy_customers(only(swept, SEATED), len(heavy.words)), step)
        settings.customers.append(root[0])
        settings.tables.append(root[1] + int(settings.heavy_tables[step].sum()))
        told_by = written(dealt(only(swept, PARTIAL)).mapInArrow(_extras(step), ROW), "extras")
        if step <= BURN_IN + 1 and seatings:  # not among the samples, and no sweep needs it any more
            discarded(seatings.pop(), extras.pop())
        seatings.append(swept)
        extras.append(told_by)
        told = only(told_by, TOLD)
    final = spark.sparkContext.broadcast(settings)
    answering = only(table, BUCKET).unionByName(only(owned, OWNED))
    for swept, told_by in zip(seatings, extras, strict=True):
        answering = answering.unionByName(only(swept, SEATED)).unionByName(only(told_by, EXTRA))
    answers = dealt(answering).mapInArrow(_answered(final), ROW)
    scores = written(dealt(only(table, DOCUMENTS).unionByName(answers)).mapInArrow(_scored(final), SCORES), "scores")
    discarded(table, owned, counted, *seatings, *extras)
    return scores
