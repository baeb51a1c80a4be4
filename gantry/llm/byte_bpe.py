"""Byte-level BPE encoding and decoding.

Encoding.  The merges are compiled into a finite-state transducer over bytes.  The
nondeterministic machine may start a token at any byte; its subset construction is done lazily:
a deterministic state is the set of trie nodes that the live starts have reached, it is built
when first entered and then reused, and its output lists the tokens that end here, longest
first.  Every prefix of a piece has one encoding, which is that of a shorter prefix plus one
token; a token can follow another only if no merge across their border comes before the merges
that made them (ranks are the order of merges, so a part has a lower rank than what it
becomes).  So the transducer keeps a register of the last token of each prefix that is
still within reach, that is of as many bytes as the longest token has.

All distinct pieces of a batch go through the transducer in lock-step, a byte of each at a time, by whole arrays: one
array of states, dense rows of moves, and tests of token pairs against a table of tests made before.
A piece longer than ``LOCKSTEP_BYTES`` goes alone; its tokens are final, and leave the register, once all prefixes
within reach agree on them, which is looked for every ``SETTLE_BYTES``, so the register stays bounded.

Decoding.  Token bytes go through an incremental UTF-8 state machine whose state is carried
from token to token, so ids can be decoded as they stream in; a sequence that is no UTF-8
gives one U+FFFD for its longest start that could have been one, as Python's ``errors="replace"`` does.
Tokens that are whole characters leave the machine where it starts and are copied as arrays.

Defined cases: null text counts as empty (no ids, empty decoded text).  Rows are treated one by one, so ties
and repeated rows keep their own result.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gantry.llm.common import memory_returned
from gantry.llm.payloads import spread
from gantry.llm.textbytes import slices

MAX_STATES = 20_000
PAIR_BITS = 20  # the table of tested pairs has so many index bits
TOKEN_BITS = 24
LOCKSTEP_BYTES = 1024
LOCKSTEP_CELLS = 2_500_000
SETTLE_BYTES = 512
NEVER = np.int64(1) << 60
# White space that the pattern's \s means (Unicode White_Space), for the regex module.
WHITE = r"\t-\r \x85\xa0  -     　"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def compile_pattern(pattern: str) -> regex.Pattern:
    """The pattern with ``\\s`` and ``\\S`` spelled out, as libraries differ on control characters."""
    spelled = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{WHITE}\p{{L}}\p{{N}}]")
    spelled = spelled.replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")
    return regex.compile(spelled)


class Transducer:
    """Bytes in, token ids out; deterministic states are built when first needed."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        top = max(self.tokens) + 1
        self.size = np.zeros(top, np.int64)
        self.size[list(self.tokens)] = [len(t) for t in self.tokens.values()]
        self.longest = int(self.size.max())
        # The trie: a node's child by (node << 8 | byte), and the token that ends at a node.
        self.child: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        left, right, whole = [], [], []
        child, get = self.child, ranks.get
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                node = child.setdefault(node << 8 | byte, len(child) + 1)
            self.token_at[node] = rank
            for k in range(1, len(token)):
                a, b = get(token[:k]), get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    whole.append(rank)
        # All merges: pairs of tokens whose bytes together are a token.
        keys = np.array(left, np.int64) << TOKEN_BITS | np.array(right, np.int64)
        order = np.argsort(keys)
        self.merges, self.merged = keys[order], np.array(whole, np.int64)[order]
        # Of each token the two that its last merge joins: -1 for single bytes, -2 until asked for.
        self.halves = np.full((top, 2), -2, np.int64)
        self.tested = np.full(1 << PAIR_BITS, -1, np.int64)
        self.verdicts = np.zeros(1 << PAIR_BITS, bool)
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[tuple[int, ...], int] = {(): 0}
        self.states: list[tuple[int, ...]] = [()]
        self.moves = np.full((256, 256), -1, np.int32)
        self.ends = np.full((256, 4), -1, np.int64)  # by state the tokens that end, longest first
        self.steps: dict[int, tuple[int, list[int]]] = {}
        self.single: dict[int, bool] = {}

    def _move(self, state: int, byte: int) -> int:
        """The state after one more byte; starts that no token continues are dropped."""
        nodes = [self.child.get(node << 8 | byte) for node in (*self.states[state], 0)]
        key = tuple(node for node in nodes if node is not None)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            tokens = [self.token_at[node] for node in key if node in self.token_at]
            if number == len(self.moves):
                self.moves = np.concatenate([self.moves, np.full_like(self.moves, -1)])
                self.ends = np.concatenate([self.ends, np.full_like(self.ends, -1)])
            if len(tokens) > self.ends.shape[1]:
                more = np.full((len(self.ends), len(tokens) - self.ends.shape[1]), -1, np.int64)
                self.ends = np.concatenate([self.ends, more], 1)
            self.ends[number, : len(tokens)] = tokens
        self.moves[state, byte] = number
        return number

    def _moved(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        after = self.moves[state, byte]
        if len(new := np.flatnonzero(after < 0)):
            for key in np.unique(state[new].astype(np.int64) << 8 | byte[new]).tolist():
                self._move(key >> 8, key & 255)
            after[new] = self.moves[state[new], byte[new]]
        return after

    def _split(self, token: int) -> tuple[int, int]:
        parts = [self.tokens[token][k : k + 1] for k in range(len(self.tokens[token]))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda k: self.ranks.get(parts[k] + parts[k + 1], 1 << 60))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-1, -1)

    def _halves(self, tokens: np.ndarray) -> np.ndarray:
        found = self.halves[tokens]
        if len(new := np.flatnonzero(found[:, 0] == -2)):
            for token in np.unique(tokens[new]).tolist():
                self.halves[token] = self._split(token)
            found = self.halves[tokens]
        return found

    def follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether no merge across the border comes before those that made the two tokens.

        Merges are undone from the last one back; ``until`` is the rank before which the two parts at the border lie side by side.
        """
        fits, at = np.ones(len(left), bool), np.arange(len(left))
        a, b, until = left.copy(), right.copy(), np.full(len(left), NEVER)
        while len(at):
            key = a << TOKEN_BITS | b
            place = np.minimum(np.searchsorted(self.merges, key), len(self.merges) - 1)
            across = np.where(self.merges[place] == key, self.merged[place], NEVER)
            fits[at[across < until]] = False
            a_right, b_left = self._halves(a)[:, 1], self._halves(b)[:, 0]
            a_made, b_made = np.where(a_right < 0, -1, a), np.where(b_left < 0, -1, b)
            undo_a = a_made > b_made
            # What is left of a token meets its part first: on equal ranks the merge across comes before b's own.
            until = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, a_right, a), np.where(undo_a, b, b_left)
            going = fits[at] & (np.maximum(a_made, b_made) >= 0)
            at, a, b, until = at[going], a[going], b[going], until[going]
        return fits

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``follows``, through the table of pairs tested before."""
        key = left << TOKEN_BITS | right
        slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        found = self.verdicts[slot]
        if len(new := np.flatnonzero(self.tested[slot] != key)):
            pairs, place = np.unique(key[new], return_inverse=True)
            found[new] = self.follows(pairs >> TOKEN_BITS, pairs & (1 << TOKEN_BITS) - 1)[place]
            self.tested[slot[new]] = -1
            # Of pairs that share a slot one stays, with its own verdict.
            one = new[np.unique(slot[new], return_index=True)[1]]
            self.tested[slot[one]], self.verdicts[slot[one]] = key[one], found[one]
        return found

    def encode_all(self, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and each piece's number of ids."""
        if len(self.states) > MAX_STATES:
            self._forget()
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-sizes, kind="stable")
        n_long = int(np.count_nonzero(sizes > LOCKSTEP_BYTES))
        found = [np.array(self.encode(pieces[k]), np.int64) for k in order[:n_long].tolist()]
        counts = np.zeros(len(pieces), np.int64)
        counts[order[:n_long]] = [len(x) for x in found]
        k = n_long
        while k < len(pieces):
            rows = order[k : k + max(1, LOCKSTEP_CELLS // int(sizes[order[k]] + 1))]
            ids, counts[rows] = self._lockstep([pieces[i] for i in rows.tolist()], sizes[rows])
            found.append(ids)
            k += len(rows)
        # From the order by size back to the order given.
        flat = np.concatenate(found) if found else np.empty(0, np.int64)
        starts = np.empty(len(pieces), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return flat[spread(starts, counts)], counts

    def _lockstep(self, pieces: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pieces from the longest to the shortest."""
        rows, steps = len(pieces), int(sizes[0]) if len(sizes) else 0
        content = np.frombuffer(b"".join(pieces), np.uint8)
        starts = np.cumsum(sizes) - sizes
        last = np.full((steps + 1, rows), -1, np.int64)  # by prefix its last token
        state = np.zeros(rows, np.int64)
        going = np.searchsorted(-sizes, -np.arange(1, steps + 1), side="right")
        for t in range(steps):
            n = int(going[t])
            state = self._moved(state[:n], content[starts[:n] + t])
            open_rows = np.arange(n)
            for k in range(self.ends.shape[1]):
                token = self.ends[state[open_rows], k]
                before = last[t + 1 - self.size[token], open_rows]
                ok = before < 0  # the token starts the piece
                rest = np.flatnonzero(~ok)
                ok[rest] = self.fits(before[rest], token[rest])
                last[t + 1, open_rows[ok]] = token[ok]
                open_rows = open_rows[~ok]
                if not len(open_rows):
                    break
        taken, at, alive = [], sizes.copy(), np.flatnonzero(sizes > 0)
        counts = np.zeros(rows, np.int64)
        while len(alive):
            token = last[at[alive], alive]
            taken.append((alive, token))
            counts[alive] += 1
            at[alive] -= self.size[token]
            alive = alive[at[alive] > 0]
        ids, place = np.empty(int(counts.sum()), np.int64), np.cumsum(counts) - 1
        for k, (which, token) in enumerate(taken):
            ids[place[which] - k] = token
        return ids, counts

    def _path(self, last: list[int], end: int) -> list[int]:
        ids = []
        while end:
            ids.append(last[end])
            end -= int(self.size[last[end]])
        return ids[::-1]

    def _settle(self, last: list[int]) -> tuple[list[int], list[int]]:
        """Tokens that no later byte can change, and the register without them."""
        within = set(range(max(0, len(last) - 1 - self.longest), len(last)))
        while len(within) > 1:
            latest = max(within)
            within.remove(latest)
            within.add(latest - int(self.size[last[latest]]))
        common = within.pop()
        return self._path(last, common), last[common:]

    def _fit(self, left: int, right: int) -> bool:
        """``follows`` for one pair."""
        key = left << TOKEN_BITS | right
        known = self.single.get(key)
        if known is None:
            if len(self.single) > 100_000:
                self.single.clear()
            until, going, known = int(NEVER), True, True
            while going and known:
                across = self.ranks.get(self.tokens[left] + self.tokens[right])
                known = across is None or across >= until
                (_, left_right), (right_left, _) = self._halves(np.array([left, right])).tolist()
                left_made, right_made = left if left_right >= 0 else -1, right if right_left >= 0 else -1
                going = max(left_made, right_made) >= 0
                if left_made > right_made:
                    left, until = left_right, left
                else:
                    right, until = right_left, right + 1
            self.single[key] = known
        return known

    def _step(self, state: int, byte: int) -> tuple[int, list[tuple[int, int]]]:
        if len(self.steps) > 100_000:
            self.steps.clear()
        after = int(self.moves[state, byte])
        after = self._move(state, byte) if after < 0 else after
        tokens = [(t, -int(self.size[t])) for t in self.ends[after].tolist() if t >= 0]
        self.steps[state << 8 | byte] = after, tokens
        return after, tokens

    def encode(self, piece: bytes) -> list[int]:
        """Of one piece of any length, byte by byte."""
        ids, last, state, due = [], [-1], 0, SETTLE_BYTES
        for byte in piece:
            state, tokens = self.steps.get(state << 8 | byte) or self._step(state, byte)
            for token, start in tokens:  # noqa: B007
                if last[start] < 0 or self._fit(last[start], token):
                    break
            last.append(token)
            if len(last) > due:
                settled, last = self._settle(last)
                ids += settled
                due = len(last) + SETTLE_BYTES
        return ids + self._path(last, len(last) - 1)


class Encoder:
    """Texts in, ids out.

    No piece of the pattern has white space after another character.  So a text can be cut before every single
    space that stands between two other characters.  What lies between two cuts (a word with its marks) is
    split and encoded once for all its copies in the batch.
    """

    def __init__(self, path: str, pattern: str) -> None:
        self.transducer = Transducer(load_ranks(path))
        self.split = compile_pattern(pattern).findall

    def _piece_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct pieces: all ids, and where each piece's begin and how many they are; in the order of ``pieces``."""
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
        whole = np.array([self.transducer.ranks.get(p, -1) for p in distinct], np.int64)
        apart = np.flatnonzero(whole < 0)
        ids, apart_counts = self.transducer.encode_all([distinct[k] for k in apart.tolist()])
        counts = np.ones(len(distinct), np.int64)
        counts[apart] = apart_counts
        starts = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int32)
        flat[starts[whole >= 0]] = whole[whole >= 0]
        flat[spread(starts[apart], apart_counts)] = ids
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        return flat, starts[codes], counts[codes]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and each text's number of ids."""
        if not len(texts):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        texts = pc.fill_null(texts, "")
        parts = pc.split_pattern(texts, " ")
        chunk_counts = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(chunk_counts) - chunk_counts
        coded = parts.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        chunks = coded.dictionary.to_pylist()
        uncut = np.array([not c or c[0].isspace() or c[-1].isspace() for c in chunks], bool)
        # The first chunk of a text has no space before it.  A text with a chunk that cannot be cut off is split as a whole.
        whole = np.add.reduceat(uncut[codes], first) > 0
        heads = pc.if_else(pa.array(whole), texts, coded.dictionary.take(pa.array(codes[first]))).to_pylist()
        pieces = self.split("".join([" " + c for c, u in zip(chunks, uncut.tolist(), strict=True) if not u]))
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum([0 if u else len(c) + 1 for c, u in zip(chunks, uncut.tolist(), strict=True)])
        unit_counts = np.diff(np.searchsorted(np.cumsum(lengths), ends, side="right"), prepend=0)
        head_counts = np.empty(len(heads), np.int64)
        for k, text in enumerate(heads):
            own = self.split(text)
            head_counts[k] = len(own)
            pieces += own
        del chunks, heads
        # Of texts the units, of units the pieces, of pieces the ids: units are the chunks, then a head for each text.
        unit_counts = np.concatenate([unit_counts, head_counts])
        nothing = len(unit_counts)
        unit_counts = np.append(unit_counts, 0)
        codes[np.repeat(whole, chunk_counts)] = nothing
        codes[first] = np.arange(nothing - len(texts), nothing)
        flat, starts, counts = self._piece_ids(pieces)
        flat = flat[spread(starts, counts)]  # of the units in a row
        unit_ids = np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], np.cumsum(unit_counts)))]
        lengths = np.diff(unit_ids)[codes]
        return flat[spread(unit_ids[codes], lengths)], np.add.reduceat(lengths, first)

    def ids(self, text: str) -> list[int]:
        return self.encode(pa.array([text], pa.string()))[0].tolist()


class Utf8Machine:
    """Bytes in, characters out.  A state says how many bytes are to come and between which bounds the next one lies."""

    # Fixed values, the table of well-formed sequences: of lead bytes from .. to, the bounds of the second byte and the bytes after it.
    LEADS = (
        (0xC2, 0xDF, 0x80, 0xBF, 0), (0xE0, 0xE0, 0xA0, 0xBF, 1), (0xE1, 0xEC, 0x80, 0xBF, 1), (0xED, 0xED, 0x80, 0x9F, 1),
        (0xEE, 0xEF, 0x80, 0xBF, 1), (0xF0, 0xF0, 0x90, 0xBF, 2), (0xF1, 0xF3, 0x80, 0xBF, 2), (0xF4, 0xF4, 0x80, 0x8F, 2),
    )
    AFTER = {b: (low, high, more) for a, z, low, high, more in LEADS for b in range(a, z + 1)}

    def __init__(self) -> None:
        self.held, self.state = bytearray(), None

    def feed(self, content: bytes) -> str:
        out = []
        for byte in content:
            if self.state is not None:
                low, high, more = self.state
                if low <= byte <= high:
                    self.held.append(byte)
                    self.state = (0x80, 0xBF, more - 1) if more else None
                    if not more:
                        out.append(self.held.decode())
                        self.held.clear()
                    continue
                out.append(self.end())
            if byte < 0x80:
                out.append(chr(byte))
            elif byte in self.AFTER:
                self.state = self.AFTER[byte]
                self.held.append(byte)
            else:
                out.append("\ufffd")
        return "".join(out)

    def end(self) -> str:
        """What an unfinished sequence gives; the machine is at its start again."""
        unfinished = self.state is not None
        self.held.clear()
        self.state = None
        return "\ufffd" if unfinished else ""


def _is_utf8(content: bytes) -> bool:
    try:
        content.decode()
    except UnicodeDecodeError:
        return False
    return True


class Decoder:
    """Ids in, text out; the state of the UTF-8 machine is carried between calls of ``feed``.  Ids without a token give nothing."""

    def __init__(self, tokens: dict[int, bytes]) -> None:
        each = [tokens.get(k, b"") for k in range(max(tokens) + 1)]
        self.sizes = np.array([len(t) for t in each], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.content = np.frombuffer(b"".join(each), np.uint8)
        self.closed = np.array([t.isascii() or _is_utf8(t) for t in each], bool)
        self.machine = Utf8Machine()

    def feed(self, ids: Iterable[int], last: bool = True) -> str:
        ids = np.asarray(ids, np.int64)
        sizes = self.sizes[ids]
        content = self.content[spread(self.starts[ids], sizes)].tobytes()
        ends, out, at, machine = np.cumsum(sizes), [], 0, self.machine
        opened = np.flatnonzero(~self.closed[ids])
        for a, b in zip((ends - sizes)[opened].tolist(), ends[opened].tolist(), strict=True):
            if a > at:
                out += machine.end(), content[at:a].decode()
            out.append(machine.feed(content[a:b]))
            at = b
        if at < len(content):
            out += machine.end(), content[at:].decode()
        if last:
            out.append(machine.end())
        return "".join(out)


Batches = Iterator[pa.RecordBatch]
FEED_IDS = 1 << 14


def _encoded(batches: Batches, path: str, pattern: str) -> Batches:
    """The transducer lives as long as the task, so that waiting workers hold no memory."""
    with memory_returned():
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(path, pattern)
            for part in slices(batch):
                flat, counts = encoder.encode(part.column("text"))
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in part.schema.names if c != "text"} | {"ids": ids})
        encoder = None


def _decoded(batches: Batches, path: str) -> Batches:
    decoder = None
    for batch in batches:
        decoder = decoder or Decoder({rank: token for token, rank in load_ranks(path).items()})
        for k in range(0, batch.num_rows, 1000):
            part = batch.slice(k, 1000)
            ids = part.column("ids")
            flat, ends = ids.flatten().to_numpy(), np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy()))).tolist()
            texts = []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                blocks = range(a, max(b, a + 1), FEED_IDS)
                texts.append("".join([decoder.feed(flat[i : min(i + FEED_IDS, b)], last=i + FEED_IDS >= b) for i in blocks]))
            yield pa.RecordBatch.from_pydict({c: part.column(c) for c in part.schema.names} | {"text": pa.array(texts, pa.string())})


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id`` and the array ``ids`` of each text, by the ranks in the file ``path``."""
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return texts.mapInArrow(lambda batches: _encoded(batches, path, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` and the decoded ``text``."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: _decoded(batches, path), "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, carried: Sequence[str] = ()) -> DataFrame:
    """``decode(encode(docs))`` in one pass of each task: ``doc_id``, the columns ``carried`` along, ``ids, text``."""
    texts = docs.select(F.col("doc_id").cast("long"), *carried, "text")
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carried)
    return texts.mapInArrow(lambda batches: _decoded(_encoded(batches, path, pattern), path), f"doc_id long, {kinds}ids array<int>, text string")


def digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, carried: Sequence[str] = ()) -> DataFrame:
    """Encode, decode, and digest both results: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, and the columns ``carried``."""
    return round_trip(docs, path, pattern, carried).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
        *carried,
    )
