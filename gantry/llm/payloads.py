"""Arrays as compact binary payloads of rows, and blocks of them that go from many senders to many receivers.

Where every sender has something for every receiver, a row for each pair of them holds less and less the more there are of both.  So beyond
some number of receivers rows go through relays: a sender's row is for a group of receivers, a relay gets the rows of a band of senders for
one group, and hands a row for each receiver on, with what all its senders had for it.  With as many groups as the root of the number
of receivers, rows stay of a useful size, for twice the bytes shuffled.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard

HEAD = struct.Struct("<8sI")  # of each array its type and the size of what follows


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays by byte planes, compressed."""
    out = []
    for a in arrays:
        planes = zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes(), 1)
        out += HEAD.pack(a.dtype.str.encode(), len(planes)), planes
    return b"".join(out)


def unpack(payload: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(payload):
        kind, size = HEAD.unpack_from(payload, at)
        at += HEAD.size
        dtype = np.dtype(kind.rstrip(b"\0").decode())
        flat = np.frombuffer(zstandard.decompress(payload[at : at + size]), np.uint8).reshape(dtype.itemsize, -1)
        out.append(np.ascontiguousarray(flat.T).view(dtype).reshape(-1))
        at += size
    return out


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows one at a time, as payloads can be large."""
    for batch in batches:
        for k in range(batch.num_rows):
            part = batch.slice(k, 1)
            yield tuple(part.column(c)[0].as_py() for c in columns)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[0], starts[0] + 1, ... of each run in turn."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


@dataclass
class Block:
    """Entries one after the other: for whom, from whom, and how many of ``values`` (arrays of one length) each has."""

    targets: np.ndarray
    sources: np.ndarray
    sizes: np.ndarray
    values: list[np.ndarray]

    def pack(self) -> bytes:
        return pack(self.targets.astype(np.int64), self.sources.astype(np.int64), self.sizes.astype(np.int64), *self.values)

    @staticmethod
    def joined(payloads: list[bytes]) -> Block:
        parts = [unpack(p) for p in payloads]
        targets, sources, sizes, *values = (np.concatenate(x) for x in zip(*parts, strict=True))
        return Block(targets, sources, sizes, values)

    def entries(self) -> np.ndarray:
        """Of each value, which entry it lies in."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def dealt(self, to: np.ndarray) -> Iterator[tuple[int, Block]]:
        """The entries by ``to``, a number for each, ascending."""
        order = np.argsort(to, kind="stable")
        starts = np.cumsum(self.sizes) - self.sizes
        sizes = self.sizes[order]
        at = spread(starts[order], sizes)
        values = [v[at] for v in self.values]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        receivers, first = np.unique(to[order], return_index=True)
        for receiver, a, b in zip(receivers.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
            yield receiver, Block(self.targets[order[a:b]], self.sources[order[a:b]], sizes[a:b], [v[ends[a] : ends[b]] for v in values])


def relayed(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
    """Rows (unit, other, payload) sorted by unit: those with ``other`` below 0 as they are, the blocks of a unit by their targets."""
    for unit, of_unit in groupby(rows, itemgetter(0)):
        held = []
        for _, other, payload in of_unit:
            if other < 0:
                yield unit, other, payload
            else:
                held.append(payload)
        if held:
            block = Block.joined(held)
            for target, part in block.dealt(block.targets):
                yield target, unit, part.pack()
