"""Words of UTF-8 texts and 64-bit hashes of them, by whole arrays.

A word is a run of characters other than U+0020 and U+0009 to U+000D, so byte positions suffice.  The hash
of a word is the sum of random numbers by byte value times powers of an odd base, modulo 2^64,
mixed; sums over all words of a text come from one running sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = tuple(U64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * MIX[0]
    x = (x ^ (x >> U64(27))) * MIX[1]
    return x ^ (x >> U64(31))


VALUES = mixed(np.arange(1, 257, dtype=U64) * U64(BASE))


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.ones(size, U64)
    done = 1
    while done < size:
        more = min(done, size - done)
        out[done : done + more] = out[:more] * U64(pow(base, done, 1 << 64))
        done += more
    return out


def powers(base: int, size: int) -> np.ndarray:
    return _powers(base, max(1 << 16, 1 << (size - 1).bit_length()))[:size]


def word_spans(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after its last."""
    edges = np.flatnonzero(np.diff(BLANK[text].view(np.int8), prepend=1, append=1))
    return edges[::2], edges[1::2]


def word_hashes(text: np.ndarray) -> np.ndarray:
    """Hashes of the words of ``text`` (bytes as uint8), in order."""
    first, after = word_spans(text)
    if not len(first):
        return np.empty(0, U64)
    sums = np.empty(len(text) + 1, U64)
    sums[0] = 0
    np.cumsum(VALUES[text] * powers(BASE, len(text)), out=sums[1:])
    return mixed((sums[after] - sums[first]) * powers(INVERSE, len(text))[first])


BATCH_BYTES = 5 << 20


def slices(batch: pa.RecordBatch, limit_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of about ``limit_bytes`` of text, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        limit = (ends[at - 1] if at else 0) + limit_bytes
        after = max(at + 1, int(np.searchsorted(ends, limit, side="right")))
        yield batch.slice(at, after - at)
        at = after


def lowered_bytes(texts: pa.Array) -> Iterator[np.ndarray]:
    """Each text with A-Z in lower case, as bytes; null is empty."""
    lowered = pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_binary())
    if lowered.offset:
        lowered = pa.concat_arrays([lowered])
    _, ends, content = lowered.buffers()
    ends = np.frombuffer(ends, np.int64)[: len(lowered) + 1]
    content = np.frombuffer(content, np.uint8) if content is not None and content.size else np.empty(0, np.uint8)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield content[a:b]
