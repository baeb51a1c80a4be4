"""Mixing and sharding against slot-by-slot and prefix-by-prefix versions."""

import hashlib
import random
from collections import Counter

import pytest

from gantry.llm import mixing, sharding


def brute_mix(rows, weights, size):
    """(id, class, block, phase, slot, in_mix) of each (id, text, source): units cut by running bytes, then slot by slot."""
    units = {}
    for i, t, source in rows:
        h = int(hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:15], 16)
        unit = units.setdefault((source if source in weights else "*", h), [0, []])
        unit[0] += len((t or "").encode())
        unit[1].append((i, t, source))
    begins, block_of = Counter(), {}
    for (c, h), (weight, _) in sorted(units.items()):
        block_of[c, h] = begins[c] // size
        begins[c] += weight
    blocks = {c: max(1, -(-begins[c] // size)) for c, _ in units}
    weights = {"*": 1} | weights
    slots, left, given, now, phase = {}, dict(blocks), Counter(), 0, 0
    while left:
        total = sum(weights[c] for c in left)
        c = min((c for c in left if given[c] * total <= now * weights[c]), key=lambda c: (-(-(given[c] + 1) * total // weights[c]), c))
        slots[c, blocks[c] - left[c]] = len(slots), phase
        given[c] += 1
        left[c] -= 1
        now += 1
        if not left[c]:
            del left[c]
            given, now, phase = Counter(), 0, phase + 1
    out = []
    for (c, h), (_, members) in units.items():
        block = min(block_of[c, h], blocks[c] - 1)
        slot, phase = slots[c, block]
        out += [(i, c, block, phase, slot, phase == 0) for i, _, _ in members]
    return sorted(out, key=str), slots


@pytest.mark.parametrize("weights", [{"a": 2, "b": 1}, {"a": 7, "*": 3}, {"b": 3}, {"a": 1, "b": 1, "c": 5}])
def test_mixing(spark, weights):
    """With nulls, empties, long texts, repeated rows and columns named like those added."""
    r = random.Random(21)
    rows = [(k, "x" * r.randrange(400), r.choice(("a", "a", "a", "b", "it's", None))) for k in range(400)]
    rows += [(None, None, "a"), (700, "", "b"), (701, "y" * 5000, "b")] + [(702, "z" * 90, "a")] * 30
    docs = spark.createDataFrame([(*row, "q", 1) for row in rows], "doc_id long, text string, source string, Slot string, h int").repartition(3)
    found = mixing.placed(docs, weights, 500)
    assert found.columns == ["doc_id", "text", "source", "h", *mixing.ADDED]
    want, slots = brute_mix(rows, weights, 500)
    assert sorted(map(tuple, mixing.mixed(docs, weights, 500).collect()), key=str) == want
    # Bytes of each class up to any slot of the first phase: within a block and a unit of its share.
    weight, sizes = Counter(), Counter()
    for x in found.collect():
        weight[x["class"], x["block"]] += len(x["text"] or "")
    present = {c: ({"*": 1} | weights)[c] for c, _ in slots}
    for (c, block), (slot, phase) in sorted(slots.items(), key=lambda x: x[1]):
        sizes[c] += weight[c, block]
        if not phase:
            assert all(abs(sizes[d] - (slot + 1) * q / sum(present.values()) * 500) < 500 + 5000 for d, q in present.items())
    assert mixing.mixed(docs.limit(0), weights).count() == 0


def test_small_rows_keep_the_share_in_bytes(spark):
    """Rows of a fifth of a block at most: less than a block and a row from the share, at every slot that keeps the mix."""
    r = random.Random(22)
    docs = spark.createDataFrame([(k, "x" * r.randrange(100), "a" if k % 3 else "b") for k in range(1500)], "doc_id long, text string, source string")
    weight, slots, sizes = Counter(), {}, Counter()
    for x in mixing.placed(docs, {"a": 1, "b": 1}, 500).collect():
        weight[x["slot"]] += len(x["text"])
        slots[x["slot"]] = x["class"], x["in_mix"]
    for at in sorted(slots):
        sizes[slots[at][0]] += weight[at]
        if slots[at][1]:
            assert abs(sizes["a"] - (at + 1) * 250) < 600 and abs(sizes["b"] - (at + 1) * 250) < 600
    assert len(slots) >= max(slots) - 1  # no row may begin in a class's last block


def test_mixing_weights(spark):
    docs = spark.createDataFrame([(1, "x", "a")], "doc_id long, text string, source string")
    for bad in ({"a": 0}, {"a": 20_000}, {f"s{k}": 2 for k in range(400)}):
        with pytest.raises(ValueError):
            mixing.mixed(docs, bad)


@pytest.mark.parametrize(("limit", "n"), [(300, 400), (50, 60), (100_000, 50)])
def test_sharding_against_prefixes(spark, limit, n):
    """From few to many levels; hashes with nine zero bits in front make some buckets much deeper than others."""
    r = random.Random(5)
    plain = [(k, r.getrandbits(60) >> (9 if k % 3 else 0), r.randrange(40)) for k in range(n)]
    found = {x["doc_id"]: (x["depth"], x["bucket"], x["shard_bytes"]) for x in sharding.assigned(spark.createDataFrame(plain, "doc_id long, h long, bytes long"), limit).collect()}
    for k, h, _ in plain:
        for depth in range(61):
            size = sum(b for _, other, b in plain if other >> 60 - depth == h >> 60 - depth)
            if size <= limit:
                break
        assert found[k] == (depth, h >> 60 - depth, size)
