"""Fill-in-middle, Lempel-Ziv fingerprints and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import same
from gantry.llm import catalog, fill_in_middle, importance, lz_fingerprint

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, n int, form string, h1 int, output string, range int, copied int, features string, score int, rank int, part int, c int"


def corpus(n=80, seed=5):
    """Texts in several scripts, blanks at both ends, markers, nulls, ties, repeated rows, a null id and long texts."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(30)] + ["Äpfel", "日本語", "naïve", "x" * 60, "\U0001f600", "A-B", "<", "<P", "S>"]
    rows = [(k, "".join(r.choice(words) + r.choice((" ", "  ", "\n", "\t\x0b")) for _ in range(r.choice((0, 1, 5, 40, 200))))) for k in range(n)]
    rows += [(k + 500, "  " + t.strip()) for k, t in rows[:20]]
    rows += [(900, None), (901, ""), (902, " \n "), (903, "a <M> b"), (904, "one"), (905, "long " * 20_000), (906, "日" * 9000 + " 本"), (None, "no id here"), (7, "tie " * 30)]
    rows += rows[:3]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "a", 2, "b", 3, 4, "c", 5, 6, 7, 8) for i, t in rows], DOCS).repartition(3)


def draws(prefix, i):
    digest = hashlib.sha256(f"{prefix}:{'' if i is None else i}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def transformed(i, text):
    units = UNIT.findall(text or "")
    text, n, (h1, h2, h3, h4) = text or "", len(units), draws(42, i)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize(("chunk", "block"), [(fill_in_middle.CHUNK, fill_in_middle.BLOCK), (1, 1), (7, 21)])
def test_fill_in_middle(spark, chunk, block):
    rows = corpus()
    if chunk < 10:
        rows = [x for x in rows if len(x[1] or "") < 3000]
    out = fill_in_middle.fill_in_middle(frame(spark, rows), chunk=chunk, block=block)
    found = out.withColumn("again", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda x: tuple("" if v is None else str(v) for v in x)
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["again"]) for r in found), key=key) == sorted(
        ((i, *transformed(i, t), t or "") for i, t in rows), key=key
    )
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_nothing(spark):
    assert fill_in_middle.digests(fill_in_middle.fill_in_middle(frame(spark, []))).collect() == []


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_importance_resampling"])
def test_against_sql(spark, sf_dir, name):
    same(catalog.QUERIES[name](spark, sf_dir), sf_dir, catalog.ORACLE_SQL[name])


def phrases(text):
    found, content, a = set(), (text or "").encode(), 0
    for b in range(1, len(content) + 1):
        if content[a:b] not in found:
            found.add(content[a:b])
            a = b
    return found


def hash_of(phrase):
    h = 1
    for byte in phrase:
        h = (h * lz_fingerprint.FACTOR + byte + 1) % lz_fingerprint.PRIME
    return int(lz_fingerprint.mixed(np.array([h], np.uint64))[0]) >> 32


def signature(text, size=lz_fingerprint.SIZE):
    return sorted({hash_of(p) for p in phrases(text)})[:size]


def like(a, b, size=lz_fingerprint.SIZE):
    if not a and not b:
        return 1.0
    least = sorted({*a, *b})[:size]
    return len({*least} & {*a} & {*b}) / len(least)


def hexed(s):
    return "".join(f"{x:08x}" for x in s)


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_lz_fingerprints(spark, ranges):
    rows = [x for x in corpus() if x[0] is None or x[0] != 7]
    rows = sorted({(i, t or "") for i, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0), reverse=True)
    found = {r["doc_id"]: r for r in lz_fingerprint.edited(frame(spark, rows), ranges=ranges).collect()}
    assert len(found) == len(rows)
    signed = {t: signature(t) for _, t in rows}
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        keep, r = (len(text) + 1) // 2, found[i]
        changed = text[:keep] + following[: len(text) - keep]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (hexed(signed[text]), hexed(signature(changed)))
        assert r["near_edited"] == pytest.approx(like(signed[text], signature(changed)))
        assert r["near_next"] == pytest.approx(like(signed[text], signed[following]))


def test_lz_edge_cases(spark):
    run = lambda rows: sorted(tuple(r) for r in lz_fingerprint.edited(frame(spark, rows), ranges=4).select("doc_id", "n_chars", "fingerprint", "near_next").collect())
    assert run([]) == []
    assert run([(1, None)]) == [(1, 0, "", 1.0)]
    assert run([(1, None), (2, "ab")]) == [(1, 0, "", 0.0), (2, 2, hexed(signature("ab")), 0.0)]
    again = run([(1, "abcabc")] * 40 + [(2, "x")])
    assert len(again) == 41 and [r[3] for r in again].count(1.0) == 39
    nameless = lz_fingerprint.edited(frame(spark, [(None, "a b"), (None, "a b")]))
    assert [r["near_next"] for r in nameless.collect()] == [1.0, 1.0]


def test_lz_likeness_by_columns(spark):
    docs = frame(spark, [(k, t) for k, (_, t) in enumerate(corpus(30))])
    prints = lz_fingerprint.fingerprints(docs)
    pairs = prints.alias("a").join(prints.alias("b"), F.col("b.doc_id") == F.col("a.doc_id") + 1)
    found = pairs.select(F.col("a.fingerprint").alias("x"), F.col("b.fingerprint").alias("y"), lz_fingerprint.likeness(F.col("a.fingerprint"), F.col("b.fingerprint")).alias("near")).collect()
    cut = lambda s: [int(s[k : k + 8], 16) for k in range(0, len(s), 8)]
    assert len(found) > 40
    for r in found:
        assert r["near"] == pytest.approx(like(cut(r["x"]), cut(r["y"])))


def test_lz_tells_copies_from_others():
    r = random.Random(4)
    text = " ".join(f"{r.choice('abcdef')}{r.randrange(400)}" for _ in range(2000))
    other = " ".join(f"{r.choice('uvwxyz')}{r.randrange(400)}" for _ in range(2000))
    of = lambda t: lz_fingerprint.Phrases().feed(t.encode()).smallest(128)
    assert lz_fingerprint.likeness_of(of(text), of(text + " end")) > 0.9
    assert lz_fingerprint.likeness_of(of(text), of(text[:-3000] + other[:3000])) > lz_fingerprint.likeness_of(of(text), of(other)) + 0.2


def test_crc_algebra():
    r = random.Random(2)
    words = [bytes(r.randrange(256) for _ in range(r.choice((1, 2, 7, 48, 49, 300)))) for _ in range(200)]
    flat = np.frombuffer(b"".join(words), np.uint8)
    after = np.cumsum([len(w) for w in words])
    first = after - [len(w) for w in words]
    crcs = importance.word_crcs(flat, first, after)
    assert crcs.tolist() == [zlib.crc32(w) for w in words]
    text = np.repeat(np.arange(20), 10)
    for n, (runs, owner) in enumerate(importance.run_crcs(crcs, after - first, text, 4), 1):
        want = [(zlib.crc32(b" ".join(words[k : k + n])), k // 10) for k in range(200 - n + 1) if k // 10 == (k + n - 1) // 10]
        assert list(zip(runs.tolist(), owner.tolist(), strict=True)) == want


def resample(rows, target, max_words, buckets, min_words, percent):
    def features(text):
        w = WORD.findall((text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, max_words + 1) for k in range(len(w) - n + 1)]

    each = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in each for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for i, n, f in each:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = draws(2024, i)[0]
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    can = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(can[: percent * len(can) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize(("max_words", "buckets", "min_words", "percent"), [(1, 10_000, 20, 10), (3, 500, 5, 60), (2, 10_000, 0, 100), (1, 50, 3, 0)])
def test_importance_resampling(spark, max_words, buckets, min_words, percent):
    rows, target = corpus(), ["W1 w2 w3, Äpfel", None, "", "日本語 w9 W9", "naïve w1 w2"]
    of_target = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id int, text string")
    found = importance.resampled(frame(spark, rows), of_target, max_words, buckets, min_words, percent).collect()
    key = lambda x: tuple("" if v is None else str(v) for v in x)
    assert sorted(map(tuple, found), key=key) == sorted(resample(rows, target, max_words, buckets, min_words, percent), key=key)


def test_importance_of_nothing(spark):
    nothing = spark.createDataFrame([], "item_id int, text string")
    assert importance.resampled(frame(spark, []), nothing).collect() == []
    rows = [(1, "a b c"), (2, None)]
    assert sorted(map(tuple, importance.resampled(frame(spark, rows), nothing, min_words=0, percent=50).collect()), key=str) == sorted(resample(rows, [], 1, 10_000, 0, 50), key=str)
