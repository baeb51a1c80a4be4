"""Each operator against a brute-force version or exact round trip, with nulls, empties, ties and odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import same
from gantry.llm import byte_bpe, catalog, chat_format, components, exact_dedup, lm_scoring, mixing, ngram_join, payloads
from gantry.llm import common, quality_classifier, quality_rules, sharding, url_filter
from gantry import scratch
from gantry.llm.common import written

public_tokenizers = pytest.importorskip("public_tokenizers")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest int, keep_id int, block int, score int, n int, label int"
WORDS = [f"w{k}" for k in range(40)]


def corpus(n=60, seed=1):
    """Random texts with exact and near copies, nulls, blanks, repeated rows, a null id and a long text."""
    r = random.Random(seed)
    texts = [" ".join(r.choices(WORDS, k=r.choice((3, 8, 12, 60, 90)))) for _ in range(n)]
    rows = [(k, t) for k, t in enumerate(texts)]
    for k in range(0, n, 5):
        rows.append((1000 + k, texts[k].upper()))
        near = texts[k].split()
        near[r.randrange(len(near))] = "changed"
        rows.append((2000 + k, " ".join(near)))
    rows += [(3000, None), (3001, ""), (3002, " \n\t"), (3003, "one"), (3004, "ONE"), (3005, "\x0bone\x1ctwo"), (3006, "Ä ä \u00a0x"), (3007, "x " * 30_000)]
    r.shuffle(rows)
    return rows


def table(spark, rows):
    full = [(i, t, (None, "en", "de")[k % 3], (None, "a", "b")[k % 3], None if t is None else len(t), 1, 2, 3, 4, 5, 6) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS).repartition(3)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def counts_of(text):
    w, text = WORD.findall(text or ""), text or ""
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    rows = corpus() + [(4000, "a b c a b c\nx\ny\nx\n x\n" * 3), (4001, "### $$$ <b> | é" * 20), (None, "a b")]
    found = quality_rules.quality_rules(table(spark, rows), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(found) == len(rows)
    want = {i: counts_of(t) for i, t in rows}
    for r in found:
        n, repeated = want[r["doc_id"]][0], want[r["doc_id"]][4]
        assert (n, *want[r["doc_id"]][1:]) == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], repeated), r
        assert repeated == r["n_repeat_words"] and r["base_failed"] == (n < 50 or 100 * repeated > 50 * n) == (not r["kept"])


def test_cutoffs_hold_their_risk(spark):
    r = random.Random(3)
    rows = [("en", r.random() * (0.1 if q else 1), q) for q in [1] * 3000 + [0] * 500]
    features = spark.createDataFrame([(k, s, v, 0.0, 0.0, 0.0, 0.0) for k, (s, v, _) in enumerate(rows)], "doc_id long, stratum string, symbols double, dup_lines double, repeats double, capitals double, shouts double")
    labels = spark.createDataFrame([(k, q) for k, (_, _, q) in enumerate(rows)], "doc_id long, quality int")
    (found,) = quality_rules.cutoffs(features, labels, risk=0.05, delta=0.05).collect()

    def cdf(k, n, p):
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log(1 - p)) for j in range(k + 1))

    level = 0.05 / (len(quality_rules.RULES) * len(quality_rules.GRID))
    held = [c for c in quality_rules.GRID if cdf(sum(v > c and q for _, v, q in rows), 3000, 0.01) <= level]
    assert found["max_symbols"] == min(held) and found["max_repeats"] == quality_rules.GRID[0]
    p = spark.range(1).select(quality_rules.binomial_cdf(F.lit(12), F.lit(900), 0.02)).first()[0]
    assert p == pytest.approx(cdf(12, 900, 0.02))


def test_copies_are_one_trial(spark):
    """200 good texts in 40 rows each don't make 8,000 trials; a text that any row of it calls bad isn't good."""
    docs = spark.createDataFrame([(k, f"{'w ' * 60}{k % 200}", "en") for k in range(8000)], "doc_id long, text string, lang string")
    features = written(quality_rules.measured(docs), "copies")
    labels = spark.createDataFrame([(k, int(k % 200 > 0 or k > 0)) for k in range(8000)], "doc_id long, quality int")
    (found,) = quality_rules.cutoffs(features, labels, risk=0.02, delta=0.05).collect()
    (alone,) = quality_rules.cutoffs(features.filter("doc_id between 1 and 199"), labels, risk=0.02, delta=0.05).collect()
    assert tuple(found) == tuple(alone)


def test_windows_whose_hashes_meet(spark):
    """Long repetitive texts, against brute force; with so many windows that hash bits are few."""
    r = random.Random(13)
    rows = [(k, " ".join(r.choices("abcdefghij", k=r.choice((4, 5, 30, 3000))))) for k in range(30)] + [(99, "a b c d " * 5000)]
    found = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.measured(table(spark, rows)).collect()}
    assert found == {i: counts_of(t)[4] for i, t in rows}


def test_small_strata_get_cutoffs(spark):
    """With 321 good rows two cuts hold a risk of 0.02 for one of four strata: one for each of the first two rules."""
    r = random.Random(7)
    rows = [(s, 0.015, r.choice((0.0, 0.03, 0.14))) for s in ("de", "en", "es") for _ in range(321)] + [("xx", 0.0, 0.0)] * 200
    features = spark.createDataFrame([(k, s, v, 0.0, 0.0, c, 0.0) for k, (s, v, c) in enumerate(rows)], "doc_id long, stratum string, symbols double, dup_lines double, repeats double, capitals double, shouts double")
    labels = spark.createDataFrame([(k, 1) for k in range(len(rows))], "doc_id long, quality int")
    found = {r["stratum"]: tuple(r)[1:] for r in quality_rules.cutoffs(features, labels, risk=0.02, delta=0.05).collect()}
    assert found == {s: (0.02, 0.02, None, None, None) for s in ("de", "en", "es")}


@pytest.mark.parametrize("odd", [1, 2, 3, 4])
def test_an_odd_text_costs_only_its_own_rule(spark, odd):
    """230 good rows allow one cut; one of them that is extreme by another rule leaves it as sharp as before."""
    rows = [[0.0] * 5 for _ in range(230)]
    rows[7][odd] = 0.9
    features = spark.createDataFrame([(k, "es", *v) for k, v in enumerate(rows)], "doc_id long, stratum string, " + ", ".join(f"{r} double" for r in quality_rules.RULES))
    (found,) = quality_rules.cutoffs(features, spark.createDataFrame([(k, 1) for k in range(230)], "doc_id long, quality int"), risk=0.02, delta=0.05).collect()
    assert found["max_symbols"] == 0.02


def test_small_stratum_rejects_its_bad_texts(spark):
    """The stratum of sf0.1 with 307 good texts: all bad ones go, no good one does."""
    base = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{base}/documents.parquet").filter("lang = 'es'")
    labels = spark.read.parquet(f"{base}/labels.parquet")
    judged = quality_rules.quality_rules(docs, labels, delta=quality_rules.DELTA / 4).join(labels, "doc_id").filter("NOT base_failed")
    found = {r["quality"]: (r["n"], r["kept"]) for r in judged.groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()}
    assert found[0][0] > 20 and found[0][1] == 0 and found[1][0] == found[1][1]


def test_cutoffs_hold_the_joint_risk(spark):
    """Rows rejected by any rule are fewer than the cuts allowed, which the exact bound gives; and bad texts are rejected."""
    r = random.Random(11)
    good = [" ".join(r.choices(WORDS, k=60)) + "!" * r.choice((0, 0, 1, 5)) + "#" * (k % 40 == 0) for k in range(400)]
    bad = [" # ".join(r.choices(WORDS, k=60)) for _ in range(60)]
    labels = spark.createDataFrame([(k, int(k < 400)) for k in range(460)], "doc_id long, quality int")
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(good + bad)], "doc_id long, text string, lang string")
    found = quality_rules.quality_rules(docs, labels).collect()
    allowed = sum(sum(math.comb(400, j) * 0.02**j * 0.98 ** (400 - j) for j in range(k + 1)) <= 0.05 for k in range(9))
    assert sum(not r["kept"] and not r["base_failed"] for r in found if r["doc_id"] < 400) < allowed
    assert not any(r["kept"] for r in found if r["doc_id"] >= 400)


PATH = public_tokenizers.path(catalog.VOCABULARY)


def test_byte_bpe(spark):
    tiktoken = pytest.importorskip("tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})
    r = random.Random(5)
    alphabet = [chr(c) for c in [*range(1, 256), 0x1680, 0x180E, 0x2000, 0x200B, 0x2028, 0x3000, 0x4E2D, 0x1F600, 0x301, 0x660]] + [" "] * 40 + list("the tion'sllre") * 4
    rows = corpus() + [(5000 + k, "".join(r.choices(alphabet, k=r.randrange(60)))) for k in range(300)] + [(6000, "a" * 9000), (6001, "<|endoftext|>"), (None, "x")]
    found = {r["doc_id"]: r for r in byte_bpe.round_trip(table(spark, rows), PATH).collect()}
    digests = {r["doc_id"]: r for r in byte_bpe.digests(table(spark, rows), PATH).collect()}
    for i, text in rows:
        ids = own.encode_ordinary(text or "")
        assert found[i]["ids"] == ids and found[i]["text"] == (text or "")
        assert digests[i]["n_tokens"] == len(ids)
        assert digests[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    apart = byte_bpe.decode(byte_bpe.encode(table(spark, rows), PATH), PATH)
    assert {r["doc_id"]: r["text"] for r in apart.collect()} == {i: t or "" for i, t in rows}


def test_streaming_decoder():
    decoder = byte_bpe.Decoder({0: b"\xe2", 1: b"\x82\xac", 2: b"a"})
    assert [decoder.feed([0], last=False), decoder.feed([1, 2], last=False), decoder.feed([0])] == ["", "€a", "\ufffd"]


def test_utf8_machine():
    """Any bytes, cut anywhere, against Python's own decoder."""
    r = random.Random(3)
    for _ in range(2000):
        content = bytes(r.choices([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF, 0xC0, 0xF4, 0x90, 0xE0], k=r.randrange(12)))
        machine, cut = byte_bpe.Utf8Machine(), r.randrange(len(content) + 1)
        assert machine.feed(content[:cut]) + machine.feed(content[cut:]) + machine.end() == content.decode(errors="replace")
        decoder = byte_bpe.Decoder({k: bytes([k]) for k in range(256)})
        ids = list(content)
        assert decoder.feed(ids[:cut], last=False) + decoder.feed(ids[cut:]) == content.decode(errors="replace")


def test_long_pieces():
    """Longer than the lock-step takes, so that tokens are emitted while the piece goes on."""
    tiktoken, ranks = pytest.importorskip("tiktoken"), byte_bpe.load_ranks(PATH)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder, r = byte_bpe.Encoder(PATH, public_tokenizers.PATTERN), random.Random(4)
    for text in ("ab" * 4000, "a" * 20_000, "".join(r.choices("etaoinshr", k=20_000)), "\u4e2d\u6587\u5b57" * 3000, "x" * (byte_bpe.LOCKSTEP_BYTES + 1), "=" * 5000):
        assert encoder.ids(text) == own.encode_ordinary(text)


def test_chat_format(spark):
    texts = ["hi", "</s>[INST] ok [/INST]", "\\a\\\\[<", None, "", "[ROLE x[:]", " [/INST]", "<s>" * 50]
    r = random.Random(2)
    turns = [(c, t, r.choice(("user", "assistant", "system", "tool<", None)), r.choice(texts), "x") for c in range(30) for t in range(r.randrange(1, 7))]
    turns += [(None, 0, "user", "a", "x"), (90, 0, "user", "q", "x"), (90, 1, "assistant", "r", "x"), (91, 0, "assistant", "r", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, loss string").repartition(3)
    formatted = chat_format.segments(df)
    found = {r["conv_id"]: r for r in chat_format.read_back(formatted).collect()}
    assert len(found) == len({t[0] for t in turns})
    for conv, r in found.items():
        mine = sorted((t for t in turns if t[0] == conv), key=lambda t: t[1])
        digest = hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in mine).encode()).hexdigest()
        loss = "".join(t[3] or "" for t in mine if t[2] == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(mine), digest)
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert found[90]["valid"] and not found[91]["valid"]
    chars = {r["conv_id"]: r["n"] for r in formatted.groupBy("conv_id").agg(F.sum(F.length("segment")).alias("n")).collect()}
    assert chars == {c: r["formatted_chars"] for c, r in found.items()}
    assert chat_format.read_back(chat_format.segments(df.limit(0))).count() == 0
    again = written(formatted.orderBy(F.rand(3)), "segments")  # in any order, as tables come
    assert {r["conv_id"]: r for r in chat_format.read_back(again).collect()} == found
    for broken in (again.filter("seg <> 1"), again.filter("valid IS NULL"), again.unionByName(again.filter("seg = 2"))):
        with pytest.raises(Exception, match="is due|is not closed"):
            chat_format.read_back(broken).collect()


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            o = len(sets[a] & sets[b])
            if a < b and o and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("small", [False, True])
def test_ngram_join(spark, small):
    base = " ".join(random.Random(9).choices(WORDS, k=80)).split()
    rows = corpus(80, seed=4) + [(7000 + k, " ".join(base[:k] + [f"z{k}"] + base[k + 1 :])) for k in range(40)]
    options = {"block_shingles": 300, "broadcast_nodes": 0} if small else {}
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(table(spark, rows), **options).collect()}
    assert found == brute_components(rows)


def test_ngram_join_of_a_large_group(spark, monkeypatch):
    """A block in many slices: most of it hangs on hubs, some of it on a chain or on one member, some on nothing."""
    r = random.Random(31)
    base = r.sample([f"b{k}" for k in range(400)], 100)
    rows = [(k, " ".join(base[:j] + [f"z{k}"] + base[j + 1 :])) for k, j in enumerate(r.choices(range(100), k=150))]
    chain = base
    for k in range(40):  # each step like the last, soon unlike the base
        chain = [*chain[:k], f"c{k}", *chain[k + 1 :]]
        rows.append((500 + k, " ".join(chain)))
    rows += [(700 + k, " ".join([*base[:30], *(f"d{k}_{j}" for j in range(70))])) for k in range(30)]
    rows += [(800 + k, " ".join([*base[: 84 - k], *(f"e{j}" for j in range(16 + k))])) for k in range(12)]
    want = brute_components(rows)
    for limit in (400, None):
        assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.ngram_join(table(spark, rows), limit).collect()} == want

    def refused(df):
        raise AssertionError("broadcast")

    monkeypatch.setattr(ngram_join.F, "broadcast", refused)
    found = ngram_join.ngram_join(table(spark, rows), 400, broadcast_nodes=0)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in found.collect()} == want


def test_ngram_join_light_sets(spark):
    """Many small sets, so that subsets are enumerated."""
    r = random.Random(8)
    rows = [(k, " ".join(r.choices("abc", k=r.randrange(1, 14)))) for k in range(250)]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(table(spark, rows)).collect()} == brute_components(rows)
    rows = {"doc_id": [1] * 10, "n": [10] * 10, "key": list(range(10)), "place": list(range(10))}
    keys = next(ngram_join._small_keys(12)(iter([pa.RecordBatch.from_pydict(rows)])))
    assert keys.num_rows == 45 + 10 + 1  # for larger sets of 10, 11 and 12 shingles; 13 are too many to link with


@pytest.mark.parametrize(("size", "relay"), [(40, 1024), (700, 1024), (40, 1), (700, 1)])
def test_ngram_join_in_many_chunks(spark, size, relay, monkeypatch):
    """Equal and similar sets that lie in different chunks, with few shingles of their own; straight and through relays."""
    monkeypatch.setattr(ngram_join, "RELAY_PARTS", relay)
    monkeypatch.setattr(ngram_join, "PART_BYTES", 2000)
    r = random.Random(10)
    pool = [" ".join(r.choices(WORDS, k=30)) for _ in range(12)]
    rows = [(k, " ".join(r.sample(pool, 4))) for k in range(150)] + [(500 + k, " ".join([*pool[:5], f"y{k % 20}"])) for k in range(40)]
    rows += [(900 + k, rows[k][1]) for k in range(0, 150, 3)]
    monkeypatch.setattr(ngram_join, "CHUNK_SHINGLES", size * 8)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(table(spark, rows)).collect()} == brute_components(rows)


def test_blocks_and_relays():
    """What every sender has for every receiver arrives once, whatever the routes; and the rows are fewer than pairs."""
    r = np.random.default_rng(3)
    for parts, chunks in ((4, 3), (50, 30), (2000, 900)):
        routes = ngram_join.Routes.of(parts, chunks, 0)
        sent, rows = Counter(), []
        for chunk in r.choice(1 << 40, chunks, replace=False).tolist():
            own = np.sort(r.choice(parts, min(parts, 40), replace=False))
            sizes = r.integers(1, 4, len(own))
            values = r.integers(0, 1 << 30, sizes.sum())
            sent.update(zip(np.repeat(own, sizes).tolist(), [chunk] * len(values), values.tolist(), strict=True))
            block = payloads.Block(own, np.full(len(own), chunk), sizes, [values])
            rows += [(unit, chunk, b.pack()) for unit, b in block.dealt(routes.to_parts(own, chunk))]
        first = len(rows)
        out = list(payloads.relayed(iter([*sorted([*rows, (-3, -1, b"kept")], key=lambda x: x[:2])])))
        assert out.pop(0) == (-3, -1, b"kept")
        got = Counter()
        for part, _, payload in out:
            b = payloads.Block.joined([payload])
            assert set(b.targets.tolist()) == {part}
            got.update(zip([part] * len(b.values[0]), np.repeat(b.sources, b.sizes).tolist(), b.values[0].tolist(), strict=True))
        assert got == sent
        if parts == 2000:
            assert first <= chunks * 40 and len(out) < chunks * 40


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)]
    forest = components.Forest()
    for a, b in edges:
        forest.join(a, b)
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()}
    assert found == {n: c for n, c in zip(*forest.edges(), strict=True) if n != c}


def test_stars_and_owned_tables_go(spark):
    """Of the components only the last star is left; tables of an owner go with it, but those kept."""
    folder = Path(scratch.run_dir(spark).removeprefix("file:"))
    names = lambda: {p.name for p in folder.iterdir()} if folder.exists() else set()
    rdds = lambda: set(Path(scratch.shared_dir(spark).removeprefix("file:")).glob("**/rdd-*"))
    before, at_first = names(), rdds()
    components.components(spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long"))
    assert len(names() - before) == 1 and rdds() == at_first
    before = names()
    with common.owned(spark):
        written(spark.range(3), "gone")
        rest = written(spark.range(4), "stays", kept=True)
    assert [n.split("-")[0] for n in names() - before] == ["stays"] and rest.count() == 4
    common.discarded(rest)
    assert names() == before


def test_settings_return_after_threads(spark):
    """Whatever the order in which threads leave, the session's settings are those of before."""
    before = {name: spark.conf.get(name) for name in common.BOUNDED}
    first, second = common.bounded(spark), common.bounded(spark)
    first.__enter__()
    second.__enter__()
    assert {name: spark.conf.get(name) for name in common.BOUNDED} == common.BOUNDED
    first.__exit__(None, None, None)
    assert {name: spark.conf.get(name) for name in common.BOUNDED} == common.BOUNDED
    second.__exit__(None, None, None)
    assert {name: spark.conf.get(name) for name in common.BOUNDED} == before


def test_lm_scoring(spark):
    rows = corpus(150, seed=6) + [(3001, "twice given w1")]
    found = lm_scoring.lm_scores(table(spark, rows)).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, [*words(t), None]) for i, t in rows]
    c = Counter(x for i, w in tokens if not held(i) for x in w)
    n, v = sum(c.values()), len(c)
    want = sorted((i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in tokens)
    assert sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == want
    out = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert all(r["score"] < 0 for r in found)


def test_lm_rare_words_are_contexts(spark):
    """900 words, each after one other word alone: none has 1/512 of the tokens, yet each foretells the next."""
    r = random.Random(12)
    pairs = [f"a{k} b{k}" for k in range(900)]
    rows = [(k, " ".join(r.sample(pairs, 60))) for k in range(150)]
    out = [r for r in lm_scoring.lm_scores(table(spark, rows)).collect() if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in out)
    # Half of the tokens are certain, the other half one of 900.
    assert sum(r["score"] for r in out) / tokens > 0.65 * sum(r["base_score"] for r in out) / tokens


def test_lm_scores_follow_from_the_corpus_alone(spark):
    """Not from the layout of the rows, the number of partitions or the sizes of chunks."""
    docs = table(spark, corpus(150, seed=6))
    first = {(r["doc_id"], r["n_tokens"]): r["score"] for r in lm_scoring.lm_scores(docs).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = lm_scoring.lm_scores(docs.repartition(11)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {(r["doc_id"], r["n_tokens"]): r["score"] for r in again} == pytest.approx(first, abs=1e-9)


def frequent_corpus(n=120, seed=9):
    """A few words make up most of the tokens, as in any language; some texts are repeated."""
    r = random.Random(seed)
    rows = [(k, " ".join(r.choices(WORDS, weights=[1000 / (j + 1) for j in range(40)], k=r.choice((5, 30, 80))))) for k in range(n)]
    return rows + [(500 + k, rows[k][1]) for k in range(0, n, 6)] + [(900, None), (901, "")]


def test_lm_heavy_words_are_split(spark, monkeypatch):
    """With words of more than 40 tokens dealt to shards: the same counts, nearly the same scores, whatever the layout; no bucket has all pairs of a word."""
    docs = table(spark, frequent_corpus())
    key = lambda r: (r["doc_id"], r["n_tokens"])
    exact = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    whole = {key(r): r for r in lm_scoring.lm_scores(docs).collect()}
    monkeypatch.setattr(lm_scoring, "HEAVY_TOKENS", 40)
    split = {key(r): r for r in lm_scoring.lm_scores(docs).collect()}
    again = {key(r): r for r in lm_scoring.lm_scores(docs.repartition(7)).collect()}
    assert split.keys() == whole.keys()
    for k, r in split.items():
        assert [r[c] for c in exact[:-1]] == [whole[k][c] for c in exact[:-1]] and r["base_score"] == pytest.approx(whole[k]["base_score"])
        assert r["score"] == pytest.approx(again[k]["score"], abs=1e-9)
        assert r["score"] == pytest.approx(whole[k]["score"], rel=0.03, abs=0.05)
    total = [sum(r["score"] for r in x.values()) for x in (whole, split)]
    assert total[1] == pytest.approx(total[0], rel=0.003)


def test_lm_shards():
    heavy = lm_scoring.Heavy.of([(-5, 100), (7, 1000), (9, 10)], 10)
    assert heavy.words.tolist() == [7, 9, 2**64 - 5] and heavy.shards.tolist() == [128, 2, 16]
    assert heavy.index(np.array([9, 8, 2**64 - 5], np.uint64)).tolist() == [1, -1, 2]
    names = heavy.dishes(np.zeros(5000, np.int64), np.arange(5000, dtype=np.uint64))
    assert len(np.unique(names)) == 128 and np.bincount(np.unique(names, return_inverse=True)[1]).max() < 80
    assert lm_scoring.NO_HEAVY.index(np.array([1], np.uint64)).tolist() == [-1]


class PlainGibbs:
    """One customer after the other, with the sizes of all tables; the model of ``lm_scoring`` written down anew."""

    def __init__(self, texts, d, root_d, seed):
        self.r, self.d, self.root_d = random.Random(seed), d, root_d
        self.pairs = [(u, w) for t in texts for u, w in zip(["<s>", *t[:-1]], t, strict=True)]
        self.types = len({w for _, w in self.pairs})
        self.rooms, self.root = {}, {}
        self.root_tables = self.root_customers = 0
        for u, w in self.pairs:
            self.sit(u, w)

    def at_root(self, w):
        tables = self.root.get(w, [])
        pull = lm_scoring.ROOT_STRENGTH + self.root_d * self.root_tables
        return (sum(tables) - self.root_d * len(tables) + pull / (self.types + 1)) / (lm_scoring.ROOT_STRENGTH + self.root_customers)

    def probability(self, u, w):
        room = self.rooms.get(u, {})
        customers, tables = sum(sum(t) for t in room.values()), sum(len(t) for t in room.values())
        own = room.get(w, [])
        return (sum(own) - self.d * len(own) + (lm_scoring.STRENGTH + self.d * tables) * self.at_root(w)) / (lm_scoring.STRENGTH + customers)

    def seat(self, tables, d, new):
        at = self.r.random() * (sum(tables) - d * len(tables) + new)
        for k, n in enumerate(tables):
            at -= n - d
            if at < 0:
                tables[k] += 1
                return False
        tables.append(1)
        return True

    def leave(self, tables):
        at = self.r.randrange(sum(tables))
        for k, n in enumerate(tables):
            at -= n
            if at < 0:
                tables[k] -= 1
                if not tables[k]:
                    del tables[k]
                    return True
                return False

    def sit(self, u, w):
        room = self.rooms.setdefault(u, {})
        new = (lm_scoring.STRENGTH + self.d * sum(len(t) for t in room.values())) * self.at_root(w)
        if self.seat(room.setdefault(w, []), self.d, new):
            pull = (lm_scoring.ROOT_STRENGTH + self.root_d * self.root_tables) / (self.types + 1)
            self.root_customers += 1
            self.root_tables += self.seat(self.root.setdefault(w, []), self.root_d, pull)

    def sweep(self):
        for u, w in self.pairs:
            if self.leave(self.rooms[u][w]):
                self.root_customers -= 1
                self.root_tables -= self.leave(self.root[w])
            self.sit(u, w)


def test_lm_against_a_plain_gibbs_sampler(spark):
    """On a toy corpus the scores are those of a sampler that moves one customer at a time, averaged over many sweeps."""
    rows = frequent_corpus(60)
    texts = {i: [*words(t), None] for i, t in rows}
    training = [t for i, t in texts.items() if not lm_scoring.held_out(i)]
    pairs = Counter(p for t in training for p in zip(["<s>", *t[:-1]], t, strict=True))
    singles = Counter(w for t in training for w in t)
    of = lambda c: lm_scoring._discount(sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values()))
    sampler = PlainGibbs(training, of(pairs), of(singles), 3)
    asked = {p for t in texts.values() for p in zip(["<s>", *t[:-1]], t, strict=True)}
    total, sweeps = dict.fromkeys(asked, 0.0), 30
    for k in range(10 + sweeps):
        sampler.sweep()
        if k >= 10:
            for p in asked:
                total[p] += sampler.probability(*p)
    want = {i: sum(math.log10(total[p] / sweeps) for p in zip(["<s>", *t[:-1]], t, strict=True)) for i, t in texts.items()}
    found = {r["doc_id"]: r["score"] for r in lm_scoring.lm_scores(table(spark, rows)).collect()}
    assert found.keys() == want.keys()
    assert sum(found.values()) == pytest.approx(sum(want.values()), rel=0.005)
    assert all(found[i] == pytest.approx(want[i], rel=0.04, abs=0.1) for i in want)


def dealt(batches):
    """Rows as a shuffle would bring them, one batch each."""
    return iter(sorted(batches, key=lambda b: tuple(b.column(c)[0].as_py() for c in ("bucket", "kind", "other"))))


class Held:
    def __init__(self, value):
        self.value = value


def test_lm_probabilities_sum_to_one(monkeypatch):
    """Over all words of training and the unknown one, after every context; and tables never exceed customers."""
    monkeypatch.setattr(lm_scoring, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("One", (), {"partitionId": lambda self: 0})())}))
    r, buckets = random.Random(2), 4
    texts = [" ".join(r.choices(WORDS, weights=range(1, 41), k=r.randrange(1, 60))) for _ in range(60)]
    docs = pa.RecordBatch.from_pydict({"doc_id": pa.array([k for k in range(400) if not lm_scoring.held_out(k)][:60], pa.int64()), "text": texts})
    kinds = lambda rows, *which: [b for b in rows if b.column("kind")[0].as_py() in which]
    none = Held(lm_scoring.NO_HEAVY)
    rows = list(lm_scoring._summed(buckets, none)(dealt(lm_scoring._chunks(buckets, none)(iter([docs])))))
    added = lambda rows, n: [sum(x) for x in zip(*(b.column("sums")[0].as_py()[:n] for b in rows), strict=True)]
    sums = added(kinds(rows, lm_scoring.BUCKET), 7)
    s = lm_scoring.Settings(sums[0], sums[2], 0.6, 0.4, [sums[1]], [sums[2]])
    owned = list(lm_scoring._grouped(lm_scoring._owners)(dealt(kinds(rows, lm_scoring.PARTIAL))))
    told, all_rows, seated = kinds(owned, lm_scoring.TOLD), kinds(rows, lm_scoring.BUCKET) + kinds(owned, lm_scoring.OWNED), []
    for step in range(1, lm_scoring.SWEEPS + 1):
        swept = list(lm_scoring._swept(Held(s), step, buckets)(dealt(kinds(rows, lm_scoring.BUCKET) + told + seated)))
        extras = list(lm_scoring._extras(step)(dealt(kinds(swept, lm_scoring.PARTIAL))))
        told, seated = kinds(extras, lm_scoring.TOLD), kinds(swept, lm_scoring.SEATED)
        root = added(seated, 2)
        s.customers.append(root[0])
        s.tables.append(root[1])
        assert sums[2] <= root[1] <= root[0] <= sums[0]
        all_rows += seated + kinds(extras, lm_scoring.EXTRA)
    answers = sorted(lm_scoring._answered(Held(s))(dealt(all_rows)), key=lambda b: b.column("other")[0].as_py())
    columns = [np.concatenate(x) for x in zip(*(payloads.unpack(b.column("payload")[0].as_py()) for b in answers), strict=True)]
    _, lengths, order, (n_words, start), *_ = payloads.unpack(kinds(rows, lm_scoring.DOCUMENTS)[0].column("payload")[0].as_py())
    ranks = payloads.unpack(kinds(rows, lm_scoring.DOCUMENTS)[0].column("payload")[0].as_py())[0]
    place = order[ranks].astype(np.int64)
    pairs, counts = np.unique(lm_scoring.pairs_of(place, int(start), lengths), return_counts=True)
    at = 2 + 2 * lm_scoring.SAMPLES
    assert (columns[at] == np.minimum(counts, 2)).all() and (columns[at + 1] == counts[counts > 1]).all()
    assert all(((t >= 1) & (t <= columns[at + 1])).all() for t in columns[at + 2 :])
    unknown = np.mean([s.root(0, 0, k) for k in range(lm_scoring.BURN_IN + 1, lm_scoring.SWEEPS + 1)])
    word, context = np.divmod(np.arange(n_words * n_words), n_words)
    mark = np.zeros(n_words * n_words, np.uint8)
    mark[(pairs >> 32) * n_words + (pairs & 0xFFFFFFFF)] = columns[at]
    grid = lm_scoring.probabilities(s, word, context, [*columns[:at], mark, *columns[at + 1 :]]).reshape(n_words, n_words)
    words = np.delete(np.arange(n_words), start)
    for c in range(n_words):
        rest = [(lm_scoring.STRENGTH + s.discount * columns[2 + k][c]) / (lm_scoring.STRENGTH + columns[1][c]) * s.root(0, 0, lm_scoring.BURN_IN + 1 + k) for k in range(lm_scoring.SAMPLES)]
        assert grid[words, c].sum() + np.mean(rest) == pytest.approx(1.0, abs=1e-6)
    assert 0 < unknown < 1


def test_stirling_numbers():
    """Against the recursion on plain numbers, and the draw against its law."""
    d, s = 0.3, {(0, 0): 1.0}
    for n in range(8):
        for t in range(1, n + 2):
            s[n + 1, t] = s.get((n, t - 1), 0.0) + (n - d * t) * s.get((n, t), 0.0)
    found = np.exp(lm_scoring.stirling(d, 8))
    assert all(found[n, t] == pytest.approx(v) for (n, t), v in s.items() if n)
    p, others, many = 0.2, 5, 40_000
    tables = lm_scoring.reseated(np.full(many, 6), np.full(many, p), np.full(many, others), 1.0, d, np.random.default_rng(1))
    law = np.array([s[6, t] * p**t * np.prod([1.0 + d * (others + j) for j in range(t)]) for t in range(1, 7)])
    assert np.bincount(tables, minlength=7)[1:] / many == pytest.approx(law / law.sum(), abs=0.01)


def test_quality_classifier(spark):
    r = random.Random(4)
    good = [(k, " ".join(r.choices(WORDS, k=80))) for k in range(200)]
    bad = [(1000 + k, " | ".join(r.choices(WORDS, k=80))) for k in range(100)]
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in good + bad], "doc_id long, quality int")
    rows = good + bad + [(5000, None), (5001, ""), (None, "w1 w2")]
    found = quality_classifier.quality_classifier(table(spark, rows), labels).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)
    out = [r for r in found if r["held_out"] and r["doc_id"] < 5000]
    assert sum(r["predicted"] == int(r["doc_id"] < 1000) for r in out) > 0.95 * len(out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found if r["doc_id"] is not None)
    without = quality_classifier.quality_classifier(table(spark, rows[:3]), labels.limit(0)).collect()
    assert {r["score"] for r in without} == {0.5}
    docs = table(spark, rows)
    kept = quality_classifier.accepted(docs, quality_classifier.train(docs, labels))
    assert kept.schema == docs.schema
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in found if r["predicted"])


def test_factorisation_identity():
    m = quality_classifier.FactorisationMachine.start()
    index, x = np.array([1, 5, 9]), np.array([0.5, 2.0, -1.0])
    pairs = sum(float(m.factors[i] @ m.factors[j]) * a * b for k, (i, a) in enumerate(zip(index, x)) for j, b in list(zip(index, x))[k + 1 :])
    assert m.raw(index, x) == pytest.approx(pairs)


@pytest.mark.parametrize("memory", [exact_dedup.MEMORY_BYTES, 2000])
def test_exact_dedup(spark, memory):
    rows = corpus() + [(3001, ""), (None, "one"), (8000, "one")]
    found = exact_dedup.exact_dedup(table(spark, rows), memory).collect()
    key = lambda t: (t or "").translate(LOWER)
    group = {}
    for i, t in rows:
        group.setdefault(key(t), []).append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in group.items()}
    want = [(i, best[key(t)], len(group[key(t)]), i == best[key(t)], hashlib.sha256(key(t).encode()).hexdigest()) for i, t in rows]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_sharding(spark):
    rows = [(k, "x" * (k % 97) * 20) for k in range(500)] + [(9000, "y" * 6000), (9001, None), (None, "")] + [(9002, "z" * 900)] * 9
    found = sharding.shards(table(spark, rows), 4000).collect()
    sizes = Counter()
    by_key = {}
    for r in found:
        by_key.setdefault(r["shard"], r)
    assert len(found) == len(rows)
    plain = dict(rows)
    for r in found:
        sizes[r["shard"]] += len(plain[r["doc_id"]] or "")
    for shard, r in by_key.items():
        assert sizes[shard] == r["shard_bytes"] and (r["oversized"] or r["shard_bytes"] <= 4000) and len(shard) == r["depth"]
    assert sum(r["oversized"] for r in found) == 1 + 9
    names = sorted(by_key)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    assert sharding.shards(table(spark, []), 4000).count() == 0


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 7, "b": 2, "c": 1}, {"a": 5, "b": 3, "c": 3, "d": 1, "*": 1}, {"a": 1}])
def test_pfair_deviation(weights):
    order, total, given = mixing.earliest_deadline_first(weights), sum(weights.values()), Counter()
    for slot, (c, k) in enumerate(order, 1):
        assert k == given[c]
        given[c] += 1
        assert all(abs(given[x] - slot * q / total) < 1 for x, q in weights.items())
    assert given == weights


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://X.example.COM/en/7/a?b#c", "http://example.com/en/8", "ftp://a.net/de/1", "http://example.net/de/80", "http://example.net/de/7",
            "https://www.bad.io:443/p/?utm_source=x&id=3#f", "http://bad.io/p?id=3", "http://bad.io/p?id=4", "http://com/en/", "http://notcom/en/", "http://a.org/es/", "a://b://c/d", "http://bad.io/p?ref=1&id=3"]
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    listed = spark.createDataFrame([("https://bad.io/p?id=3",), (None,), ("https://bad.io/p?id=3",)], "url string")
    for limit in (url_filter.BROADCAST_BYTES, 0):
        found = {r["page_id"]: r for r in url_filter.url_filter(pages, listed, catalog.RULES, limit).collect()}
        want = {3: ("example.com/en/7", "allow"), 4: ("com/en/", "block"), 5: ("net/de/", "allow"), 6: ("example.net/de/8", "block"), 7: ("net/de/", "allow"), 8: (None, "block"), 9: (None, "block"), 11: ("com/en/", "block"), 13: ("org/es/", "block"), 15: (None, "block")}
        assert {k: (r["rule"], r["verdict"]) for k, r in found.items()} == {k: want.get(k, (None, "allow")) for k in range(len(urls))}
        assert (found[3]["host"], found[3]["path"], found[0]["host"], found[14]["host"], found[14]["path"]) == ("x.example.com", "/en/7/a", "", "b:", "//c/d")
    assert url_filter.url_filter(pages, listed.limit(0), catalog.RULES).filter("listed").count() == 0


def test_very_long_urls(spark):
    """Hosts, paths and queries of 300,000 characters, with and without a scheme, listed or ruled upon."""
    long = 300_000
    urls = ["x" * long, "http://" + "h" * long + ".com/en/" + "p" * long, "http://a.io/" + "q/" * (long // 2), "http://b.io/p?" + "&".join(f"k{k}=v" for k in range(long // 10)), "http://b.io/?" + "utm_a=1&" * (long // 10) + "id=1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([(urls[2],), ("http://www.b.io?id=1",)], "url string")
    found = {r["page_id"]: r for r in url_filter.url_filter(pages, listed, catalog.RULES).collect()}
    assert {k: (r["rule"], r["verdict"]) for k, r in found.items()} == {0: (None, "allow"), 1: ("com/en/", "block"), 2: (None, "block"), 3: (None, "allow"), 4: (None, "block")}
    assert (found[0]["host"], len(found[1]["host"]), len(found[1]["path"]), found[3]["path"]) == ("", long + 4, long + 4, "/p")


def test_bloom_has_no_false_negatives(spark):
    many = spark.range(3000).select(F.concat(F.lit("http://h/"), F.col("id").cast("string")).alias("url"), F.col("id").alias("page_id"))
    found = url_filter.url_filter(many, many.filter("page_id % 3 = 0").select("url"), [url_filter.Rule("z", "/", "block")])
    assert found.filter("listed").count() == 1000 and found.filter("listed and page_id % 3 <> 0").count() == 0


def test_exact_join_removes_false_positives(spark, monkeypatch):
    """A filter too small for its list lets pages through that aren't listed; the verdicts don't change."""
    many = spark.range(3000).select(F.concat(F.lit("http://h/"), F.col("id").cast("string")).alias("url"), F.col("id").alias("page_id"))
    monkeypatch.setattr(url_filter, "BITS_PER_URL", 2)
    listed = many.filter("page_id % 3 = 0").select(url_filter.canonical(F.col("url")).alias("canonical"))
    rest = many.filter("page_id % 3 <> 0").select(url_filter.canonical(F.col("url")).alias("canonical"))
    blocks = 8  # as 1,000 URLs of 2 bits come to
    words = url_filter._words(F.col("canonical"))
    hits = rest.withColumn("block", url_filter._block(F.col("canonical"), blocks)).join(url_filter.bloom(listed, blocks), "block")
    for k, w in enumerate(words):
        hits = hits.filter(F.col(f"w{k}").bitwiseAND(w) == w)
    assert hits.count() > 100
    found = url_filter.url_filter(many, many.filter("page_id % 3 = 0").select("url"), [])
    assert found.filter("listed").count() == 1000 and found.filter("verdict = 'block' and page_id % 3 <> 0").count() == 0


def test_canonical_urls(spark):
    urls = {"http://a.b/p?page=1": "a.b/p?page=1", "http://a.b/p/?ref=x&page=2&&utm_a=1": "a.b/p?page=2", "https://WWW.a.B:443//#x": "a.b", "a.b": None, "http://a.b/p?": "a.b/p"}
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", url_filter.canonical(F.col("url")).alias("c")).collect()
    assert {r["url"]: r["c"] for r in rows} == urls


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    same(catalog.QUERIES[name](spark, sf_dir), sf_dir, catalog.ORACLE_SQL[name])


def test_empty_tables(spark):
    docs = table(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (
        quality_rules.quality_rules(docs, labels), byte_bpe.digests(docs, PATH), ngram_join.ngram_join(docs), lm_scoring.lm_scores(docs),
        quality_classifier.quality_classifier(docs, labels), exact_dedup.exact_dedup(docs),
        url_filter.url_filter(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "url string"), catalog.RULES),
    ):
        assert df.count() == 0
