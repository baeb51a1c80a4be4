"""The pipeline stage by stage against plain Python, with repeated ids, nulls, empty tables and clashing columns."""

import hashlib
import random

import pytest
from test_mixing_sharding import brute_mix

import corpus_pipeline
from gantry.llm import mixing, quality_classifier

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept_rows int, slot string, row long, digest string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = [f"w{k}" for k in range(60)]
ROWS = [
    (1, "a"), (1, "b"), (2, "A"), (3, "b"), (3, "b"), (None, None), (None, ""), (4, "one long line " * 3000), (7, "c"), (7, "C"), (None, "c"),
    (10, " ".join(BASE)), (10, " ".join([*BASE[:59], "x"])), (5, " ".join([*BASE[:58], "y", "z"])), (None, " ".join(["v", *BASE[1:]])), (6, " ".join(BASE[::-1])),
]


def frame(spark, rows):
    full = [(i, t, (None, "en")[k % 2], ("src0", "src1", None)[k % 3], None if t is None else len(t), k, "q", 5, "d") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS).repartition(3)


def test_classify_keeps_what_the_classifier_accepts(spark, tmp_path):
    r = random.Random(4)
    rows = ROWS + [(100 + k, " ".join(r.choices(BASE, k=80))) for k in range(60)] + [(300 + k, " | ".join(r.choices(BASE, k=80))) for k in range(60)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(k, int(k < 300)) for k in [*range(100, 160), *range(300, 360)]], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.classify(spark, docs, str(tmp_path))
    assert kept.schema == docs.schema
    scored = quality_classifier.score(docs.withColumn("doc_id", docs.kept_rows.cast("long")), quality_classifier.train(docs, labels))
    assert sorted(x["kept_rows"] for x in kept.collect()) == sorted(x["doc_id"] for x in scored.filter("predicted = 1").collect())
    assert kept.filter("doc_id between 100 and 159").count() > 55 and kept.filter("doc_id >= 300").count() < 5


def test_classify_learns_one_row_of_an_id(spark, tmp_path):
    """An id with many rows gives one to the sample, whatever their order."""
    rows = [(1, f"t{k % 7} | {k % 5}") for k in range(300)] + [(k, f"good {k}") for k in range(2, 40)]
    labels = spark.createDataFrame([(k, int(k > 1)) for k in range(1, 40)], "doc_id long, quality int")
    docs = frame(spark, rows)
    first, again = (quality_classifier.train(d, labels) for d in (docs, docs.repartition(7)))
    assert first.bias == again.bias and (first.factors == again.factors).all()


def test_deduplicate_keeps_one_row_of_each_text(spark):
    docs = frame(spark, ROWS)
    kept = corpus_pipeline.deduplicate(spark, docs, "")
    assert kept.schema == docs.schema
    best = {}
    for i, t in ROWS:
        key = (t or "").translate(LOWER)
        best[key] = max(best.get(key, -1), -1 if i is None else i)
    found = [((x["text"] or "").translate(LOWER), -1 if x["doc_id"] is None else x["doc_id"]) for x in kept.collect()]
    assert sorted(found) == sorted(best.items())
    again = corpus_pipeline.deduplicate(spark, docs.repartition(5), "")
    assert sorted(x["kept_rows"] for x in again.collect()) == sorted(x["kept_rows"] for x in kept.collect())


def test_near_deduplicate_keeps_one_row_of_each_group(spark):
    docs = corpus_pipeline.deduplicate(spark, frame(spark, ROWS), "")
    kept = corpus_pipeline.near_deduplicate(spark, docs, "")
    assert kept.schema == docs.schema
    rows = [(x["doc_id"], x["text"]) for x in docs.collect()]

    def shingles(text):
        w = (text or "").split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    want = {}
    for g, (i, _) in zip(group, rows, strict=True):
        want.setdefault(g, []).append(i)
    least = [min((i for i in ids if i is not None), default=None) for ids in want.values()]
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == sorted(map(str, least))
    assert len(least) < len(rows)


def test_mix_and_tokenize_keep_all_rows(spark):
    rows = ROWS + [(k, "x y " * 5000) for k in range(200, 260)]
    docs = frame(spark, rows)
    mixed = corpus_pipeline.mix(spark, docs, "")
    sources = [("src0", "src1", None)[k % 3] for k in range(len(rows))]
    want, _ = brute_mix([(i, t, s) for (i, t), s in zip(rows, sources, strict=True)], {k: v for k, v in corpus_pipeline.WEIGHTS.items()}, mixing.BLOCK_BYTES)
    assert sorted([tuple(x) for x in mixed.select("doc_id", *mixing.ADDED).collect()], key=str) == [tuple(w) for w in want]
    found = corpus_pipeline.tokenize(spark, mixed, "").collect()
    digests = [hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows]
    assert sorted(x["decoded_sha256"] for x in found) == sorted(digests)
    assert sorted([tuple(x[c] for c in ("doc_id", *corpus_pipeline.MIX)) for x in found], key=str) == sorted([tuple(x[c] for c in ("doc_id", *corpus_pipeline.MIX)) for x in mixed.collect()], key=str)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[1:]])
def test_stages_take_empty_tables(spark, stage):
    docs = frame(spark, ROWS)
    if stage is corpus_pipeline.tokenize:
        docs = corpus_pipeline.mix(spark, docs, "")
    assert stage(spark, docs.limit(0), "").count() == 0


def test_run(spark, sf_dir):
    """Stage names, and that later stages only lose rows."""
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "byte-level BPE encoding and decoding",
    ]
    found = corpus_pipeline.run(spark, sf_dir)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert 0.5 * documents < found.count() <= documents
