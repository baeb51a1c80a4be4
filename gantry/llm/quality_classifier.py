"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Inputs of a text: its words hashed to ``BUCKETS`` (damped counts, unit length), fixed statistics
of its structure, and the stored number of characters against the real one.  Pairs interact through
rank-``RANK`` factors; the sum over all pairs is half of (sum of squares of factor sums minus sum of squared
terms), so a score costs time linear in the text.

The model is fitted on a bounded sample of the labelled rows (``SAMPLE`` rows, those with the
smallest hash of their id; the bound is a parameter), by Adam on log loss.  Texts of the sample are turned into inputs on
the executors; only these inputs reach the driver.  Every text is scored whole, by an Arrow UDF that sees the
text and its stated size; all other columns stay on the JVM's side.

Defined cases: null or empty text has no words and gets the score of its structure.  Without labelled rows
the score is 0.5.  Contradicting labels of one id: the lowest counts.  Of rows with one id one is learnt from, that
with the smallest hash of its text, then the smallest stated size and text.  Repeated rows are scored
alike; null ids are scored too.  Other columns are not read.  The model is fitted while the query is built.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantry.llm.common import memory_returned
from gantry.llm.textbytes import lowered_bytes, slices, word_hashes, word_spans

BUCKETS = 1 << 14
RANK = 8
SAMPLE = 6_000
EPOCHS = 12
THRESHOLD = 0.7
STRUCTURE = ("one", "size", "word length", "distinct", "repeats", "symbols", "capitals", "shouts", "bars", "digits", "stops", "breaks", "repeated lines", "stated size")
CLASSES = {name: np.isin(np.arange(256), np.frombuffer(chars.encode(), np.uint8)) for name, chars in
           {"symbols": "#*$%&<>", "capitals": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "shouts": "!", "bars": "|", "digits": "0123456789", "stops": ".,;:?", "breaks": "\n"}.items()}


def inputs(text: np.ndarray, lowered: np.ndarray, stated: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words, their weights, and the structure statistics (each about 0 to 1)."""
    hashes = word_hashes(lowered)
    n = len(hashes)
    buckets, counts = np.unique((hashes >> np.uint64(50)).astype(np.int64) % BUCKETS, return_counts=True)
    weights = np.log1p(counts)
    weights = weights / max(np.sqrt((weights**2).sum()), 1e-9)
    first, after = word_spans(text)
    size = max(1, int((after - first).sum()))
    by_byte = np.bincount(text, minlength=256)
    lines = [line for line in text.tobytes().split(b"\n") if line.strip()]
    shares = [min(1.0, 3 * by_byte[c].sum() / size) for c in CLASSES.values()]
    structure = [
        1.0, np.log1p(n) / 10, min(size / max(n, 1) / 20, 1.0), len(set(hashes.tolist())) / max(n, 1),
        np.count_nonzero(hashes[1:] == hashes[:-1]) / max(n, 1), *shares,
        1 - len(set(lines)) / max(len(lines), 1), min(2.0, (stated or 0) / max(len(text), 1)),
    ]
    return buckets, weights, np.array(structure)


@dataclass
class FactorisationMachine:
    """Rows 0 .. BUCKETS-1 stand for words, the last ones for structure statistics."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    @staticmethod
    def start(seed: int = 7) -> FactorisationMachine:
        rows = BUCKETS + len(STRUCTURE)
        return FactorisationMachine(0.0, np.zeros(rows), np.random.default_rng(seed).normal(0, 0.05, (rows, RANK)))

    def raw(self, index: np.ndarray, x: np.ndarray) -> float:
        terms = self.factors[index] * x[:, None]
        sums = terms.sum(0)
        return self.bias + float(self.linear[index] @ x) + 0.5 * float((sums**2).sum() - (terms**2).sum())

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = 0.02, decay: float = 1e-5, seed: int = 7) -> None:
        """Adam, in small batches of rows of (index, x, label)."""
        rng = np.random.default_rng(seed)
        parameters = [self.linear, self.factors]
        first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
        bias_first = bias_second = 0.0
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), 64):
                batch = [rows[i] for i in order[k : k + 64]]
                step += 1
                index = np.concatenate([r[0] for r in batch])
                x = np.concatenate([r[1] for r in batch])
                starts = np.cumsum([0, *(len(r[0]) for r in batch[:-1])])
                owner = np.repeat(np.arange(len(batch)), [len(r[0]) for r in batch])
                terms = self.factors[index] * x[:, None]
                sums = np.add.reduceat(terms, starts)
                score = self.bias + np.add.reduceat(self.linear[index] * x, starts)
                score += 0.5 * ((sums**2).sum(1) - np.add.reduceat((terms**2).sum(1), starts))
                slope = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - np.array([r[2] for r in batch])) / len(batch)
                touched, place = np.unique(index, return_inverse=True)
                to_linear = np.bincount(place, slope[owner] * x, len(touched)) + decay * self.linear[touched]
                to_each = (slope[owner] * x)[:, None] * (sums[owner] - terms)
                to_factors = np.stack([np.bincount(place, to_each[:, f], len(touched)) for f in range(RANK)], 1) + decay * self.factors[touched]
                correct = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for p, m, v, g in zip(parameters, first, second, (to_linear, to_factors), strict=True):
                    m[touched] = 0.9 * m[touched] + 0.1 * g
                    v[touched] = 0.999 * v[touched] + 0.001 * g**2
                    p[touched] -= rate * correct * m[touched] / (np.sqrt(v[touched]) + 1e-8)
                g = float(slope.sum())
                bias_first, bias_second = 0.9 * bias_first + 0.1 * g, 0.999 * bias_second + 0.001 * g**2
                self.bias -= rate * correct * bias_first / (np.sqrt(bias_second) + 1e-8)


def _joined(buckets: np.ndarray, weights: np.ndarray, structure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([buckets, np.arange(BUCKETS, BUCKETS + len(structure))]), np.concatenate([weights, structure])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index and x of each row of a batch."""
    for part in slices(batch):
        texts, stated = part.column("text"), part.column("n_chars").to_pylist()
        for text, lowered, said in zip(texts.to_pylist(), lowered_bytes(texts), stated, strict=True):
            yield _joined(*inputs(np.frombuffer((text or "").encode(), np.uint8), lowered, said))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorisationMachine | None:
    """Fit on the labelled rows that are not held out; None without any."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter(~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with memory_returned():
            for batch in batches:
                both = list(_rows(batch))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id"),
                    "quality": batch.column("quality"),
                    "at": pa.array([i.astype(np.int32) for i, _ in both], pa.list_(pa.int32())),
                    "x": pa.array([x.astype(np.float32) for _, x in both], pa.list_(pa.float32())),
                })

    sampled = _read(docs).join(F.broadcast(chosen), "doc_id")
    # One row of each id, before anything reaches the driver.
    row = F.struct(F.xxhash64("text").alias("hash"), "n_chars", "text")
    sampled = sampled.groupBy("doc_id", F.col("quality").cast("int").alias("quality")).agg(F.min(row).alias("row")).select("doc_id", "quality", "row.text", "row.n_chars")
    found = sampled.mapInArrow(run, "doc_id long, quality int, at array<int>, x array<float>").toArrow().sort_by([("doc_id", "ascending")])
    rows = [
        (at.values.to_numpy().astype(np.int64), x.values.to_numpy().astype(np.float64), int(quality.as_py() == 1))
        for quality, at, x in zip(*(found.column(c) for c in ("quality", "at", "x")), strict=True)
    ]
    if not rows:
        return None
    machine = FactorisationMachine.start()
    machine.fit(rows)
    return machine


def score_of(machine: FactorisationMachine | None, text: Column, n_chars: Column) -> Column:
    """The score of a row; 0.5 without a machine."""

    @F.arrow_udf("double")
    def scores(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        with memory_returned():
            for texts, stated in columns:
                batch = pa.RecordBatch.from_pydict({"text": texts, "n_chars": stated})
                raw = np.array([0.0 if machine is None else machine.raw(index, x) for index, x in _rows(batch)])
                yield pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30))), pa.float64())

    return scores(text, n_chars)


def _stated(docs: DataFrame) -> Column:
    return F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text", _stated(docs).alias("n_chars"))


def score(docs: DataFrame, machine: FactorisationMachine | None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` for every row."""
    scored = docs.select(F.col("doc_id").cast("long"), score_of(machine, F.col("text"), _stated(docs)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, machine: FactorisationMachine | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all their columns, that score ``threshold`` or more; in one pass without a join."""
    return docs.filter(score_of(machine, F.col("text"), _stated(docs)) >= threshold)


def quality_classifier(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    return score(docs, train(docs, labels, sample), threshold).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
