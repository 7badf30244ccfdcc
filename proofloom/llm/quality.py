"""Operator 6: a quality classifier, histogram gradient-boosted trees over document statistics.

A text becomes a row of statistics of its characters, words and lines. Trees are grown level by level on histograms of
at most 64 quantile bins, with the logistic loss, on at most MAX_ROWS labelled rows (an even share by hashed doc_id
where there are more); a finished tree is three flat arrays in heap order, walked for all rows at once. Labels, lang,
source and doc_id are never inputs of a score.

Null and empty texts have statistics of zero and get a score like any other; very long ones are measured whole. Without
labels every score is 0.5. A label that occurs more than once counts by its greatest value; labelled ids that are null or
absent from the documents teach nothing, and of documents that share a labelled id the least text teaches. Repeated rows
repeat their result; an empty table gives an empty one. Extra columns, whatever their names, are ignored by `judge` and
kept by `kept`.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import slices, stored, table

MAX_ROWS, BINS, DEPTH, TREES, RATE, LEAST, RIDGE = 20_000, 64, 5, 80, 0.15, 1.0, 1.0
THRESHOLD = 0.3
SYMBOLS = b"|!#%&*$<>{}[]=_~^@/\\;:()\"'?+-"


def statistics(text: str) -> list[float]:
    """Statistics of a whole text, each about 0 to 1 or a logarithm."""
    data = text.encode()
    n = max(1, len(data))
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = text.split()
    lines = text.split("\n")
    nw, nl = max(1, len(words)), max(1, len(lines))
    often = Counter(words)
    top = max(often.values(), default=0)
    once = sum(v == 1 for v in often.values())
    repeats = sum(a == b for a, b in zip(words[:-1], words[1:], strict=True))
    p = count[count > 0] / n
    letters = count[65:91].sum() + count[97:123].sum() + count[128:].sum()
    full = sum(x.endswith((".", "!", "?")) for x in lines)
    lengths = [len(w) for w in often] or [0]
    symbol = [count[c] / nw for c in SYMBOLS]
    stop = sum(v for w, v in often.items() if len(w) <= 3)
    return [
        np.log1p(len(data)), np.log1p(len(words)), np.log1p(len(lines)), len(text) / nw, len(text) / nl / 100, count[65:91].sum() / n,
        count[48:58].sum() / n, letters / n, count[128:].sum() / n, (count[32] + count[10]) / n, count[46] / nw, count[44] / nw,
        len(often) / nw, once / nw, top / nw, repeats / nw, len(set(lines)) / nl, full / nl, float(-(p * np.log2(p)).sum()),
        float(np.mean(lengths)), float(np.max(lengths)) / 20, stop / nw, sum(count[c] for c in SYMBOLS) / n, sum(v for w, v in often.items() if w[0].isupper()) / nw,
        sum(v for w, v in often.items() if w.isupper()) / nw, sum(v for w, v in often.items() if w.isalpha()) / nw, *symbol,
    ]


N_FEATURES = len(statistics(""))


def _measured(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t.as_py() or "") for t in texts], np.float32).reshape(-1, N_FEATURES)


@dataclass
class Trees:
    """Flat arrays in heap order: inner nodes' features and thresholds, and leaves' values."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    none = np.zeros((0, 2**DEPTH - 1))
    if not len(y):
        return Trees(0.0, none.astype(int), none, np.zeros((0, 2**DEPTH)))
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(prior / (1 - prior)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T, strict=True)])
    total = np.full(len(y), start)
    features, thresholds, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(2**DEPTH - 1, int), np.full(2**DEPTH - 1, np.inf)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for f, (q, b) in enumerate(zip(cuts, bins, strict=True)):
                if not len(q):
                    continue
                cell = (at - first) * (BINS + 1) + b
                sums = [np.bincount(cell, w, width * (BINS + 1)).reshape(width, -1).cumsum(1) for w in (g, h)]
                (gl, gt), (hl, ht) = ((s[:, : len(q)], s[:, -1:]) for s in sums)
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(hl < LEAST) | (ht - hl < LEAST)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                for node in np.flatnonzero(top > best):
                    best[node], feature[first + node], threshold[first + node] = top[node], f, q[k[node]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        at -= 2**DEPTH - 1
        leaf = -RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + RIDGE)
        total += leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(start, np.array(features), np.array(thresholds), np.array(leaves))


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Trees:
    """Learns from at most max_rows labelled documents, none of them held out; their statistics are what reaches the driver."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality")).filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    total = known.count()
    if total > max_rows:  # an even share by hashed doc_id, a little below the bound
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2**32)) < int(0.97 * max_rows / total * 2**32))
    known = stored(known, "known")  # small, so that the documents need not move
    rows = docs.select("doc_id", "text").join(known, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x = _measured(batch.column("text"))
                flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES, pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), flat, batch.column("quality").cast(pa.float64())], names=["doc_id", "x", "quality"])

    found = rows.mapInArrow(run, StructType([docs.schema["doc_id"], *StructType.fromDDL("x array<float>, quality double")])).toArrow().sort_by("doc_id")
    x = found.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
    return grow(x, found.column("quality").to_numpy())


def judge(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document."""
    trees = fit(docs, labels, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(trees.score(_measured(batch.column("text"))), pa.float64())], names=["doc_id", "score"])

    rows = docs.select("doc_id", "text")
    out = rows.mapInArrow(run, StructType([rows.schema["doc_id"], *StructType.fromDDL("score double")]))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents that the classifier accepts, with their own columns: texts are scored where they are."""
    trees = fit(docs, labels, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield batch.filter(pa.array(trees.score(_measured(batch.column("text"))) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
