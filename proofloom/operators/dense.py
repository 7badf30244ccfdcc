"""An approximate index of vectors: coarse lists by k-means, residual codes within them, exact scores of the best.

A vector of length 1 lies in the list of its nearest centre; a code of a byte a part says which of 256 corrections comes
nearest to what the centre leaves over. A query looks into the `probe` lists whose centres are nearest to it, ranks what it
finds there by codes, which are a few bytes a vector, and scores a shortlist exactly. Only the lists that any query probes
are read, and of those that are not on a shortlist only the codes.

Centres and corrections are learned from the TRAIN vectors of least hash; every vector is in the index. Lists are folders,
each in parts by hash, so a list that holds most vectors is many tasks. More vectors go into the same lists by add(). Null
vectors, those that hold nulls, and those of another size than the first are left out; zero vectors have the score 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions.blocks import _by_size
from ..functions.vectors import cosine
from ..params import DEFAULT, Params
from ..shared import stored
from .retrieval import top_k

TRAIN, ROUNDS, CODES = 20_000, 12, 256
#: Cells of a matrix of scores that is held at once.
CELLS = 4_000_000


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centres of the rows of x; an empty one starts again from a row that is far from its own."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        far = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
        own = far.argmin(1)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.divide(sums, counts[:, None], out=centres, where=counts[:, None] > 0)
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            centres[empty] = x[np.argsort(-far[np.arange(len(x)), own], kind="stable")[: len(empty)]]
    return centres


@dataclass(frozen=True)
class Quantiser:
    """centres (lists, size) and corrections (parts, codes, size / parts)."""

    centres: np.ndarray
    corrections: np.ndarray

    @staticmethod
    def learned(x: np.ndarray, lists: int, parts: int, seed: int) -> Quantiser:
        rng = np.random.default_rng(seed)
        centres = kmeans(x, lists, rng)
        rest = x - centres[_nearest(x, centres)]
        width = x.shape[1] // parts
        return Quantiser(centres, np.stack([_padded(kmeans(rest[:, i * width : (i + 1) * width], CODES, rng)) for i in range(parts)]))

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list and the code of each row."""
        own = _nearest(x, self.centres)
        rest, width = x - self.centres[own], self.corrections.shape[2]
        return own, np.stack([_nearest(rest[:, i * width : (i + 1) * width], c) for i, c in enumerate(self.corrections)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, parts, codes): what each correction adds to each query's score."""
        width = self.corrections.shape[2]
        return np.stack([q[:, i * width : (i + 1) * width] @ c.T for i, c in enumerate(self.corrections)], 1)


def _padded(centres: np.ndarray) -> np.ndarray:
    return np.concatenate([centres, np.repeat(centres[:1], CODES - len(centres), 0)])


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, CELLS // len(centres))
    size = (centres * centres).sum(1)
    return np.concatenate([np.empty(0, np.int64), *((size - 2 * x[a : a + step] @ centres.T).argmin(1) for a in range(0, len(x), step))])


def _least(hashed: DataFrame, n: int) -> DataFrame:
    """(chunk_id, embedding) of the n rows of least h, then chunk_id.

    Hashes below a bound that about 2 n rows pass are looked at first, so that the tasks do not pass on n rows each.
    """
    total = hashed.count()
    if total > 2 * n:
        few = stored(hashed.filter(F.col("h") < int(2**64 * (2 * n / total)) - 2**63).select("chunk_id", "embedding", "h"), "training")
        hashed = few if few.count() >= n else hashed
    return hashed.orderBy("h", "chunk_id").limit(n).select("chunk_id", "embedding")


class DenseIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, vectors: DataFrame, lists: int | None = None, parts: int = 16, seed: int = 0, train: int = TRAIN) -> DenseIndex:
        """Learns from, and adds, vectors (chunk_id, embedding); lists: the root of their number, if not given."""
        vectors = vectors.select("chunk_id", "embedding")
        rows = _least(vectors.filter("embedding IS NOT NULL").withColumn("h", F.xxhash64("chunk_id")), train).toArrow()
        sizes = list(_by_size(rows.column("embedding").combine_chunks())) if rows.num_rows else []
        if not any(len(x) for _, _, x in sizes):
            raise ValueError("there are no vectors to learn from")
        size, _, x = max(sizes, key=lambda s: len(s[2]))
        parts = max(p for p in range(1, parts + 1) if size % p == 0)
        q = Quantiser.learned(x, lists or max(1, round(math.sqrt(vectors.count()))), parts, seed)
        model = [(q.centres.tolist(), q.corrections.tolist())]
        self.spark.createDataFrame(model, "centres array<array<double>>, corrections array<array<array<double>>>").coalesce(1).write.parquet(f"{self.path}/model")
        return self.add(vectors)

    def _model(self) -> Quantiser:
        row = self.spark.read.parquet(f"{self.path}/model").first()
        return Quantiser(np.array(row.centres), np.array(row.corrections))

    def add(self, vectors: DataFrame) -> DenseIndex:
        """Puts vectors into the lists; ids are expected to be new."""
        share = self.spark.sparkContext.broadcast(self._model())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for size, at, x in _by_size(batch.column("embedding")):
                    if size == share.value.centres.shape[1] and len(at):
                        own, codes = share.value.encoded(x)
                        kept = batch.take(pa.array(at))
                        code = pa.array([c.tobytes() for c in codes], pa.binary())
                        yield pa.RecordBatch.from_arrays([*kept.columns, code, pa.array(own.astype(np.int32))], names=["chunk_id", "embedding", "code", "list"])

        rows = vectors.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
        coded = rows.mapInArrow(run, "chunk_id string, embedding array<double>, code binary, list int")
        coded.repartition("list", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.mode("append").partitionBy("list").parquet(f"{self.path}/lists")
        return self

    def _lists(self) -> DataFrame:
        return self.spark.read.schema("chunk_id string, embedding array<double>, code binary, list int").parquet(f"{self.path}/lists")

    def topk(self, queries: DataFrame, k: int, probe: int, shortlist: int | None = None, p: Params = DEFAULT) -> DataFrame:
        """(query_id, chunk_id, dense_score, rank): each query's (query_id, q) k nearest in the lists that it probes.

        With a shortlist, codes choose so many vectors for a query; without one all in its lists are scored, which, with all
        lists probed, is the exact answer. Queries are taken in blocks of about p.max_queries.
        """
        model = self._model()
        blocks = max(1, math.ceil(queries.count() / p.max_queries))
        out = None
        for i in range(blocks):
            block = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
            one = self._block(model, block, k, min(probe, len(model.centres)), shortlist)
            out = one if out is None else out.unionByName(one)
        return out

    def _block(self, model: Quantiser, queries: DataFrame, k: int, probe: int, shortlist: int | None) -> DataFrame:
        asked = queries.select("query_id", "q").toArrow()
        found = [(at, x) for size, at, x in _by_size(asked.column("q").combine_chunks()) if size == model.centres.shape[1]] if asked.num_rows else []
        at, q = found[0] if found else (np.empty(0, np.int64), np.empty((0, model.centres.shape[1])))
        ids = asked.column("query_id").combine_chunks().take(pa.array(at))
        near = q @ model.centres.T
        probes = np.argsort(-near, axis=1, kind="stable")[:, :probe]
        by_list = {int(c): np.flatnonzero((probes == c).any(1)) for c in np.unique(probes)}
        rows = self._lists().filter(F.col("list").isin(list(by_list)))
        least = k if shortlist is None else shortlist
        share = self.spark.sparkContext.broadcast((ids, q, near, model.tables(q) if shortlist is not None else None, by_list))
        schema = StructType([queries.schema["query_id"], rows.schema["chunk_id"], StructField("list", IntegerType()), StructField("score", DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, near, tables, by_list = share.value
            best = np.full((len(ids), least), -np.inf)
            for batch in batches:
                lists = batch.column("list").to_numpy()
                for c in np.unique(lists).tolist():
                    who, own = by_list[c], np.flatnonzero(lists == c)
                    step = max(1, CELLS // max(1, len(who)))
                    for a in range(0, len(own), step):
                        some = own[a : a + step]
                        if tables is None:
                            score = q[who] @ next(x for _, _, x in _by_size(batch.column("embedding").take(pa.array(some)))).T
                        else:
                            codes = np.frombuffer(b"".join(batch.column("code").take(pa.array(some)).to_pylist()), np.uint8).reshape(len(some), -1)
                            score = near[who, c][:, None] + sum(tables[who, i][:, codes[:, i]] for i in range(codes.shape[1]))
                        seen = np.concatenate([best[who], score], axis=1)
                        best[who] = np.partition(seen, seen.shape[1] - least, axis=1)[:, -least:]
                        x, y = np.nonzero(score >= best[who].min(1)[:, None] - 2e-6)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(who[x])), batch.column("chunk_id").take(pa.array(some[y])), pa.array(np.full(len(x), c, np.int32)), pa.array(score[x, y])], names=["query_id", "chunk_id", "list", "score"])

        scored = rows.select("chunk_id", "list", "embedding" if shortlist is None else "code").mapInArrow(run, schema)
        if shortlist is not None:
            chosen = stored(top_k(scored, "score", shortlist).select("query_id", "chunk_id", "list"), "shortlist")
            exact = rows.select("chunk_id", "list", "embedding").join(chosen, ["list", "chunk_id"]).join(queries.select("query_id", "q"), "query_id")
            scored = exact.select("query_id", "chunk_id", cosine(F.col("q"), F.col("embedding")).alias("score"))
        return top_k(scored.select("query_id", "chunk_id", F.round("score", 6).alias("dense_score")), "dense_score", k)
