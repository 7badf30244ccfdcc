"""Chunks, their register and their inverted index as stored tables, which ingests add to, and which queries read in part.

A library is a folder. Each ingest writes a segment beside the others, never into them:

    chunks      the new chunks with a number each, by publication and edition
    dead        numbers of the chunks that the new ones replace
    postings    by bucket of the term, in order: rows of a term and window of WINDOW numbers, with (no, tf, dl) of its
                chunks, and the greatest tf and least dl among them; a window that two tasks read has a row of each
    terms       by the same buckets: by how many chunks with the term the ingest adds to the corpus; below 0 for replaced ones
    documents   the register's new rows

What counts is named by the last manifest, a small JSON file with a number: segments, chunks, words, and the mean of the
terms' raw weights. An ingest writes its segment, audits it, and publishes it by moving the next manifest into place, in
one step. If anything fails before that, the segment goes, and nothing has changed; after a crash the next ingest removes
what no manifest names. There is one writer at a time, and any number of readers: a manifest's segments never change.

Numbers follow the order in which chunks arrive, and a chunk that gives way to another of its id leaves a gap. What moves
between tasks are terms with packed numbers and counts (`postings`), which become rows a window (`windowed`) after that.

Statistics are sums over segments, so after any ingests they are those of the live chunks, without a pass over the rest.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.postings import counted
from ..functions.postings import spread as _spread
from ..params import DEFAULT, Params
from ..shared import stored
from .documents import numbered
from .retrieval import matching

#: Buckets of terms, chunks of a window, and windows of a shard.
BUCKETS, WINDOW, SHARD = 64, 16, 256
#: Words of a part of the postings that a task sorts.
SORTED = 1_000_000
#: Values that a filter of a scan may list.
LISTED = 10_000
#: Scores that a task holds at once.
CELLS = 4_000_000
LIVE = " live"  # no term holds a space
EMPTY = {"version": 0, "segments": [], "next_no": 0, "n": 0, "words": 0, "mean": 0.0, "last_id": 0}
EDITION = ("publication_name", "edition_date")
_OPTIONAL = {"section_title": "string", "page_number": "long"}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Library:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        """buckets: of terms; more for more chunks, and the same as long as the library lives."""
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._class = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._class(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    # Manifests

    def manifest(self) -> dict:
        at = self._class(f"{self.path}/manifests")
        numbers = [int(f.getPath().getName().removesuffix(".json")) for f in self._fs.listStatus(at) if f.getPath().getName().endswith(".json")] if self._fs.exists(at) else []
        if not numbers:
            return dict(EMPTY)
        stream = self._fs.open(self._class(f"{self.path}/manifests/{max(numbers)}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """The step that makes an ingest count."""
        whole, temporary = self._class(f"{self.path}/manifests/{manifest['version']}.json"), self._class(f"{self.path}/manifests/{uuid.uuid4().hex}.tmp")
        out = self._fs.create(temporary)
        out.write(json.dumps(manifest).encode())
        out.close()
        if self._fs.exists(whole) or not self._fs.rename(temporary, whole):
            self._fs.delete(temporary, False)
            raise RuntimeError("another ingest has been published meanwhile")

    def _sweep(self, named: Sequence[str]) -> None:
        """Removes segments that no manifest names."""
        at = self._class(f"{self.path}/segments")
        for f in self._fs.listStatus(at) if self._fs.exists(at) else []:
            if f.getPath().getName() not in named:
                self._fs.delete(f.getPath(), True)

    # Tables

    @property
    def is_built(self) -> bool:
        """Whether there is anything to search; no table is read."""
        return self.manifest()["n"] > 0

    def _read(self, manifest: dict, name: str) -> DataFrame | None:
        paths = [f"{self.path}/segments/{s['name']}/{name}" for s in manifest["segments"] if s[name]]
        out = None
        for p in paths:  # a folder each, as partition columns are found below it
            one = self.spark.read.schema(SCHEMAS[name]).parquet(p)
            out = one if out is None else out.unionByName(one)
        return out

    def chunks(self, filters: dict[str, str] | None = None, manifest: dict | None = None) -> DataFrame:
        """Live chunks; filters on publication_name and edition_date keep other partitions from being read."""
        manifest = manifest or self.manifest()
        rows, dead = self._read(manifest, "chunks"), self._read(manifest, "dead")
        if rows is None:
            return self.spark.createDataFrame([], SCHEMAS["chunks"])
        rows = rows.filter(matching(filters)) if filters else rows
        return rows if dead is None else rows.join(dead, "no", "left_anti")

    def documents(self) -> DataFrame:
        rows = self._read(self.manifest(), "documents")
        return self.spark.createDataFrame([], SCHEMAS["documents"]) if rows is None else rows

    def terms(self, manifest: dict | None = None) -> DataFrame:
        """(term, nd) of all terms of live chunks."""
        rows = self._read(manifest or self.manifest(), "terms")
        if rows is None:
            return self.spark.createDataFrame([], "term string, nd long")
        return rows.groupBy("term").agg(F.sum("nd").alias("nd")).filter("nd > 0")

    def _of(self, rows: DataFrame, buckets: list[int], terms: list[str]) -> DataFrame:
        """rows of the asked terms: other buckets are not read, and others of the same buckets go."""
        rows = rows.filter(F.col("bucket").isin(buckets))
        if len(terms) <= LISTED:
            return rows.filter(F.expr(f"term IN ({', '.join(map(_quoted, terms))})")) if terms else rows.filter("false")
        return rows.join(F.broadcast(self.spark.createDataFrame([(t,) for t in terms], "term string")), "term", "left_semi")

    # Ingests

    def ingest(self, chunks: DataFrame, files: DataFrame | None = None, replace_editions: bool = False) -> dict:
        """Adds chunks (chunk_id, publication_name, edition_date, section_id, chunk_text[, section_title, page_number]) in
        place of those of the same ids, and registers files (filename, publication_name, edition_date, ingested_at); returns
        the new manifest. Of rows that share an id the one of greatest text stays. Old chunks that the new ones do not name
        stay too, unless replace_editions says that the new ones are all of their editions."""
        old = self.manifest()
        self._sweep([s["name"] for s in old["segments"]])
        name = uuid.uuid4().hex
        try:
            new = self._written(chunks, files, old, f"{self.path}/segments/{name}", name, replace_editions)
            self._audit(new, f"{self.path}/segments/{name}", old)
            self._publish(new)
        except BaseException:
            self._undo(name)
            raise
        return new

    def _undo(self, name: str) -> None:
        self._fs.delete(self._class(f"{self.path}/segments/{name}"), True)

    def _written(self, chunks: DataFrame, files: DataFrame | None, old: dict, at: str, name: str, replace_editions: bool) -> dict:
        for c, kind in _OPTIONAL.items():
            if c not in chunks.columns:
                chunks = chunks.withColumn(c, F.lit(None).cast(kind))
        own = ["publication_name", "edition_date", "section_id", "section_title", "page_number"]
        dl = F.size(T.tokens(F.col("chunk_text"))).cast("long")
        one = stored(chunks.select("chunk_id", "chunk_text", *own).withColumns({"dl": dl, "_at": F.monotonically_increasing_id()}), "arrived")
        rows, arrived = _numbered(_last_of_ids(one), one, old["next_no"])
        rows.select("no", "chunk_id", "section_id", "section_title", F.col("page_number").cast("long").alias("page_number"), "chunk_text", "dl", *EDITION).repartition(*EDITION, F.expr(f"no div {WINDOW * SHARD}")).write.partitionBy(*EDITION).parquet(f"{at}/chunks")
        placed, rows = rows, self.spark.read.schema(SCHEMAS["chunks"]).parquet(f"{at}/chunks")

        gone = self.spark.createDataFrame([], "no long, dl long, chunk_text string")
        if old["n"]:
            # A chunk's id holds its edition, so only chunks of the new ones' editions can be replaced.
            editions = [(r[0], r[1]) for r in rows.select(*EDITION).distinct().limit(LISTED + 1).collect()]
            held = self.chunks(manifest=old)
            if len(editions) <= LISTED:
                where = F.lit(False)
                for p, e in editions:
                    where = where | (F.col("publication_name").eqNullSafe(p) & F.col("edition_date").eqNullSafe(e))
                held = held.filter(where)
            by = list(EDITION) if replace_editions else ["chunk_id"]
            gone = stored(held.join(rows.select(*by).distinct(), by, "left_semi").select("no", "dl", "chunk_text"), "gone")
            gone.select("no").write.parquet(f"{at}/dead")

        added, lost = (x.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first() for x in (rows, gone))
        # So many parts, by bucket and range of numbers, that each can be sorted in memory, however frequent a term is.
        parts = math.ceil(added.words / SORTED) + 1
        span = math.ceil((arrived + 1) / math.ceil(parts / self.buckets))
        moved = placed.select("no", "dl", T.tokens(F.col("chunk_text")).alias("t")).mapInArrow(postings, PACKED).withColumn("bucket", self._bucket(F.col("term")))
        moved = moved.repartition(parts, "bucket", F.expr(f"(no[0] - {old['next_no']}) div {span}"))
        lists = moved.select("bucket", "term", "no", "tf", "dl").mapInArrow(windowed, f"bucket int, {LISTS}").select("window", "term", "hits", "max_tf", "min_dl", "bucket")
        lists.sortWithinPartitions("bucket", "term", "window").write.partitionBy("bucket").parquet(f"{at}/postings")

        lists = self.spark.read.schema(SCHEMAS["postings"]).parquet(f"{at}/postings")
        more = lists.select("bucket", "term", F.size("hits").cast("long").alias("nd"))
        less = gone.select(F.explode(F.array_distinct(T.tokens(F.col("chunk_text")))).alias("term")).select(self._bucket(F.col("term")).alias("bucket"), "term", F.lit(-1).cast("long").alias("nd"))
        terms = more.unionByName(less).groupBy("bucket", "term").agg(F.sum("nd").alias("nd"))
        terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{at}/terms")

        segment = {"name": name, "chunks": added.n, "dead": lost.n, "postings": added.words, "terms": added.words + lost.words, "documents": 0}
        new = old | {"version": old["version"] + 1, "segments": [*old["segments"], segment], "next_no": old["next_no"] + arrived, "n": old["n"] + added.n - lost.n, "words": old["words"] + added.words - lost.words}
        if files is not None:
            counts = rows.groupBy(*EDITION).agg(F.count("*").alias("chunk_count"))
            listed = files.join(counts, list(EDITION), "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0).cast("long")))
            listed = numbered(listed, [F.col("ingested_at"), F.col("filename")], "id", old["last_id"])
            listed.selectExpr("cast(id as long) AS id", "filename", "publication_name", "edition_date", "chunk_count", "cast(ingested_at as string) AS ingested_at").write.parquet(f"{at}/documents")
            segment["documents"] = self.spark.read.schema(SCHEMAS["documents"]).parquet(f"{at}/documents").count()
            new["last_id"] += segment["documents"]
        n = F.lit(new["n"])
        raw = F.log(n - F.col("nd") + 0.5) - F.log(F.col("nd") + 0.5)
        new["mean"] = self.terms(new).agg(F.avg(raw)).first()[0] or 0.0
        return new

    def _audit(self, new: dict, at: str, old: dict) -> None:
        """Refuses a segment whose tables do not agree: postings hold every word of the chunks, and ids are no chunk's twice."""
        segment = new["segments"][-1]
        held = self.spark.read.schema(SCHEMAS["postings"]).parquet(f"{at}/postings") if segment["postings"] else None
        words = held.agg(F.sum(F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["tf"]))).first()[0] if held is not None else 0
        if words != segment["postings"] or new["n"] < 0 or segment["dead"] > old["n"]:
            raise RuntimeError(f"the segment holds {words} of {segment['postings']} words")

    # Search

    def topk(self, queries: DataFrame, k: int, filters: dict[str, str] | None = None, p: Params = DEFAULT) -> DataFrame:
        """(query_id, chunk_id, bm25_score, rank): each query's (query_id, query) k best live chunks, as if all were scored.

        Queries are taken in blocks of about p.max_queries. Chunks that match filters are ranked alone; weights come from
        all chunks. Only buckets of asked terms are read, and their lists move to shards of SHARD windows, whose tasks pass
        on each query's best chunks.
        """
        m = self.manifest()
        blocks = max(1, math.ceil(queries.count() / p.max_queries)) if m["n"] else 0
        names = [f.name for f in queries.schema.fields if f.name == "query_id"]
        out = None
        for i in range(blocks):
            block = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
            one = self._best(m, block, k, filters, p)
            out = one if out is None else out.unionByName(one)
        if out is None:
            return queries.select(*names, F.lit("").alias("chunk_id"), F.lit(0.0).alias("bm25_score"), F.lit(0).cast("long").alias("rank")).limit(0)
        ids = out.join((self.chunks(filters, m) if filters else self._read(m, "chunks")).select("no", "chunk_id"), "no")
        order = Window.partitionBy("query_id").orderBy(F.desc("bm25_score"), "chunk_id")
        return ids.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).select("query_id", "chunk_id", "bm25_score", "rank")

    def _best(self, m: dict, queries: DataFrame, k: int, filters: dict[str, str] | None, p: Params) -> DataFrame:
        """(query_id, no, bm25_score) of each query's k best chunks and of those that score like the last of them."""
        asked = queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf")).withColumn("bucket", self._bucket(F.col("term"))).toArrow()
        terms = pc.unique(asked.column("term").combine_chunks())
        some = pc.unique(asked.column("bucket").combine_chunks()).to_pylist()
        of = lambda rows: self._of(rows, some, terms.to_pylist())
        known = of(self._read(m, "terms")).groupBy("term").agg(F.sum("nd").alias("nd")).filter("nd > 0").toArrow()
        weights = Weights.of(asked, known, m, p)
        lists = of(self._read(m, "postings")).select(F.expr(f"window div {SHARD}").alias("shard"), "term", "hits").mapInArrow(packed, f"shard long, {PACKED}")
        if filters or any(x["dead"] for x in m["segments"]):
            live = self.chunks(filters, m).groupBy(F.expr(f"no div {WINDOW * SHARD}").alias("shard")).agg(F.array_sort(F.collect_list("no")).alias("no"))
            none = F.transform("no", lambda x: F.lit(0).cast("long"))
            lists = lists.unionByName(live.select("shard", F.lit(LIVE).alias("term"), "no", none.alias("tf"), none.alias("dl")))
            weights = replace(weights, some=True)
        share = self.spark.sparkContext.broadcast(weights)
        schema = StructType([queries.schema["query_id"], StructField("no", LongType()), StructField("bm25_score", DoubleType())])
        ids = pa.schema([("query_id", weights.ids.type), ("no", pa.int64()), ("bm25_score", pa.float64())])
        found = lists.repartition("shard").sortWithinPartitions("shard").mapInArrow(lambda batches: best_of(windowed(batches), share.value, k, ids), schema)
        best = F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("bm25_score")))
        return found.withColumn("place", best).filter(F.col("place") <= k).drop("place")


def _last_of_ids(one: DataFrame) -> DataFrame:
    """one (chunk_id, chunk_text, _at, ...), a written table, with the row of greatest text of those of the same id; only texts of repeated ids move."""
    twice = stored(one.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("chunk_id").alias("_id")), "repeated")
    if twice.isEmpty():
        return one
    rows = one.join(twice, F.col("chunk_id").eqNullSafe(F.col("_id")), "left_semi").select("chunk_id", "chunk_text", "_at")
    best = rows.groupBy("chunk_id").agg(F.max(F.struct("chunk_text", "_at")).alias("b")).select("b._at")
    return one.join(stored(rows.select("_at").join(best, "_at", "left_anti"), "replaced"), "_at", "left_anti")


def _numbered(rows: DataFrame, one: DataFrame, after: int) -> tuple[DataFrame, int]:
    """rows with no, counting on from after in the order in which one was written, which holds them; and how many one has."""
    part = F.shiftright("_at", 33)
    counts = {r.p: r.n for r in one.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    bases, total = [], after
    for p in sorted(counts):
        bases.append((p, total + 1))
        total += counts[p]
    base = rows.sparkSession.createDataFrame(bases, "_part long, _base long")
    numbered_ = rows.withColumn("_part", part).join(F.broadcast(base), "_part").withColumn("no", F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return numbered_.drop("_at", "_part", "_base"), total - after


def _listed(offsets: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, pa.int64())) for v in values]


def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (no, dl, t) to a row a term of each batch: numbers of the chunks that hold it, in order, how often, and their lengths."""
    for batch in batches:
        no, dl = batch.column("no").to_numpy(), batch.column("dl").to_numpy()
        order = np.argsort(no, kind="stable")
        terms, term, row, tf = counted(batch.column("t").take(pa.array(order)))
        offsets = np.searchsorted(term, np.arange(len(terms) + 1))
        at = order[row]
        yield pa.RecordBatch.from_arrays([terms, *_listed(offsets, no[at], tf, dl[at])], names=["term", "no", "tf", "dl"])


def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, term, no, tf, dl), numbers in order, to rows (key, window, term, hits, max_tf, min_dl) of the windows that they fill."""
    for batch in batches:
        if not batch.num_rows:
            continue
        own = pc.list_parent_indices(batch.column("no")).to_numpy()
        no, tf, dl = (batch.column(c).flatten().to_numpy() for c in ("no", "tf", "dl"))
        window = no // WINDOW
        new = np.ones(len(no), bool)
        new[1:] = (own[1:] != own[:-1]) | (window[1:] != window[:-1])
        first = np.flatnonzero(new)
        if not len(first):
            continue
        for a in range(0, len(first), 50_000):
            some = first[a : a + 50_000]
            end = first[a + 50_000] if a + 50_000 < len(first) else len(no)
            x = slice(some[0], end)
            hits = pa.StructArray.from_arrays([pa.array(v[x], pa.int64()) for v in (no, tf, dl)], names=["no", "tf", "dl"])
            hits = pa.ListArray.from_arrays(pa.array(np.append(some, end) - some[0], pa.int32()), hits)
            kept = pa.array(own[some])
            most, least = np.maximum.reduceat(tf[x], some - some[0]), np.minimum.reduceat(dl[x], some - some[0])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), pa.array(window[some]), batch.column("term").take(kept), hits, pa.array(most), pa.array(least)], names=[batch.schema.names[0], "window", "term", "hits", "max_tf", "min_dl"])


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, term, hits) to (shard, term, no, tf, dl), one for neighbours of the same shard and term."""
    for batch in batches:
        if not batch.num_rows:
            continue
        shard, hits = batch.column("shard").to_numpy(), batch.column("hits")
        term = batch.column("term").dictionary_encode().indices.to_numpy()
        counts, values = pc.list_value_length(hits).to_numpy(), hits.flatten()
        no = values.field("no").to_numpy()
        ends = np.cumsum(counts)
        falls = np.append(True, no[ends[:-1]] <= no[ends[:-1] - 1])  # numbers stay in order within a row
        new = falls
        new[1:] |= (shard[1:] != shard[:-1]) | (term[1:] != term[:-1])
        first = np.flatnonzero(new)
        offsets = np.append((ends - counts)[first], ends[-1])
        kept = pa.array(first)
        yield pa.RecordBatch.from_arrays([batch.column("shard").take(kept), batch.column("term").take(kept), *_listed(offsets, no, values.field("tf").to_numpy(), values.field("dl").to_numpy())], names=["shard", "term", "no", "tf", "dl"])


@dataclass(frozen=True)
class Weights:
    """What a block of queries asks: terms, and for each, in order, the places in ids of the queries and their weights."""

    ids: pa.Array
    terms: pa.Array
    first: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    k1: float
    b: float
    mean: float
    some: bool = False

    @staticmethod
    def of(asked: pa.Table, known: pa.Table, m: dict, p: Params) -> Weights:
        nd = known.column("nd").to_numpy().astype(np.float64)
        raw = np.log(m["n"] - nd + 0.5) - np.log(nd + 0.5)
        idf = np.where(raw < 0, p.bm25_epsilon * m["mean"], raw)
        terms, ids = known.column("term").combine_chunks(), pc.unique(asked.column("query_id").combine_chunks())
        at = pc.index_in(asked.column("term").combine_chunks(), terms)
        kept = pc.is_valid(at).to_numpy(zero_copy_only=False)
        at = pc.fill_null(at, 0).to_numpy()[kept]
        query = pc.index_in(asked.column("query_id").combine_chunks(), ids).to_numpy()[kept]
        order = np.argsort(at, kind="stable")
        first = np.searchsorted(at[order], np.arange(len(terms) + 1))
        return Weights(ids, terms, first, query[order], (asked.column("qf").to_numpy()[kept] * idf[at])[order], p.bm25_k1, p.bm25_b, m["words"] / m["n"])

    def impact(self, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / self.mean))


def best_of(batches: Iterator[pa.RecordBatch], weights: Weights, k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Each query's k best chunks of the shards that come, which are sorted, and those that score like the last of them.

    A window whose bound, the sum of what its greatest counts and least length give, is below a query's k-th score so far
    is left out for that query.
    """
    n = len(weights.ids)
    least = np.full(n, -np.inf)
    q, no, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for shard, rows in _shards(batches):
        found = _shard_scores(shard, rows, weights, least)
        q, no, score = (np.concatenate(x) for x in zip((q, no, score), found, strict=True))
        order = np.lexsort((-score, q))
        q, no, score = q[order], no[order], score[order]
        first = np.searchsorted(q, np.arange(n))
        last = first + k - 1
        full = (last < len(q)) & (q[np.minimum(last, len(q) - 1)] == np.arange(n)) if len(q) else np.zeros(n, bool)
        least[full] = score[last[full]]
        kept = score >= least[q]
        q, no, score = q[kept], no[kept], score[kept]
    if len(q):
        yield from pa.table([weights.ids.take(pa.array(q)), pa.array(no), pa.array(score)], schema=schema).to_batches(50_000)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                if held and shards[a] != at:
                    yield at, pa.Table.from_batches(held)
                    held = []
                at = int(shards[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield at, pa.Table.from_batches(held)


def _shard_scores(shard: int, rows: pa.Table, w: Weights, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, no, score) of the chunks of one shard that may be among the queries' best."""
    span = WINDOW * SHARD
    rows = rows.combine_chunks()
    column = lambda c: rows.column(c).combine_chunks()
    terms = column("term")
    at = pc.fill_null(pc.index_in(terms, w.terms), -1).to_numpy().astype(np.int64)
    lists = column("hits")
    counts, begins = pc.list_value_length(lists).to_numpy().astype(np.int64), lists.offsets.to_numpy()[:-1].astype(np.int64)
    values = lists.values
    hit = {c: values.field(c).to_numpy() for c in ("no", "tf", "dl")}
    alive = None
    if w.some:
        alive = np.zeros(span, bool)
        own = np.flatnonzero(pc.equal(terms, LIVE).to_numpy(zero_copy_only=False))
        alive[hit["no"][_spread(begins[own], counts[own])] - shard * span] = True
    impact = w.impact(hit["tf"], hit["dl"])
    windows = column("window").to_numpy() - shard * SHARD
    top = w.impact(column("max_tf").to_numpy(), column("min_dl").to_numpy())
    lines = np.flatnonzero(at >= 0)
    asking = w.first[at[lines] + 1] - w.first[at[lines]]
    line, pair = np.repeat(lines, asking), _spread(w.first[at[lines]], asking)
    query, weight = w.query[pair], w.weight[pair]
    bounds = np.bincount(query * SHARD + windows[line], np.maximum(weight * top[line], 0), minlength=len(least) * SHARD)
    may = bounds[query * SHARD + windows[line]] >= least[query] - 1e-6
    line, query, weight = line[may], query[may], weight[may]
    out = []
    step = max(1, CELLS // span)
    for a in range(0, len(least), step):  # blocks of queries, so that their scores fit
        some = (query >= a) & (query < a + step) if len(least) > step else slice(None)
        x, y, z = line[some], query[some] - a, weight[some]
        total = np.zeros(min(step, len(least) - a) * span)
        cuts = np.searchsorted(np.cumsum(counts[x]), np.arange(0, counts[x].sum() + CELLS, CELLS), side="right") if len(x) else [0]
        for i, j in zip(cuts, [*cuts[1:], len(x)], strict=True):
            if i < j:
                n = counts[x[i:j]]
                h = _spread(begins[x[i:j]], n)
                total += np.bincount(np.repeat(y[i:j] * span, n) + hit["no"][h] - shard * span, np.repeat(z[i:j], n) * impact[h], minlength=len(total))
        total = np.round(total, 6).reshape(-1, span)
        good = (total > 0) & (total >= least[a : a + len(total), None])
        if alive is not None:
            good &= alive
        r, c = np.nonzero(good)
        out.append((r + a, c + shard * span, total[r, c]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


PACKED = "term string, no array<long>, tf array<long>, dl array<long>"
LISTS = "window long, term string, hits array<struct<no: long, tf: long, dl: long>>, max_tf long, min_dl long"
SCHEMAS = {
    "chunks": "no long, chunk_id string, section_id string, section_title string, page_number long, chunk_text string, dl long, publication_name string, edition_date string",
    "dead": "no long",
    "postings": "window long, term string, hits array<struct<no: long, tf: long, dl: long>>, max_tf long, min_dl long, bucket int",
    "terms": "term string, nd long, bucket int",
    "documents": "id long, filename string, publication_name string, edition_date string, chunk_count long, ingested_at string",
}
