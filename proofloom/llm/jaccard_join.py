"""Operator 9: exact n-gram Jaccard join by set-relation skipping.

A document's set is its distinct 3-word shingles (64-bit hashes; all its words as one if it has fewer). Two documents
link when 100 * intersection >= 90 * union.

1. Counts. Each task counts its documents' shingles in a fixed table of SKETCH_BITS counters; the tables are summed, and
   their logarithms (one byte a counter) are broadcast. They give all sets one order, rare shingles first.
2. Classes. Documents with the same set are one class, whose answers are computed once.
3. Index. By the prefix filter, sets that link share one of their n - ceil(0.9 n) + 1 first shingles. A list of the
   index holds (set, size, position) of one shingle. Two entries can only link if both
   percent * n <= 100 * n' - (100 + percent) * position' hold, so an entry is a pair of bounds: with a list's lower bounds
   sorted and the greatest upper bounds of its blocks known, a block that no bound reaches is skipped whole, and entries
   without any partner leave the list before a set is read. Lists of more than LONG entries are dealt into parts first.
4. Answers. In each list every set is compared with the entry of least position alone, its hub, the one that can share
   most with the others. A set that links with a hub takes over the hub's answers, for what reaches the one reaches the
   other. Only lists whose sets then lie in different components are looked at again, in groups of bounded size: a set's
   own candidates are those of its hub's that the distance between the two leaves in doubt, and parity sketches, an
   exact lower bound of the symmetric difference, skip most of these. In a large group one pair for any two components is
   verified first; lists that hold a refused set are gone through again for all that is left, so copies cost no more than
   their number and no link is lost.

Exact counts of intersections decide every link. Null and empty texts, and texts without words, have n_shingles 0 and
are their own components. Very long texts are whole sets like others. A null doc_id has its set counted, and takes the
component of documents with the same set, or null; rows that share a doc_id are joined by it. Repeated rows repeat their
result; an empty table gives an empty one; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import group_edges, group_pairs, slices, small_and_large, stored, table, whole_groups
from .graph import components
from .hashing import shingles, word_hashes

SHINGLE, PERCENT = 3, 90
SKETCH_BITS, PIECE_BITS = 22, 16
#: Parts in which a piece's counters are summed first.
SHARES = 64
BATCH_BYTES = 2_000_000
#: Entries of a part of a list, and of a group of an open list; bytes of a sketch that travels with an entry.
LONG, BLOCK, CELLS = 100_000, 8192, 128


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[np.ndarray]:
    words, offsets = word_hashes(batch.column("text"))
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield shingles(words[a:b], n)


def _counted(n: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2**bits, np.uint32)
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                found = [x for x in _sets(batch, n) if len(x)]
                if found:
                    np.add.at(total, (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        part = TaskContext.get().partitionId() % SHARES
        for i, piece in enumerate(total.reshape(-1, 2 ** min(PIECE_BITS, bits))):
            if piece.any():
                yield pa.RecordBatch.from_pydict({"piece": [i], "part": [part], "counts": [zlib.compress(piece.astype(np.uint64).tobytes(), 1)]})

    return run


def _total(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """The sum of counters that come one by one; only the sum is held."""
    total = np.zeros(1, np.uint64)
    for batch in batches:
        for x in batch.column("counts"):
            total = total + np.frombuffer(zlib.decompress(x.as_buffer()), np.uint64)
    return total


def _part_sums(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_pydict({"piece": [key[0].as_py()], "counts": [zlib.compress(_total(batches).tobytes(), 1)]})


def _levels(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    level = np.minimum(255, 4 * np.log2(1.0 + _total(batches))).astype(np.uint8)
    yield pa.RecordBatch.from_pydict({"piece": [key[0].as_py()], "levels": [level.tobytes()]})


def frequency_levels(docs: DataFrame, n: int = SHINGLE, bits: int = SKETCH_BITS) -> np.ndarray:
    """A byte for each counter: four times the binary logarithm of how often its shingles occur, over all documents."""
    pieces = docs.select("text").mapInArrow(_counted(n, bits), "piece long, part long, counts binary")
    # A piece's counters are summed in SHARES parts first, so no task gets those of all tasks before it.
    pieces = pieces.groupBy("piece", "part").applyInArrow(_part_sums, "piece long, counts binary").groupBy("piece").applyInArrow(_levels, "piece long, levels binary")
    out = np.zeros((2 ** max(0, bits - PIECE_BITS), 2 ** min(PIECE_BITS, bits)), np.uint8)
    for r in pieces.collect():  # 2 ** bits bytes in all, whatever the corpus
        out[r.piece] = np.frombuffer(r.levels, np.uint8)
    return out.ravel()


def parity(hashes: np.ndarray) -> bytes:
    """One bit for each of about 4 n cells: whether an odd number of the set's hashes fall into it."""
    bits = 1 << max(10, int(len(hashes) * 2).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def folded(sketch: bytes) -> bytes:
    """The sketch's cells folded onto CELLS bytes, which bound the difference as well, if more loosely."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, CELLS // 8), axis=0).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """No more than the symmetric difference of the two sets."""
    x, y = (np.frombuffer(v, np.uint8) for v in (a, b))
    if len(x) != len(y):  # cells of the larger fold onto those of the smaller
        x, y = sorted((x, y), key=len)
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _indexed(n: int, percent: int, levels) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        shift = np.uint64(64 - int(np.log2(len(level))))
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                rows: dict[str, list] = {"n": [], "print": [], "prefix": [], "sketch": [], "cells": []}
                for s in _sets(batch, n):
                    size = len(s)
                    rows["n"].append(size)
                    rows["print"].append(xxhash.xxh3_128_digest(s.tobytes()))
                    length = size - -(-percent * size // 100) + 1 if size else 0
                    # s is in ascending order, so a stable sort by frequency alone has one order for all sets.
                    rows["prefix"].append(s[np.argsort(level[(s >> shift).astype(np.int64)], kind="stable")[:length]].view(np.int64))
                    rows["sketch"].append(parity(s))
                    rows["cells"].append(folded(rows["sketch"][-1]))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n": pa.array(rows["n"], pa.int64()), "print": pa.array(rows["print"], pa.binary()), "prefix": pa.array(rows["prefix"], pa.list_(pa.int64())), **{c: pa.array(rows[c], pa.binary()) for c in ("sketch", "cells")}})

    return run


def _bounds(n: np.ndarray, pos: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The bounds of entries: a and b may link by their sizes and positions if low[a] <= high[b] and low[b] <= high[a]."""
    return percent * n, 100 * n - (100 + percent) * pos


def _with_partner(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which entries of one list may link with any other: blocks of ascending low are skipped by their greatest high."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], high[order]
    best, second = np.empty_like(high), np.empty_like(high)  # of all entries up to each, the greatest and the next
    best[:] = np.maximum.accumulate(high)
    own = np.append(True, high[1:] > best[:-1])
    second[:] = np.maximum.accumulate(np.where(own, np.append(np.iinfo(np.int64).min, best[:-1]), high))
    reach = np.searchsorted(low, high, side="right") - 1  # the last entry whose low is within high
    inside = reach >= np.arange(len(low))  # then the entry itself is among those that it reaches
    top = np.where(inside & (high == best[reach]), second[reach], best[reach])
    found = np.zeros(len(low), bool)
    found[order] = (reach >= 0) & (top >= low)
    return found


def _listed(percent: int):
    """Of entries (token, part, parts, rep, n, pos), which come list by list in order of pos, n, rep, those with a partner, and their list's hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, ("token", "part"), 50_000, 8_000_000):
            c = {k: whole.column(k).to_numpy() for k in whole.schema.names}
            begins = group_edges(c["token"], c["part"])
            counts = np.diff(np.append(begins, len(whole)))
            low, high = _bounds(c["n"], c["pos"], percent)
            keep = c["parts"] > 1  # the others of such a list are in other parts
            for i, j in small_and_large(begins, counts, rows=20_000):
                if counts[i] > 64:
                    at = slice(begins[i], begins[i] + counts[i])
                    keep[at] |= _with_partner(low[at], high[at])
                else:
                    a, b = group_pairs(begins[i:j], counts[i:j])
                    ok = (low[a] <= high[b]) & (low[b] <= high[a])
                    keep[a[ok]] = keep[b[ok]] = True
            at = np.flatnonzero(keep)
            first = group_edges(c["token"][at], c["part"][at])
            hub = np.repeat(at[first], np.diff(np.append(first, len(at))))
            yield pa.RecordBatch.from_pydict({k: pa.array(c[k][at]) for k in ("token", "parts", "rep", "n", "pos")} | {f"hub_{k}": pa.array(c[k][hub]) for k in ("rep", "n", "pos")})

    return run


LISTED = "token long, parts int, rep long, n long, pos int, hub_rep long, hub_n long, hub_pos int"


def _doubtful(percent: int, forest: bool):
    """(a, b) of the pairs within groups of open lists that are in different components and that nothing rules out.

    With forest, a pair counts as joined once it is given, so that two components give one pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, ("part", "token"), 4 * BLOCK, 4_000_000):
            rep, n, pos, hub, apart, component = (whole.column(k).to_numpy() for k in ("rep", "n", "pos", "hub", "apart", "component"))
            begins = group_edges(whole.column("part").to_numpy(), whole.column("token").to_numpy())
            counts = np.diff(np.append(begins, len(whole)))
            cells = np.frombuffer(b"".join(whole.column("cells").to_pylist()), np.uint64).reshape(len(whole), -1)
            low, high = _bounds(n, pos, percent)

            def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                return np.bitwise_count(cells[a] ^ cells[b]).sum(axis=1).astype(np.int64)  # noqa: B023

            def most(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                return (100 - percent) * (n[a] + n[b]) // (100 + percent)  # noqa: B023

            left, right = [], []
            for i, j in small_and_large(begins, counts):
                if counts[i] <= 64:
                    a, b = group_pairs(begins[i:j], counts[i:j])
                    ok = (component[a] != component[b]) & (low[a] <= high[b]) & (low[b] <= high[a])
                    a, b = a[ok], b[ok]
                    ok = least(a, b) <= most(a, b)
                    left.append(a[ok])
                    right.append(b[ok])
                    continue
                every = np.arange(begins[i], begins[i] + counts[i])
                label, place = component.copy(), {int(rep[x]): x for x in every.tolist()}
                answers: dict[int, np.ndarray] = {}  # of each hub, how far it is from every entry at least
                for x in every.tolist():
                    b = every[every > x]
                    b = b[(label[b] != label[x]) & (low[x] <= high[b]) & (low[b] <= high[x])]
                    h = place.get(int(hub[x]))
                    if h is not None and len(b):
                        if h not in answers and len(answers) < 200:
                            answers[h] = least(np.full(len(every), h), every)
                        if h in answers:
                            b = b[answers[h][b - every[0]] - apart[x] <= most(np.full(len(b), x), b)]
                    b = b[least(np.full(len(b), x), b) <= most(np.full(len(b), x), b)]
                    if forest:  # the first of each component, which is then x's own
                        _, at = np.unique(label[b], return_index=True)
                        b = b[np.sort(at)]
                        label[every[np.isin(label[every], label[b])]] = label[x]
                    left.append(np.full(len(b), x))
                    right.append(b)
            a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(rep[a], rep[b])), "b": pa.array(np.maximum(rep[a], rep[b]))})

    return run


def _checked(pairs: DataFrame, sets: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) of set ids that link, and how far `apart` they are: by their sketches first, then by their whole sets."""
    cells = lambda side: sets.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {k: b.column(k).to_pylist() for k in b.schema.names}
            ok = [(100 + percent) * least_difference(x, y) <= (100 - percent) * (i + j) for x, y, i, j in zip(c["s_a"], c["s_b"], c["n_a"], c["n_b"], strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = stored(pairs.join(cells("a"), "a").join(cells("b"), "b").mapInArrow(sketched, "a long, b long"), "pairs")
    texts = docs.filter("doc_id IS NOT NULL").join(left.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text", F.length("text").alias("size"))
    # Rows that share a doc_id: the set that has the id is told by its print below.
    prints = sets.select(F.col("rep").alias("doc_id"), "print")
    texts = stored(texts.join(prints, "doc_id"), "texts")
    side = lambda k: texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"t_{k}"), F.col("print").alias(f"p_{k}"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "t_b", BATCH_BYTES):
                keep, apart = [], []
                both = (_sets(pa.RecordBatch.from_arrays([b.column(t)], names=["text"]), n) for t in ("t_a", "t_b"))
                for p_a, p_b, x, y in zip(b.column("p_a").to_pylist(), b.column("p_b").to_pylist(), *both, strict=True):
                    own = xxhash.xxh3_128_digest(x.tobytes()) == p_a and xxhash.xxh3_128_digest(y.tobytes()) == p_b
                    common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                    keep.append(own and 100 * common >= percent * (len(x) + len(y) - common))
                    apart.append(len(x) + len(y) - 2 * common)
                found = pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(apart, pa.int64())], names=["a", "b", "apart"])
                yield found.filter(pa.array(keep, pa.bool_()))

    return left.join(side("a"), "a").join(side("b"), "b").mapInArrow(exact, "a long, b long, apart long")


def _open_pairs(lists: DataFrame, found: DataFrame, hubs: DataFrame, sets: DataFrame, percent: int, forest: bool, block: int) -> DataFrame:
    """Pairs that are left in lists whose sets lie in different components (node, component).

    The sets of a list outside its greatest component are dealt into blocks, and these meet each other and the blocks of
    the greatest component, so a group holds at most two blocks.
    """
    placed = lists.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("token", "rep", "n", "pos", F.coalesce("component", "rep").alias("component"))
    placed = stored(placed, "placed")
    each = placed.groupBy("token", "component").agg(F.count("*").alias("k"))
    mixed_lists = each.groupBy("token").agg(F.max_by("component", "k").alias("main"), F.max("k").alias("in_main"), F.sum("k").alias("k"), F.count("*").alias("components")).filter("components > 1")
    ceil = lambda x: F.ceil(x / block).cast("int")
    dealt = placed.join(mixed_lists.select("token", "main", ceil(F.col("in_main")).alias("mains"), ceil(F.col("k") - F.col("in_main")).alias("others"), (F.col("k") <= block).alias("whole")), "token")
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("component") == F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    group = lambda kind, i, j: F.xxhash64("token", F.lit(kind), i, j)
    to_others = F.sequence(F.lit(0), F.col("others") - 1)
    groups = (
        F.when(F.col("whole"), F.array(group(0, F.lit(0), F.lit(0))))
        .when(F.col("component") == F.col("main"), F.transform(to_others, lambda j: group(1, F.col("own"), j)))
        .otherwise(F.concat(F.transform(to_others, lambda j: group(2, F.least("own", j), F.greatest("own", j))), F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda i: group(1, i, F.col("own")))))
    )
    dealt = dealt.withColumn("own", own).withColumn("part", F.explode(groups)).select("part", "token", "rep", "n", "pos", "component")
    dealt = dealt.join(sets.select("rep", "cells"), "rep").join(hubs, "rep", "left").withColumns({"hub": F.coalesce("hub", "rep"), "apart": F.coalesce("apart", F.lit(0).cast("long"))})
    ordered = dealt.repartition("part").sortWithinPartitions("part", "token", "pos")
    return ordered.mapInArrow(_doubtful(percent, forest), "a long, b long").distinct()


def linked(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, bits: int = SKETCH_BITS, long: int = LONG, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs, n, bits))
    rows = stored(docs.mapInArrow(_indexed(n, percent, levels), "doc_id long, n long, print binary, prefix array<long>, sketch binary, cells binary"), "sets")
    some = rows.filter("n > 0 AND doc_id IS NOT NULL")
    # A class is the rows of one set; its id is the least doc_id. An id may name several sets where rows share it.
    sets = stored(some.groupBy("print", "n").agg(F.min("doc_id").alias("rep"), *(F.min_by(c, "doc_id").alias(c) for c in ("prefix", "sketch", "cells"))), "classes")
    entries = sets.select("rep", "n", F.posexplode("prefix").alias("pos", "token"))
    heavy = stored(entries.groupBy("token").count().filter(F.col("count") > long).select("token", F.ceil(F.col("count") / long).cast("int").alias("parts")), "long-lists")
    entries = entries.join(heavy, "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    ordered = entries.select("token", "part", "parts", "rep", "n", "pos").repartition("token", "part").sortWithinPartitions("token", "part", "pos", "n", "rep")
    lists = stored(ordered.mapInArrow(_listed(percent), LISTED), "lists")

    hub, own = F.struct("hub_pos", "hub_n", "hub_rep"), F.struct(F.col("pos").alias("hub_pos"), F.col("n").alias("hub_n"), F.col("rep").alias("hub_rep"))
    parted = lists.filter("parts > 1").groupBy("token").agg(F.min(hub).alias("top"), F.collect_set(hub).alias("hubs"))  # one hub a part of a long list
    stars = lists.select(hub.alias("a"), own.alias("b")).union(parted.select("top", F.explode("hubs")))
    low, high = (lambda x: percent * F.col(f"{x}.hub_n")), (lambda x: 100 * F.col(f"{x}.hub_n") - (100 + percent) * F.col(f"{x}.hub_pos"))
    stars = stars.filter("a.hub_rep <> b.hub_rep").filter((low("a") <= high("b")) & (low("b") <= high("a")))
    often = stars.groupBy(F.col("a.hub_rep").alias("a"), F.col("b.hub_rep").alias("b")).count()
    best = often.groupBy("b").agg(F.max_by("a", F.struct("count", -F.col("a"))).alias("a"))
    first = stored(best.select("a", "b"), "first")
    links = stored(_checked(first, sets, docs, n, percent), "links")
    # A document stands for its class; rows that share a doc_id stand for one node.
    same = some.join(sets.select("print", "rep"), "print").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).filter("u <> v")
    hubs = links.select(F.col("b").alias("rep"), F.col("a").alias("hub"), "apart")
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    found = stored(components(edges), "components")
    given = stored(_open_pairs(lists, found, hubs, sets, percent, True, block), "open-pairs")
    if not given.isEmpty():
        more = stored(_checked(given, sets, docs, n, percent).select("a", "b"), "links")
        edges = edges.union(more.toDF("u", "v"))
        refused = given.join(more, ["a", "b"], "left_anti").select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        again = lists.join(lists.join(refused, "rep", "left_semi").select("token").distinct(), "token", "left_semi")
        left = _open_pairs(stored(again, "lists"), stored(components(edges), "components"), hubs, sets, percent, False, block)
        left = stored(left.join(given, ["a", "b"], "left_anti"), "open-pairs")
        if not left.isEmpty():
            edges = stored(edges.union(_checked(left, sets, docs, n, percent).select("a", "b")), "links")
    member = stored(components(edges.union(same)), "components")
    own = sets.select("print", F.col("rep").alias("class"))
    out = rows.select("doc_id", "n", "print").join(own, "print", "left").withColumn("node", F.when(F.col("n") > 0, F.coalesce("doc_id", "class")).otherwise(F.col("doc_id")))
    out = out.join(member, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))
