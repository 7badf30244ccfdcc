"""Operator 2: fuzzy line dedup by MinHash.

1. Signatures. A line, stripped of white space and with A-Z lower-cased, has the set of its runs of SHINGLE characters
   (all of it if it is shorter). One hash a shingle is dealt into BANDS x ROWS bins, each keeping its least value; empty
   bins borrow from the next one that is filled. The rows of a band make one key. With 12 bands of 5 rows, lines of
   Jaccard 0.8 share a key with probability 0.99.
2. Lists. Keys move packed, many in a row, and are sorted as arrays where they meet; what a key has alone stays there. The
   lines of a key form a list; of lists with the same lines one is kept. A list travels as its lines' hashes,
   set sizes and parity sketches; a list of more than BLOCK lines is dealt into blocks, and each pair of blocks is a
   group of its own. Within a group, sizes and sketches rule pairs out as whole arrays, in memory of a bounded size; of
   those left a forest, nearest first, is given, since a pair between lines that are already connected says nothing new.
3. Verification. The exact Jaccard of the shingle sets decides each pair given. Lists that hold a refused pair are gone
   through again for all pairs that lie in different components, so no pair of a list is left out, and only pairs that
   sketches cannot tell from links become rows. The lines of lists are fetched once, with their sketches, by a Bloom filter
   of at most BLOOM_BYTES; the more lines there are, the more others pass it, which costs and changes nothing. Of them only
   those of pairs move again, to be verified.
4. Components, by distributed union-find; of each the first occurrence stays, by doc_id, then place in the text.

Equal lines (as normalised) are one line from the start. Lines of white space are neither counted nor removed. Null texts
stay null; empty ones stay. Very long lines are whole shingle sets like others; very long texts are read by lines. Rows
that repeat (doc_id and text) count as one document and keep the same lines; a null doc_id comes before all others. An
empty table gives an empty one. Extra columns are kept, whatever their names, but for n_lines and n_kept, which are
replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import group_edges, group_pairs, slices, small_and_large, stored, table, whole_groups
from .graph import components
from .hashing import mixed, power

SHINGLE, BANDS, ROWS, SIMILARITY, SEED = 5, 12, 5, 0.8, 11
#: Bytes of texts at a time: as rows come and go, and what hashing and sorting keep near the processor.
BATCH_BYTES, HASH_BYTES, SORT_BYTES = 1_000_000, 250_000, 50_000
#: How many (band, line) a task packs at a time.
PACKED = 1_000_000
BLOOM_BYTES, BLOOM_BITS = 64_000_000, 12
BLOCK = 8192
SKETCH_BITS = 1024
#: White space as Unicode has it, and Java's (?U)\s with it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_U = np.uint64


def normalised(line: str) -> bytes:
    return line.strip(WHITE).encode().lower()  # of bytes, this lowers A-Z alone


def line_hash(line: bytes) -> int:
    """Of a normalised line, signed."""
    h = xxhash.xxh3_64_intdigest(line)
    return h - (1 << 64) if h >> 63 else h


def shingle_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of every line's shingles in turn, and the line that each belongs to."""
    texts = [x.decode() for x in lines]
    padded = [x if len(x) >= SHINGLE else x + "\0" * (SHINGLE - len(x)) for x in texts]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    chars = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32)
    sums = np.zeros(len(chars) + 1, _U)
    np.cumsum((chars.astype(_U) + _U(SEED)) * power("up", len(chars)), out=sums[1:])
    within = np.ones(max(0, len(chars) - SHINGLE + 1), bool)  # at the last SHINGLE - 1 places of a line none begins
    within[(np.cumsum(sizes)[:-1, None] - np.arange(1, SHINGLE)).ravel()] = False
    hashes = (sums[SHINGLE:] - sums[:-SHINGLE]) * power("down", len(chars))[: len(within)]
    return mixed(hashes[within]), np.repeat(np.arange(len(lines)), sizes - SHINGLE + 1)


def band_keys(lines: list[bytes]) -> np.ndarray:
    """The BANDS keys of each line, as signed integers."""
    k = BANDS * ROWS
    hashes, own = shingle_hashes(lines)
    empty = np.uint32(2**32 - 1)
    bins = np.full(len(lines) * k, empty, np.uint32)
    at = own * k + ((hashes >> _U(32)) * _U(k) >> _U(32)).astype(np.int64)
    np.minimum.at(bins, at, (hashes & _U(0xFFFFFFFE)).astype(np.uint32))
    bins = bins.reshape(-1, k).astype(_U)
    some = np.flatnonzero((bins == empty).any(axis=1))  # an empty bin borrows from the next filled one, with its distance
    twice = np.where(bins[some] == empty, 2 * k, np.arange(k))
    twice = np.concatenate([twice, np.minimum(twice + k, 2 * k)], axis=1)
    source = np.minimum.accumulate(twice[:, ::-1], axis=1)[:, ::-1][:, :k]
    bins[some] = np.take_along_axis(bins[some], source % k, axis=1) + (source - np.arange(k)).astype(_U) * _U(0x9E3779B900000000)
    keys = np.zeros((len(lines), BANDS), _U)
    for r in range(ROWS):
        keys = mixed(keys * _U(0x9E3779B97F4A7C15) + bins.reshape(len(lines), BANDS, ROWS)[:, :, r])
    return mixed(keys + np.arange(BANDS, dtype=_U)).view(np.int64)


def _lines(text: str | None) -> Iterator[tuple[int, bytes]]:
    for i, line in enumerate((text or "").split("\n")):
        if own := normalised(line):
            yield i, own


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The normalised lines of a column of texts, but for those of white space: each one's row, place in its text, and bytes."""
    lists = pc.split_pattern(texts.fill_null(""), "\n")
    lines = pc.ascii_lower(pc.utf8_trim(lists.flatten(), WHITE))
    sizes = lists.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    solid = pc.greater(pc.binary_length(lines), 0)
    at = solid.to_numpy(zero_copy_only=False)
    return row[at], place[at], lines.filter(solid).cast(pa.binary()).to_pylist()


def _hashed(lines: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, lines), _U, len(lines)).view(np.int64)


def _occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", BATCH_BYTES):
            row, place, lines = _split(batch.column("text"))
            own = [batch.column(c).take(pa.array(row)) for c in ("doc_id", "digest")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(place.astype(np.int32)), pa.array(_hashed(lines))], names=["doc_id", "digest", "place", "line"])


def _packed(parts: int):
    """(part, entries) of texts: the (band, line) of their lines, of each part many in one row."""

    def rows(bands: np.ndarray, lines: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(bands), PACKED):
            entries = np.stack([bands[i : i + PACKED], lines[i : i + PACKED]], axis=1)
            part = ((entries[:, 0].view(_U) >> _U(32)) * _U(parts) >> _U(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            begins = group_edges(part[order])
            offsets = np.append(begins, len(order)).astype(np.int32) * np.int32(entries.itemsize * 2)
            packed = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(entries[order])])
            yield pa.RecordBatch.from_arrays([pa.array(part[order][begins]), packed], names=["part", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        keys, own, held = [], [], 0
        for whole in batches:
            for batch in slices(whole, "text", HASH_BYTES):
                lines = _known(done, batch)
                if not lines:
                    continue
                done.update(lines)
                keys.append(band_keys(list(lines.values())).ravel())
                own.append(np.repeat(np.fromiter(lines, np.int64, len(lines)), BANDS))
                held += len(own[-1])
                if held >= PACKED:
                    yield from rows(np.concatenate(keys), np.concatenate(own))
                    keys, own, held = [], [], 0
        if held:
            yield from rows(np.concatenate(keys), np.concatenate(own))

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, line), each once, of the bands of two lines and more, from rows (part, entries) that come part by part."""
    for whole in whole_groups(batches, ("part",), 4 * BLOCK, 16_000_000):
        entries = np.frombuffer(b"".join(whole.column("entries").to_pylist()), np.int64).reshape(-1, 2)
        order = np.argsort(entries[:, 0])
        entries = entries[order[_several(entries[order, 0])]]
        entries = entries[np.lexsort((entries[:, 1], entries[:, 0]))]
        entries = entries[group_edges(entries[:, 0], entries[:, 1])]  # each once, and so some bands have one line now
        entries = entries[_several(entries[:, 0])]
        yield pa.RecordBatch.from_arrays([pa.array(entries[:, 0]), pa.array(entries[:, 1])], names=["band", "line"])


def _several(keys: np.ndarray) -> np.ndarray:
    """The places of those of the sorted keys that are there more than once."""
    counts = np.diff(np.append(group_edges(keys), len(keys)))
    return np.flatnonzero(np.repeat(counts > 1, counts))


def _bloom_places(h: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    a = mixed(h.view(_U))
    b = mixed(a ^ _U(0x5851F42D4C957F2D)) | _U(1)
    return (a[None, :] + np.arange(hashes, dtype=_U)[:, None] * b[None, :]) % _U(bits)


def _known(done: set[int], batch: pa.RecordBatch) -> dict[int, bytes]:
    """The distinct lines of a batch by hash, but for those that this task has dealt with; forgetting some only repeats their rows."""
    lines = _split(batch.column("text"))[2]
    lines = {h: line for h, line in zip(_hashed(lines).tolist(), lines, strict=True) if h not in done}
    if len(done) > 300_000:
        done.clear()
    return lines


def _of_lines(docs: DataFrame, wanted: DataFrame, limit: int) -> DataFrame:
    """(line, n, cells, words) for the lines in wanted, and perhaps some others: each once."""
    n = wanted.count()
    size = max(64, min(limit, math.ceil(n * BLOOM_BITS / 8)))
    hashes = max(1, min(5, round(size * 8 / max(1, n) * math.log(2))))

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.uint8)
        for b in batches:
            at = _bloom_places(b.column("line").to_numpy(), size * 8, hashes).ravel()
            np.bitwise_or.at(bits, (at >> _U(3)).astype(np.int64), np.uint8(1) << (at & _U(7)).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"bits": [bits.tobytes()]})

    bits = np.zeros(size, np.uint8)
    parts = max(1, min(16, n // 200_000))
    for r in wanted.coalesce(parts).mapInArrow(built, "bits binary").toLocalIterator():  # at most 16 of BLOOM_BYTES, one at a time
        bits |= np.frombuffer(r.bits, np.uint8)
    share = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                lines = _known(done, batch)
                hashed = np.fromiter(lines, np.int64, len(lines))
                if len(hashed):
                    at = _bloom_places(hashed, size * 8, hashes)
                    hashed = hashed[((share.value[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1).all(axis=0)]
                if not len(hashed):
                    continue
                done.update(hashed.tolist())
                some = [lines[h] for h in hashed.tolist()]
                keys, starts = shingle_sets(some)
                cells = pa.array([x.tobytes() for x in parity_sketches(keys, starts)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(hashed), pa.array(np.diff(starts)), cells, pa.array(some, pa.binary())], names=["line", "n", "cells", "words"])

    found = docs.select("text").mapInArrow(run, "line long, n long, cells binary, words binary")
    return found.repartition("line").dropDuplicates(["line"])  # moved first, as few repeat within a task and a sort of texts costs more


def shingle_sets(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each line in turn, ascending within it, and the n + 1 offsets of lines in them."""
    keys, counts, at = [], [], 0
    while at < len(lines):
        to, size = at, 0
        while to < len(lines) and to - at < 1000 and (to == at or size + len(lines[to]) < SORT_BYTES):
            size += len(lines[to])
            to += 1
        hashes, own = shingle_hashes(lines[at:to])
        key = np.sort(own.astype(_U) << _U(54) | hashes >> _U(10))
        key = key[np.append(True, key[1:] != key[:-1])]
        counts.append(np.bincount((key >> _U(54)).astype(np.int64), minlength=to - at))
        keys.append(key & _U(2**54 - 1))
        at = to
    return np.concatenate(keys), np.concatenate([[0], *counts]).cumsum()


def parity_sketches(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each set, as 64-bit words, which cells an odd count of its hashes falls into."""
    out = np.zeros((len(starts) - 1, SKETCH_BITS // 64), _U)
    for at in range(0, len(out), 1000):
        some = starts[at : at + 1001]
        own = np.repeat(np.arange(len(some) - 1), np.diff(some))
        cells = own * SKETCH_BITS + (keys[some[0] : some[-1]] % _U(SKETCH_BITS)).astype(np.int64)
        odd = np.bincount(cells, minlength=(len(some) - 1) * SKETCH_BITS).astype(np.uint8) & 1
        out[at : at + 1000] = np.packbits(odd.reshape(-1, SKETCH_BITS), axis=1).view(_U)
    return out


def _fitting(n: np.ndarray, cells: np.ndarray, folded: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs (a, b) sizes and sketches do not rule out, and how far apart the sketches of these are."""
    most = ((1 - SIMILARITY) / (1 + SIMILARITY) * (n[a] + n[b]) + 1e-6).astype(np.int64)  # sets of SIMILARITY differ in no more
    ok = np.flatnonzero(np.abs(n[a] - n[b]) <= most)
    ok = ok[np.bitwise_count(folded[a[ok]] ^ folded[b[ok]]).sum(axis=1) <= most[ok]]
    apart = np.bitwise_count(cells[a[ok]] ^ cells[b[ok]]).sum(axis=1)
    return ok[apart <= most[ok]], apart[apart <= most[ok]]


class _Rows:
    """The lines of whole groups as sizes and sketches, and which of them are taken as connected."""

    def __init__(self, n: np.ndarray, cells: np.ndarray):
        self.n, self.cells = n, cells
        self.folded = np.bitwise_xor.reduce(cells.reshape(len(n), -1, 2), axis=1)
        self.parent = list(range(len(n)))

    def fitting(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The places of the pairs that sizes and sketches do not rule out, those of nearest sketches first."""
        ok, apart = _fitting(self.n, self.cells, self.folded, a, b)
        return ok[np.argsort(apart, kind="stable")]

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def joined(self, a: int, b: int) -> bool:
        """Whether a and b, so far apart, are now taken as connected."""
        x, y = self.root(a), self.root(b)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def _large_group(rows: _Rows, begin: int, end: int, block: np.ndarray, component: np.ndarray, forest: bool) -> Iterator[tuple[int, int]]:
    """Pairs of one group, a line against all others of allowed size at a time; of two blocks, only pairs between them."""
    order = begin + np.argsort(rows.n[begin:end], kind="stable")
    n, block, label = rows.n[order], block[order], component[order]
    two = block.min() != block.max()
    for i, to in enumerate(np.searchsorted(n, np.floor(n / SIMILARITY + 1e-9), side="right").tolist()):
        b = np.arange(i + 1, to)
        b = b[(label[b] != label[i]) & ((block[b] != block[i]) | (not two))]
        b = b[rows.fitting(np.full(len(b), order[i]), order[b])]
        while len(b):
            j, b = int(b[0]), b[1:]
            yield int(order[i]), int(order[j])
            if forest:
                label[label == label[j]] = label[i]
                b = b[label[b] != label[i]]


def _pairs(forest: bool):
    """(a, b) of lines in different components within each group of rows (part, band, block, component, line, n, cells), which come group by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, ("part", "band"), 4 * BLOCK, 8_000_000):
            part, band, block, component, line, n = (whole.column(c).to_numpy() for c in ("part", "band", "block", "component", "line", "n"))
            rows = _Rows(n, np.frombuffer(b"".join(whole.column("cells").to_pylist()), _U).reshape(len(whole), -1))
            begins = group_edges(part, band)
            counts = np.diff(np.append(begins, len(part)))
            found: list[tuple[int, int]] = []
            for i, j in small_and_large(begins, counts):
                if counts[i] > 64:
                    found += _large_group(rows, begins[i], begins[i] + counts[i], block, component, forest)
                    continue
                a, b = group_pairs(begins[i:j], counts[i:j])
                apart = component[a] != component[b]
                a, b = a[apart], b[apart]
                ok = rows.fitting(a, b)
                found += [(x, y) for x, y in zip(a[ok].tolist(), b[ok].tolist(), strict=True) if not forest or rows.joined(x, y)]
            u, v = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(line[u], line[v])), pa.array(np.minimum(line[u], line[v]))], names=["a", "b"])

    return run


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose shingle sets agree by SIMILARITY."""
    for whole in batches:
        for b in slices(whole, "w_b", BATCH_BYTES):
            left, right = b.column("w_a").to_pylist(), b.column("w_b").to_pylist()
            place = {x: i for i, x in enumerate({*left, *right})}
            keys, starts = shingle_sets(list(place))
            own = lambda x: keys[starts[place[x]] : starts[place[x] + 1]]  # noqa: B023, E731
            keep = []
            for x, y in zip(left, right, strict=True):
                both = np.sort(np.concatenate([own(x), own(y)]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(common >= SIMILARITY * (len(both) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def similar_lines(docs: DataFrame, bloom_limit: int = BLOOM_BYTES) -> DataFrame:
    """(node, component) of line hashes: lines that are alike, directly or through others."""
    parts = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = docs.select("text").mapInArrow(_packed(parts), "part int, entries binary")
    return similar_in_lists(packed.repartition("part").sortWithinPartitions("part").mapInArrow(_shared, "band long, line long"), docs, bloom_limit)


def similar_in_lists(bands: DataFrame, docs: DataFrame, bloom_limit: int = BLOOM_BYTES, block: int = BLOCK) -> DataFrame:
    """(node, component) of the lines of docs that lists (band, line), each row once, bring together and that are alike."""
    bands = stored(bands, "band-lists")
    # Lines that are alike share most of their lists: of the lists with the same lines one is enough.
    same = [F.min("line").alias("head"), F.count("*").alias("n"), *(F.bit_xor(F.xxhash64("line", F.lit(i))).alias(f"x{i}") for i in (0, 1))]
    kept = bands.groupBy("band").agg(*same).filter("n > 1").groupBy("head", "n", "x0", "x1").agg(F.min("band").alias("band"))
    lists = bands.join(kept.select("band", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "band")
    lists = stored(lists.withColumn("block", F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int")), "lists")
    sketches = stored(_of_lines(docs, lists.select("line").distinct(), bloom_limit), "sketches")

    def pairs(some: DataFrame, forest: bool) -> DataFrame:
        dealt = some.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        part = F.xxhash64("band", F.least("block", "other"), F.greatest("block", "other"))
        rows = dealt.select(part.alias("part"), "band", "block", "component", "line").join(sketches.drop("words"), "line")
        return rows.repartition("part").sortWithinPartitions("part", "band").mapInArrow(_pairs(forest), "a long, b long").distinct()

    def verified(some: DataFrame) -> DataFrame:
        lines = some.select(F.explode(F.array("a", "b")).alias("line")).distinct()
        words = stored(sketches.select("line", "words").join(lines, "line", "left_semi"), "lines")
        side = lambda k: words.select(F.col("line").alias(k), F.col("words").alias(f"w_{k}"))
        return stored(some.join(side("a"), "a").join(side("b"), "b").mapInArrow(_similar, "a long, b long"), "line-links").toDF("u", "v")

    given = stored(pairs(lists.withColumn("component", F.col("line")), True), "line-pairs")
    links = verified(given)
    found = components(links)
    refused = stored(given.join(links.toDF("a", "b"), ["a", "b"], "left_anti"), "refused")
    if refused.isEmpty():
        return found
    found = stored(found, "line-components")
    again = lists.join(lists.join(refused.select(F.col("a").alias("line")).distinct(), "line", "left_semi").select("band").distinct(), "band", "left_semi")
    again = again.join(found.withColumnRenamed("node", "line"), "line", "left").withColumn("component", F.coalesce("component", "line"))
    left = stored(pairs(again, False).join(given, ["a", "b"], "left_anti"), "line-pairs")
    return found if left.isEmpty() else components(verified(left).union(found))


def deduplicated(docs: DataFrame, bloom_limit: int = BLOOM_BYTES) -> DataFrame:
    """docs with texts that keep one line of each component, and n_lines and n_kept, the non-empty lines before and after."""
    # A document travels as one column, so its own columns never clash with those of the search.
    own = docs.drop("n_lines", "n_kept")
    keyed = own.select(F.struct("*").alias("own"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"))
    found = stored(keyed.select("doc_id", "digest", "own.text").mapInArrow(_occurring, "doc_id long, digest long, place int, line long"), "occurrences")
    alike = stored(similar_lines(docs, bloom_limit), "alike")
    each = found.groupBy("line").agg(F.count("*").alias("k")).join(alike.withColumnRenamed("node", "line"), "line", "left")
    each = stored(each.filter("k > 1 OR component IS NOT NULL").select("line", F.coalesce("component", "line").alias("component")), "repeated")
    place = F.struct("doc_id", "place", "digest").alias("place")
    places = stored(found.join(each, "line").select("component", place), "places")
    firsts = places.groupBy("component").agg(F.min("place").alias("first"), F.count("*").alias("k")).filter("k > 1")
    firsts = stored(firsts.select("component", "first"), "firsts")  # so that the join can split a large component
    repeats = places.join(firsts, "component").filter("NOT first <=> place").select("place.*")
    gone = repeats.groupBy("doc_id", "digest").agg(F.collect_set("place").alias("gone"))
    return _rewritten(keyed, gone, own.columns)


def _rewritten(keyed: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest"), "gone")
    joined = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("digest") == F.col("gone_digest")), "left")
    joined = joined.withColumn("all", F.split("own.text", "\n", -1)).withColumn("gone", F.coalesce("gone", F.expr("cast(array() as array<int>)")))
    left = F.expr("array_join(transform(array_except(sequence(0, size(all) - 1), gone), i -> all[i]), '\n')")
    n = F.coalesce(F.expr("cast(size(filter(all, x -> x rlike '(?U)\\\\S')) as bigint)"), F.lit(0))
    text = F.when(F.size("gone") > 0, left).otherwise(F.col("own.text"))
    return joined.select(*(text.alias(c) if c == "text" else F.col("own").getField(c).alias(c) for c in columns), n.alias("n_lines"), (n - F.size("gone")).alias("n_kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
