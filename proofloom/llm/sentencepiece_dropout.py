"""Operator 1: SentencePiece encoding with seeded merge-dropout, and decoding.

A text is a space mark and its characters, with spaces as space marks. Where no piece of the vocabulary has two
characters of the classes that meet, a text falls into units that are encoded apart. In a unit the agenda takes the
adjacent pair of best score, the leftmost of equals; a pair is skipped, for good, if the keyed hash of the seed, the
doc_id, the unit, its place in the document and the pair's three bounds falls below the dropout rate, so every
occurrence of a unit is cut by itself. Equal units of a batch share the work only where no pair that comes up without
dropout is skipped; the others advance together in numpy, one merge each a round; long units have a heap.

Characters without a piece become byte pieces, and so does a space mark that the text itself holds; decoding therefore
gives back every text exactly. With a rate of 0 the ids are those of the library. Null texts have null ids and stay null;
empty ones have no ids; very long ones are one text. A null doc_id has a key as well. Repeated rows repeat their result;
an empty table gives an empty one. Extra columns are kept, but for `ids` and `n_tokens`, which are replaced.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import slices, table

MARK = "▁"
RATE, SEED = 0.1, 20240
HEAP_FROM = 48
BATCH_BYTES = 500_000
#: Stands for a space mark of the text itself until it becomes bytes; not a character, so no valid text holds it.
_OWN_MARK = "\udcff"
_loaded: dict[tuple, "Pieces"] = {}
_U, _M = np.uint64, 2**64 - 1


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _mixed(h: int) -> int:
    """mixed() of one number."""
    h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD & _M
    h = (h ^ h >> 33) * 0xC4CEB9FE1A85EC53 & _M
    return h ^ h >> 33


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Pieces:
    """The vocabulary as arrays: pairs of pieces that merge, sorted, with the merged piece and its rank."""

    def __init__(self, path: str, rate: float, seed: int):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.rate, self.seed = rate, seed
        self.limit = min(int(rate * 2.0**64), 2**64 - 1)
        n = model.get_piece_size()
        self.surface = [b"" if model.is_control(i) or model.is_unknown(i) else bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in range(n))]
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.ids = {model.id_to_piece(i): i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        order = sorted(self.ids.values(), key=lambda i: (-model.get_score(i), i))
        rank = {i: r for r, i in enumerate(order)}
        pairs = sorted((self.ids[p[:k]] << 32 | self.ids[p[k:]], i, rank[i]) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        self.key, self.merged, self.rank = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.pair = {k: (i, r) for k, i, r in pairs}
        self.first = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.first[ord(p)] = i
        bits = max(4, int(np.ceil(np.log2(len(pairs) * 8))))
        self.shift, self.slots = _U(64 - bits), np.full(2**bits, -1, np.int32)
        todo, at = np.arange(len(pairs)), self._slot(self.key)
        while len(todo):  # open addressing: of the pairs that meet at a free slot one stays, the others go on
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            left = self.slots[at] != todo
            todo, at = todo[left], (at[left] + 1) & (len(self.slots) - 1)
        self.kind, self.meet = self._classes()

    def _classes(self) -> tuple[np.ndarray, np.ndarray]:
        """The class of each character, and whether a piece has characters of two classes side by side."""
        kind = np.zeros(0x110000, np.uint8)
        kind[:128] = np.arange(1, 129)
        for letters in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"):
            kind[[ord(c) for c in letters]] = ord(letters[0]) + 1
        kind[ord(MARK)] = 129
        meet = np.zeros((130, 130), bool)
        for p in self.ids:
            k = kind[_code_points(p)]
            meet[k[:-1], k[1:]] = True
        return kind, meet

    @classmethod
    def load(cls, path: str, rate: float = RATE, seed: int = SEED) -> "Pieces":
        if (path, rate, seed) not in _loaded:
            _loaded[path, rate, seed] = cls(path, rate, seed)
        return _loaded[path, rate, seed]

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return (pair.astype(_U) * _U(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _found(self, pair: np.ndarray) -> np.ndarray:
        """The index of each pair that merges, or -1."""
        out, todo, at = np.full(len(pair), -1, np.int64), np.arange(len(pair)), self._slot(pair)
        while len(todo):
            here = self.slots[at]
            same = (here >= 0) & (self.key[here] == pair[todo])
            out[todo[same]] = here[same]
            on = (here >= 0) & ~same
            todo, at = todo[on], (at[on] + 1) & (len(self.slots) - 1)
        return out

    def _unit_keys(self, occurrences: np.ndarray, chars: np.ndarray, place: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The keyed hash of each unit: of the key of its occurrence and of its characters with their places."""
        own = np.add.reduceat(mixed(chars.astype(_U) << _U(32) ^ place.astype(_U)), begins)
        return mixed(own ^ mixed(occurrences.astype(_U) + _U(self.seed * 0x9E3779B97F4A7C15 % 2**64)))

    def _skipped(self, key: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed(key ^ self._bounds(start, mid, end)) < _U(self.limit)

    def _bounds(self, start: np.ndarray, mid: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed(start.astype(_U) * _U(0x9E3779B97F4A7C15) + mid.astype(_U) * _U(0xC2B2AE3D27D4EB4F) + end.astype(_U) * _U(0x165667B19E3779F9))

    def _out(self, unit: str, ids: list[int], starts: list[int], ends: list[int]) -> list[int]:
        out: list[int] = []
        for i, a, b in zip(ids, starts, ends, strict=True):
            out += [i] if i >= 0 else [self.bytes[x] for x in unit[a:b].replace(_OWN_MARK, MARK).encode()]
        return out

    def by_heap(self, occurrence: int, unit: str) -> list[int]:
        """The same by a heap; what each symbol and its right neighbour may become is kept, and replaced when either grows."""
        n = len(unit)
        chars = _code_points(unit)
        key = self._unit_keys(np.array([occurrence]), chars, np.arange(n), np.array([0]))
        first = self.first[chars].astype(np.int64)
        ids, end, left, right = first.tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        a = np.flatnonzero((first[:-1] >= 0) & (first[1:] >= 0))
        at = self._found(first[a] << 32 | first[a + 1])
        a, at = a[at >= 0], at[at >= 0]
        ok = ~self._skipped(key, a, a + 1, a + 2)
        rank, merged = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        rank[a[ok]], merged[a[ok]] = self.rank[at[ok]], self.merged[at[ok]]
        agenda = (self.rank[at[ok]] << 32 | a[ok]).tolist()
        heapq.heapify(agenda)
        rank, merged, own = rank.tolist(), merged.tolist(), int(key[0])
        pair, limit, push, pop = self.pair, self.limit, heapq.heappush, heapq.heappop

        def propose(a: int, b: int) -> None:
            found = pair.get(ids[a] << 32 | ids[b]) if ids[a] >= 0 and ids[b] >= 0 else None
            if found and _mixed(own ^ _mixed(a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + end[b] * 0x165667B19E3779F9 & _M)) >= limit:
                merged[a], rank[a] = found
                push(agenda, found[1] << 32 | a)
            else:
                rank[a] = -1

        while agenda:
            x = pop(agenda)
            a = x & 0xFFFFFFFF
            if rank[a] != x >> 32:  # it has grown, gone, or got another neighbour
                continue
            b = right[a]
            ids[a], end[a], right[a], rank[b] = merged[a], end[b], right[b], -1
            rank[a] = -1
            if right[a] < n:
                left[right[a]] = a
                propose(a, right[a])
            ids[b] = -2
            if left[a] >= 0:
                propose(left[a], a)
        at = [i for i in range(n) if ids[i] != -2]
        return self._out(unit, [ids[i] for i in at], at, [end[i] for i in at])

    def _rounds(self, chars: np.ndarray, sizes: np.ndarray, keys: np.ndarray | None, seen: list[np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
        """(owner, start, end, id) of every symbol that is left in units given by their characters; id -1 has no piece.

        Without keys nothing is skipped. The pairs that come up are added to seen: owner, start, mid and end, 6 bits each
        but the first.
        """
        n = len(sizes)
        ids = self.first[chars].astype(np.int64)
        owner = np.repeat(np.arange(n), sizes)
        start = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        end = start + 1
        done: list[tuple[np.ndarray, ...]] = []
        while len(ids):
            a = np.flatnonzero(owner[:-1] == owner[1:])
            a = a[(ids[a] >= 0) & (ids[a + 1] >= 0)]
            at = self._found(ids[a] << 32 | ids[a + 1])
            a, at = a[at >= 0], at[at >= 0]
            if seen is not None:
                seen.append(owner[a] << 18 | start[a] << 12 | start[a + 1] << 6 | end[a + 1])
            if keys is not None:
                ok = ~self._skipped(keys[owner[a]], start[a], start[a + 1], end[a + 1])
                a, at = a[ok], at[ok]
            if len(a):  # of each unit's pairs the one of least rank, the leftmost of equals
                first = np.flatnonzero(np.concatenate([[True], owner[a[1:]] != owner[a[:-1]]]))
                best = np.minimum.reduceat(self.rank[at] << 32 | np.arange(len(a)), first) & 0xFFFFFFFF
                a, at = a[best], at[best]
            active = np.zeros(n, bool)
            active[owner[a]] = True
            ids[a], end[a] = self.merged[at], end[a + 1]
            keep = np.ones(len(ids), bool)
            keep[a + 1] = False
            going = active[owner]
            done.append(tuple(x[keep & ~going] for x in (owner, start, end, ids)))
            ids, owner, start, end = (x[keep & going] for x in (ids, owner, start, end))
        owner, start, end, ids = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.empty(0, np.int64),) * 4
        order = np.argsort(owner << 32 | start)
        return owner[order], start[order], end[order], ids[order]

    def _distinct(self, chars: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct unit one that is it, and which of them each unit is."""
        place = np.arange(len(chars)) - np.repeat(begins, sizes)
        _, rep, which = np.unique(np.add.reduceat(mixed(chars.astype(_U) << _U(32) ^ place.astype(_U)), begins), return_index=True, return_inverse=True)
        twin = rep[which]
        if (sizes[twin] == sizes).all() and (chars[np.repeat(begins[twin] - begins, sizes) + np.arange(len(chars))] == chars).all():
            return rep, which
        return np.arange(len(sizes)), np.arange(len(sizes))  # two different units share a hash: take each by itself

    def _any_skipped(self, keys: np.ndarray, which: np.ndarray, seen: list[np.ndarray]) -> np.ndarray:
        """Whether a unit of these keys skips any of the pairs seen in the distinct unit that it is."""
        pairs = np.sort(np.concatenate(seen)) if seen else np.empty(0, np.int64)
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
        first = np.searchsorted(pairs, np.arange(which.max(initial=-1) + 2) << 18)
        bounds = self._bounds(pairs >> 12 & 63, pairs >> 6 & 63, pairs & 63)
        counts = np.diff(first)[which]
        own = np.repeat(np.arange(len(which)), counts)
        at = np.arange(len(own)) + np.repeat(first[which] - (np.cumsum(counts) - counts), counts)
        out = np.zeros(len(which), bool)
        out[own[mixed(keys[own] ^ bounds[at]) < _U(self.limit)]] = True
        return out

    def encode(self, texts: list[str | None], doc_keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and the offsets of each text's ids."""
        marked = [MARK + (t.replace(MARK, _OWN_MARK) if MARK in t else t).replace(" ", MARK) if t else "" for t in texts]
        lengths = np.array([len(t) for t in marked], np.int64)
        whole = "".join(marked)
        if not whole:
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        chars = _code_points(whole)
        kind = self.kind[chars]
        cut = np.ones(len(chars), bool)
        cut[1:] = ~self.meet[kind[:-1], kind[1:]]
        doc_begins = np.cumsum(lengths) - lengths
        cut[doc_begins[lengths > 0]] = True
        begins = np.flatnonzero(cut)
        sizes = np.diff(np.append(begins, len(chars)))
        owner = np.searchsorted(np.cumsum(lengths), begins, side="right")
        occurrences = mixed(np.array(doc_keys, _U)[owner] ^ mixed((begins - doc_begins[owner]).astype(_U)))
        keys = self._unit_keys(occurrences, chars, np.arange(len(chars)) - np.repeat(begins, sizes), begins)
        taken = lambda units: np.repeat(begins[units] - (np.cumsum(sizes[units]) - sizes[units]), sizes[units]) + np.arange(sizes[units].sum())
        rep, which = self._distinct(chars, begins, sizes)
        shared = np.flatnonzero(sizes[rep] <= HEAP_FROM)
        seen: list[np.ndarray] = []
        plain = self._rounds(chars[taken(rep[shared])], sizes[rep[shared]], None, seen)
        # What is encoded: distinct units without dropout, short units that skip a pair, and long units.
        short, long = np.flatnonzero(sizes <= HEAP_FROM), np.flatnonzero(sizes > HEAP_FROM)
        own = short[self._any_skipped(keys[short], np.searchsorted(shared, which[short]), seen)]
        dropped = self._rounds(chars[taken(own)], sizes[own], keys[own])
        n_shared, n_short = len(rep), len(rep) + len(own)
        which = which.copy()
        which[own], which[long] = n_shared + np.arange(len(own)), n_short + np.arange(len(long))
        rep = np.concatenate([rep, own, long])
        n, rep_sizes, rep_begins = len(rep), sizes[rep], begins[rep]
        unit = np.concatenate([shared[plain[0]], n_shared + dropped[0]])
        start, end, ids = (np.concatenate(x) for x in zip(plain[1:], dropped[1:], strict=True))
        counts = np.zeros(n, np.int64)
        counts += np.bincount(unit, minlength=n)
        odd: dict[int, list[int]] = {}
        for i in np.unique(unit[ids < 0]).tolist():
            a, b = np.searchsorted(unit, [i, i + 1])
            odd[i] = self._out(whole[rep_begins[i] : rep_begins[i] + rep_sizes[i]], ids[a:b].tolist(), start[a:b].tolist(), end[a:b].tolist())
        for u in range(n_short, n):
            odd[u] = self.by_heap(int(occurrences[rep[u]]), whole[rep_begins[u] : rep_begins[u] + rep_sizes[u]])
        simple = ~np.isin(unit, list(odd)) if odd else np.ones(len(unit), bool)
        for u, own in odd.items():
            counts[u] = len(own)
        rep_offsets = np.cumsum(counts) - counts
        flat = np.empty(counts.sum(), np.int32)
        is_odd = np.zeros(n, bool)
        is_odd[list(odd)] = True
        flat[np.repeat(~is_odd, counts)] = ids[simple]
        for u, own in odd.items():
            flat[rep_offsets[u] : rep_offsets[u] + len(own)] = own
        own_counts = counts[which]
        out_begins = np.cumsum(own_counts) - own_counts
        out = flat[np.repeat(rep_offsets[which] - out_begins, own_counts) + np.arange(own_counts.sum())]
        return out, np.concatenate([[0], np.cumsum(np.bincount(owner, own_counts, len(texts)))]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join([self.surface[i] for i in ids.tolist()]).decode()[1:] if len(ids) else ""


def doc_key(doc_id: int | None, seed: int = SEED) -> int:
    return xxhash.xxh64_intdigest(str(doc_id).encode(), seed)


def encode(docs: DataFrame, model: str, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """docs with `ids` (array of int) and `n_tokens`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(model, rate, seed)
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                keys = [doc_key(d, seed) for d in batch.column("doc_id").to_pylist()]
                values, offsets = pieces.encode(batch.column("text").to_pylist(), keys)
                null = batch.column("text").is_null()
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values), mask=null)
                counts = pa.array(np.diff(offsets), mask=null.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*batch.columns, ids, counts], names=[*batch.schema.names, "ids", "n_tokens"])

    kept = docs.drop("ids", "n_tokens")
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType())]))


def decode(encoded: DataFrame, model: str, name: str = "decoded") -> DataFrame:
    """encoded, which has `ids`, with the text that they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(model)
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                texts = [None if not x.is_valid else pieces.decode(x.values.to_numpy(zero_copy_only=False)) for x in batch.column("ids")]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(name, StringType())]))


def digested(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, lossless): the ids' crc32 as little-endian unsigned 32-bit integers, and whether they decode to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(model)
        for b in batches:
            ids = [x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in b.column("ids")]
            crc = [None if x is None else zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            same = [t.as_py() == (None if x is None else pieces.decode(x)) for x, t in zip(ids, b.column("text"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids_crc32", "lossless"])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, lossless boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return digested(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model), model)
