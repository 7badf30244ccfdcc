"""Operator 7: token ids as flat unsigned integer files with 64-bit document offsets, memory-mapped when read.

A file set is a folder with, for each range of (doc_id, hash of the text), `NNNNN.ids` (little-endian unsigned 16- or 32-bit ids, whichever
holds the vocabulary), `NNNNN.offsets` (n + 1 unsigned 64-bit offsets of documents within the file) and `NNNNN.docs`
(n signed 64-bit doc_ids). Ranges are in ascending order of doc_id, so the place of a file among all ids is the sum of
the lengths before it: a prefix sum over one small row a file. There is a file for about FILE_BYTES of text, more where
the input is too small to keep all cores busy; readers map local files and read ranges of remote ones.

Null or empty texts hold only the end id; very long ones are encoded whole. A null doc_id sorts first and is read back as
null. Rows that share a doc_id each have their own place, ordered by the hash of their text, and may lie in several
files. An empty table makes a file set without documents. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, table
from .files import AtomicFile, local_path, opened

NO_DOC = -(2**63)
CACHED_WORDS = 800_000
#: Of text: what a file is for, and the least that is worth a file.
FILE_BYTES, LEAST_BYTES = 128_000_000, 8_000_000
#: The sha256 of the rules (normaliser and splits, as JSON) under which a text is its words one by one.
WORD_RULES = "030f605e4f340b0458c72cba5c104920ded9b7910a25d9e82c455d4a8374b9a5"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Lines that the vocabulary's rules take apart at spaces, full stops and commas alone.
_PLAIN = re.compile(rf"(?:[{_LETTERS} ]++|[.,](?= |\Z))*+\Z")
_WORD = re.compile("[a-zß-öø-ÿ]+\\Z")
_loaded: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Encodes texts with the tokenizers library, each distinct word once for as long as it is kept.

    Under WORD_RULES white space is dropped and nothing joins across it, so a text's ids are its words' ids in turn. In
    lines of Latin letters, spaces, full stops and commas, each mark that ends a word is a word of its own. Under other
    rules the library encodes whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        text = json.dumps([rules["normalizer"], rules["pre_tokenizer"]], sort_keys=True)
        self.by_words = hashlib.sha256(text.encode()).hexdigest() == WORD_RULES
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.kind = "H" if self.dtype.itemsize == 2 else "I"
        self.known: dict[str, bytes] = {"": b""}
        split = ByteLevel(add_prefix_space=False, use_regex=False)
        self.by_bytes = {c: split.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}

    @classmethod
    def load(cls, path: str) -> "WordEncoder":
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _learn(self, words: set[str]) -> None:
        known, dtype, model, hard, kind = self.known, self.dtype, self.tokenizer.model, [], self.kind
        for w in words:
            if _WORD.match(w):  # lower-case letters only: the library's own merges, without the passes of its normaliser
                known[w] = array(kind, [t.id for t in model.tokenize(w if w.isascii() else w.translate(self.by_bytes))]).tobytes()
            else:
                hard.append(w)
        for w, e in zip(hard, self.tokenizer.encode_batch(hard, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, dtype).tobytes()

    @staticmethod
    def words(text: str | None) -> list[str]:
        out: list[str] = []
        for line in (text or "").split("\n"):
            if _PLAIN.match(line):
                out += line.lower().replace(".", " .").replace(",", " ,").split(" ")
            else:
                out += line.replace("\t", " ").replace("\r", " ").split(" ")
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        if not self.by_words:
            for a in range(0, len(texts), 64):
                out += [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch([t or "" for t in texts[a : a + 64]], add_special_tokens=False)]
            return out
        for a in range(0, len(texts), 64):
            some = [self.words(t) for t in texts[a : a + 64]]
            distinct = set().union(*some)
            if len(self.known) > CACHED_WORDS:
                self.known = {"": b""}
            self._learn({w for w in distinct if w not in self.known})
            out += [b"".join(map(self.known.__getitem__, w)) for w in some]
        return out


@dataclass(frozen=True)
class TokenFiles:
    """A written file set: its folder, the width of an id and a row (part, docs, ids, base) for each file."""

    folder: str
    width: int
    parts: list[tuple[int, int, int, int]]


def _writer(folder: str, tokenizer: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder = TaskContext.get().partitionId(), WordEncoder.load(tokenizer)
        ids, docs = (AtomicFile(f"{folder}/{part:05d}.{x}") for x in ("ids", "docs"))
        lengths, end = array("q"), np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            texts = batch.column("text")
            for a in range(0, batch.num_rows, 256):
                for encoded in encoder.encode(texts.slice(a, 256).to_pylist()):
                    ids.write(encoded + end)
                    lengths.append((len(encoded) + len(end)) // encoder.dtype.itemsize)
            docs.write(pc.fill_null(batch.column("doc_id"), NO_DOC).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        offsets = AtomicFile(f"{folder}/{part:05d}.offsets")
        offsets.write(np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes())
        for f in (ids, docs, offsets):
            f.commit()
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [len(lengths)], "ids": [sum(lengths)], "width": [encoder.dtype.itemsize]})

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, files: int | None = None) -> TokenFiles:
    """Writes the file set; what reaches the driver is one row for each file."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not files:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(1, math.ceil(size / FILE_BYTES), min(2 * docs.sparkSession.sparkContext.defaultParallelism, math.ceil(size / LEAST_BYTES)))
    ordered = rows.withColumn("digest", F.xxhash64("text")).repartitionByRange(files, "doc_id", "digest").sortWithinPartitions("doc_id", "digest", "text")
    rows = sorted(ordered.mapInArrow(_writer(folder, tokenizer, end_id), "part long, docs long, ids long, width long").collect())
    bases = np.concatenate([[0], np.cumsum([r.ids for r in rows])]).tolist()
    return TokenFiles(folder, max([2, *(r.width for r in rows)]), [(r.part, r.docs, r.ids, int(b)) for r, b in zip(rows, bases, strict=False)])


class _Numbers:
    """A file of numbers: mapped where it is on a mount of this machine, else read by ranges."""

    def __init__(self, uri: str, dtype: str, n: int):
        self.dtype, path = np.dtype(dtype), local_path(uri)
        self.all = np.empty(0, dtype) if not n else np.memmap(path, dtype, "r", shape=(n,)) if path else None
        if self.all is None:
            fs, path = opened(uri)
            self.file = fs.open_input_file(path)

    def read(self, a: int, b: int) -> np.ndarray:
        if self.all is not None:
            return self.all[a:b]
        return np.frombuffer(self.file.read_at((b - a) * self.dtype.itemsize, a * self.dtype.itemsize), self.dtype)


def _reader(folder: str, width: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            name, n = f"{folder}/{row['part']:05d}", row["docs"]
            ids, offsets, docs = _Numbers(f"{name}.ids", f"<u{width}", row["ids"]), _Numbers(f"{name}.offsets", "<u8", n + 1), _Numbers(f"{name}.docs", "<i8", n)
            for a in range(0, n, 1000):
                to = min(a + 1000, n)
                cuts = offsets.read(a, to + 1).astype(np.int64)
                some = ids.read(int(cuts[0]), int(cuts[-1]))
                own = [np.asarray(some[x:y]).astype("<u4") for x, y in zip((cuts[:-1] - cuts[0]).tolist(), (cuts[1:] - cuts[0]).tolist(), strict=True)]
                out = {
                    "doc_id": pa.array([None if d == NO_DOC else d for d in docs.read(a, to).tolist()], pa.int64()),
                    "start": pa.array(cuts[:-1] + row["base"]),
                    "n_tokens": pa.array(np.diff(cuts)),
                    "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    return run


def read_token_files(spark: SparkSession, files: TokenFiles, with_ids: bool = False) -> DataFrame:
    """A row a document, (doc_id, start, n_tokens, ids_crc32[, ids]), from the mapped files; a task takes whole files."""
    parts = spark.createDataFrame(files.parts, "part long, docs long, ids long, base long").repartition(max(1, len(files.parts)))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return parts.mapInArrow(_reader(files.folder, files.width, with_ids), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write_token_files(table(spark, sf_dir, "documents"), new_folder(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_token_files(spark, files)
