"""Operator 3: secret scans by grammar inference.

Base patterns find assigned values, access ids and long hexadecimal runs, as the contract states them. What they find in
all documents are labelled credentials, of whose distinct strings a bounded sample by hash is kept, whole. All other words
of all documents, numbers, dates and identifiers too, are the background. For each kind with any labelled string, the
prefix tree of its strings, over character classes, is reduced by merging states whose outgoing frequencies agree within
the Hoeffding bound (ALERGIA), in red-blue order; how long its strings are is counted beside it, long ones in bins whose
width grows with the length.

All candidates are then scored whole: the value of every base span, and every token of LEAST or more characters, or what
base spans leave over of it. A score is the best automaton's log-likelihood a character, less that under the background's
class bigrams. Base spans stay whatever they score; other candidates above MARGIN become spans of kind `format`. `scores`
holds every candidate above MARGIN as kind:start:end:score, base ones with their values' bounds.

Null and empty texts give no spans; very long texts and tokens are scanned and scored whole. Rows are independent, so
repeated rows repeat their result, and null doc_ids are kept. Few labelled strings make a vague automaton, smoothed like
any other; without any, nothing is scored and no span is added. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices, stored, table

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "format")
#: Bounds of the training sample: strings of a kind, and their characters; the string that passes the latter is the last.
SAMPLE_STRINGS, SAMPLE_CHARS = 300, 200_000
#: Lengths below are bins of their own; above, a bin is an eighth of an octave.
EXACT, BINS = 64, 128
LEAST_WORD = 8  # characters of a word that is background
BATCH_BYTES = 2_000_000
LEAST = 20  # characters of a token that is scored
ALPHA, MARGIN, PRIOR = 0.05, 0.5, 0.1
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LONG = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{20,}")
_CUES = ("passw", "secret", "token", "apikey", "api_key")
#: Classes: digits, letters that hexadecimal has and others, of either case; each of the marks is its own class.
_CLASSES = str.maketrans({**dict.fromkeys("ABCDEF", "H"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "A"), **dict.fromkeys("abcdef", "h"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "a"), **dict.fromkeys("0123456789", "0")})
END, OTHER = "$", "?"
PAIR_SYMBOLS = END + OTHER + "HAha0+/_.=-"  # of the background's pairs; all characters outside the classes are one
SYMBOLS = len(PAIR_SYMBOLS) - 1  # what may come next in a string: a class or its end


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the contract's patterns, by start, then kind."""
    out: list[tuple[int, int, int]] = []
    lower = text.lower()
    if any(c in lower for c in _CUES):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    for run in _LONG.finditer(text):  # a run of 24 hexadecimal digits lies within one such token
        out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text, run.start(), run.end())]
    return [(a, b, BASE[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2]))]


def value_bounds(text: str, start: int, end: int, kind: str) -> tuple[int, int]:
    """Where the credential itself is within a base span."""
    return _ASSIGN.match(text, start, end).span(2) if kind == "assign" else (start, end)


def length_bin(n: int) -> tuple[int, float]:
    """The bin of a length, and about how many lengths are in it."""
    if n < EXACT:
        return n, 1.0
    eighth = int(8 * math.log2(n / EXACT))
    return EXACT + eighth, EXACT * (2 ** ((eighth + 1) / 8) - 2 ** (eighth / 8))


class Automaton:
    """A probabilistic finite automaton over character classes, with the counts it was inferred from."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        for s in strings:
            at = 0
            for c in s.translate(_CLASSES):
                self.count[at][c] += 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                at = self.next[at][c]
            self.count[at][END] += 1
        self.lengths = Counter(length_bin(len(s))[0] for s in strings)
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer()

    def _differ(self, a: int, b: int) -> bool:
        ca, cb = self.count[a], self.count[b]
        na, nb = sum(ca.values()), sum(cb.values())
        if not na or not nb:
            return False
        most = self.bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
        return any(abs(ca[c] / na - cb[c] / nb) > most for c in ca.keys() | cb.keys())

    def _compatible(self, red: int, blue: int) -> bool:
        """Whether the two, and what follows each by the same classes, agree; what follows blue is still a tree."""
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            if self._differ(a, b):
                return False
            todo += [(self.next[a][c], n) for c, n in self.next[b].items() if c in self.next[a]]
        return True

    def _fold(self, red: int, blue: int) -> None:
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            self.count[a].update(self.count[b])
            for c, n in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], n))
                else:
                    self.next[a][c] = n

    def _infer(self) -> None:
        red, seen = [0], {0}
        while True:
            blue = next(((q, c, n) for q in red for c, n in sorted(self.next[q].items()) if n not in seen), None)
            if blue is None:
                break
            q, c, n = blue
            into = next((r for r in red if self._compatible(r, n)), None)
            if into is None:
                red.append(n)
                seen.add(n)
            else:
                self.next[q][c] = into
                self._fold(into, n)
        names = {q: i for i, q in enumerate(red)}
        self.next = [{c: names[n] for c, n in self.next[q].items()} for q in red]
        self.count = [self.count[q] for q in red]
        n = [sum(k for c, k in counts.items() if c != END) + PRIOR * (SYMBOLS - 1) for counts in self.count]
        self.log = [{c: math.log((k + PRIOR) / total) for c, k in counts.items() if c != END} for counts, total in zip(self.count, n, strict=True)]
        self.rest = [math.log(PRIOR / total) for total in n]

    def score(self, classes: str) -> float:
        """Mean log-likelihood of a string of classes and of its length; where a class leads nowhere, the start goes on."""
        own, width = length_bin(len(classes))
        at, total = 0, math.log((self.lengths[own] + PRIOR) / (sum(self.lengths.values()) + PRIOR * BINS) / width)
        for c in classes:
            total += self.log[at].get(c, self.rest[at])
            at = self.next[at].get(c, 0)
        return total / (len(classes) + 1)


class Formats:
    """Automata by kind and the background's class bigrams."""

    def __init__(self, labelled: dict[str, list[str]], background: Counter):
        self.automata = {k: Automaton(sorted(v)) for k, v in sorted(labelled.items()) if v}
        totals: Counter = Counter()
        for (a, _), n in background.items():
            totals[a] += n
        self.log = {pair: math.log((n + 1) / (totals[pair[0]] + SYMBOLS)) for pair, n in background.items()}
        self.totals = totals

    def likelihood(self, token: str) -> float:
        """The best automaton's mean log-likelihood less the background's."""
        classes = token.translate(_CLASSES)
        around = END + classes + END
        ground = sum(self.log.get((a, b), -math.log(self.totals[a] + SYMBOLS)) for a, b in zip(around[:-1], around[1:], strict=True)) / (len(classes) + 1)
        return max((a.score(classes) for a in self.automata.values()), default=-math.inf) - ground


@functools.cache
def _symbols() -> np.ndarray:
    """The place in PAIR_SYMBOLS of each character, white space as the end."""
    symbol = np.full(0x110000, PAIR_SYMBOLS.index(OTHER), np.uint8)
    for c in map(chr, range(128)):
        if (known := c.translate(_CLASSES)) in PAIR_SYMBOLS[2:]:
            symbol[ord(c)] = PAIR_SYMBOLS.index(known)
    symbol[[c for c in range(0x110000) if chr(c).isspace()]] = 0
    return symbol


def unlabelled(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a space in place of each base span; spans are by start."""
    out, at = [], 0
    for a, b, _ in spans:
        out.append(text[at : max(a, at)])
        at = max(at, b)
    return " ".join([*out, text[at:]])


def background(texts: list[str]) -> np.ndarray:
    """How often each pair of PAIR_SYMBOLS occurs in the words of LEAST_WORD or more characters, with their ends."""
    chars = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le"), np.uint32)
    kinds = _symbols()[chars].astype(np.int64)
    edges = np.flatnonzero(np.diff(kinds == 0)) + 1  # white space comes first and last, so these are starts and ends in turn
    starts, ends = edges[::2], edges[1::2]
    kept = ends - starts >= LEAST_WORD
    inside = np.zeros(len(chars) + 1, np.int64)
    inside[starts[kept]] += 1
    inside[ends[kept] + 1] -= 1
    at = np.flatnonzero(np.cumsum(inside[:-1]))
    return np.bincount(kinds[at - 1] * len(PAIR_SYMBOLS) + kinds[at], minlength=len(PAIR_SYMBOLS) ** 2)


def _sampled(strings: set[tuple[int, str]]) -> list[tuple[int, str]]:
    """Those of least hash within the sample's bounds."""
    out, chars = [], 0
    for h, value in heapq.nsmallest(SAMPLE_STRINGS, strings):
        if chars >= SAMPLE_CHARS:
            break
        out.append((h, value))
        chars += len(value)
    return out


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's pair counts, and its distinct labelled strings of each kind that may be in the sample."""
    pairs = np.zeros(len(PAIR_SYMBOLS) ** 2, np.int64)
    strings: dict[str, set[tuple[int, str]]] = {k: set() for k in BASE}
    for whole in batches:
        for batch in slices(whole, "text", BATCH_BYTES):
            rest = []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text or "")
                for a, b, kind in spans:
                    x, y = value_bounds(text, a, b, kind)
                    strings[kind].add((xxhash.xxh64_intdigest(text[x:y].encode()) >> 1, text[x:y]))
                rest.append(unlabelled(text, spans) if spans else text or "")
            pairs += background(rest)
            strings = {kind: set(_sampled(own)) for kind, own in strings.items()}
    rows = [{"kind": kind, "value": value, "n": h} for kind, own in strings.items() for h, value in own]
    n = len(PAIR_SYMBOLS)
    rows += [{"kind": "", "value": PAIR_SYMBOLS[i // n] + PAIR_SYMBOLS[i % n], "n": int(pairs[i])} for i in np.flatnonzero(pairs).tolist()]
    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("kind", pa.string()), ("value", pa.string()), ("n", pa.int64())]))


def learn(docs: DataFrame) -> Formats:
    """Fits on all documents: on the sums of their pairs, and on a sample of each kind's distinct labelled strings by hash."""
    found = stored(docs.select("text").mapInArrow(_labelled, "kind string, value string, n long"), "labelled")
    least = Window.partitionBy("kind").orderBy("n", "value")
    strings = found.filter("kind <> ''").distinct().withColumn("k", F.row_number().over(least)).filter(F.col("k") <= SAMPLE_STRINGS)
    before = F.coalesce(F.sum(F.length("value")).over(least.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    strings = strings.withColumn("before", before).filter(F.col("before") < SAMPLE_CHARS).select("kind", "value", "n")
    sums = found.filter("kind = ''").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    rows = strings.union(sums).collect()  # a kind's sample and PAIR_SYMBOLS squared
    pairs = {(r.value[0], r.value[1]): r.n for r in rows if not r.kind}
    strings = {kind: [r.value for r in rows if r.kind == kind] for kind in BASE}
    return Formats(strings, Counter(pairs))


def _left_over(start: int, end: int, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """The parts of a token, of LEAST characters or more, that no base span covers; spans are by start."""
    for a, b, _ in spans:
        if a < end and start < b:
            if a - start >= LEAST:
                yield start, a
            start = b
    if end - start >= LEAST:
        yield start, end


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all that is scored, by start, then kind: values of base spans, and tokens or what is left of them."""
    out = [(*value_bounds(text, *span), span[2]) for span in base]
    for m in _LONG.finditer(text):
        out += [(a, b, "format") for a, b in _left_over(m.start(), m.end(), base)]
    return sorted(out, key=_order)


def _order(span: tuple) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


def find(text: str, formats: Formats, margin: float = MARGIN) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, float]], int]:
    """Base spans and format spans by start, then kind; the candidates above the margin with their scores; how many were scored."""
    base = base_spans(text)
    scored = [(a, b, kind, formats.likelihood(text[a:b])) for a, b, kind in candidates(text, base)] if formats.automata else []
    likely = [x for x in scored if x[3] > margin]
    return sorted([*base, *(x[:3] for x in likely if x[2] == "format")], key=_order), likely, len(scored)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_format", pa.int64()), ("n_scored", pa.int64()), ("scores", pa.string())])


def scan(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format, n_scored, scores) for each row of docs (doc_id, text)."""
    formats = formats or learn(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    spans, likely, n = find(text or "", formats)
                    counts = Counter(s[2] for s in spans)
                    base = joined([s for s in spans if s[2] in BASE])
                    scores = ",".join(f"{kind}:{a}:{b}:{score:.3f}" for a, b, kind, score in likely)
                    rows.append({"doc_id": doc_id, **{f"n_{k}": counts[k] for k in BASE}, "base_sha256": hashlib.sha256(base.encode()).hexdigest(), "spans": joined(spans), "n_format": counts["format"], "n_scored": n, "scores": scores})
                yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long, n_scored long, scores string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
