"""Operator 11: phrase collocations per language.

Texts, A-Z lower-cased, are cut into pieces at marks and line ends, and those into words. Every run of 1 to max_n words is
a row with its language and count; rows are summed per language. Candidates are phrases of two words and more that occur
least_count times. A cut splits a candidate in two parts, whose counts are joined to it; the cut of lowest score counts,
where a score is twice the candidate's count by those of its parts, in millionths, as an exact quotient of decimals.
Candidates that nearly always go on to the same longer one are dropped by an anti-join with the one-word extensions: what
holds for any longer candidate holds for one of those, as it occurs at least as often. A window ranks the rest.

A phrase occurs no more often than its parts, so a run of words with a part below least_count is left out before its row
is made. Words are counted first. Then 64-bit hashes of the pairs of frequent words are; a hash counts at least as often
as each of its pairs, so pairs whose hash is rare are rare. Then all longer runs, of frequent pairs alone, become rows with
their texts, and those are what is counted. What is frequent goes to the tasks as a Bloom filter, made by grouping, of
FILTER_BITS at most. It never leaves out a frequent part; as it fills up beyond its bound, more rows are made, and the
results stay the same. A task adds up equal rows, as they come, before they move, so a word that every text has is a row a
task and not one a text.

Very long texts are taken in parts that end at piece ends. Null and empty texts have no words, and rows with a null
language count as `und`. Repeated rows count as often as they come. An empty table gives an empty result. Extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices, stored, table
from .hashing import byte_hashes, mixed, text_bytes

MAX_N, LEAST_COUNT, TOP = 4, 30, 2000
#: A candidate is dropped if a longer one has so many hundredths of its count.
COVERED = 80
UNKNOWN = "und"
#: Bits of a filter at most, and for each phrase in it.
FILTER_BITS, BITS_EACH = 2**27, 16
BATCH_BYTES, HELD_ROWS = 1_000_000, 400_000
#: Parts of a language's candidates that are ranked before they meet.
SHARES = 32
_ENDS = re.compile(r"[.,;:!?\n-\r]")
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_FORM = np.arange(256, dtype=np.uint8)
_FORM[65:91] += 32
_FORM[9] = 32
_U = np.uint64
SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("key", pa.int64()), ("f", pa.int64())])


class Words:
    """The words of texts, all bytes in one array: where each begins and ends, its hash, its text's language, and its piece."""

    def __init__(self, texts: pa.Array, langs: np.ndarray, seeds: np.ndarray):
        """langs: the number of each text's language in seeds. A-Z are lower-cased, and one space stays between words."""
        data, offsets = text_bytes(texts)
        data = _FORM[data]
        space = data == 32
        again = space[1:] & space[:-1]
        if again.any():
            kept = np.concatenate([[True], ~again])
            offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
            data, space = data[kept], space[kept]
        end = _END[data]
        solid = ~(end | space)
        begin, last = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        begin[edges] = solid[edges]
        last[edges - 1] = solid[edges - 1]
        self.data, self.starts, self.ends = data, np.flatnonzero(begin), np.flatnonzero(last) + 1
        counts = np.diff(np.searchsorted(self.starts, offsets))
        row = np.repeat(np.arange(len(counts)), counts)
        self.piece = np.cumsum(end)[self.starts] + row
        self.lang = langs[row]
        self.seed = seeds[self.lang]
        self.hashes = byte_hashes(data, self.starts, self.ends)

    def runs(self, n: int) -> np.ndarray:
        """The first words of all runs of n words within a piece."""
        return np.flatnonzero(self.piece[: len(self.piece) - n + 1] == self.piece[n - 1 :]) if len(self.piece) >= n else np.empty(0, np.int64)

    def keys(self, at: np.ndarray, n: int) -> np.ndarray:
        """64-bit hashes of the runs of n words at these words and their languages."""
        total = self.seed[at] + _U(n)
        for i in range(n):
            total = mixed(total * _U(0x9E3779B97F4A7C15) + self.hashes[at + i])
        return total

    def bytes_of(self, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of these ranges, one after another, and their offsets."""
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        return self.data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])], offsets

    def counted(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first words, hashes, counts) of the distinct runs of n words at these words."""
        keys = self.keys(at, n)
        keys, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        starts, sizes = self.starts[at], self.ends[at + n - 1] - self.starts[at]
        like = first[inverse]
        if not np.array_equal(sizes, sizes[like]) or not np.array_equal(self.lang[at], self.lang[at[like]]) or not np.array_equal(self.bytes_of(starts, sizes)[0], self.bytes_of(starts[like], sizes)[0]):
            # Two runs have one hash: each run is a row of its own, and equal ones are summed later.
            return at, self.keys(at, n), np.ones(len(at), np.int64)
        return at[first], keys, counts

    def texts(self, at: np.ndarray, n: int) -> pa.Array:
        data, offsets = self.bytes_of(self.starts[at], self.ends[at + n - 1] - self.starts[at])
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))


def parted(texts: list[str], langs: list[str], limit: int = BATCH_BYTES) -> Iterator[tuple[pa.Array, list[str]]]:
    """The texts and their languages; long ones in parts of about limit characters that end at piece ends."""
    for text, lang in zip(texts, langs, strict=True):
        at = 0
        while at < len(text):
            m = _ENDS.search(text, at + limit) if len(text) - at > limit else None
            to = m.end() if m else len(text)
            yield text[at:to], lang
            at = to


def words_of(batch: pa.RecordBatch) -> Iterator[tuple[Words, np.ndarray]]:
    """Words of a batch (lang, text), and the names of their languages."""
    for part in slices(batch, "text", BATCH_BYTES):
        texts, langs = part.column("text").fill_null(""), part.column("lang")
        if pc.max(pc.binary_length(texts)).as_py() > 2 * BATCH_BYTES:
            own = list(parted(texts.to_pylist(), langs.to_pylist()))
            groups = [(pa.array([t]), pa.array([x])) for t, x in own]
        else:
            groups = [(texts, langs)]
        for own_texts, own_langs in groups:
            coded = own_langs.dictionary_encode()
            names = coded.dictionary
            seeds = np.array([mixed(byte_hashes(*_whole(x)))[0] for x in names.to_pylist()], _U)
            yield Words(own_texts, coded.indices.to_numpy(zero_copy_only=False), seeds), names


def _whole(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode() + b"\0", np.uint8)
    return data, np.array([0]), np.array([len(data)])


class Filter:
    """A Bloom filter of two bits a key in one array of bits."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, _U(len(words) * 64 - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for bit in (keys & self.mask, (keys >> _U(32)) & self.mask):
            out &= (self.words[bit >> _U(6)] >> (bit & _U(63))) & _U(1) > 0
        return out


def frequent(keys: DataFrame, most_bits: int = FILTER_BITS) -> Filter:
    """A filter of keys (key); its words of 64 bits are made by grouping, and most_bits / 64 of them at most reach the driver."""
    size = min(most_bits, 2 ** max(10, math.ceil(math.log2(max(1, keys.count() * BITS_EACH)))))
    bit = F.explode(F.array(F.col("key").bitwiseAND(size - 1), F.shiftrightunsigned("key", 32).bitwiseAND(size - 1)))
    rows = keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    words = np.zeros(size // 64, _U)
    words[rows.column("place").to_numpy()] = rows.column("bits").to_numpy().view(_U)
    return Filter(words)


def _passing(words: Words, part: int, known: Filter | None) -> np.ndarray:
    """Whether a run of `part` words that is in known begins at each word."""
    ok = np.ones(len(words.starts), bool)
    if known is not None:
        ok[:] = False
        at = words.runs(part)
        ok[at] = known.has(words.keys(at, part))
    return ok


def _runs(words: Words, n: int, part: int, ok: np.ndarray) -> np.ndarray:
    """The first words of the runs of n words all of whose runs of `part` words pass."""
    at = words.runs(n)
    for i in range(n - part + 1 if part else 0):
        at = at[ok[at + i]]
    return at


def grams(docs: DataFrame, sizes: range, part: int = 0, known: Filter | None = None) -> DataFrame:
    """(lang, phrase, key, f): runs of words of these sizes, whose runs of `part` words are all in known, summed by task."""
    share = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for words, names in words_of(batch):
                ok = _passing(words, part, share.value)
                for n in sizes:
                    at = _runs(words, n, part, ok)
                    if len(at):
                        first, keys, counts = words.counted(at, n)
                        held.append(pa.table([names.take(pa.array(words.lang[first])), words.texts(first, n).cast(pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], schema=SCHEMA))
                        rows += len(first)
                if rows > HELD_ROWS:
                    whole = _summed(held)
                    if len(whole) > HELD_ROWS // 2:
                        yield from whole.to_batches(20_000)
                        held, rows = [], 0
                    else:
                        held, rows = [whole], len(whole)
        if held:
            yield from _summed(held).to_batches(20_000)

    return docs.select("lang", "text").mapInArrow(run, "lang string, phrase string, key long, f long")


def _summed(tables: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(tables).group_by(["lang", "phrase", "key"]).aggregate([("f", "sum")])
    return whole.rename_columns({"f_sum": "f"}).select(SCHEMA.names)


def pair_hashes(docs: DataFrame, known: Filter) -> DataFrame:
    """(key, f): hashes of pairs of words that are both in known, summed by task."""
    share = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for words, _ in words_of(batch):
                held.append(words.keys(_runs(words, 2, 1, _passing(words, 1, share.value)), 2))
                n += len(held[-1])
                if n > 2 * HELD_ROWS:
                    yield from _counts(held)
                    held, n = [], 0
        if held:
            yield from _counts(held)

    return docs.select("lang", "text").mapInArrow(run, "key long, f long")


def _counts(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    keys, counts = np.unique(np.concatenate(held), return_counts=True)
    yield from pa.table({"key": pa.array(keys.view(np.int64)), "f": pa.array(counts)}).to_batches(50_000)


def counted(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST_COUNT) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of up to max_n words that occur `least` times, and (lang, n) of all words."""
    enough = F.col("f") >= least
    one = stored(grams(docs, range(1, 2)).groupBy("lang", "phrase", "key").agg(F.sum("f").alias("f")), "words")
    words = one.groupBy("lang").agg(F.sum("f").alias("n"))
    known = stored(one.filter(enough), "frequent")
    out = known.select("lang", "phrase", F.lit(1).alias("size"), "f")
    if max_n > 1:
        pairs = stored(pair_hashes(docs, frequent(known)).groupBy("key").agg(F.sum("f").alias("f")).filter(enough), "pairs")
        longer = grams(docs, range(2, max_n + 1), 2, frequent(pairs)).groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(enough)
        longer = stored(longer.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "f"), "phrases")
        out = out.unionByName(longer)
    return out, words


def _extended(candidates: DataFrame) -> DataFrame:
    """(lang, phrase, most): of each phrase that a candidate has but for its first or last word, the greatest count of those."""
    both = F.explode(F.array(F.regexp_extract("phrase", "(?s)^(.*) [^ ]+$", 1), F.regexp_extract("phrase", "(?s)^[^ ]+ (.*)$", 1)))
    return candidates.filter("size > 2").select("lang", both.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def mined(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST_COUNT, top: int = TOP) -> DataFrame:
    """Each language's `top` collocations: (lang, rank, phrase, a, l, r, n, score)."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text")
    counts, words = counted(texts, max_n, least)
    candidates = counts.filter("size > 1")
    cuts = candidates.withColumn("w", F.split("phrase", " ")).select("lang", "phrase", F.col("f").alias("a"), F.posexplode(F.expr("transform(sequence(1, size - 1), k -> named_struct('head', array_join(slice(w, 1, k), ' '), 'tail', array_join(slice(w, k + 1, size), ' ')))")).alias("k", "cut"))
    heads, tails = (counts.select("lang", F.col("phrase").alias(f"cut_{side}"), F.col("f").alias(side)) for side in ("l", "r"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.col("cut.head").alias("cut_l"), F.col("cut.tail").alias("cut_r")).join(heads, ["lang", "cut_l"]).join(tails, ["lang", "cut_r"])
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumns({"twice": F.lit(2_000_000).cast("decimal(10,0)") * F.col("a").cast("decimal(19,0)"), "both": wide("l") + wide("r")}).withColumn("score", F.expr("twice div both"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    own = scored.select("lang", "phrase", "a", "l", "r", "score")
    covered = _extended(candidates).select("lang", "phrase", (F.col("most").cast("decimal(19,0)") * 100).alias("most"))
    left = own.join(covered, (own.lang == covered.lang) & (own.phrase == covered.phrase) & (covered.most >= own.a.cast("decimal(19,0)") * COVERED), "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = left.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS s FROM documents),
 p AS (SELECT lang, unnest(s) AS piece FROM d),
 w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
 g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, {MAX_N + 1}) AS u(k) WHERE len(w) >= k),
 c AS MATERIALIZED (SELECT lang, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, k AS size, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST_COUNT}),
 n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
 x AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM c WHERE size > 1),
 y AS (SELECT x.*, h.f AS l, t.f AS r, 2000000 * a::HUGEINT // (h.f + t.f) AS score FROM x JOIN c h ON h.lang = x.lang AND h.phrase = array_to_string(list_slice(w, 1, k), ' ') JOIN c t ON t.lang = x.lang AND t.phrase = array_to_string(list_slice(w, k + 1, x.size), ' ')),
 z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 o AS (SELECT lang, size, f, unnest(range(1, size)) AS m, string_split(phrase, ' ') AS w FROM c WHERE size > 2),
 q AS (SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(f) AS most FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM o) GROUP BY ALL),
 v AS (SELECT z.* FROM z LEFT JOIN q USING (lang, phrase) WHERE most IS NULL OR 100 * most < {COVERED} * a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM v) JOIN n USING (lang) WHERE rank <= {TOP}
"""
