"""Operator 8: benchmark decontamination with DataFrame and SQL functions only.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all characters beyond ASCII. Windows are ten
consecutive words of a benchmark item; an item of fewer is one window. Every window of a text holds an anchor, a few
words that begin at a multiple of a stride, so a text's anchors alone are looked up in the broadcast set of the items'
n-grams; only around anchors that are found are whole windows compared, word for word, with the windows themselves. Windows
fall into CLASSES by their length, each with anchors and a stride of its own, so that one short item does not make every
word of the others an anchor.
Sets travel as hash sets within the plan while the benchmark has at most MAX_WINDOWS windows and MAX_BYTES of them
(checked). Beyond that a text's anchors are looked up by 64-bit hashes, as a broadcast set if there are at most
MAX_ANCHORS of them (checked), else by a join of those hashes; only where anchors are found are windows cut out and joined
with the benchmark's, word for word. Both ways give the same rows.

Very long texts are searched whole. Null and empty texts have no words, and null or empty items no windows; with an empty benchmark nothing is hit. Rows
that repeat (doc_id and text) each get the same result; null doc_ids are kept. Extra columns are ignored by `report`,
and kept by `clean`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: What stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, ANCHOR = 10, 3
#: Least lengths of the windows of a class.
CLASSES = (1, 2, 3, 4, 6, WINDOW)
MAX_WINDOWS, MAX_BYTES = 50_000, 8_000_000
#: Words that a text is searched for at once.
FEW_WORDS = 1000
#: Hashes of 8 bytes that may be broadcast.
MAX_ANCHORS = 8_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def windows(items: DataFrame) -> DataFrame:
    """Distinct (item_id, n, gram) of items (item_id, text): n words joined by spaces."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).withColumn("n", F.least(F.lit(WINDOW), F.size("w"))).filter("n > 0")
    return w.select("item_id", "n", F.explode(F.expr("transform(sequence(0, size(w) - n), i -> array_join(slice(w, i + 1, n), ' '))")).alias("gram")).distinct()


def _text_set(values: list[str]) -> str:
    quoted = ("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return "(" + ", ".join(quoted) + ")"


def _classes(sizes: list[int]) -> list[tuple[int, int, list[int]]]:
    """(anchor's size, stride, lengths) of each class of window lengths that is there."""
    own = [[n for n in sizes if a <= n < b] for a, b in zip(CLASSES, (*CLASSES[1:], WINDOW + 1), strict=True)]
    return [(min(ANCHOR, x[0]), x[0] - min(ANCHOR, x[0]) + 1, x) for x in own if x]


def _hits(docs: DataFrame, found: list) -> DataFrame:
    """Adds `hits`, the (s, n) of each window that occurs in the words `w`."""
    none = F.expr("cast(array() as array<struct<s: int, n: int>>)")
    names = []
    for i, (size, stride, sizes) in enumerate(_classes(sorted({r.n for r in found}))):
        grams = sorted({r.gram for r in found if r.n in sizes})
        anchors = sorted({" ".join(x[k : k + size]) for x in (g.split(" ") for g in grams) for k in range(len(x) - size + 1)})
        at = f"filter(sequence(0, greatest(size(w) - {size}, 0), {stride}), p -> p + {size} <= size(w) AND {_joined('p', size)} IN {_text_set(anchors)})"
        if size == 1 and len(anchors) <= FEW_WORDS:  # most texts have none of them, which is found faster
            at = f"CASE WHEN arrays_overlap(w, array{_text_set(anchors)}) THEN {at} ELSE cast(array() as array<int>) END"
        around = ", ".join(
            f"transform(filter(array_distinct(flatten(transform(anchors{i}, p -> sequence(greatest(p - {n - size}, 0), p)))), s -> s + {n} <= size(w) AND array_join(slice(w, s + 1, {n}), ' ') IN {_text_set([r for r in grams if r.count(' ') + 1 == n])}), s -> named_struct('s', s, 'n', {n}))"
            for n in sizes
        )
        docs = docs.withColumn(f"anchors{i}", F.expr(at)).withColumn(f"hits{i}", F.when(F.size(f"anchors{i}") == 0, none).otherwise(F.expr(f"concat({around})")))
        names.append(i)
    return docs.withColumn("hits", F.concat(*(F.col(f"hits{i}") for i in names)) if names else none).drop(*(f"{c}{i}" for i in names for c in ("anchors", "hits")))


def _joined(p: str, n: int) -> str:
    return "concat_ws(' ', " + ", ".join(f"w[{p} + {i}]" for i in range(n)) + ")"


def _hits_by_join(docs: DataFrame, found: DataFrame, max_anchors: int) -> DataFrame:
    """The same by joins: hashes of a text's anchors first, then, around those that are found, whole windows."""
    empty = F.expr("cast(array() as array<struct<s: int, n: int>>)")
    sizes = [r.n for r in found.select("n").distinct().orderBy("n").collect()]  # WINDOW numbers at most
    if not sizes:
        return docs.withColumn("hits", empty)
    rows = stored(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    starts = None
    for size, stride, own_sizes in _classes(sizes):
        grams = found.filter(F.col("n").isin(own_sizes)).select(F.split("gram", " ").alias("w"))
        anchors = stored(grams.select(F.explode(F.expr(f"transform(sequence(0, size(w) - {size}), p -> xxhash64({_joined('p', size)}))")).alias("anchor")).distinct(), "anchors")
        own = rows.filter(F.size("w") >= size).select("row", F.explode(F.expr(f"transform(sequence(0, size(w) - {size}, {stride}), p -> named_struct('p', p, 'anchor', xxhash64({_joined('p', size)})))")).alias("a")).select("row", "a.p", "a.anchor")
        at = own.join(F.broadcast(anchors) if anchors.count() <= max_anchors else anchors, "anchor", "left_semi")
        # A window that holds the anchor begins no further before it than the window is longer.
        each = at.select("row", "p", F.explode(F.array(*(F.lit(n) for n in own_sizes))).alias("n")).select("row", "n", F.explode(F.expr(f"sequence(greatest(p - (n - {size}), 0), p)")).alias("s")).distinct()
        starts = each if starts is None else starts.unionByName(each)
    starts = starts.groupBy("row").agg(F.collect_list(F.struct("n", "s")).alias("starts"))  # of one text alone
    cut = rows.select("row", "w").join(starts, "row").select("row", F.explode(F.expr("transform(filter(starts, x -> x.s + x.n <= size(w)), x -> named_struct('n', x.n, 's', x.s, 'gram', array_join(slice(w, x.s + 1, x.n), ' ')))")).alias("x")).select("row", "x.*")
    hits = cut.join(found.select("n", "gram").distinct(), ["n", "gram"]).groupBy("row").agg(F.collect_list(F.struct("s", "n")).alias("hits"))
    return rows.join(hits, "row", "left").drop("row").withColumn("hits", F.coalesce("hits", empty))


def with_hits(docs: DataFrame, items: DataFrame, max_windows: int = MAX_WINDOWS, max_anchors: int = MAX_ANCHORS) -> tuple[DataFrame, DataFrame, bool]:
    """docs with `w`, `hits` and `n_hit`, the benchmark's windows, and whether these are few."""
    found = stored(windows(items), "windows")
    rows = docs.withColumn("w", words(F.col("text")))
    n = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("gram")), F.lit(0)).alias("bytes")).first()
    few = n.n <= max_windows and n.bytes <= MAX_BYTES
    rows = _hits(rows, found.select("n", "gram").distinct().collect()) if few else _hits_by_join(rows, found, max_anchors)
    covered = F.expr("cast(size(array_distinct(flatten(transform(hits, h -> sequence(h.s, h.s + h.n - 1))))) as bigint)")
    return rows.withColumn("n_hit", covered), found, few


def report(docs: DataFrame, items: DataFrame, max_windows: int = MAX_WINDOWS, max_anchors: int = MAX_ANCHORS) -> DataFrame:
    """A row for each document: n_words, n_hit, n_items, items_sha256, contaminated."""
    rows, found, few = with_hits(docs.select("doc_id", "text"), items, max_windows, max_anchors)
    rows = rows.select("doc_id", F.md5("text").alias("digest"), F.size("w").cast("long").alias("n_words"), "n_hit", F.expr("array_distinct(transform(hits, h -> array_join(slice(w, h.s + 1, h.n), ' ')))").alias("grams"))
    each = rows.select("*", F.posexplode_outer("grams").alias("i", "gram")).drop("grams")
    known = found.groupBy("gram").agg(F.collect_set("item_id").alias("items"))
    known = F.broadcast(known) if few else known
    each = each.join(known, "gram", "left").withColumn("item_id", F.explode_outer("items"))
    # A row counts once: its first gram's first item.
    first = F.coalesce(F.col("i"), F.lit(0)) == 0
    copies = F.sum(F.when(first & (F.col("item_id").isNull() | (F.col("item_id") == F.array_min("items"))), 1).otherwise(0))
    keyed = each.groupBy("doc_id", "digest", "n_words", "n_hit").agg(copies.alias("copies"), F.array_sort(F.collect_set("item_id")).alias("ids"))
    out = keyed.select(
        "doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.explode(F.expr("sequence(1, copies)")).alias("copy")
    )
    return out.drop("copy")


def clean(docs: DataFrame, items: DataFrame, remove: str = "documents") -> DataFrame:
    """docs without the documents that are hit or, with remove="spans", without the words that are hit."""
    # A document travels as one column, so its own columns never clash with those of the search.
    rows, _, _ = with_hits(docs.select(F.struct("*").alias("own"), "text"), items)
    if remove == "documents":
        # Written first: a filter that sank below the search would split the text again for every word it looks at.
        return stored(rows.select("own", "n_hit"), "searched").filter("n_hit = 0").select("own.*")
    # Pieces alternate between words and what stands between them; `lead` is 1 if a text does not begin with a word.
    word = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
    pieces = F.regexp_extract_all("text", F.lit(rf"{word}+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    rows = rows.withColumn("pieces", pieces).withColumn("lead", F.when(F.col("text").rlike(rf"\A{word}"), 0).otherwise(1))
    rows = rows.withColumn("gone", F.expr("array_distinct(flatten(transform(hits, h -> sequence(h.s, h.s + h.n - 1))))"))
    left = F.expr("array_join(filter(pieces, (p, i) -> NOT ((i + lead) % 2 = 0 AND array_contains(gone, cast((i - lead) div 2 as int)))), '')")
    text = F.when(F.col("n_hit") > 0, left).otherwise(F.col("text"))
    return rows.select(*(text.alias(c) if c == "text" else F.col("own").getField(c).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     i AS (SELECT item_id, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s, w FROM b WHERE len(w) > 0),
     g AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS gram FROM i),
     x AS (SELECT r, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS gram
           FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
     h AS (SELECT DISTINCT r, item_id, n, s FROM x JOIN g USING (n, gram)),
     t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY r),
     c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN t USING (r) LEFT JOIN c USING (r)
"""
