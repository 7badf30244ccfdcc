"""Operator 12: a Merkle manifest of a dataset, with proofs by the preimages of parents.

A document's leaf is the hash of its columns, each with its length, so that no two different rows read alike. Per language
the leaves, by doc_id (null first) and then by leaf, are the lowest nodes of a tree: every ARITY consecutive nodes become
the hash of their digests, written one after another, until one node is left, the language's subroot. The subroots, null
first, make the manifest's tree in the same way.

A parent is stored as its preimage, the concatenated digests of its children. Subtrees of STRIDE levels are one row, so a
billion leaves take five rounds of one grouping each. A leaf joins the row of its block, which holds the preimages of all
its ancestors: what is left of a preimage without the leaf's own slot of 64 characters are the siblings, and a digest that
is put into that slot and hashed, level after level, folds to the root.

Leaves move to ranges by language and doc_id, which give them their places, and to their blocks. A language that holds
most rows is many ranges and many blocks. One number a round reaches the driver. Null and empty columns and very long
texts are hashed whole, each in its own way. Rows that share a doc_id, or repeat, are leaves of their own; places of equal
ones go to them in any order. An empty table gives an empty result. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 64
ARITY, STRIDE = 2, 6
WIDTH = ARITY**STRIDE
POWERS = f"array({', '.join(f'{ARITY**l}L' for l in range(STRIDE + 1))})"


def leaf(columns: dict[str, Column]) -> Column:
    """The hash of a row: each column as `-` if it is null, else its length in bytes, a colon and its text."""
    texts = [c.cast("string") for c in columns.values()]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t), F.lit(":"), t)) for t in texts)), 256)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (tree, ...) with r, a row's place in its tree from 0, and n, how many rows its tree has.

    Rows are sorted in ranges; of a range's rows of one tree, only their first place and their number move on.
    """
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = stored(ranged.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "ranges")
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = ranged.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("k"))
    runs = stored(runs.select("tree", "part", (F.coalesce(F.sum("k").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("k").over(tree).alias("n")), "runs")
    return ranged.join(runs, ["tree", "part"]).withColumn("r", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def blocks(nodes: DataFrame) -> DataFrame:
    """Subtrees over nodes (tree, r, n, h) of one level: (tree, b, n, top, levels), of at most WIDTH nodes each.

    levels[l] holds the preimages l + 1 levels above the nodes, in order. A subtree has STRIDE levels; the only one of its
    tree has as many as leave one node.
    """
    grouped = nodes.groupBy("tree", F.expr(f"r div {WIDTH}").alias("b"), "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "h"))), lambda x: x["h"]).alias("h"))
    parents = f"transform(sequence(0, cast((size(acc.h) - 1) div {ARITY} as int)), i -> array_join(slice(acc.h, i * {ARITY} + 1, {ARITY}), ''))"
    up = f"transform(array({parents}), p -> named_struct('h', transform(p, x -> sha2(x, 256)), 'levels', concat(acc.levels, array(p))))[0]"
    grown = F.expr(f"aggregate(sequence(1, {STRIDE}), named_struct('h', h, 'levels', cast(array() as array<array<string>>)), (acc, l) -> CASE WHEN n <= {WIDTH} AND size(acc.h) = 1 THEN acc ELSE {up} END)")
    return grouped.select("tree", "b", "n", grown.alias("x")).select("tree", "b", "n", F.col("x.h")[0].alias("top"), F.col("x.levels").alias("levels"))


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """The blocks over nodes (tree, r, n, h), over those blocks, and so on, until every tree has one that is its last."""
    out = [stored(blocks(nodes), "blocks")]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > WIDTH:
        last = out[-1].filter(F.col("n") > WIDTH)
        out.append(stored(blocks(last.select("tree", F.col("b").alias("r"), F.expr(f"(n + {WIDTH - 1}) div {WIDTH}").alias("n"), F.col("top").alias("h"))), "blocks"))
    return out


def tops(made: list[DataFrame]) -> DataFrame:
    """(tree, h): the node that is left of each tree."""
    ends = [x.filter(F.col("n") <= WIDTH).select("tree", F.col("top").alias("h")) for x in made]
    out = ends[0]
    for x in ends[1:]:
        out = out.unionByName(x)
    return out


def own_path(place: str) -> Column:
    """(pre, slot) of the ancestors within its block of the node with this place in its level, lowest first."""
    j = f"pmod({place}, {WIDTH})"
    return F.expr(f"transform(levels, (p, l) -> named_struct('pre', p[cast({j} div {POWERS}[l + 1] as int)], 'slot', cast(pmod({j} div {POWERS}[l], {ARITY}) as int)))")


def with_paths(nodes: DataFrame, made: list[DataFrame], above: DataFrame) -> DataFrame:
    """nodes (tree, r, ...) with `path`, the (pre, slot) of all ancestors, lowest first, and what else above holds.

    above: (tree, above, ...), the path that goes on from each tree's top. Paths come down from block to block.
    """
    extra = [c for c in above.columns if c not in ("tree", "above")]
    upper = None
    for level in reversed(made):
        ends = level.filter(F.col("n") <= WIDTH).join(above, "tree")
        names = ["tree", "b", "levels", "above", *extra]
        if upper is None:
            upper = ends.select(names)
            continue
        inner = level.filter(F.col("n") > WIDTH).select("tree", F.col("b").alias("_b"), F.col("levels").alias("_levels"), F.expr(f"b div {WIDTH}").alias("b"))
        inner = inner.join(upper, ["tree", "b"]).select("tree", F.col("_b").alias("b"), F.col("_levels").alias("levels"), F.concat(own_path("_b"), "above").alias("above"), *extra)
        upper = stored(ends.select(names).unionByName(inner), "paths")
    joined = nodes.withColumn("b", F.expr(f"r div {WIDTH}")).join(upper, ["tree", "b"])
    return joined.withColumn("path", F.concat(own_path("r"), "above")).drop("b", "levels", "above")


def siblings(path: Column) -> Column:
    """Each ancestor's preimage without the node's own slot, one after another."""
    return F.array_join(F.transform(path, lambda x: F.overlay(x["pre"], F.lit(""), x["slot"] * DIGEST + 1, F.lit(DIGEST))), "")


def folded(start: Column, path: Column) -> Column:
    """The root that a node's digest leads to: it replaces its slot in the preimage, whose hash goes on."""
    return F.aggregate(path, start, lambda h, x: F.sha2(F.overlay(x["pre"], h, x["slot"] * DIGEST + 1, F.lit(DIGEST)), 256))


@dataclass(frozen=True)
class Manifest:
    """leaves (tree, r, n, doc_id, h, changed), their rounds of blocks, and subroots (tree, h, path, root)."""

    leaves: DataFrame
    made: list[DataFrame]
    subroots: DataFrame


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None) -> Manifest:
    """The trees over docs; `changed` holds columns of altered copies, whose leaves stand beside the true ones."""
    own = {c: F.col(c) for c in COLUMNS}
    name = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), "lang"))  # null first, then by bytes
    rows = docs.select(*COLUMNS).select(name.alias("tree"), "doc_id", leaf(own).alias("h"), *([leaf(own | changed).alias("changed")] if changed else []))
    leaves = stored(placed(stored(rows, "leaves"), ["doc_id", "h"]), "placed")
    made = rounds(leaves)
    heads = placed(tops(made).select(F.lit("").alias("tree"), F.col("tree").alias("lang_tree"), "h"), ["lang_tree"])
    heads = stored(heads, "subroots")
    top = rounds(heads)
    none = heads.select("tree", F.expr("cast(array() as array<struct<pre: string, slot: int>>)").alias("above")).distinct()
    paths = with_paths(heads, top, none)
    root = F.when(F.size("path") == 0, F.col("h")).otherwise(F.sha2(F.element_at("path", -1)["pre"], 256))
    return Manifest(leaves, made, stored(paths.select(F.col("lang_tree").alias("tree"), "h", "path", root.alias("root")), "heads"))


def proofs(m: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, path[, changed]) of every leaf."""
    above = m.subroots.select("tree", F.col("path").alias("above"), F.col("h").alias("subroot"), "root")
    rows = with_paths(m.leaves, m.made, above)
    return rows.withColumnRenamed("h", "leaf").drop("tree", "r", "n")


def report(docs: DataFrame, tampered: Column) -> DataFrame:
    """Every document's proof, and the root that it leads to where the rows that `tampered` is true for have one more character."""
    more = F.when(F.coalesce(tampered, F.lit(False)), F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    rows = proofs(manifest(docs, {"n_chars": more}))
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(F.col("changed"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return report(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0)


_CRC = "xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda acc, c: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(acc, c)), 4294967295::BIGINT), 4294967295)"
_PART = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_PART.format(n_chars if c == "n_chars" else c) for c in COLUMNS) + ")"


SQL = f"""
WITH RECURSIVE d AS (SELECT *, doc_id IS NOT NULL AND {_CRC} % 7 = 0 AS bad FROM documents),
 l AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, {_leaf_sql("n_chars")} AS h, {_leaf_sql("(CASE WHEN bad THEN n_chars + 1 ELSE n_chars END)")} AS changed FROM d),
 p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS r, count(*) OVER (PARTITION BY g) AS n FROM l),
 u AS (SELECT g, 0 AS v, r, n, h, '' AS pre FROM p UNION ALL
       SELECT g, v + 1, r // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY r)), string_agg(h, '' ORDER BY r) FROM u WHERE n > 1 GROUP BY g, v, r // 2, n),
 s AS (SELECT g, v, h, row_number() OVER (ORDER BY encode(g)) - 1 AS r, count(*) OVER () AS n FROM u WHERE n = 1),
 t AS (SELECT 0 AS v, r, n, h, '' AS pre FROM s UNION ALL
       SELECT v + 1, r // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY r)), string_agg(h, '' ORDER BY r) FROM t WHERE n > 1 GROUP BY v, r // 2, n),
 f AS (SELECT p.g, p.r AS leaf_r, 0 AS v, p.r, p.n, p.changed AS h, '' AS sib FROM p UNION ALL
       SELECT f.g, leaf_r, f.v + 1, f.r // 2, (f.n + 1) // 2, sha256(left(u.pre, 64 * (f.r % 2)) || f.h || substr(u.pre, 64 * (f.r % 2) + 65)), f.sib || left(u.pre, 64 * (f.r % 2)) || substr(u.pre, 64 * (f.r % 2) + 65)
       FROM f JOIN u ON u.g = f.g AND u.v = f.v + 1 AND u.r = f.r // 2 WHERE f.n > 1),
 k AS (SELECT f.g, leaf_r, 0 AS v, s.r, s.n, f.h, f.sib FROM f JOIN s USING (g) WHERE f.n = 1 UNION ALL
       SELECT k.g, leaf_r, k.v + 1, k.r // 2, (k.n + 1) // 2, sha256(left(t.pre, 64 * (k.r % 2)) || k.h || substr(t.pre, 64 * (k.r % 2) + 65)), k.sib || left(t.pre, 64 * (k.r % 2)) || substr(t.pre, 64 * (k.r % 2) + 65)
       FROM k JOIN t ON t.v = k.v + 1 AND t.r = k.r // 2 WHERE k.n > 1)
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, (SELECT h FROM t WHERE n = 1) AS root, sha256(k.sib) AS proof_sha256, k.h AS folded_root, k.h = (SELECT h FROM t WHERE n = 1) AS verified
FROM p JOIN s USING (g) JOIN k ON k.g = p.g AND k.leaf_r = p.r AND k.n = 1
"""
