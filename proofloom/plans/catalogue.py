"""Every query over the driver's tables, and the same in SQL.

The tables have no editions, headers, claims or model scores, so both sides derive them by the same expressions:
publication, edition and section from doc_id; headers before every third line; verdicts and chunks' vectors from the
embeddings, of which answers and publications take twenty and ten in turn.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import softmax, unit

from ..operators import documents as D
from ..operators import evidence as E
from ..operators import reports as R
from ..operators import retrieval as Q
from ..operators.dense import DenseIndex
from ..operators.library import Library
from ..params import DEFAULT
from ..shared import new_folder, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
META = ("element_at(array('FSR', 'MPR', 'PSR', 'FER'), cast(doc_id % 4 as int) + 1)", "if(doc_id div 4 % 2 = 0, 'June 2024', 'Dec 2024')", "concat(1 + doc_id % 9, '.', 1 + doc_id div 9 % 5)")
DUCK_META = "(['FSR', 'MPR', 'PSR', 'FER'])[doc_id % 4 + 1] AS publication_name, CASE WHEN doc_id // 4 % 2 = 0 THEN 'June 2024' ELSE 'Dec 2024' END AS edition_date, concat(1 + doc_id % 9, '.', 1 + doc_id // 9 % 5) AS section_id"
TOKENS = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')"
WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
CHUNKS = f"""
w AS (SELECT doc_id, lang, text, {WORDS} AS w, {DUCK_META} FROM documents),
s AS (SELECT *, unnest(CASE WHEN len(w) <= 512 THEN [0] ELSE range(0, len(w) - 50, 462) END) AS start FROM w WHERE len(w) > 0),
c AS (SELECT doc_id, lang, publication_name, edition_date, section_id, start // 462 AS chunk_idx, CASE WHEN len(w) <= 512 THEN text ELSE array_to_string(list_slice(w, start + 1, start + 512), ' ') END AS chunk_text,
      concat_ws('_', publication_name, edition_date, section_id, 'd' || doc_id, 'chunk' || start // 462) AS chunk_id FROM s)"""
BM25 = f"""
{CHUNKS},
t AS MATERIALIZED (SELECT chunk_id, list_filter(regexp_split_to_array(lower(chunk_text), '\\s+'), lambda w: w <> '') AS t FROM c),
dl AS (SELECT chunk_id, len(t) AS dl FROM t),
p AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM t) GROUP BY ALL),
n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
r AS MATERIALIZED (SELECT term, nd, ln(n - nd + 0.5::DOUBLE) - ln(nd + 0.5::DOUBLE) AS raw FROM (SELECT term, count(*) AS nd FROM p GROUP BY term), n),
i AS (SELECT term, nd, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r),
q AS (SELECT query_id, term, count(*) AS qf FROM (SELECT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
b AS (SELECT query_id, chunk_id, round(sum(qf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS bm25_score
      FROM q JOIN i USING (term) JOIN p USING (term) JOIN dl USING (chunk_id), n GROUP BY ALL HAVING bm25_score > 0)"""
COSINE = "round(list_cosine_similarity({}::DOUBLE[], {}::DOUBLE[]), {})"
DENSE = f"""
v AS (SELECT chunk_id, c.publication_name, c.edition_date, embedding FROM c JOIN embeddings ON vec_id = (doc_id * 31 + chunk_idx) % (SELECT count(*) FROM embeddings)),
dq AS (SELECT item_id AS query_id, embedding AS q FROM benchmark JOIN embeddings ON vec_id = (item_id * 17 + 5) % (SELECT count(*) FROM embeddings)),
ds AS (SELECT query_id, chunk_id, publication_name, {COSINE.format("q", "embedding", 6)} AS dense_score FROM v, dq)"""
FUSED = f"""
WITH {BM25.strip()}, {DENSE.strip()},
d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, chunk_id) AS dr FROM ds QUALIFY dr <= 20),
sp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, chunk_id) AS sr FROM b QUALIFY sr <= 20),
f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + k)), 8) AS rrf_score, coalesce(max(dense_score), 0) AS dense_score, coalesce(max(bm25_score), 0) AS bm25_score, min(dr) AS dr, min(sr) AS sr
      FROM (SELECT query_id, chunk_id, dr AS k, dense_score, NULL::DOUBLE AS bm25_score, dr, NULL AS sr FROM d UNION ALL SELECT query_id, chunk_id, sr, NULL, bm25_score, NULL, sr FROM sp) GROUP BY ALL),
g AS (SELECT query_id, chunk_id, rrf_score, dense_score, bm25_score, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, dr NULLS LAST, sr NULLS LAST) AS rank FROM f QUALIFY rank <= 10)
"""
CLAIMS = """
WITH e AS (SELECT vec_id, vec_id % 50 AS answer_id, embedding::DOUBLE[] AS v FROM embeddings),
x AS (SELECT *, exp(8 * v[1]) AS a, exp(8 * v[2]) AS b, exp(8 * v[3]) AS c FROM e),
claims AS (SELECT answer_id, vec_id AS claim_idx, round(a / (a + b + c), 6) AS contradiction, round(b / (a + b + c), 6) AS entailment_score, round(c / (a + b + c), 6) AS neutral,
           round(0.6::DOUBLE + v[5], 4) AS attribution_score, abs(v[6]) < 0.02 AS ambiguous, round(abs(v[6]), 4) AS confidence_gap, concat('Claim ', vec_id, CASE WHEN vec_id % 3 = 0 THEN ' is short.' ELSE concat(' of answer ', vec_id % 50, ' says that the ratio rose by ', vec_id % 13, ' percent over the whole of the period under review.') END) AS claim_text, v[7] < -0.28 AS has_conflict, CASE WHEN vec_id % 7 = 0 THEN ' ' ELSE 's' || vec_id % 9 END AS source_section_id FROM x),
k AS (SELECT *, CASE WHEN contradiction >= entailment_score AND contradiction >= neutral THEN 'CONTRADICTION' WHEN entailment_score >= neutral THEN 'ENTAILMENT' ELSE 'NEUTRAL' END AS verdict FROM claims),
u AS (SELECT *, CASE verdict WHEN 'CONTRADICTION' THEN 3000 ELSE 0 END AS uc, CASE verdict WHEN 'NEUTRAL' THEN 1000 ELSE 0 END AS un, CASE WHEN entailment_score < 0.5 THEN 2000 ELSE 0 END AS ul,
      CASE WHEN entailment_score >= 0.5 AND entailment_score <= 0.8 THEN 500 ELSE 0 END AS um, CASE WHEN ambiguous THEN 500 ELSE 0 END AS ua, CASE WHEN NOT ambiguous AND attribution_score < 0.65 THEN 300 ELSE 0 END AS uw FROM k)
"""
SIMILAR = f"s AS (SELECT l.vec_id // 20 AS answer_id, l.vec_id AS i, r.vec_id AS j, {COSINE.format('l.embedding', 'r.embedding', 4)} AS score FROM embeddings l JOIN embeddings r ON l.vec_id // 20 = r.vec_id // 20 AND l.vec_id <> r.vec_id)"
LINES = "CASE WHEN lang = 'en' THEN array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 3 = 1 THEN concat(1 + doc_id % 9, '.', 1 + i // 3, ' Topic Number', chr(10), x) ELSE x END), chr(10)) ELSE text END"


NOISE = f"(x = '' OR regexp_matches(x, '{T.NUMERIC_ROW}') OR regexp_matches(x, '{T.PAGE_MARK}') OR regexp_matches(x, '{T.TABLE_HEAD}') OR (regexp_matches(x, '{T.CAPITALS}') AND length(x) < {T.CAPITALS_BELOW}) OR regexp_matches(x, '{T.DATED_ROW}'))"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id").selectExpr("doc_id", "lang", "text", f"{META[0]} AS publication_name", f"{META[1]} AS edition_date", f"{META[2]} AS section_id")
    rows = D.chunks(docs)
    return rows.withColumn("chunk_id", D.chunk_id(F.col("publication_name"), F.col("edition_date"), F.concat_ws("_", "section_id", F.concat(F.lit("d"), "doc_id")), F.col("chunk_idx")))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_libraries: dict[tuple[str, str], Library] = {}


def library(spark: SparkSession, sf_dir: str) -> Library:
    """The documents' chunks with their index, ingested when a session first asks for them, as a service does when it starts."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _libraries:
        made = Library(spark, new_folder(spark, "library"), buckets=16)
        made.ingest(chunked(spark, sf_dir))
        _libraries[key] = made
    return _libraries[key]


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's chunks, with the document and the place that their ids hold."""
    part = lambda i: F.regexp_extract("chunk_id", "_d([0-9]+)_chunk([0-9]+)$", i).cast("long")
    return library(spark, sf_dir).chunks().select(part(1).alias("doc_id"), part(2).alias("chunk_idx"), "chunk_id", "publication_name", "edition_date", F.regexp_replace("section_id", "_d[0-9]+$", "").alias("section_id"), "chunk_text")


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without their texts, which are not read."""
    return stored_chunks(spark, sf_dir).drop("chunk_text")


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = F.broadcast(e.agg(F.count("*").alias("n")))
    of = chunk_ids(spark, sf_dir).crossJoin(n).select("chunk_id", "publication_name", ((F.col("doc_id") * 31 + F.col("chunk_idx")) % F.col("n")).alias("vec_id"))
    asked_ = load(spark, sf_dir, "benchmark").crossJoin(n).select(F.col("item_id").alias("query_id"), ((F.col("item_id") * 17 + 5) % F.col("n")).alias("vec_id"))
    return asked_.join(e, "vec_id").select("query_id", F.col("embedding").alias("q")), of.join(e, "vec_id").select("chunk_id", "publication_name", "embedding")


@query("tokenise_stats", f"SELECT doc_id, len({TOKENS}) AS n_tokens, len(list_distinct({TOKENS})) AS n_distinct FROM documents")
def tokenise_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query("chunk_windows", f"WITH {CHUNKS} SELECT doc_id, chunk_idx, chunk_id, len(list_filter(regexp_split_to_array(chunk_text, '\\s+'), lambda w: w <> '')) AS n_words, md5(chunk_text) AS digest FROM c")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked(spark, sf_dir).select("doc_id", "chunk_idx", "chunk_id", F.size(T.words(F.col("chunk_text"))).cast("long").alias("n_words"), F.md5("chunk_text").alias("digest"))


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("if(lang = 'en', array_join(transform(split(text, '\\n'), (x, i) -> if(i % 3 = 0, concat(1 + doc_id % 9, '.', 1 + i div 3, ' Topic Number\\n', x), x)), '\\n'), text)")
    return spread(load(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id").select("doc_id", F.lit(1).alias("page_number"), text.alias("text"))


@query(
    "section_segments",
    f"""WITH t AS (SELECT doc_id, {LINES} AS text FROM documents WHERE text <> ''), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos, text FROM t),
    h AS (SELECT *, trim(line, E' \\t\\n\\r') AS x FROM l), k AS (SELECT doc_id, pos, x, text, regexp_matches(x, '^\\d+\\.\\d+ Topic Number$') AS head FROM h WHERE x <> ''),
    o AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY doc_id ORDER BY pos) AS section_ord FROM k)
    SELECT doc_id, section_ord, regexp_extract(max(x) FILTER (head), '^(\\S+)', 1) AS section_id, 'Topic Number' AS section_title, md5(coalesce(string_agg(x, chr(10) ORDER BY pos) FILTER (NOT head), '')) AS digest
    FROM o WHERE section_ord > 0 GROUP BY ALL
    UNION ALL SELECT doc_id, 1, 'UNSTRUCTURED-p1', 'Page 1', md5(any_value(text)) FROM o GROUP BY doc_id HAVING max(section_ord) = 0""",
)
def section_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.sections(paged(spark, sf_dir)).select("doc_id", "section_ord", "section_id", "section_title", F.md5("text").alias("digest"))


@query(
    "strip_noise",
    "WITH t AS (SELECT doc_id, list_filter(list_transform(string_split('617075 (12.3)|12 ~ P a g e|Table 3 of all|GDP - X.|September-24 617,075|'.replace('|', chr(10)).replace('~', '|') || text || '|  Goldman said so |STILL A LINE OF THIRTY CAPITAL|kept prose'.replace('|', chr(10)), chr(10)), lambda x: trim(x, E' \\t\\n\\r')),"
    f" lambda x: NOT {NOISE}) AS kept FROM documents)"
    " SELECT doc_id, len(kept) AS n_kept, md5(array_to_string(kept, ' ')) AS digest FROM t",
)
def strip_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.concat(F.lit("617075 (12.3)\n12 | P a g e\nTable 3 of all\nGDP - X.\nSeptember-24 617,075\n"), "text", F.lit("\n  Goldman said so \nSTILL A LINE OF THIRTY CAPITAL\nkept prose"))
    kept = F.filter(F.transform(F.split(noisy, "\n"), T.strip), lambda x: ~T.noise(x))
    return load(spark, sf_dir, "documents").select("doc_id", F.size(kept).cast("long").alias("n_kept"), F.md5(T.strip_noise(noisy)).alias("digest"))


@query("sections_rollup", f"WITH {CHUNKS}, r AS (SELECT publication_name, edition_date, section_id, min_by('T' || doc_id, doc_id) AS section_title, count(*) AS chunk_count FROM c GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY publication_name, edition_date ORDER BY section_id) AS place FROM r")
def sections_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.list_sections(chunk_ids(spark, sf_dir).withColumn("section_title", F.concat(F.lit("T"), "doc_id")))


@query(
    "documents_with_sections",
    f"""WITH {CHUNKS}, s1 AS (SELECT publication_name, edition_date, section_id, min(doc_id) AS first_doc FROM c GROUP BY ALL), n AS (SELECT publication_name, edition_date, string_agg(section_id, ',' ORDER BY first_doc) AS sections, count(*) AS n_sections FROM s1 GROUP BY ALL),
    d AS (SELECT item_id AS id, (['FSR', 'MPR', 'PSR', 'XXX'])[item_id % 4 + 1] AS publication_name, CASE WHEN item_id // 4 % 2 = 0 THEN 'June 2024' ELSE 'Dec 2024' END AS edition_date FROM benchmark)
    SELECT id, publication_name, edition_date, coalesce(sections, '') AS sections, coalesce(n_sections, 0) AS n_sections FROM d LEFT JOIN n USING (publication_name, edition_date)""",
)
def documents_with_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    registered = load(spark, sf_dir, "benchmark").selectExpr("item_id AS id", "element_at(array('FSR', 'MPR', 'PSR', 'XXX'), cast(item_id % 4 as int) + 1) AS publication_name", "if(item_id div 4 % 2 = 0, 'June 2024', 'Dec 2024') AS edition_date")
    return D.documents_with_sections(registered, chunk_ids(spark, sf_dir)).select("id", "publication_name", "edition_date", "sections", "n_sections")


@query(
    "bm25_corpus_stats",
    f"""WITH {CHUNKS}, t AS (SELECT chunk_id, list_distinct({TOKENS.replace("text", "chunk_text")}) AS t FROM c), d AS (SELECT term, count(*) AS nd FROM (SELECT unnest(t) AS term FROM t) GROUP BY term),
    r AS (SELECT term, nd, ln((SELECT count(*) FROM c) - nd + 0.5::DOUBLE) - ln(nd + 0.5::DOUBLE) AS raw FROM d), m AS (SELECT avg(raw) AS mean FROM r) SELECT term, nd, round(CASE WHEN raw < 0 THEN 0.25::DOUBLE * mean ELSE raw END, 6) AS idf FROM r, m""",
)
def bm25_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.bm25_index(chunked(spark, sf_dir)).terms.select("term", "nd", F.round("idf", 6).alias("idf"))


@query("bm25_topk", f"WITH {BM25} SELECT query_id, chunk_id, bm25_score, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, chunk_id) AS rank FROM b QUALIFY rank <= 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library(spark, sf_dir).topk(asked(spark, sf_dir), DEFAULT.sparse_k)


@query("bm25_filtered_topk", f"WITH {BM25} SELECT query_id, chunk_id, bm25_score, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, chunk_id) AS rank FROM b JOIN c USING (chunk_id) WHERE publication_name = 'MPR' AND edition_date = 'June 2024' QUALIFY rank <= 20")
def bm25_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library(spark, sf_dir).topk(asked(spark, sf_dir), DEFAULT.sparse_k, {"publication_name": "MPR", "edition_date": "June 2024"})


@query(
    "bm25_exhaustive",
    f"WITH {BM25} SELECT query_id, count(*) AS n_chunks, round(sum(bm25_score), 2) AS total FROM b GROUP BY query_id",
)
def bm25_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's score for every question, summed: what the stored index leaves out is counted here."""
    scores = Q.bm25_scores(Q.bm25_index(chunked(spark, sf_dir)), asked(spark, sf_dir))
    return scores.groupBy("query_id").agg(F.count("*").alias("n_chunks"), F.round(F.sum("bm25_score"), 2).alias("total"))


@query("dense_topk", f"WITH {CHUNKS}, {DENSE} SELECT query_id, chunk_id, dense_score, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, chunk_id) AS rank FROM ds QUALIFY rank <= 20")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = vectors(spark, sf_dir)
    return Q.dense_topk(q, v, DEFAULT.dense_k)


_indexes: dict[tuple[str, str], DenseIndex] = {}


def dense_index(spark: SparkSession, sf_dir: str) -> DenseIndex:
    """The chunks' vectors in lists, made when a session first asks for them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        _indexes[key] = DenseIndex(spark, new_folder(spark, "dense")).build(vectors(spark, sf_dir)[1], lists=32)
    return _indexes[key]


@query("dense_index_all_lists", f"WITH {CHUNKS}, {DENSE} SELECT query_id, chunk_id, dense_score, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, chunk_id) AS rank FROM ds QUALIFY rank <= 20")
def dense_index_all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index with all lists probed and no shortlist: what it answers is exact."""
    return dense_index(spark, sf_dir).topk(vectors(spark, sf_dir)[0], DEFAULT.dense_k, 32)


@query("dense_index_topk")
def dense_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three quarters of the lists, as these vectors have no clusters, and a shortlist of 200; tests hold the recall above 0.9."""
    return dense_index(spark, sf_dir).topk(vectors(spark, sf_dir)[0], DEFAULT.dense_k, 24, 200)


@query("dense_filtered_topk", f"WITH {CHUNKS}, {DENSE} SELECT query_id, chunk_id, dense_score, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, chunk_id) AS rank FROM ds WHERE publication_name = 'PSR' QUALIFY rank <= 20")
def dense_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = vectors(spark, sf_dir)
    return Q.dense_topk(q, v.filter(Q.matching({"publication_name": "PSR"})), DEFAULT.dense_k)


def hybrid(spark: SparkSession, sf_dir: str, k: int = DEFAULT.final_k) -> DataFrame:
    return Q.fused(dense_topk(spark, sf_dir), bm25_topk(spark, sf_dir), k)


@query("hybrid_score_records", FUSED + "SELECT * FROM g")
def hybrid_score_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir)


@query("dedup_by_section", FUSED + "SELECT query_id, section_id, chunk_id, rank FROM g JOIN c USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY query_id, section_id ORDER BY rank) = 1")
def dedup_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = chunk_ids(spark, sf_dir).select("chunk_id", "section_id")
    return Q.first_of(hybrid(spark, sf_dir).join(meta, "chunk_id"), ["query_id", "section_id"], "rank").select("query_id", "section_id", "chunk_id", "rank")


@query("format_sources", FUSED + "SELECT query_id, md5(string_agg('[' || publication_name || '·' || edition_date || '·' || section_id || '] ' || chunk_text, chr(10) || chr(10) ORDER BY rank)) AS digest FROM g JOIN c USING (chunk_id) GROUP BY query_id")
def format_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hybrid(spark, sf_dir).join(stored_chunks(spark, sf_dir), "chunk_id")
    return Q.formatted(rows, "rank").select("query_id", F.md5("sources").alias("digest"))


def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer's sentences against its chunks: the other vectors of its twenty."""
    e = load(spark, sf_dir, "embeddings").select(F.expr("vec_id div 20").alias("answer_id"), "vec_id", unit(F.col("embedding")).alias("v"))
    return E.similarity(e.select("answer_id", F.col("vec_id").alias("i"), F.col("v").alias("a")), e.select("answer_id", F.col("vec_id").alias("j"), F.col("v").alias("b"))).filter("i <> j")


@query("attribution_matrix", f"WITH {SIMILAR} SELECT * FROM s")
def attribution_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(spark, sf_dir)


@query("attribute_argmax", f"WITH {SIMILAR}, m AS (SELECT answer_id, i, j, score FROM s QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, j) = 1) SELECT answer_id, i, CASE WHEN score >= 0.45 THEN j END AS j, CASE WHEN score >= 0.45 THEN score ELSE 0 END AS confidence FROM m")
def attribute_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.attributed(similar(spark, sf_dir))


@query(
    "primary_attributions",
    f"WITH {SIMILAR}, k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, j) AS k FROM s QUALIFY k <= 2) SELECT answer_id, i, max(j) FILTER (k = 1) AS primary_chunk, max(score) FILTER (k = 1) AS attribution_score, max(j) FILTER (k = 2) AS runner_up_chunk, max(score) FILTER (k = 2) AS runner_up_score, round(attribution_score - runner_up_score, 4) AS confidence_gap, confidence_gap < 0.02 AS ambiguous FROM k GROUP BY answer_id, i",
)
def primary_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.primary(similar(spark, sf_dir))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lambda i: F.element_at(F.col("embedding").cast("array<double>"), i)
    e = load(spark, sf_dir, "embeddings").withColumn("p", softmax(F.transform(F.slice("embedding", 1, 3).cast("array<double>"), lambda x: 8 * x)))
    rows = e.select(
        (F.col("vec_id") % 50).alias("answer_id"), F.col("vec_id").alias("claim_idx"), F.round(F.col("p")[0], 6).alias("contradiction"), F.round(F.col("p")[1], 6).alias("entailment_score"), F.round(F.col("p")[2], 6).alias("neutral"), F.round(0.6 + v(5), 4).alias("attribution_score"),
        (F.abs(v(6)) < 0.02).alias("ambiguous"), F.round(F.abs(v(6)), 4).alias("confidence_gap"),
        F.expr("concat('Claim ', vec_id, if(vec_id % 3 = 0, ' is short.', concat(' of answer ', vec_id % 50, ' says that the ratio rose by ', vec_id % 13, ' percent over the whole of the period under review.')))").alias("claim_text"), (v(7) < -0.28).alias("has_conflict"), F.when(F.col("vec_id") % 7 == 0, " ").otherwise(F.concat(F.lit("s"), F.col("vec_id") % 9)).alias("source_section_id"),
    )
    return rows.withColumn("verdict", E.verdict(F.col("contradiction"), F.col("entailment_score"), F.col("neutral")))


@query("nli_verdicts", CLAIMS + "SELECT answer_id, claim_idx, contradiction, entailment_score, neutral, verdict FROM k")
def nli_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).select("answer_id", "claim_idx", "contradiction", "entailment_score", "neutral", "verdict")


@query(
    "trust_gate",
    CLAIMS
    + "SELECT answer_id, greatest(0, 10000 - sum(uc + un + ul + um + ua + uw) - CASE WHEN bool_or(has_conflict) THEN 5000 ELSE 0 END)::DOUBLE / 10000 AS overall_score, CASE WHEN bool_or(uc > 0 OR ul > 0 OR has_conflict) THEN 'Non_Compliant' WHEN bool_or(un > 0 OR um > 0 OR uw > 0 OR ua > 0) THEN 'Needs_Human_Review' ELSE 'Safe' END AS status FROM u GROUP BY answer_id",
)
def trust_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.trust_gate(claims(spark, sf_dir))


@query(
    "shapley",
    CLAIMS
    + ", f AS (SELECT answer_id, claim_idx, CASE verdict WHEN 'CONTRADICTION' THEN 3000 ELSE un + ul + um END + ua + uw AS units FROM u) SELECT answer_id, claim_idx, units / 10000 AS phi, greatest(0, 10000 - sum(units) OVER (PARTITION BY answer_id))::DOUBLE / 10000 AS overall_score, row_number() OVER (PARTITION BY answer_id ORDER BY units DESC, claim_idx) AS place FROM f",
)
def shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.shapley(claims(spark, sf_dir))


@query("penalty_breakdown", CLAIMS + "SELECT answer_id, sum(uc)::DOUBLE / 10000 AS contradiction_penalty, sum(un)::DOUBLE / 10000 AS neutral_penalty, sum(ul)::DOUBLE / 10000 AS low_penalty, sum(um)::DOUBLE / 10000 AS mid_penalty, CASE WHEN bool_or(has_conflict) THEN 0.5::DOUBLE ELSE 0 END AS conflict_penalty FROM u GROUP BY answer_id")
def penalty_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.breakdown(claims(spark, sf_dir))


@query(
    "scorecard",
    CLAIMS + "SELECT answer_id, round(avg((verdict = 'ENTAILMENT')::INT), 6) AS faithfulness, 1.0::DOUBLE AS citation_precision, round(avg((trim(source_section_id) <> '')::INT), 6) AS cited_share, bool_or(has_conflict) AS edition_conflict_risk, 0.95::DOUBLE AS context_relevance, 0.9::DOUBLE AS paraphrase_stability FROM u GROUP BY answer_id",
)
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.scorecard(claims(spark, sf_dir))


@query("edition_conflicts_nli", CLAIMS + "SELECT answer_id, claim_idx, contradiction FROM k WHERE contradiction > 0.70")
def edition_conflicts_nli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).filter(F.col("contradiction") > DEFAULT.conflict).select("answer_id", "claim_idx", "contradiction")


#: Embeddings as sections: ten make a publication, five of them an edition.
SECTIONS = "SELECT vec_id, 'P' || vec_id // 10 AS publication, 'S' || vec_id % 5 AS section_id, CASE WHEN vec_id % 10 < 5 THEN 'June 2024' ELSE 'Dec 2024' END AS edition, vec_id % 10 // 5 AS edition_no, embedding FROM embeddings"


def edition_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").selectExpr("vec_id", "'P' || vec_id div 10 AS publication", "'S' || vec_id % 5 AS section_id", "if(vec_id % 10 < 5, 'June 2024', 'Dec 2024') AS edition", "vec_id % 10 div 5 AS edition_no", "embedding")


@query(
    "edition_conflicts_cosine",
    f"WITH s AS ({SECTIONS}) SELECT o.publication, o.section_id, {COSINE.format('o.embedding', 'n.embedding', 6)} AS similarity, similarity < 0.75 AS has_conflict, similarity AS authority_newer, similarity / 2 AS authority_older FROM s o JOIN s n USING (publication, section_id) WHERE o.edition_no < n.edition_no",
)
def edition_conflicts_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = E.section_pairs(edition_sections(spark, sf_dir), same_section=True)
    s, has, newer, old = E.cosine_conflict(F.col("old.embedding"), F.col("new.embedding"))
    return pairs.select("publication", F.col("old.section_id").alias("section_id"), s.alias("similarity"), has.alias("has_conflict"), newer.alias("authority_newer"), old.alias("authority_older"))


#: A stand-in for the model: what two sections' vectors say of contradiction, entailment and neither.
JUDGED = "exp(12 * (o.embedding[1] + n.embedding[1])::DOUBLE) AS a, exp(12 * (o.embedding[2] + n.embedding[2])::DOUBLE) AS b, exp(12 * (o.embedding[3] + n.embedding[3])::DOUBLE) AS c"


def judged(pairs: DataFrame) -> DataFrame:
    logit = lambda i: 12 * (F.element_at("old.embedding", i) + F.element_at("new.embedding", i)).cast("double")
    return pairs.withColumn("contradiction", F.round(softmax(F.array(logit(1), logit(2), logit(3)))[0], 6))


@query(
    "edition_section_conflicts",
    f"WITH s AS ({SECTIONS}), j AS (SELECT o.publication, o.section_id AS old_section, n.section_id AS new_section, n.edition AS superseding_edition, {JUDGED} FROM s o JOIN s n USING (publication) WHERE o.edition_no < n.edition_no) SELECT publication, old_section, new_section, round(a / (a + b + c), 6) AS contradiction_score, superseding_edition FROM j WHERE contradiction_score > 0.70",
)
def edition_section_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.conflicts(judged(E.section_pairs(edition_sections(spark, sf_dir))))


@query(
    "edition_conflict_reports",
    f"WITH s AS ({SECTIONS}), j AS (SELECT o.publication, o.section_id, o.edition AS older_edition, n.edition AS newer_edition, {JUDGED} FROM s o JOIN s n USING (publication, section_id) WHERE o.edition_no < n.edition_no), k AS (SELECT *, round(a / (a + b + c), 6) AS p FROM j)"
    " SELECT publication, section_id, older_edition, newer_edition, p > 0.70 AS has_conflict, CASE WHEN p > 0.70 THEN 'Contradiction Probability: ' || printf('%.2f', 100 * p) || '%' ELSE '' END AS conflict_description, CASE WHEN p > 0.70 THEN newer_edition ELSE '' END AS superseding_edition,"
    " 'CrossEncoder probability of newer text contradicting older text: ' || printf('%.4f', p) AS details FROM k",
)
def edition_conflict_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.edition_conflict(judged(E.section_pairs(edition_sections(spark, sf_dir), same_section=True)))


def related_sql(least: float) -> str:
    return f"""WITH h AS (SELECT event_id AS id, embedding FROM events JOIN embeddings ON event_id = vec_id ORDER BY id DESC LIMIT 200), p AS (SELECT q.vec_id AS query_id, id, {COSINE.format('q.embedding', 'h.embedding', 4)} AS similarity FROM embeddings q, h WHERE q.vec_id <> id),
    t AS (SELECT * FROM p WHERE similarity >= {least} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id DESC) <= 3) SELECT * FROM t WHERE similarity < 0.99"""


def related_at(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    """Every embedding asks the newest past ones; those past ones are the events that have an embedding."""
    e = load(spark, sf_dir, "embeddings")
    history = load(spark, sf_dir, "events").select("event_id").join(e, F.col("event_id") == F.col("vec_id")).select(F.col("event_id").alias("id"), "embedding")
    return E.related(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), history, replace(DEFAULT, related=least))


@query("related_queries", related_sql(0.7))
def related_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return related_at(spark, sf_dir, DEFAULT.related)


@query("related_queries_wide", related_sql(0.3))
def related_queries_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return related_at(spark, sf_dir, 0.3)


LOG_JSON = "CASE event_id % 6 WHEN 0 THEN '{bad' WHEN 1 THEN 'null' WHEN 2 THEN '{}' WHEN 3 THEN '{\"final_audit_summary\": {}}' ELSE '{\"final_audit_summary\": {\"overall_trust_status\": \"' || event_type || '\", \"compliance_score_summary\": \"s' || user_id || '\"}}' END"


@query(
    "audit_log_list",
    f"""WITH l AS (SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, {LOG_JSON} AS j FROM events), g AS (SELECT *, CASE WHEN json_valid(j) THEN json_type(j) = 'OBJECT' ELSE false END AS ok FROM l)
    SELECT id, timestamp, CASE WHEN ok THEN coalesce(json_extract_string(j, '$.final_audit_summary.overall_trust_status'), 'Unknown') ELSE 'Error' END AS status, CASE WHEN ok THEN coalesce(json_extract_string(j, '$.final_audit_summary.compliance_score_summary'), 'N/A') ELSE 'Error' END AS summary FROM g""",
)
def audit_log_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.log_list(load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.expr(LOG_JSON).alias("audit_data_json")))


@query("audit_log_by_id", "SELECT event_id AS id, event_type, value FROM events WHERE event_id = 42")
def audit_log_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.log_by_id(load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", "value"), 42)


@query("upsert_chunks", f"WITH {CHUNKS} SELECT chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'new ' ELSE 'old ' END || length(chunk_text) AS state FROM c UNION ALL SELECT 'extra' || item_id, 'new 0' FROM benchmark")
def upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunked(spark, sf_dir)
    state = lambda s: F.concat(F.lit(s), F.length("chunk_text"))
    old = c.select("chunk_id", state("old ").alias("state"))
    new = c.filter("doc_id % 3 = 0").select("chunk_id", state("new ").alias("state"))
    extra = load(spark, sf_dir, "benchmark").select(F.concat(F.lit("extra"), "item_id").alias("chunk_id"), F.lit("new 0").alias("state"))
    return D.upserted(old, new.unionByName(extra))


@query("set_query_embedding", "SELECT event_id AS id, CASE WHEN vec_id IS NOT NULL THEN 'v' || label ELSE 'none' END AS query_embedding FROM events LEFT JOIN embeddings ON vec_id = event_id")
def set_query_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit("none").alias("query_embedding"))
    changes = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("v"), "label").alias("query_embedding"))
    return D.updated(logs, changes, "id", "query_embedding")


@query("conflict_cache_latest", "SELECT user_id, max_by(event_id, event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def conflict_cache_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.latest(load(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


RAW = "'```json' || chr(10) || '[{\"requirement_id\": \"R' || item_id || '\", \"requirement_text\": \"t' || length(text) || '\", \"category\": \"c\", \"regulatory_relevance\": [\"a\", \"b' || item_id % 3 || '\"]}, {\"category\": \"d\"}]' || chr(10) || '```'"


@query(
    "parse_requirements",
    "SELECT item_id AS answer_id, 0::BIGINT AS place, 'R' || item_id AS id, 't' || length(text) AS text, 'c' AS category, 'a, b' || item_id % 3 AS regulatory_relevance FROM benchmark WHERE item_id % 5 <> 0 UNION ALL SELECT item_id, 1, 'REQ-UNKNOWN', '', 'd', '' FROM benchmark WHERE item_id % 5 <> 0",
)
def parse_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(f"if(item_id % 5 = 0, '```json[{{bad', {RAW})")
    return R.requirements(load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("answer_id"), raw.alias("raw")))


@query(
    "compliance_score",
    FUSED + ", a AS (SELECT query_id, round(avg(dense_score), 6) AS alignment, count(*) FILTER (bm25_score = 0) AS n_violations FROM g WHERE rank <= 5 GROUP BY query_id) SELECT query_id, alignment, n_violations, round(100 * alignment * (1 - least(1.0::DOUBLE, 0.25::DOUBLE * n_violations)), 3) AS compliance_score FROM a",
)
def compliance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = hybrid(spark, sf_dir, DEFAULT.requirement_k)
    return R.compliance_score(top.groupBy("query_id").agg(F.round(F.avg("dense_score"), 6).alias("alignment"), F.count_if(F.col("bm25_score") == 0).alias("n_violations")))


@query("publication_filter", f"SELECT doc_id, publication_name FROM (SELECT doc_id, {DUCK_META} FROM documents) WHERE publication_name IN ('FSR', 'PSR')")
def publication_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").selectExpr("doc_id", f"lower({META[0]}) AS p").withColumn("publication_name", F.upper("p"))
    return rows.filter(F.col("publication_name").isin("FSR", "PSR")).select("doc_id", "publication_name")


@query("extension_filter", "SELECT page_id, lower(regexp_extract(url, '\\.([A-Za-z]+)$', 1)) AS extension FROM pages WHERE lower(regexp_extract(url, '\\.([A-Za-z]+)$', 1)) IN ('html', 'pdf', 'txt')")
def extension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", r"\.([A-Za-z]+)$", 1)).alias("extension")).filter(F.col("extension").isin("html", "pdf", "txt"))
