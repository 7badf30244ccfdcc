"""The queries of the answer pipeline and the catalogue's tables, and the same in SQL; registered beside the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import doubles, softmax, unit
from ..operators import answers as A
from ..operators import documents as D
from ..operators import evidence as E
from ..operators import reports as R
from ..operators import retrieval as Q
from ..params import DEFAULT
from ..shared import new_folder, stored
from ..sources.buckets import Bucketed
from ..sources.files import uploads
from ..sources.tables import SCHEMAS
from .catalogue import edition_sections as sections_of_editions
from .catalogue import CHUNKS, CLAIMS, COSINE, DUCK_META, FUSED, LINES, META, NOISE, SECTIONS, SIMILAR, asked, bm25_topk, chunk_ids, claims, dense_topk, hybrid, library, load, paged, query, related_at, related_sql, similar, stored_chunks, vectors


def fixed(x: str, n: int) -> str:
    return f"printf('%.{n}f', ({x})::DOUBLE)"


def quoted(pattern: str, *values: str) -> str:
    """A pattern's texts and values, joined in SQL."""
    parts = ["'" + p.replace("'", "''") + "'" for p in pattern.split("{}")]
    return "concat(" + ", ".join(x for pair in zip(parts, [*values, "''"], strict=True) for x in pair) + ")"


GATE = """, gate AS (SELECT answer_id, greatest(0, 10000 - sum(uc + un + ul + um + ua + uw) - CASE WHEN bool_or(has_conflict) THEN 5000 ELSE 0 END)::DOUBLE / 10000 AS overall_score,
 CASE WHEN bool_or(uc > 0 OR ul > 0 OR has_conflict) THEN 'Non_Compliant' WHEN bool_or(un > 0 OR um > 0 OR uw > 0 OR ua > 0) THEN 'Needs_Human_Review' ELSE 'Safe' END AS status FROM u GROUP BY answer_id),
 card AS (SELECT answer_id, round(avg((verdict = 'ENTAILMENT')::INT), 6) AS faithfulness, round(avg((trim(source_section_id) <> '')::INT), 6) AS cited_share FROM u GROUP BY answer_id)"""
_SCORE, _START = fixed("entailment_score", 2), "left(claim_text, 60)"
_GAP, _ATTRIBUTION = fixed("confidence_gap", 4), fixed("attribution_score", 4)
REASONS = f""", said AS (
 SELECT answer_id, 0 AS kind, 0 AS pos, 0 AS step, '{E.CONFLICT_REASON}' AS what FROM u GROUP BY answer_id HAVING bool_or(has_conflict)
 UNION ALL SELECT answer_id, 1, claim_idx, 0, {quoted(E.CONTRADICTION_REASON, _START)} FROM u WHERE uc > 0
 UNION ALL SELECT answer_id, 1, claim_idx, 0, {quoted(E.NEUTRAL_REASON, _START)} FROM u WHERE un > 0
 UNION ALL SELECT answer_id, 1, claim_idx, 1, {quoted(E.LOW_REASON, _SCORE)} FROM u WHERE ul > 0
 UNION ALL SELECT answer_id, 1, claim_idx, 1, {quoted(E.MEDIUM_REASON, _SCORE)} FROM u WHERE um > 0
 UNION ALL SELECT answer_id, 2, claim_idx, 0, {quoted(E.AMBIGUOUS_REASON, _GAP, 'claim_idx')} FROM u WHERE ua > 0
 UNION ALL SELECT answer_id, 2, claim_idx, 0, {quoted(E.WEAK_REASON, _ATTRIBUTION, 'claim_idx')} FROM u WHERE uw > 0),
 reasons AS (SELECT answer_id, coalesce(string_agg(what, ' | ' ORDER BY kind, pos, step), '{E.SAFE_REASON}') AS reasoning FROM (SELECT DISTINCT answer_id FROM u) LEFT JOIN said USING (answer_id) GROUP BY answer_id)"""


@query(
    "entailment_matrix",
    CLAIMS
    + """, f AS (SELECT answer_id, source_section_id AS passage, min(claim_idx) AS first_claim FROM k WHERE trim(source_section_id) <> '' GROUP BY ALL),
 g AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY first_claim) AS place FROM f),
 m AS (SELECT answer_id, claim_idx, passage, place, exp(8 * (c.v[1] + p.v[1])) AS a, exp(8 * (c.v[2] + p.v[2])) AS b, exp(8 * (c.v[3] + p.v[3])) AS c FROM k JOIN g USING (answer_id) JOIN e c ON c.vec_id = claim_idx JOIN e p ON p.vec_id = first_claim)
 SELECT answer_id, claim_idx, passage, place, round(a / (a + b + c), 6) AS contradiction, round(b / (a + b + c), 6) AS entailment, round(c / (a + b + c), 6) AS neutral FROM m""",
)
def entailment_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = claims(spark, sf_dir).join(load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("claim_idx"), doubles(F.slice("embedding", 1, 3)).alias("v")), "claim_idx")
    passages = own.select("answer_id", "claim_idx", F.col("source_section_id").alias("passage"), F.col("v").alias("pv"))
    pairs = E.entailment_pairs(own.select("answer_id", "claim_idx", "v"), passages).withColumn("p", softmax(F.zip_with("v", "pv", lambda x, y: 8 * (x + y))))
    return pairs.select("answer_id", "claim_idx", "passage", "place", *(F.round(F.col("p")[i], 6).alias(c) for i, c in enumerate(("contradiction", "entailment", "neutral"))))


@query("verified_claims", CLAIMS + GATE + f" SELECT answer_id, claim_idx, verdict, entailment_score, {quoted(E.EXPLANATION, _SCORE, fixed('contradiction', 2), fixed('neutral', 2))} AS explanation, overall_score, status, faithfulness, cited_share FROM u JOIN gate USING (answer_id) JOIN card USING (answer_id)")
def verified_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.verified(claims(spark, sf_dir))


@query("gate_reasoning", CLAIMS + REASONS + " SELECT * FROM reasons")
def gate_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.gate_reasons(claims(spark, sf_dir))


@query(
    "shapley_reasons",
    CLAIMS
    + f"SELECT answer_id, claim_idx, concat_ws(', ', CASE WHEN verdict = 'CONTRADICTION' THEN 'contradiction' END, CASE WHEN un > 0 THEN 'neutral' END, CASE WHEN verdict <> 'CONTRADICTION' AND ul > 0 THEN {quoted(E.PENALTY_REASONS['low'], _SCORE)} END,"
    f" CASE WHEN verdict <> 'CONTRADICTION' AND um > 0 THEN {quoted(E.PENALTY_REASONS['mid'], _SCORE)} END, CASE WHEN ua > 0 THEN {quoted(E.PENALTY_REASONS['ambiguous'], _GAP)} END, CASE WHEN uw > 0 THEN {quoted(E.PENALTY_REASONS['weak'], _ATTRIBUTION)} END) AS penalty_reasons FROM u",
)
def shapley_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.penalty_reasons(claims(spark, sf_dir)).withColumn("penalty_reasons", F.array_join("penalty_reasons", ", "))


@query(
    "claim_breakdown",
    CLAIMS
    + f"SELECT answer_id, claim_idx, CASE WHEN length(claim_text) > 80 THEN left(claim_text, 80) || '...' ELSE claim_text END AS claim_text, verdict, (uc + un + ul + um) / 10000 AS phi, concat_ws('; ', CASE WHEN uc > 0 THEN '{E.BREAKDOWN_REASONS['contradiction']}' END, CASE WHEN un > 0 THEN '{E.BREAKDOWN_REASONS['neutral']}' END,"
    f" CASE WHEN ul > 0 THEN {quoted(E.BREAKDOWN_REASONS['low'], fixed('entailment_score', 3))} END, CASE WHEN um > 0 THEN {quoted(E.BREAKDOWN_REASONS['mid'], fixed('entailment_score', 3))} END) AS penalty_reasons FROM u",
)
def claim_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.claim_breakdown(claims(spark, sf_dir)).withColumn("penalty_reasons", F.array_join("penalty_reasons", "; "))


@query(
    "marginal_contributions",
    CLAIMS
    + ", f AS (SELECT answer_id, claim_idx, uc + un + ul + um + ua + uw AS units, sum(uc + un + ul + um + ua + uw) OVER (PARTITION BY answer_id) AS total FROM u) SELECT answer_id, claim_idx, (greatest(0, 10000 - (total - units)) - greatest(0, 10000 - total))::DOUBLE / 10000 AS phi FROM f",
)
def marginal_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.marginal(claims(spark, sf_dir))


@query("sentence_sources", f"WITH {SIMILAR}, m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, j) = 1), c AS (SELECT vec_id AS j, vec_id // 20 AS answer_id, 'S' || vec_id % 5 AS section_id, 'label ' || label AS chunk_text FROM embeddings) SELECT m.answer_id, i, CASE WHEN score >= 0.45 THEN m.j END AS j, CASE WHEN score >= 0.45 THEN score ELSE 0 END AS confidence, CASE WHEN score >= 0.45 THEN section_id ELSE '' END AS section_id, CASE WHEN score >= 0.45 THEN chunk_text ELSE '' END AS chunk_text FROM m JOIN c ON c.j = m.j")
def sentence_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = load(spark, sf_dir, "embeddings").selectExpr("vec_id AS j", "vec_id div 20 AS answer_id", "concat('S', vec_id % 5) AS section_id", "concat('label ', label) AS chunk_text")
    return E.sourced(E.attributed(similar(spark, sf_dir)), chunks)


_SENTENCES = "list_filter(list_transform(regexp_split_to_array(regexp_replace(clean, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, E' \\t\\n\\r')), lambda x: length(x) > 20)"


@query(
    "top_sentences",
    f"""WITH t AS (SELECT doc_id, text, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \\t\\n\\r')), lambda x: NOT {NOISE}), ' ') AS clean FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, text, clean, {_SENTENCES} AS s FROM t), x AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM s),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (length(x) * 37 + i - 1) % 101 DESC, i) AS k FROM x QUALIFY k <= 3), j AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS focused FROM b GROUP BY doc_id)
    SELECT doc_id, md5(CASE WHEN len(s) = 0 THEN left(CASE WHEN clean <> '' THEN clean ELSE text END, 800) ELSE focused END) AS digest, len(s) AS n_sentences FROM s LEFT JOIN j USING (doc_id)""",
)
def top_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for a sentence's similarity: a number from its length and place."""
    score = lambda x, i: (F.length(x) * 37 + i) % 101
    p = DEFAULT
    text = T.focused(F.col("text"), score, p.min_sentence, p.top_sentences, p.passage_cut)
    n = F.size(F.filter(T.sentences(T.strip_noise(F.col("text"))), lambda x: F.length(x) > p.min_sentence))
    return load(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(text).alias("digest"), n.cast("long").alias("n_sentences"))


@query("retrieved_chunks", FUSED + "SELECT query_id, rank, publication_name, edition_date, section_id, md5(chunk_text) AS digest FROM g JOIN c USING (chunk_id)")
def retrieved_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir).join(stored_chunks(spark, sf_dir), "chunk_id").select("query_id", "rank", "publication_name", "edition_date", "section_id", F.md5("chunk_text").alias("digest"))


@query("retrieval_records", FUSED + "SELECT query_id, chunk_id, concat_ws('_', publication_name, edition_date, section_id, 'c' || (rank - 1)) AS record_id, section_id, publication_name, edition_date, dense_score, bm25_score, rrf_score, rank FROM g JOIN c USING (chunk_id)")
def retrieval_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.score_records(hybrid(spark, sf_dir), chunk_ids(spark, sf_dir)).select("query_id", "chunk_id", "record_id", "section_id", "publication_name", "edition_date", "dense_score", "bm25_score", "rrf_score", "rank")


@query("requirement_sources", FUSED + "SELECT query_id, md5(string_agg('[' || publication_name || ' | ' || edition_date || ' | Section ' || section_id || ']' || chr(10) || chunk_text || chr(10) || chr(10), '' ORDER BY rank)) AS digest FROM g JOIN c USING (chunk_id) WHERE rank <= 5 GROUP BY query_id")
def requirement_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hybrid(spark, sf_dir, DEFAULT.requirement_k).join(stored_chunks(spark, sf_dir), "chunk_id")
    return Q.formatted(rows, "rank", wide=True).select("query_id", F.md5("sources").alias("digest"))


@query(
    "hybrid_by_key",
    FUSED
    + """, ck AS (SELECT chunk_id, publication_name, edition_date, left(section_id, 1) AS section_id, left(chunk_text, 80) AS head FROM c),
 l AS (SELECT query_id, chunk_id, dr AS k, dense_score, NULL::DOUBLE AS bm25_score, dr, NULL AS sr FROM d UNION ALL SELECT query_id, chunk_id, sr, NULL, bm25_score, NULL, sr FROM sp),
 h AS (SELECT query_id, publication_name, edition_date, section_id, head, round(sum(1.0::DOUBLE / (60 + k)), 8) AS rrf_score, coalesce(max_by(dense_score, dr) FILTER (dr IS NOT NULL), 0) AS dense_score, coalesce(max_by(bm25_score, sr) FILTER (sr IS NOT NULL), 0) AS bm25_score, min(dr) AS d1, min(sr) AS s1,
       coalesce(max_by(chunk_id, sr) FILTER (sr IS NOT NULL), max_by(chunk_id, dr) FILTER (dr IS NOT NULL)) AS chunk_id FROM l JOIN ck USING (chunk_id) GROUP BY ALL)
 SELECT query_id, chunk_id, rrf_score, dense_score, bm25_score, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, d1 NULLS LAST, s1 NULLS LAST) AS rank FROM h QUALIFY rank <= 10""",
)
def hybrid_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion where rows are one by publication, edition, section and the first 80 characters; sections are broad here, so that rows do meet."""
    key = ("publication_name", "edition_date", "section_id", "head")
    heads = stored_chunks(spark, sf_dir).select("chunk_id", "publication_name", "edition_date", F.substring("section_id", 1, 1).alias("section_id"), F.substring("chunk_text", 1, 80).alias("head"))
    dense, sparse = dense_topk(spark, sf_dir), bm25_topk(spark, sf_dir)
    keyed = lambda rows: rows.join(heads, "chunk_id")
    return Q.fused(keyed(dense), keyed(sparse), DEFAULT.final_k, keys=key).drop(*key)


@query(
    "answer_report",
    FUSED
    + ","
    + CLAIMS.strip().removeprefix("WITH")
    + GATE
    + REASONS
    + f""", sh AS (SELECT answer_id, greatest(0, 10000 - sum(CASE verdict WHEN 'CONTRADICTION' THEN 3000 ELSE un + ul + um END + ua + uw))::DOUBLE / 10000 AS shapley_score, count(*) AS n_claims FROM u GROUP BY answer_id),
 rq AS (SELECT query_id, string_agg(id, ',' ORDER BY similarity DESC, id DESC) AS related FROM ({related_sql(0.3)}) GROUP BY query_id),
 so AS (SELECT query_id, rank, section_id, '[' || publication_name || '·' || edition_date || '·' || section_id || '] ' || chunk_text AS b FROM g JOIN c USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY query_id, section_id ORDER BY rank) = 1),
 sx AS (SELECT query_id, count(*) AS n_sources, string_agg(b, chr(10) || chr(10) ORDER BY rank) AS sources FROM so GROUP BY query_id)
 SELECT item_id AS query_id, coalesce(n_sources, 0) AS n_sources, md5(coalesce(sources, '')) AS digest, coalesce(n_claims, 0) AS n_claims, coalesce(status, 'Safe') AS status, coalesce(overall_score, 1) AS overall_score, coalesce(shapley_score, 1) AS shapley_score,
        coalesce(faithfulness, 1) AS faithfulness, md5(coalesce(reasoning, '{E.SAFE_REASON}')) AS reasoning, coalesce(related, '') AS related
 FROM benchmark LEFT JOIN sx ON item_id = sx.query_id LEFT JOIN gate ON item_id = gate.answer_id LEFT JOIN reasons ON item_id = reasons.answer_id LEFT JOIN card ON item_id = card.answer_id LEFT JOIN sh ON item_id = sh.answer_id LEFT JOIN rq ON item_id = rq.query_id""",
)
def answer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = stored_chunks(spark, sf_dir)
    q, v = vectors(spark, sf_dir)
    queries = asked(spark, sf_dir).join(q, "query_id")
    found = A.retrieved(library(spark, sf_dir), queries, v)
    related = related_at(spark, sf_dir, 0.3)
    out = A.audited(queries, found, chunks, claims(spark, sf_dir), related)
    return out.select("query_id", "n_sources", F.md5("sources").alias("digest"), "n_claims", "status", "overall_score", "shapley_score", "faithfulness", F.md5("reasoning").alias("reasoning"), "related")


INGESTED = f"""t AS (SELECT doc_id, {LINES} AS text FROM documents WHERE text <> ''), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos, text FROM t),
    k AS (SELECT doc_id, pos, trim(line, E' \\t\\n\\r') AS x, text, regexp_matches(trim(line, E' \\t\\n\\r'), '^\\d+\\.\\d+ Topic Number$') AS head FROM l WHERE trim(line, E' \\t\\n\\r') <> ''),
    o AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY doc_id ORDER BY pos) AS section_ord FROM k),
    z AS (SELECT doc_id, section_ord, regexp_extract(max(x) FILTER (head), '^(\\S+)', 1) AS section_id, coalesce(string_agg(x, chr(10) ORDER BY pos) FILTER (NOT head), '') AS text FROM o WHERE section_ord > 0 GROUP BY ALL
          UNION ALL SELECT doc_id, 1, 'UNSTRUCTURED-p1', any_value(text) FROM o GROUP BY doc_id HAVING max(section_ord) = 0),
    w AS (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM z),
    s AS (SELECT *, unnest(CASE WHEN len(w) <= 512 THEN [0] ELSE range(0, len(w) - 50, 462) END) AS start FROM w WHERE len(w) > 0),
    i AS (SELECT doc_id, {DUCK_META.rsplit(", concat", 1)[0]}, section_ord, section_id, CASE WHEN len(w) <= 512 THEN text ELSE array_to_string(list_slice(w, start + 1, start + 512), ' ') END AS chunk_text, row_number() OVER (PARTITION BY doc_id ORDER BY section_ord, start) - 1 AS chunk_idx FROM s)"""


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.ingested(paged(spark, sf_dir).withColumns({"publication_name": F.expr(META[0]), "edition_date": F.expr(META[1])}))


@query("ingest_chunks", f"WITH {INGESTED} SELECT doc_id, chunk_idx, concat_ws('_', publication_name, edition_date, section_id, 'chunk' || chunk_idx) AS chunk_id, 1 AS page_number, md5(chunk_text) AS digest FROM i")
def ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingested(spark, sf_dir).select("doc_id", "chunk_idx", "chunk_id", "page_number", F.md5("chunk_text").alias("digest"))


@query("ingest_counts", f"WITH {INGESTED} SELECT doc_id, count(DISTINCT section_ord) AS n_sections, count(*) AS n_chunks FROM i GROUP BY doc_id")
def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.ingest_counts(ingested(spark, sf_dir))


#: Pages of a line each, of which four documents' worth make one, so that ranges of pages cut its sections.
_LONG = f"""t AS (SELECT doc_id, {LINES} AS text FROM documents WHERE text <> ''), l AS (SELECT doc_id // 200 AS book, unnest(string_split(text, chr(10))) AS line, doc_id % 200 * 4000 + generate_subscripts(string_split(text, chr(10)), 1) AS page_number FROM t),
    k AS (SELECT book, page_number, trim(line, E' \\t\\n\\r') AS x, regexp_matches(trim(line, E' \\t\\n\\r'), '^\\d+\\.\\d+ Topic Number$') AS head FROM l),
    o AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY book ORDER BY page_number) AS section_ord FROM k)"""


@query("long_document_sections", f"WITH {_LONG} SELECT book, section_ord, regexp_extract(max(x) FILTER (head), '^(\\S+)', 1) AS section_id, min(page_number) AS start_page, md5(coalesce(string_agg(x, chr(10) ORDER BY page_number) FILTER (NOT head AND x <> ''), '')) AS digest FROM o WHERE section_ord > 0 GROUP BY book, section_ord")
def long_document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred documents are one of very many pages, a line each; its pages are ranges of a thousand."""
    lines = paged(spark, sf_dir).filter("text <> ''").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    pages = lines.select(F.expr("doc_id div 200").alias("doc_id"), (F.col("doc_id") % 200 * 4000 + F.col("i") + 1).alias("page_number"), "text")
    return D.sections(pages, span=1000).select(F.col("doc_id").alias("book"), "section_ord", "section_id", "start_page", F.md5("text").alias("digest"))


FILES = "SELECT doc_id, 'f' || doc_id || '.pdf' AS filename, '2024-03-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS ingested_at FROM documents"
REGISTERED = f"""r AS (SELECT item_id + 1 AS id, 'old' || item_id AS filename, 'MPR' AS publication_name, 'June 2024' AS edition_date, 3 AS chunk_count, '2024-02-' || lpad((item_id % 28 + 1)::VARCHAR, 2, '0') AS ingested_at FROM benchmark),
    m AS (SELECT doc_id, any_value(publication_name) AS publication_name, any_value(edition_date) AS edition_date, count(*) AS chunk_count FROM c GROUP BY doc_id), f AS ({FILES}),
    a AS (SELECT * FROM r UNION ALL SELECT (SELECT max(id) FROM r) + row_number() OVER (ORDER BY ingested_at, filename), filename, publication_name, edition_date, coalesce(chunk_count, 0), ingested_at FROM f LEFT JOIN m USING (doc_id))"""


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = load(spark, sf_dir, "benchmark").selectExpr("item_id + 1 AS id", "concat('old', item_id) AS filename", "'MPR' AS publication_name", "'June 2024' AS edition_date", "3L AS chunk_count", "concat('2024-02-', lpad(item_id % 28 + 1, 2, '0')) AS ingested_at")
    files = load(spark, sf_dir, "documents").selectExpr("doc_id", "concat('f', doc_id, '.pdf') AS filename", "concat('2024-03-', lpad(doc_id % 28 + 1, 2, '0')) AS ingested_at")
    return D.registered(old, chunk_ids(spark, sf_dir), files)


@query("register_documents", f"WITH {CHUNKS}, {REGISTERED} SELECT * FROM a")
def register_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registered(spark, sf_dir)


@query("documents_newest", f"WITH {CHUNKS}, {REGISTERED} SELECT id, filename, ingested_at, row_number() OVER (ORDER BY ingested_at DESC, id DESC) AS place FROM a QUALIFY place <= 100")
def documents_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.newest(registered(spark, sf_dir).select("id", "filename", "ingested_at"), [F.desc("ingested_at"), F.desc("id")], 100)


@query("edition_sections", f"WITH {CHUNKS} SELECT publication_name, edition_date, section_id, min_by('T' || doc_id, doc_id) AS section_title, min_by(doc_id % 7 + 1, doc_id) AS page_number, count(*) AS chunk_count, (SELECT count(DISTINCT section_id) FROM c AS b WHERE b.publication_name = 'MPR' AND b.edition_date = 'June 2024' AND b.section_id <= c.section_id) AS place FROM c WHERE publication_name = 'MPR' AND edition_date = 'June 2024' GROUP BY publication_name, edition_date, section_id")
def edition_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk_ids(spark, sf_dir).withColumns({"section_title": F.concat(F.lit("T"), "doc_id"), "page_number": F.col("doc_id") % 7 + 1})
    return D.list_sections(rows, "MPR", "June 2024")


@query("replace_edition", f"WITH {CHUNKS}, n AS (SELECT 'new' || item_id AS chunk_id, (['MPR', 'FSR'])[item_id % 2 + 1] AS publication_name, 'June 2024' AS edition_date FROM benchmark) SELECT chunk_id, publication_name, edition_date FROM c WHERE NOT (publication_name IN ('MPR', 'FSR') AND edition_date = 'June 2024') UNION ALL SELECT * FROM n")
def replace_edition(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = load(spark, sf_dir, "benchmark").selectExpr("concat('new', item_id) AS chunk_id", "if(item_id % 2 = 0, 'MPR', 'FSR') AS publication_name", "'June 2024' AS edition_date")
    return D.replaced_editions(chunk_ids(spark, sf_dir).select("chunk_id", "publication_name", "edition_date"), new)


@query("audit_logs_newest", "SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, row_number() OVER (ORDER BY strftime(ts, '%Y-%m-%d %H:%M:%S') DESC, event_id DESC) AS place FROM events QUALIFY place <= 200")
def audit_logs_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))
    return D.newest(logs, [F.desc("timestamp"), F.desc("id")], DEFAULT.history)


_NEW_LOGS = "SELECT '2030-01-' || lpad((item_id % 28 + 1)::VARCHAR, 2, '0') AS timestamp, 'q' || item_id AS query, CASE WHEN item_id % 3 = 0 THEN '' ELSE 'Safe' END AS status FROM benchmark"


@query(
    "audit_append",
    f"WITH o AS (SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, event_type AS query, 'Safe' AS status, NULL AS response_json, NULL AS audit_data_json FROM events), n AS ({_NEW_LOGS}) SELECT * FROM o UNION ALL SELECT (SELECT max(id) FROM o) + row_number() OVER (ORDER BY timestamp, query), timestamp, query, status, 'said ' || query, json_object('query', query, 'status', status)::VARCHAR FROM n",
)
def audit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("event_type").alias("query"), F.lit(None).cast("string").alias("response_json"), F.lit("Safe").alias("status"), F.lit(None).cast("string").alias("audit_data_json"))
    new = load(spark, sf_dir, "benchmark").selectExpr("concat('2030-01-', lpad(item_id % 28 + 1, 2, '0')) AS timestamp", "concat('q', item_id) AS query", "if(item_id % 3 = 0, '', 'Safe') AS status")
    return R.appended_logs(old, new.withColumns({"audit_data_json": R.as_report(["query", "status"]), "response_json": F.concat(F.lit("said "), "query")}))


@query("audit_log_defaults", "SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN '' ELSE 't' || event_id END AS timestamp, CASE WHEN event_id % 3 < 2 THEN 'unknown' ELSE event_type END AS status FROM events")
def audit_log_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = load(spark, sf_dir, "events").selectExpr("event_id AS id", "if(event_id % 4 = 0, null, concat('t', event_id)) AS timestamp", "case event_id % 3 when 0 then null when 1 then '' else event_type end AS status")
    return R.defaulted(logs)


JUDGEMENTS = "CASE item_id % 5 WHEN 0 THEN '{bad' WHEN 1 THEN '{}' WHEN 2 THEN '```json{\"alignment_score\": ' || item_id || ', \"risk_level\": \"hIGH\"}```' ELSE '{\"alignment_score\": 80, \"gaps\": [\"g' || item_id || '\", \"h\"], \"violations\": [\"v\"], \"risk_level\": \"low\", \"overall_compliance_score\": 75, \"remediation_suggestions\": [\"r\"]}' END"


@query(
    "mapper_results",
    "WITH b AS (SELECT item_id AS id, item_id % 5 AS k FROM benchmark) SELECT id, CASE k WHEN 0 THEN 50 WHEN 1 THEN 0 WHEN 2 THEN id ELSE 80 END::DOUBLE AS alignment_score, CASE k WHEN 0 THEN 'JSON parsing failed' WHEN 1 THEN '' WHEN 2 THEN '' ELSE 'g' || id || '; h' END AS gaps, CASE WHEN k > 2 THEN 'v' ELSE '' END AS violations,"
    " CASE k WHEN 0 THEN 'Medium' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Low' END AS risk_level, CASE k WHEN 0 THEN 50 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE 75 END::DOUBLE AS overall_compliance_score, CASE k WHEN 0 THEN 'Retry analysis' WHEN 1 THEN '' WHEN 2 THEN '' ELSE 'r' END AS remediation_suggestions, alignment_score / 100 AS alignment FROM b",
)
def mapper_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.mapped(load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.expr(JUDGEMENTS).alias("raw")))
    return rows.withColumns({c: F.array_join(c, "; ") for c in ("gaps", "violations", "remediation_suggestions")})


@query("file_names", "SELECT page_id, string_split(url, '/')[-1] AS file, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) AS extension FROM pages")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", T.basename(F.col("url")).alias("file"), T.extension(F.col("url")).alias("extension"))


@query("upload_verdicts", "SELECT page_id, CASE WHEN lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) NOT IN ('pdf', 'html', 'txt') THEN 'unsupported' WHEN page_id % 4 = 0 THEN 'empty' WHEN page_id % 4 = 1 THEN 'too large' ELSE 'ok' END AS verdict FROM pages")
def upload_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = load(spark, sf_dir, "pages").selectExpr("page_id", "url AS path", "case page_id % 4 when 0 then 0L when 1 then 20000000L else page_id end AS length")
    return uploads(listed, ("pdf", "html", "txt")).select("page_id", "verdict")


@query("json_vectors", "SELECT vec_id, CASE WHEN vec_id % 5 > 1 THEN vec_id + vec_id % 7 END::DOUBLE AS total FROM embeddings")
def json_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings from JSON texts; malformed ones are null."""
    text = F.expr("case vec_id % 5 when 0 then '{bad' when 1 then null else concat('[', vec_id, ', ', vec_id % 7, ']') end")
    return load(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(E.vector(text), F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("unit_vectors", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, round(v[-1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS last FROM e")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings").select("vec_id", unit(F.col("embedding")).alias("u"))
    return e.select("vec_id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.element_at("u", -1), 6).alias("last"))


_CACHED = f"""s AS ({SECTIONS}), p AS (SELECT o.publication, o.section_id, o.edition AS edition_a, n.edition AS edition_b, {COSINE.format('o.embedding', 'n.embedding', 6)} AS cosine_sim FROM s o JOIN s n USING (publication, section_id) WHERE o.edition_no < n.edition_no),
 r AS (SELECT *, cosine_sim < 0.75 AS has_conflict, row_number() OVER (ORDER BY publication, section_id) AS i, count(*) OVER () AS n FROM p)"""


@query(
    "conflict_cache_append",
    f"WITH {_CACHED} SELECT i AS id, publication, section_id, edition_a, edition_b, cosine_sim, has_conflict, edition_b AS authoritative, '2024-01-01T00:00:00' AS cached_at FROM r UNION ALL SELECT n + row_number() OVER (ORDER BY publication, section_id), publication, section_id, edition_a, edition_b, cosine_sim, has_conflict, edition_b, '2024-02-01T00:00:00' FROM r WHERE has_conflict",
)
def conflict_cache_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of editions go into an empty cache, and those in conflict once more; the cache is a stored table of buckets."""
    pairs = E.section_pairs(sections_of_editions(spark, sf_dir), same_section=True)
    s, has, _, _ = E.cosine_conflict(F.col("old.embedding"), F.col("new.embedding"))
    found = stored(pairs.select("publication", F.col("old.section_id").alias("section_id"), F.col("old.edition").alias("edition_a"), F.col("new.edition").alias("edition_b"), s.alias("cosine_sim"), has.alias("has_conflict")), "conflicts")
    cache = Bucketed(spark, new_folder(spark, "cache"), SCHEMAS["edition_conflict_cache"], "id", 8)
    order = [F.col("publication"), F.col("section_id")]
    cache.append(E.cache_rows(found, F.lit("2024-01-01T00:00:00")), order)
    cache.append(E.cache_rows(found.filter("has_conflict"), F.lit("2024-02-01T00:00:00")), order)
    return cache.read()


@query("bucketed_upserts", "SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'new' ELSE event_type END AS event_type, CASE WHEN event_id % 500 = 0 THEN -1 WHEN event_id % 50 = 0 THEN 2 ELSE 1 END AS version FROM events UNION ALL SELECT -1 - item_id, 'added', 2 FROM benchmark")
def bucketed_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stored table that two upserts, the second of which comes twice, and an update change."""
    table = Bucketed(spark, new_folder(spark, "events"), "event_id long, event_type string, version int", "event_id", 16)
    events = load(spark, sf_dir, "events").select("event_id", "event_type", F.lit(1).alias("version"))
    table.upsert(events, "version")
    more = events.filter("event_id % 50 = 0").select("event_id", F.lit("new").alias("event_type"), F.lit(2).alias("version"))
    more = more.unionByName(load(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("event_id"), F.lit("added").alias("event_type"), F.lit(2).alias("version")))
    for _ in range(2):
        table.upsert(more.unionByName(more.withColumns({"event_type": F.lit("older"), "version": F.lit(0)})), "version")
    table.update(events.filter("event_id % 500 = 0").select("event_id", F.lit(-1).alias("version")), "version")
    return table.read()
