"""The queries of answers whose claims cite what was retrieved for their questions, and the same in SQL.

The benchmark's items are questions and, sentence by sentence, their answers. A sentence at an even place has its question's
vector, others have the next ones; a stand-in for the model judges by the lengths of claim and passage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import softmax
from ..operators import answers as A
from ..operators import evidence as E
from .catalogue import CLAIMS, COSINE, FUSED, NOISE, asked, library, load, query, related_at, related_sql, stored_chunks, vectors
from .reports import GATE, REASONS, fixed, quoted

_STRIP = "trim({}, E' \\t\\n\\r')"
SENTENCES = f"list_filter(list_transform(regexp_split_to_array(regexp_replace({{}}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_STRIP.format('x')}), lambda x: x <> '')"


def clean_sql(text: str) -> str:
    return f"array_to_string(list_filter(list_transform(string_split({text}, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: NOT {NOISE}), ' ')"


def prepared_sql(name: str, source: str) -> str:
    """CTEs that end in `name`: rows of source (answer_id, claim_idx, own) with `passage`, own or, above 60 words, its focus."""
    return f"""{name}_c AS (SELECT *, {clean_sql("own")} AS clean, len(list_filter(regexp_split_to_array(own, '\\s+'), lambda w: w <> '')) > 60 AS long FROM {source}),
 {name}_s AS (SELECT *, list_filter({SENTENCES.format("clean")}, lambda x: length(x) > 20) AS s FROM {name}_c),
 {name}_x AS (SELECT answer_id, claim_idx, key, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM {name}_s WHERE long),
 {name}_b AS (SELECT * FROM {name}_x QUALIFY row_number() OVER (PARTITION BY answer_id, claim_idx, key ORDER BY (length(x) * 37 + i - 1 + claim_idx) % 101 DESC, i) <= 3),
 {name}_j AS (SELECT answer_id, claim_idx, key, string_agg(x, ' ' ORDER BY i) AS focus FROM {name}_b GROUP BY ALL),
 {name} AS (SELECT s.*, CASE WHEN NOT long THEN own WHEN len(s.s) = 0 THEN left(CASE WHEN clean <> '' THEN clean ELSE own END, 800) ELSE focus END AS passage FROM {name}_s s LEFT JOIN {name}_j USING (answer_id, claim_idx, key))"""


def score(sentence: Column, place: Column) -> Column:
    """A stand-in for a sentence's similarity to the claim: a number from its length and both places."""
    return (F.length(sentence) * 37 + place + F.col("claim_idx")) % 101


_LOGITS = ("(length(claim_text) * 7 + length({0})) % 13 / 2e0", "(length(claim_text) + 3 * length({0})) % 11 / 1.5e0", "(length(claim_text) + length({0})) % 5 / 1e0")


def judge(pairs: DataFrame) -> DataFrame:
    logits = [F.expr(f"cast({x.format('focused_passage')} as double)") for x in _LOGITS]
    p = pairs.withColumn("p", softmax(F.array(*logits)))
    return p.select(*pairs.columns, *(F.round(F.col("p")[i], 6).alias(c) for i, c in enumerate(("contradiction", "entailment_score", "neutral"))))


def judge_sql(passage: str) -> str:
    a, b, c = (f"exp(({x.format(passage)})::DOUBLE)" for x in _LOGITS)
    return f"round({a} / ({a} + {b} + {c}), 6) AS contradiction, round({b} / ({a} + {b} + {c}), 6) AS entailment_score, round({c} / ({a} + {b} + {c}), 6) AS neutral"


CITED = (
    FUSED
    + f""", src AS (SELECT query_id AS answer_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS j FROM (SELECT query_id, section_id, chunk_id, rank FROM g JOIN c USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY query_id, section_id ORDER BY rank) = 1)),
 sn AS (SELECT answer_id, unnest(s) AS claim_text, generate_subscripts(s, 1) - 1 AS claim_idx FROM (SELECT item_id AS answer_id, {SENTENCES.format("text")} AS s FROM benchmark)),
 sv AS (SELECT answer_id, claim_idx, embedding AS e FROM sn JOIN embeddings ON vec_id = (answer_id * 17 + 5 + CASE WHEN claim_idx % 2 = 0 THEN 0 ELSE claim_idx END) % (SELECT count(*) FROM embeddings)),
 am AS (SELECT answer_id, claim_idx, j, chunk_id, {COSINE.format("sv.e", "v.embedding", 4)} AS score FROM sv JOIN src USING (answer_id) JOIN v USING (chunk_id)),
 ar AS (SELECT *, row_number() OVER (PARTITION BY answer_id, claim_idx ORDER BY score DESC, j) AS k FROM am),
 ab AS (SELECT answer_id, claim_idx, max(score) FILTER (k = 1) AS attribution_score, round(max(score) FILTER (k = 1) - coalesce(max(score) FILTER (k = 2), max(score) FILTER (k = 1)), 4) AS confidence_gap, max(chunk_id) FILTER (k = 1) AS best FROM ar WHERE k <= 2 GROUP BY ALL),
 ci AS (SELECT answer_id, claim_idx, claim_text, attribution_score, confidence_gap, confidence_gap < 0.02 AS ambiguous, CASE WHEN attribution_score >= 0.45 THEN best END AS chunk_id, CASE WHEN attribution_score >= 0.45 THEN attribution_score ELSE 0 END AS confidence FROM sn LEFT JOIN ab USING (answer_id, claim_idx)),
 ct AS (SELECT ci.*, publication_name, edition_date, section_id, chunk_text FROM ci LEFT JOIN c USING (chunk_id))"""
)
JUDGED = (
    CITED
    + f""", pa AS (SELECT *, 0 AS key, {clean_sql("coalesce(chunk_text, '')")} AS own FROM ct),
 {prepared_sql("pf", "pa")},
 vd AS (SELECT answer_id, claim_idx, claim_text, chunk_id, confidence, attribution_score, confidence_gap, ambiguous, false AS has_conflict, coalesce(publication_name, '') AS source_publication_name, coalesce(edition_date, '') AS source_edition_date, coalesce(section_id, '') AS source_section_id, passage, {judge_sql("passage")} FROM pf),
 k AS (SELECT *, CASE WHEN contradiction >= entailment_score AND contradiction >= neutral THEN 'CONTRADICTION' WHEN entailment_score >= neutral THEN 'ENTAILMENT' ELSE 'NEUTRAL' END AS verdict FROM vd)"""
)
_UNITS = ",\n " + CLAIMS[CLAIMS.index("u AS") :].strip()
_TOLD = quoted(E.EXPLANATION, fixed("entailment_score", 2), fixed("contradiction", 2), fixed("neutral", 2))


def question(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(chunks, chunks' vectors, what each question retrieved, its answer's sentences)."""
    chunks = stored_chunks(spark, sf_dir)
    q, v = vectors(spark, sf_dir)
    found = A.retrieved(library(spark, sf_dir), asked(spark, sf_dir).join(q, "query_id"), v)
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    n = F.broadcast(e.agg(F.count("*").alias("n")))
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("answer_id"), F.posexplode(T.sentences(F.col("text"))).alias("claim_idx", "claim_text")).withColumn("claim_idx", F.col("claim_idx").cast("long"))
    at = (F.col("answer_id") * 17 + 5 + F.when(F.col("claim_idx") % 2 == 0, 0).otherwise(F.col("claim_idx"))) % F.col("n")
    return chunks, v, found, items.crossJoin(n).withColumn("vec_id", at).join(e, "vec_id").select("answer_id", "claim_idx", "claim_text", "v")


def claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks, v, found, sentences = question(spark, sf_dir)
    return chunks, A.cited_claims(sentences, A.sources_of(found, chunks), v)


@query("cited_claims", CITED + f" SELECT answer_id, claim_idx, md5(claim_text) AS claim, coalesce(chunk_id, '') AS chunk_id, confidence, attribution_score, confidence_gap, ambiguous FROM ci")
def cited_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir)[1].select("answer_id", "claim_idx", F.md5("claim_text").alias("claim"), F.coalesce("chunk_id", F.lit("")).alias("chunk_id"), "confidence", "attribution_score", "confidence_gap", "ambiguous")


@query("judged_claims", JUDGED + f" SELECT answer_id, claim_idx, source_section_id, md5(passage) AS focused, contradiction, entailment_score, neutral, verdict, ambiguous, {_TOLD} AS explanation FROM k")
def judged_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims, sources, focused passages, verdicts and attributions, each in its answer's order, put together by place."""
    chunks, cited = claims(spark, sf_dir)
    rows = A.judged_claims(cited, chunks, judge, score)
    told = E.explanation(F.col("entailment_score"), F.col("contradiction"), F.col("neutral"))
    return rows.select("answer_id", "claim_idx", "source_section_id", F.md5("focused_passage").alias("focused"), "contradiction", "entailment_score", "neutral", "verdict", "ambiguous", told.alias("explanation"))


@query(
    "focused_entailment",
    CITED
    + f""", ps AS (SELECT answer_id, chunk_text, min(claim_idx) AS first_claim, arg_min(chunk_id, claim_idx) AS chunk_id FROM ct WHERE trim(chunk_text) <> '' GROUP BY ALL),
 pl AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY first_claim) AS place FROM ps),
 pp AS (SELECT answer_id, claim_idx, claim_text, pl.chunk_id, place, place AS key, pl.chunk_text AS own FROM ci JOIN pl USING (answer_id)),
 {prepared_sql("pf", "pp")}
 SELECT answer_id, claim_idx, place, chunk_id, length(passage) AS passage_length, {judge_sql("passage")} FROM pf""",
)
def focused_entailment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim with every passage that its answer cites, which is focused where it has more than 60 words."""
    chunks, cited = claims(spark, sf_dir)
    return A.entailment(cited, chunks, judge, score)


@query(
    "audited_answers",
    JUDGED
    + _UNITS
    + GATE
    + REASONS
    + f""", sh AS (SELECT answer_id, greatest(0, 10000 - sum(CASE verdict WHEN 'CONTRADICTION' THEN 3000 ELSE un + ul + um END + ua + uw))::DOUBLE / 10000 AS shapley_score, count(*) AS n_claims, count(chunk_id) AS n_cited, md5(string_agg(claim_text || '|' || source_section_id || '|' || passage || '|' || verdict || '|' || {_TOLD}, chr(10) ORDER BY claim_idx)) AS claims FROM u GROUP BY answer_id),
 rq AS (SELECT query_id, string_agg(id, ',' ORDER BY similarity DESC, id DESC) AS related FROM ({related_sql(0.3)}) GROUP BY query_id),
 sx AS (SELECT answer_id, count(*) AS n_sources, md5(string_agg('[' || publication_name || '·' || edition_date || '·' || section_id || '] ' || chunk_text, chr(10) || chr(10) ORDER BY j)) AS sources FROM src JOIN c USING (chunk_id) GROUP BY answer_id)
 SELECT item_id AS query_id, n_sources, sources, n_claims, n_cited, status, overall_score, shapley_score, faithfulness, card.cited_share, md5(reasoning) AS reasoning, coalesce(related, '') AS related, claims
 FROM benchmark JOIN sx ON item_id = sx.answer_id JOIN gate ON item_id = gate.answer_id JOIN reasons ON item_id = reasons.answer_id JOIN card ON item_id = card.answer_id JOIN sh ON item_id = sh.answer_id LEFT JOIN rq ON item_id = rq.query_id""",
)
def audited_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, v, found, sentences = question(spark, sf_dir)
    queries = asked(spark, sf_dir).select("query_id")
    out = A.answered(queries, sentences, found, chunks, v, related_at(spark, sf_dir, 0.3), judge, score)
    shown = F.array_join(F.transform("claims", lambda x: F.concat_ws("|", x["claim_text"], x["source_section_id"], x["focused_passage"], x["verdict"], x["explanation"])), "\n")
    cited = F.size(F.filter("claims", lambda x: x["confidence"] > 0)).cast("long")
    return out.select("query_id", "n_sources", F.md5("sources").alias("sources"), "n_claims", cited.alias("n_cited"), "status", "overall_score", "shapley_score", "faithfulness", "cited_share", F.md5("reasoning").alias("reasoning"), "related", F.md5(shown).alias("claims"))


_RAW = """CASE WHEN item_id % 7 = 0 THEN '{bad' WHEN item_id % 7 = 1 THEN NULL WHEN item_id % 7 = 2 THEN '{}' ELSE
 '{"alignment_score": ' || length(sources) % 101 || ', "gaps": ["g"], "violations": [' || CASE item_id % 3 WHEN 0 THEN '' WHEN 1 THEN '"v"' ELSE '"v", "w"' END || '], "risk_level": "' || CASE item_id % 2 WHEN 0 THEN 'HIGH' ELSE 'low' END || '", "overall_compliance_score": 70}' END"""


@query(
    "validated_requirements",
    FUSED
    + """, rs AS (SELECT query_id AS item_id, count(*) AS n_sections, md5(string_agg(chunk_text, '|' ORDER BY rank)) AS sections, string_agg('[' || publication_name || ' | ' || edition_date || ' | Section ' || section_id || ']' || chr(10) || chunk_text || chr(10) || chr(10), '' ORDER BY rank) AS sources FROM g JOIN c USING (chunk_id) WHERE rank <= 5 GROUP BY query_id),
 x AS (SELECT item_id AS id, n_sections, sections, item_id % 7 AS k, item_id % 3 AS v, (length(sources) % 101)::DOUBLE AS a FROM rs),
 y AS (SELECT *, CASE WHEN k < 2 THEN 50 WHEN k = 2 THEN 0 ELSE a END::DOUBLE AS alignment_score, CASE WHEN k < 3 THEN 0 ELSE v END AS n_violations FROM x)
 SELECT id, n_sections, sections, alignment_score, n_violations, CASE k WHEN 0 THEN 'JSON parsing failed' WHEN 1 THEN 'Unable to fully analyze requirement' WHEN 2 THEN '' ELSE 'g' END AS gaps, CASE WHEN k < 3 THEN 'Medium' WHEN id % 2 = 0 THEN 'High' ELSE 'Low' END AS risk_level,
        CASE WHEN k < 2 THEN 50 WHEN k = 2 THEN 0 ELSE 70 END::DOUBLE AS overall_compliance_score, round(100 * (alignment_score / 100) * (1 - least(1.0::DOUBLE, 0.25::DOUBLE * n_violations)), 3) AS compliance_score FROM y""",
)
def validated_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items as requirements; a stand-in for the model answers by their numbers and the length of what it reads."""
    q, v = vectors(spark, sf_dir)
    requirements = asked(spark, sf_dir).join(q, "query_id").select(F.col("query_id").alias("id"), F.col("query").alias("text"), "q")
    raw = F.expr(_RAW.replace("item_id", "id"))
    rows = A.validated(requirements, library(spark, sf_dir), v, lambda x: x.select("id", raw.alias("raw")))
    return rows.select("id", F.size("mapped_sections").cast("long").alias("n_sections"), F.md5(F.array_join("mapped_sections", "|")).alias("sections"), "alignment_score", "n_violations", F.array_join("gaps", "; ").alias("gaps"), "risk_level", "overall_compliance_score", "compliance_score")
