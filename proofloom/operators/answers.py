"""From questions to audited answers: what retrieval, claims and history say of each, in one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..params import DEFAULT, Params
from ..shared import stored
from . import evidence as E
from . import reports as R
from . import retrieval as Q
from .library import Library

#: Fixed value: what a requirement's judge reads where nothing was found.
NO_SECTIONS = "No relevant RBI sections found for this requirement."
#: What a claim takes from its source; empty where nothing supports it.
SOURCE = ("publication_name", "edition_date", "section_id")


def retrieved(library: Library, queries: DataFrame, vectors: DataFrame, k: int = DEFAULT.final_k, filters: dict[str, str] | None = None, p: Params = DEFAULT) -> DataFrame:
    """Hybrid retrieval of queries (query_id, query, q): each one's k best chunks with their scores and rank; none if nothing is stored.

    vectors: of the library's chunks, by chunk_id. Only chunks that match the filters are compared and ranked.
    """
    if not library.is_built:
        return Q.fused(Q.dense_topk(queries.limit(0), vectors.limit(0), p.dense_k, p), library.topk(queries, p.sparse_k, filters, p), k, p)
    own = vectors.join(library.chunks(filters).select("chunk_id"), "chunk_id", "left_semi") if filters else vectors
    return Q.fused(Q.dense_topk(queries, own, p.dense_k, p), library.topk(queries, p.sparse_k, filters, p), k, p)


def sources_of(found: DataFrame, keys: DataFrame, dedup: tuple[str, ...] = ("section_id",)) -> DataFrame:
    """(answer_id, j, chunk_id) of found (query_id, chunk_id, rank): the first chunk of each section, in their order from 0.

    keys: chunks' ids and what they are deduplicated by; no texts are needed.
    """
    first = Q.first_of(found.join(keys.select("chunk_id", *dedup), "chunk_id"), ["query_id", *dedup], "rank")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1
    return first.select(F.col("query_id").alias("answer_id"), place.cast("long").alias("j"), "chunk_id")


def support(sentences: DataFrame, sources: DataFrame, vectors: DataFrame) -> DataFrame:
    """(answer_id, i, j, score) of every sentence (answer_id, claim_idx, v) with every source (answer_id, j, chunk_id) of its answer."""
    right = sources.join(vectors.select("chunk_id", F.col("embedding").alias("b")), "chunk_id").select("answer_id", "j", "b")
    return E.similarity(sentences.select("answer_id", F.col("claim_idx").alias("i"), F.col("v").alias("a")), right)


def zipped(base: DataFrame, *parts: DataFrame) -> DataFrame:
    """Rows of base (answer_id, claim_idx, ...) with those of parts that have the same place in the same answer.

    A part that is shorter than its answer's base leaves nulls; what it has beyond the base goes.
    """
    for part in parts:
        base = base.join(part, ["answer_id", "claim_idx"], "left")
    return base


def cited_claims(sentences: DataFrame, sources: DataFrame, vectors: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Sentences (answer_id, claim_idx, claim_text, v) as claims, with the source that supports each and how clearly.

    chunk_id and confidence are those of the best source of at least p.min_attribution, else null and 0; the attribution's
    score, gap and ambiguity are of the best two, whatever they are, and null for an answer without sources.
    """
    scores = stored(support(sentences, sources, vectors), "support")
    best = E.attributed(scores, p).withColumnRenamed("i", "claim_idx")
    gap = E.primary(scores, p).select("answer_id", F.col("i").alias("claim_idx"), "attribution_score", "confidence_gap", "ambiguous")
    rows = zipped(sentences.select("answer_id", "claim_idx", "claim_text"), best, gap).join(sources, ["answer_id", "j"], "left").drop("j")
    return rows.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def judged_claims(claims: DataFrame, chunks: DataFrame, judge: Callable[[DataFrame], DataFrame], score: Callable[[Column, Column], Column], p: Params = DEFAULT) -> DataFrame:
    """claims (answer_id, claim_idx, claim_text, chunk_id, ...) with their source's fields, focused passage and verdict.

    judge adds contradiction, entailment_score and neutral to rows (answer_id, claim_idx, claim_text, focused_passage);
    score(sentence, place) is a sentence's closeness to the claim. A passage's text joins its claims here, and once, and
    leaves as the prepared passage; verdicts and passages meet their claims again by their places.
    """
    fields = [c for c in SOURCE if c in chunks.columns]
    cited = claims.join(chunks.select("chunk_id", *fields, "chunk_text"), "chunk_id", "left")
    passage = F.coalesce(T.prepared(F.col("chunk_text"), score, p), F.lit(""))
    named = {c: F.coalesce(c, F.lit("")) for c in fields}
    focused = stored(cited.select("answer_id", "claim_idx", "claim_text", passage.alias("focused_passage"), *(v.alias(f"source_{k}") for k, v in named.items())), "focused")
    verdicts = judge(focused.select("answer_id", "claim_idx", "claim_text", "focused_passage")).select("answer_id", "claim_idx", "contradiction", "entailment_score", "neutral")
    rows = zipped(claims, focused.drop("claim_text"), verdicts)
    return rows.withColumn("verdict", E.verdict(F.col("contradiction"), F.col("entailment_score"), F.col("neutral")))


def entailment(claims: DataFrame, chunks: DataFrame, judge: Callable[[DataFrame], DataFrame], score: Callable[[Column, Column], Column], p: Params = DEFAULT) -> DataFrame:
    """(answer_id, claim_idx, place, chunk_id, contradiction, entailment_score, neutral) of each claim with each passage that its answer cites.

    Passages are one where their texts are, and stand in the order in which claims first cite them; only long ones are
    focused, and short ones stay as they came.
    """
    texts = claims.filter("chunk_id IS NOT NULL").join(chunks.select("chunk_id", F.col("chunk_text").alias("passage")), "chunk_id")
    pairs = E.entailment_pairs(claims.select("answer_id", "claim_idx", "claim_text"), texts.select("answer_id", "claim_idx", "passage", "chunk_id"))
    pairs = pairs.withColumn("focused_passage", T.prepared(F.col("passage"), score, p, strip_first=False)).drop("passage")
    return judge(pairs).select("answer_id", "claim_idx", "place", "chunk_id", F.length("focused_passage").alias("passage_length"), "contradiction", "entailment_score", "neutral")


def audited(queries: DataFrame, found: DataFrame, chunks: DataFrame, claims: DataFrame, related: DataFrame, p: Params = DEFAULT, dedup: tuple[str, ...] = ("section_id",)) -> DataFrame:
    """A row for each query (query_id): its sources, gate with its reasons, contributions, scorecard and related queries.

    found: retrieved chunks with their rank; claims: with verdict, scores and attribution by answer_id, which is the
    query's id. A query without sources or claims has an empty answer: nothing counts against it.
    """
    found = stored(found.select("query_id", "chunk_id", "rank"), "found")
    sources = Q.first_of(found.join(chunks.select("chunk_id", "publication_name", "edition_date", "section_id", "chunk_text"), "chunk_id"), ["query_id", *dedup], "rank")
    shown = Q.formatted(sources, "rank", counted=True)
    own = stored(claims.join(queries.select(F.col("query_id").alias("answer_id")), "answer_id", "left_semi"), "claims")
    gate = E.trust_gate(own, p).join(E.gate_reasons(own, p), "answer_id").join(E.scorecard(own), "answer_id")
    phi = E.shapley(own, p).groupBy("answer_id").agg(F.max("overall_score").alias("shapley_score"), F.count("*").alias("n_claims"))
    gate = gate.join(phi, "answer_id").withColumnRenamed("answer_id", "query_id")
    near = related.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), (-F.col("id")).alias("i")))), lambda x: (-x["i"]).cast("string")), ",").alias("related"))
    rows = queries.select("query_id").join(shown, "query_id", "left").join(gate, "query_id", "left").join(near, "query_id", "left")
    safe = {"status": "Safe", "reasoning": E.SAFE_REASON, "sources": "", "related": ""}
    none = {"n_sources": 0, "n_claims": 0}
    one = {"overall_score": 1.0, "shapley_score": 1.0, "faithfulness": 1.0, "cited_share": 1.0, "citation_precision": 0.0}
    return rows.fillna({**safe, **none, **one, "edition_conflict_risk": False, "context_relevance": 0.95, "paraphrase_stability": 0.90})


#: A claim in a report, in this order.
RECORD = ("claim_text", "source_publication_name", "source_edition_date", "source_section_id", "confidence", "focused_passage", "verdict", "entailment_score", "explanation")


def answered(queries: DataFrame, sentences: DataFrame, found: DataFrame, chunks: DataFrame, vectors: DataFrame, related: DataFrame, judge: Callable[[DataFrame], DataFrame], score: Callable[[Column, Column], Column], p: Params = DEFAULT, dedup: tuple[str, ...] = ("section_id",)) -> DataFrame:
    """The audited answers whose sentences (answer_id, claim_idx, claim_text, v) cite what was found for their questions.

    Beside what `audited` gives, `claims` holds each answer's records in order. No edition conflicts are looked for.
    """
    found = stored(found.select("query_id", "chunk_id", "rank"), "found")
    sources = stored(sources_of(found, chunks, dedup), "sources")
    claims = judged_claims(stored(cited_claims(sentences, sources, vectors, p), "cited"), chunks, judge, score, p)
    claims = claims.withColumns({"has_conflict": F.lit(False), "explanation": E.explanation(F.col("entailment_score"), F.col("contradiction"), F.col("neutral"))})
    claims = stored(claims, "judged")
    records = claims.groupBy(F.col("answer_id").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("claim_idx", *RECORD))).alias("claims"))
    return audited(queries, found, chunks, claims, related, p, dedup).join(records, "query_id", "left")


def validated(requirements: DataFrame, library: Library, vectors: DataFrame, judge: Callable[[DataFrame], DataFrame], p: Params = DEFAULT) -> DataFrame:
    """A row for each requirement (id, text, q): what it maps to, its judgement, and its score.

    The p.requirement_k best chunks of each, texts in order of rank, are its mapped_sections, and, with their heads, what
    judge reads: it adds `raw`, a model's JSON answer or null, to rows (id, text, sources). The score counts the answer's
    own violations. A requirement to which nothing maps is judged all the same.
    """
    asked = requirements.select(F.col("id").alias("query_id"), F.col("text").alias("query"), "q")
    found = stored(retrieved(library, asked, vectors, p.requirement_k, p=p).select("query_id", "chunk_id", "rank"), "found")
    texts = found.join(library.chunks().select("chunk_id", *SOURCE, "chunk_text"), "chunk_id")
    sections = texts.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_text"))), lambda x: x["chunk_text"]).alias("mapped_sections"))
    rows = asked.select("query_id", F.col("query").alias("text")).join(Q.formatted(texts, "rank", wide=True), "query_id", "left").join(sections, "query_id", "left").withColumnRenamed("query_id", "id")
    rows = rows.withColumns({"sources": F.coalesce("sources", F.lit(NO_SECTIONS)), "mapped_sections": F.coalesce("mapped_sections", F.array().cast("array<string>"))})
    rows = stored(rows, "requirements")
    judged = R.mapped(judge(rows.select("id", "text", "sources")).select("id", "raw"))
    judged = R.compliance_score(judged.withColumn("n_violations", F.size("violations").cast("long")))
    return rows.drop("sources").join(judged, "id")
