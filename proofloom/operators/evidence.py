"""Claims against evidence: attribution, verdicts, conflicts, trust, and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.blocks import cosines
from ..functions.vectors import cosine
from ..params import DEFAULT, Params

#: Penalties, in ten-thousandths so that sums are exact in any order.
PENALTY = {"contradiction": 3000, "neutral": 1000, "low": 2000, "mid": 500, "ambiguous": 500, "weak": 300, "conflict": 5000}
#: The gate's reasons; a text, a claim's start or a number goes where braces are.
CONFLICT_REASON = "Unresolved edition conflicts detected."
CONTRADICTION_REASON = "Contradiction: '{}...'"
NEUTRAL_REASON = "Neutral verdict: '{}...'"
LOW_REASON = "Low NLI confidence ({})"
MEDIUM_REASON = "Medium NLI confidence ({})"
AMBIGUOUS_REASON = "Ambiguous attribution (gap={}) sentence {}."
WEAK_REASON = "Weak attribution (score={}) sentence {}."
SAFE_REASON = "All claims strongly supported. No conflicts. Attribution clear."
#: A claim's penalty reasons, and those of the breakdown.
PENALTY_REASONS = {
    "contradiction": "contradiction",
    "neutral": "neutral",
    "low": "low NLI confidence ({})",
    "mid": "mid NLI confidence ({})",
    "ambiguous": "ambiguous attribution (gap={})",
    "weak": "weak attribution (score={})",
}
BREAKDOWN_REASONS = {
    "contradiction": "CONTRADICTION penalty: -0.3",
    "neutral": "NEUTRAL penalty: -0.1",
    "low": "Low confidence ({} < 0.5): -0.2",
    "mid": "Medium confidence ({}): -0.05",
}
#: Fixed value: how a claim's three probabilities are told.
EXPLANATION = "CrossEncoder Probabilities -> Entail: {}, Contradict: {}, Neutral: {}"
CONTRADICTS, SUPPORTS, NEUTRAL = ("CONTRADICTION", "CONTRADICTED"), ("ENTAILMENT", "SUPPORTED"), ("NEUTRAL", "NOT_ENOUGH_INFO")


def similarity(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("answer_id",)) -> DataFrame:
    """(keys, i, j, score): cosine of every left (i, a), a sentence, with every right (j, b), a chunk of the same answer."""
    return left.join(right, list(keys)).select(*keys, "i", "j", F.round(cosine(F.col("a"), F.col("b")), 4).alias("score"))


def attributed(scores: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Each sentence's best chunk, none below the least score; the lower place wins ties."""
    keys = _answer(scores)
    best = scores.groupBy(*keys, "i").agg(F.max_by(F.struct("j", "score"), F.struct("score", -F.col("j"))).alias("m"))
    ok = F.col("m.score") >= p.min_attribution
    return best.select(*keys, "i", F.when(ok, F.col("m.j")).alias("j"), F.when(ok, F.col("m.score")).otherwise(0.0).alias("confidence"))


def _answer(scores: DataFrame) -> list[str]:
    return [c for c in ("answer_id",) if c in scores.columns]


def sourced(attributed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Attributed sentences with their chunk's (j, publication_name, edition_date, section_id, chunk_text); those without one have empty fields."""
    rows = attributed.join(chunks, [*_answer(chunks), "j"], "left")
    names = [c for c in chunks.columns if c not in ("j", "answer_id")]
    return rows.select(*attributed.columns, *(F.coalesce(c, F.lit("")).alias(c) for c in names))


def primary(scores: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Each sentence's first and second chunk and their gap; a single chunk is its own second."""
    keys = _answer(scores)
    order = Window.partitionBy(*keys, "i").orderBy(F.desc("score"), "j")
    top = scores.withColumn("k", F.row_number().over(order)).filter("k <= 2").groupBy(*keys, "i").agg(*(F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in (1, 2) for c in ("j", "score")))
    gap = F.round(F.col("score1") - F.coalesce("score2", "score1"), 4)
    return top.select(*keys, "i", F.col("j1").alias("primary_chunk"), F.col("score1").alias("attribution_score"), F.coalesce("j2", "j1").alias("runner_up_chunk"), F.coalesce("score2", "score1").alias("runner_up_score"), gap.alias("confidence_gap"), (gap < p.ambiguity_gap).alias("ambiguous"))


def verdict(c: Column, e: Column, n: Column) -> Column:
    """The likeliest label; ties go to contradiction, then entailment."""
    return F.when((c >= e) & (c >= n), "CONTRADICTION").when(e >= n, "ENTAILMENT").otherwise("NEUTRAL")


def entailment_pairs(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """Every claim (answer_id, claim_idx, ...) with every distinct non-empty passage (answer_id, passage, ...) of its answer.

    A passage that several claims cite comes once, with what its first claim gives it; `place` is its place among them.
    """
    names = [c for c in passages.columns if c not in ("answer_id", "passage", "claim_idx")]
    once = passages.filter(F.trim("passage") != "").groupBy("answer_id", "passage").agg(F.min("claim_idx").alias("_at"), *(F.min_by(c, "claim_idx").alias(c) for c in names))
    once = once.withColumn("place", F.row_number().over(Window.partitionBy("answer_id").orderBy("_at")).cast("long")).drop("_at")
    return claims.join(once, "answer_id")


def explanation(entailment: Column, contradiction: Column, neutral: Column) -> Column:
    return _filled(EXPLANATION, *(T.fixed(x, 2) for x in (entailment, contradiction, neutral)))


def _filled(pattern: str, *values: Column) -> Column:
    parts = pattern.split("{}")
    return F.concat(*(x for pair in zip((F.lit(p) for p in parts), [*values, F.lit("")], strict=True) for x in pair))


def section_pairs(sections: DataFrame, same_section: bool = False) -> DataFrame:
    """Each section of an older edition with each, or only the same, section of a newer one of its publication.

    sections: publication, section_id, edition and an orderable edition_no, and what a model needs; columns of the two
    sides come as structs, old and new.
    """
    keys = ["publication", "section_id"] if same_section else ["publication"]
    old, new = (sections.select(*keys, F.struct(*sections.columns).alias(side)) for side in ("old", "new"))
    return old.join(new, keys).filter("old.edition_no < new.edition_no").select("publication", "old", "new")


def conflicts(pairs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Those of pairs (old, new, contradiction) whose contradiction is above the threshold; the newer edition supersedes."""
    found = pairs.filter(F.col("contradiction") > p.conflict)
    return found.select("publication", F.col("old.section_id").alias("old_section"), F.col("new.section_id").alias("new_section"), F.col("contradiction").alias("contradiction_score"), F.col("new.edition").alias("superseding_edition"))


def edition_conflict(pairs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """A decision for each pair of one section's editions, with its description, both empty without a conflict."""
    c = F.col("contradiction")
    has = c > p.conflict
    return pairs.select(
        "publication", F.col("old.section_id").alias("section_id"), F.col("old.edition").alias("older_edition"), F.col("new.edition").alias("newer_edition"), has.alias("has_conflict"),
        F.when(has, F.concat(F.lit("Contradiction Probability: "), T.fixed(100 * c, 2), F.lit("%"))).otherwise("").alias("conflict_description"), F.when(has, F.col("new.edition")).otherwise("").alias("superseding_edition"),
        F.concat(F.lit("CrossEncoder probability of newer text contradicting older text: "), T.fixed(c, 4)).alias("details"),
    )


def cosine_conflict(older: Column, newer: Column, p: Params = DEFAULT) -> tuple[Column, Column, Column, Column]:
    """(similarity, has_conflict, authority of the newer, authority of the older) of one section in two editions."""
    s = F.round(cosine(older, newer), 6)
    return s, s < p.conflict_cosine, s, s / 2


def _units(name: str, when: Column) -> Column:
    return F.when(when, PENALTY[name]).otherwise(0)


def _parts(p: Params) -> dict[str, Column]:
    e = F.col("entailment_score")
    return {
        "contradiction": _units("contradiction", F.col("verdict").isin(*CONTRADICTS)),
        "neutral": _units("neutral", F.col("verdict").isin(*NEUTRAL)),
        "low": _units("low", e < 0.5),
        "mid": _units("mid", (e >= 0.5) & (e <= 0.8)),
        "ambiguous": _units("ambiguous", F.coalesce(F.col("ambiguous"), F.lit(False))),
        "weak": _units("weak", ~F.coalesce(F.col("ambiguous"), F.lit(False)) & F.coalesce(F.col("attribution_score") < p.weak_attribution, F.lit(False))),
    }


def trust_gate(claims: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(answer_id, overall_score, status) from claims with verdict, scores, attribution and has_conflict."""
    parts = _parts(p)
    conflict = F.coalesce(F.bool_or("has_conflict"), F.lit(False))
    lost = F.sum(sum(parts.values(), F.lit(0))) + _units("conflict", conflict)
    bad = F.bool_or((parts["contradiction"] > 0) | (parts["low"] > 0)) | conflict
    doubt = F.bool_or((parts["neutral"] > 0) | (parts["mid"] > 0) | (parts["weak"] > 0) | (parts["ambiguous"] > 0))
    out = claims.groupBy("answer_id").agg(lost.alias("lost"), bad.alias("bad"), doubt.alias("doubt"))
    return out.select("answer_id", (F.greatest(F.lit(0), 10000 - F.col("lost")) / 10000).alias("overall_score"), F.when(F.col("bad"), "Non_Compliant").when(F.col("doubt"), "Needs_Human_Review").otherwise("Safe").alias("status"))


def shapley(claims: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Each claim's contribution and its answer's overall score. Confidence counts only where nothing contradicts."""
    parts = _parts(p)
    plain = F.col("verdict") == CONTRADICTS[0]
    phi = F.when(plain, PENALTY["contradiction"]).otherwise(_units("neutral", F.col("verdict") == NEUTRAL[0]) + parts["low"] + parts["mid"]) + parts["ambiguous"] + parts["weak"]
    whole = Window.partitionBy("answer_id")
    rows = claims.withColumn("units", phi)
    order = Window.partitionBy("answer_id").orderBy(F.desc("units"), "claim_idx")
    return rows.select("answer_id", "claim_idx", (F.col("units") / 10000).alias("phi"), (F.greatest(F.lit(0), 10000 - F.sum("units").over(whole)) / 10000).alias("overall_score"), F.row_number().over(order).cast("long").alias("place"))


def penalty_reasons(claims: DataFrame) -> DataFrame:
    """(answer_id, claim_idx, penalty_reasons): why a claim has its contribution, in the order of the penalties."""
    parts = _parts(DEFAULT)
    plain = F.col("verdict") == CONTRADICTS[0]
    e, r = T.fixed(F.col("entailment_score"), 2), PENALTY_REASONS
    each = [
        F.when(plain, r["contradiction"]),
        F.when(F.col("verdict") == NEUTRAL[0], r["neutral"]),
        F.when(~plain & (parts["low"] > 0), _filled(r["low"], e)),
        F.when(~plain & (parts["mid"] > 0), _filled(r["mid"], e)),
        F.when(parts["ambiguous"] > 0, _filled(r["ambiguous"], T.fixed(F.col("confidence_gap"), 4))),
        F.when(parts["weak"] > 0, _filled(r["weak"], T.fixed(F.col("attribution_score"), 4))),
    ]
    return claims.select("answer_id", "claim_idx", F.array_compact(F.array(*each)).alias("penalty_reasons"))


def gate_reasons(claims: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(answer_id, reasoning): conflicts first, then each claim's verdict and confidence, then attributions; or that all is safe."""
    parts = _parts(p)
    start, e = F.substring("claim_text", 1, 60), T.fixed(F.col("entailment_score"), 2)
    said = lambda kind, step, when, what: F.when(when, F.struct(F.lit(kind).alias("kind"), F.col("claim_idx").alias("at"), F.lit(step).alias("step"), what.alias("what")))
    each = F.array_compact(
        F.array(
            said(1, 0, parts["contradiction"] > 0, _filled(CONTRADICTION_REASON, start)),
            said(1, 0, parts["neutral"] > 0, _filled(NEUTRAL_REASON, start)),
            said(1, 1, parts["low"] > 0, _filled(LOW_REASON, e)),
            said(1, 1, parts["mid"] > 0, _filled(MEDIUM_REASON, e)),
            said(2, 0, parts["ambiguous"] > 0, _filled(AMBIGUOUS_REASON, T.fixed(F.col("confidence_gap"), 4), F.col("claim_idx").cast("string"))),
            said(2, 0, parts["weak"] > 0, _filled(WEAK_REASON, T.fixed(F.col("attribution_score"), 4), F.col("claim_idx").cast("string"))),
        )
    )
    rows = claims.groupBy("answer_id").agg(F.array_sort(F.flatten(F.collect_list(each))).alias("r"), F.coalesce(F.bool_or("has_conflict"), F.lit(False)).alias("c"))
    told = F.concat(F.when(F.col("c"), F.array(F.lit(CONFLICT_REASON))).otherwise(F.array().cast("array<string>")), F.transform("r", lambda x: x["what"]))
    return rows.select("answer_id", F.when(F.size(told) == 0, SAFE_REASON).otherwise(F.array_join(told, " | ")).alias("reasoning"))


def claim_breakdown(claims: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Each claim's own penalties without attribution: (answer_id, claim_idx, claim_text, verdict, phi, penalty_reasons)."""
    parts, e = {k: v for k, v in _parts(p).items() if k in BREAKDOWN_REASONS}, T.fixed(F.col("entailment_score"), 3)
    reasons = F.array_compact(F.array(*(F.when(v > 0, _filled(BREAKDOWN_REASONS[k], *([e] if "{}" in BREAKDOWN_REASONS[k] else []))) for k, v in parts.items())))
    return claims.select("answer_id", "claim_idx", T.shortened(F.col("claim_text"), 80).alias("claim_text"), "verdict", (sum(parts.values(), F.lit(0)) / 10000).alias("phi"), reasons.alias("penalty_reasons"))


def marginal(claims: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(answer_id, claim_idx, phi): the answer's score without the claim less its score, each 0 at least."""
    units = sum(_parts(p).values(), F.lit(0))
    total = F.sum("units").over(Window.partitionBy("answer_id"))
    score = lambda lost: F.greatest(F.lit(0), 10000 - lost)
    return claims.withColumn("units", units).select("answer_id", "claim_idx", ((score(total - F.col("units")) - score(total)) / 10000).alias("phi"))


def verified(claims: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Claims with their explanations, and their answer's gate and scorecard, joined by answer."""
    rows = claims.select("answer_id", "claim_idx", "verdict", "entailment_score", explanation(F.col("entailment_score"), F.col("contradiction"), F.col("neutral")).alias("explanation"))
    return rows.join(trust_gate(claims, p), "answer_id").join(scorecard(claims).select("answer_id", "faithfulness", "cited_share"), "answer_id")


def breakdown(claims: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Each kind of penalty summed over an answer, without attribution."""
    parts = {k: v for k, v in _parts(p).items() if k not in ("ambiguous", "weak")}
    return claims.groupBy("answer_id").agg(*((F.sum(v) / 10000).alias(f"{k}_penalty") for k, v in parts.items()), (_units("conflict", F.coalesce(F.bool_or("has_conflict"), F.lit(False))) / 10000).alias("conflict_penalty"))


def scorecard(claims: DataFrame) -> DataFrame:
    """Faithfulness, citation precision as it is reported and by its formula, conflict risk, and two constants."""
    supported = F.avg(F.col("verdict").isin(*SUPPORTS).cast("double"))
    cited = F.avg((F.trim(F.coalesce("source_section_id", F.lit(""))) != "").cast("double"))
    return claims.groupBy("answer_id").agg(
        F.round(F.coalesce(supported, F.lit(1.0)), 6).alias("faithfulness"), F.when(F.count("*") > 0, 1.0).otherwise(0.0).alias("citation_precision"), F.round(F.coalesce(cited, F.lit(1.0)), 6).alias("cited_share"),
        F.coalesce(F.bool_or("has_conflict"), F.lit(False)).alias("edition_conflict_risk"), F.lit(0.95).alias("context_relevance"), F.lit(0.90).alias("paraphrase_stability"),
    )


def related(queries: DataFrame, history: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """For each query (query_id, q) its nearest among the newest past ones (id, embedding); repeats go after the cut.

    The past ones, p.history at most, go to every task, so there may be any number of queries. Null embeddings and those of
    another size are nobody's neighbours.
    """
    past = history.filter("embedding IS NOT NULL").orderBy(F.desc("id")).limit(p.history).select("id", "embedding")
    near = cosines(queries.select("query_id", "q"), past, p.history, least=p.related, places=4)
    scored = near.select("query_id", "id", F.round("score", 4).alias("similarity")).filter("id <> query_id").filter(F.col("similarity") >= p.related)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.desc("id"))
    return scored.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= p.related_k).filter(F.col("similarity") < p.related_repeat).drop("k")


def vector(json: Column) -> Column:
    """An embedding from its JSON text; what is no array of numbers is null."""
    return F.from_json(json, "array<double>")


def cache_rows(conflicts: DataFrame, at: Column) -> DataFrame:
    """Rows of the conflict cache from conflicts (publication, section_id, edition_a, edition_b, cosine_sim, has_conflict), found at a time.

    The newer edition, edition_b, is the authoritative one.
    """
    return conflicts.select("publication", "section_id", "edition_a", "edition_b", "cosine_sim", "has_conflict", F.col("edition_b").alias("authoritative"), at.alias("cached_at"))


def now() -> Column:
    """The time of the query, as text that sorts by time."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
