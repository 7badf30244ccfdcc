"""Reports and requirements: JSON with defaults in place of what is missing or malformed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .documents import appended

#: What a requirement's judgement says where the model's answer cannot be used.
FALLBACK_GAPS, FALLBACK_REMEDIATION = ["JSON parsing failed"], ["Retry analysis"]
#: Fixed value: the same where there is no answer at all.
UNANSWERED_GAPS = ["Unable to fully analyze requirement"]


def log_list(logs: DataFrame) -> DataFrame:
    """Newest first, of equals the later id: each log's status and summary from its report; a report that is not an object is an error."""
    v = F.try_parse_json("audit_data_json")
    good = v.isNotNull() & F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    get = lambda path, default: F.when(good, F.coalesce(F.try_variant_get(v, f"$.final_audit_summary.{path}", "string"), F.lit(default))).otherwise("Error")
    # Sorted first and parsed after, so that finding the sort's ranges parses nothing.
    rows = logs.select("id", F.coalesce("timestamp", F.lit("")).alias("timestamp"), "audit_data_json").orderBy(F.desc("timestamp"), F.desc("id"))
    return rows.select("id", "timestamp", get("overall_trust_status", "Unknown").alias("status"), get("compliance_score_summary", "N/A").alias("summary"))


def defaulted(logs: DataFrame) -> DataFrame:
    """Logs with an empty timestamp where it is null, and the status unknown where it is null or empty."""
    return logs.withColumns({"timestamp": F.coalesce("timestamp", F.lit("")), "status": F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown"))})


def appended_logs(logs: DataFrame, new: DataFrame) -> DataFrame:
    """logs (id, timestamp, query, response_json, status, audit_data_json) and new ones with the next ids, by timestamp and query.

    A new log without audit_data_json is a plain one; without a status it has an empty one.
    """
    for c in ("response_json", "status", "audit_data_json"):
        if c not in new.columns:
            new = new.withColumn(c, F.lit("" if c == "status" else None).cast("string"))
    return appended(logs, new, [F.col("timestamp"), F.col("query")])


def as_report(columns: list[str]) -> Column:
    """The JSON text of a report with these columns."""
    return F.to_json(F.struct(*columns))


def log_by_id(logs: DataFrame, log_id: int) -> DataFrame:
    return logs.filter(F.col("id") == log_id)


def requirements(answers: DataFrame) -> DataFrame:
    """A row for each requirement in a model's JSON array (answer_id, raw); malformed answers give none."""
    each = "array<struct<requirement_id: string, requirement_text: string, category: string, regulatory_relevance: array<string>>>"
    parsed = answers.select("answer_id", F.from_json(T.strip_fence(F.col("raw")), each).alias("r"))
    rows = parsed.select("answer_id", F.posexplode("r").alias("place", "q"))
    return rows.select("answer_id", F.col("place").cast("long").alias("place"), F.coalesce("q.requirement_id", F.lit("REQ-UNKNOWN")).alias("id"), F.coalesce("q.requirement_text", F.lit("")).alias("text"), F.coalesce("q.category", F.lit("")).alias("category"), F.coalesce(F.array_join("q.regulatory_relevance", ", "), F.lit("")).alias("regulatory_relevance"))


def mapped(answers: DataFrame) -> DataFrame:
    """A requirement's judgement (id, raw) with defaults; a missing answer and one that cannot be parsed have score 50 and Medium risk.

    Scores are 0 to 100, and `alignment` is the same from 0 to 1.
    """
    each = "alignment_score double, gaps array<string>, violations array<string>, risk_level string, overall_compliance_score double, remediation_suggestions array<string>, _corrupt string"
    parsed = F.from_json(T.strip_fence(F.col("raw")), each, {"columnNameOfCorruptRecord": "_corrupt"})
    rows = answers.select("id", "raw", parsed.alias("p")).withColumn("ok", F.col("p").isNotNull() & F.col("p._corrupt").isNull())
    none = F.array().cast("array<string>")
    texts = lambda *values: F.array(*(F.lit(x) for x in values)).cast("array<string>")
    get = lambda c, default, failed: F.when(F.col("ok"), F.coalesce(f"p.{c}", default)).otherwise(failed).alias(c)
    out = rows.select(
        "id", get("alignment_score", F.lit(0.0), F.lit(50.0)), get("gaps", none, F.when(F.col("raw").isNull(), texts(*UNANSWERED_GAPS)).otherwise(texts(*FALLBACK_GAPS))), get("violations", none, none), F.when(F.col("ok"), T.capitalised(F.coalesce("p.risk_level", F.lit("Medium")))).otherwise("Medium").alias("risk_level"),
        get("overall_compliance_score", F.lit(0.0), F.lit(50.0)), get("remediation_suggestions", none, texts(*FALLBACK_REMEDIATION)),
    )
    return out.withColumn("alignment", F.col("alignment_score") / 100)


def compliance_score(rows: DataFrame) -> DataFrame:
    """100 * alignment, less a quarter for each violation, to 0 at least."""
    return rows.withColumn("compliance_score", F.round(100 * F.col("alignment") * (1 - F.least(F.lit(1.0), 0.25 * F.col("n_violations"))), 3))
