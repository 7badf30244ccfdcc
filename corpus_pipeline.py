"""Documents to training tokens, in five stages; each works on all that the one before kept.

1. quality: documents that the classifier rejects go.
2. lines: one line of each component of similar lines stays; documents that lose every line go.
3. near_duplicates: of each component of the Jaccard join, at five-word shingles and 80 percent, the document with the
   least doc_id stays.
4. decontamination: documents that hold a benchmark passage go.
5. tokens: SentencePiece ids with merge-dropout, `ids` and `n_tokens`, beside the documents' columns.

Labels and benchmark come from sf_dir. Documents with a null doc_id take part in the stages on texts and pass the one on
doc_ids; null and empty texts that are not rejected pass through. Rows that share a doc_id are one document to stage 3
and stay or go together; repeated rows stay as often as they come. Very long texts are whole in every stage. Columns
other than the documents' own are dropped, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm import decontamination, jaccard_join, line_dedup, quality, sentencepiece_dropout
from proofloom.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The near-duplicate stage's own rule; the Jaccard join's defaults bind op9's query alone.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, learned from these documents' labels, accepts; without labels all stay."""
    return quality.kept(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat earlier ones; documents of which nothing is left go, those without lines stay."""
    out = line_dedup.deduplicated(docs.select(*COLUMNS)).filter("n_lines = 0 OR n_kept > 0")
    return out.withColumn("n_chars", F.when(F.col("n_kept") < F.col("n_lines"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked, directly or through others, the one with the least doc_id; those without words stay."""
    groups = jaccard_join.linked(docs, n=NEAR_WORDS, percent=NEAR_PERCENT)
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no window of a benchmark item; with an empty benchmark all."""
    return decontamination.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids and how many these are; null for null texts."""
    import public_tokenizers

    return sentencepiece_dropout.encode(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("tokens", tokens_stage),
]

#: SQL can express neither the trees nor the seeded encoding; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
