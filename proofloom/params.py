"""Parameters of the document-evidence operators."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Params:
    publications: tuple[str, ...] = ("FSR", "MPR", "PSR", "FER")
    chunk_words: int = 512
    chunk_overlap: int = 50
    dense_k: int = 20
    sparse_k: int = 20
    final_k: int = 10
    rrf_k: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    requirement_k: int = 5
    min_sentence: int = 20
    top_sentences: int = 3
    passage_cut: int = 800
    focus_words: int = 60
    min_attribution: float = 0.45
    ambiguity_gap: float = 0.02
    weak_attribution: float = 0.65
    conflict: float = 0.70
    conflict_cosine: float = 0.75
    related: float = 0.70
    related_repeat: float = 0.99
    related_k: int = 3
    history: int = 200
    #: About how many queries go to the tasks at once; more are taken in blocks.
    max_queries: int = 10_000


DEFAULT = Params()


def configured(spark: SparkSession, base: Params = DEFAULT) -> Params:
    """base with what the session sets as proofloom.<name>; lists are separated by commas."""
    found = {}
    for f in fields(base):
        if (text := spark.conf.get(f"proofloom.{f.name}", None)) is not None:
            old = getattr(base, f.name)
            found[f.name] = tuple(x.strip() for x in text.split(",")) if isinstance(old, tuple) else type(old)(text)
    return replace(base, **found)
