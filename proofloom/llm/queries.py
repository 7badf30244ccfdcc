"""The queries of this subpackage, by the name that the entry module registers, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontamination, jaccard_join, licenses, line_dedup, media, merkle, pii, quality, secrets, sentencepiece_dropout, token_files, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece_dropout": sentencepiece_dropout.query,
        "op2_line_dedup": line_dedup.query,
        "op3_secret_scan": secrets.query,
        "op4_pii_anchors": pii.query,
        "op5_url_cascade": urls.query,
        "op6_quality_trees": quality.query,
        "op7_token_files": token_files.query,
        "op8_decontamination": decontamination.query,
        "op9_jaccard_join": jaccard_join.query,
        "op10_media_archive": media.query,
        "op11_collocations": collocations.query,
        "op12_merkle_manifest": merkle.query,
        "op13_license_index": licenses.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_url_cascade": urls.SQL, "op8_decontamination": decontamination.SQL, "op11_collocations": collocations.SQL, "op12_merkle_manifest": merkle.SQL, "op13_license_index": licenses.SQL}
