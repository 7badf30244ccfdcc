"""The catalogue's tables: their schemas, and how they are made, appended to and guarded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "documents": "id BIGINT, filename STRING, publication_name STRING, edition_date STRING, chunk_count BIGINT, ingested_at STRING",
    "audit_logs": "id BIGINT, timestamp STRING, query STRING, response_json STRING, status STRING, audit_data_json STRING, query_embedding STRING",
    "edition_conflict_cache": "id BIGINT, publication STRING, section_id STRING, edition_a STRING, edition_b STRING, cosine_sim DOUBLE, has_conflict BOOLEAN, authoritative STRING, cached_at STRING",
}


def create(spark: SparkSession, database: str = "default") -> None:
    """Makes the tables that are not there yet."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in SCHEMAS.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def append(rows: DataFrame, name: str, database: str = "default") -> None:
    """Adds rows to a table, in its columns' order; what they lack is null."""
    table = rows.sparkSession.table(f"{database}.{name}")
    table.limit(0).unionByName(rows, allowMissingColumns=True).select(table.columns).write.insertInto(f"{database}.{name}")


def is_built(chunks: DataFrame) -> bool:
    """Whether there is anything to search; reads one row at most."""
    return not chunks.isEmpty()
