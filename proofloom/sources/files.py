"""Requirement files in, reports out."""

from __future__ import annotations

from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

UPLOAD_CAP = 10 * 1024 * 1024
EXTENSIONS = ("pdf", "docx", "txt")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of the .txt files under path, whole and stripped. Text of other kinds comes from an extractor's table."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.[tT][xX][tT]")
    return rows.select(T.basename(F.col("_metadata.file_path")).alias("file"), T.strip(F.col("value")).alias("text"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files under path, from the store's own listing: Spark's file sources leave empty files out."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, rows = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True), []
    while found.hasNext():
        f = found.next()
        rows.append((f.getPath().toString(), f.getLen()))
    return spark.createDataFrame(rows, "path string, length long")


def uploads(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS, cap: int = UPLOAD_CAP) -> DataFrame:
    """files (path, length) with their names and a verdict, without reading them: ok, unsupported, empty or too large."""
    rows = files.withColumn("file", T.basename(F.col("path")))
    verdict = F.when(~T.extension(F.col("file")).isin(*extensions), "unsupported").when(F.col("length") == 0, "empty").when(F.col("length") > cap, "too large").otherwise("ok")
    return rows.withColumn("verdict", verdict)


def publication_uploads(files: DataFrame, publications: tuple[str, ...]) -> DataFrame:
    """Those of files (file, publication, ...) that are .pdf and of a known publication, its name in capitals."""
    rows = files.withColumn("publication", F.upper("publication"))
    return rows.filter(F.col("publication").isin(*publications) & (T.extension(F.col("file")) == "pdf"))


def sample(spark: SparkSession) -> DataFrame:
    """(file, text) of a few requirements to try things out with."""
    name = "sample_requirements.txt"
    return spark.createDataFrame([(name, resources.files(__package__).joinpath(name).read_text("utf-8").strip())], "file string, text string")


def write_reports(logs: DataFrame, path: str, log_id: int | None = None) -> None:
    """The reports (id, audit_data_json): of one id, its JSON in a folder of its name; of all, JSON lines with id and report."""
    rows = logs.filter("audit_data_json IS NOT NULL")
    if log_id is None:
        rows.select(F.to_json(F.struct("id", F.try_parse_json("audit_data_json").alias("report"))).alias("value")).write.text(path)
    else:
        rows.filter(F.col("id") == log_id).select("id", F.col("audit_data_json").alias("value")).coalesce(1).write.partitionBy("id").text(path)
