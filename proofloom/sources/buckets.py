"""Tables that change by key: a folder a bucket of keys, of which a change rewrites those that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import numbered, updated, upserted
from ..shared import stored

BUCKET = "_bucket"


class Bucketed:
    """A Parquet table under path, by the hash of its key.

    A change is put together from the touched buckets and written aside first; then Spark replaces those buckets, each in
    one step, and leaves the others as they are. A change that broke off between two buckets is made whole by applying it
    again: what is applied twice gives the same table. There is one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def _with_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int"))

    def _stored(self) -> DataFrame:
        whole = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        schema = f"{self.schema}, {BUCKET} int"
        there = whole.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(whole)
        return self.spark.read.schema(schema).parquet(self.path) if there else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def one(self, value: object) -> DataFrame:
        """The rows of one key; only its bucket is read."""
        at = self._with_bucket(self.spark.createDataFrame([(value,)], f"{self.key} {dict(self._stored().dtypes)[self.key]}")).first()[BUCKET]
        return self._stored().filter((F.col(BUCKET) == at) & (F.col(self.key) == value)).drop(BUCKET)

    def _replace(self, rows: DataFrame) -> None:
        """Writes whole buckets in place of those of the same number."""
        rows = self._with_bucket(stored(rows, "buckets"))
        rows.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def _touched(self, changes: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
        """(the changes, written; the rows of the buckets that they touch; those buckets, of which there are self.buckets at most)."""
        changes = stored(self._with_bucket(changes), "changes")
        touched = sorted(r[0] for r in changes.select(BUCKET).distinct().collect())
        return changes.drop(BUCKET), self._stored().filter(F.col(BUCKET).isin(touched)).drop(BUCKET), touched

    def upsert(self, new: DataFrame, version: str) -> list[int]:
        """Puts new rows in place of those of the same keys; of new ones with the same key the one of greatest version counts."""
        new, old, touched = self._touched(new.select(self.read().columns))
        if touched:
            self._replace(upserted(old, new, self.key, version).select(old.columns))
        return touched

    def update(self, changes: DataFrame, column: str) -> list[int]:
        """Sets column by changes (key, column), one a key; keys that are not there stay away, and buckets without any of them untouched."""
        known = changes.join(self.read().select(self.key), self.key, "left_semi")
        changes, old, touched = self._touched(known)
        if touched:
            self._replace(updated(old, changes, self.key, column))
        return touched

    def append(self, new: DataFrame, order: list) -> int:
        """Adds rows with the next numbers as their keys, in the given order; nothing is read but keys. Returns the last one."""
        last = self.read().agg(F.coalesce(F.max(self.key), F.lit(0))).first()[0]
        rows = stored(numbered(new, order, self.key, last), "appended")
        columns = self.read().columns
        have = rows.columns
        rows = self._with_bucket(rows.select(*(F.col(c) if c in have else F.lit(None).alias(c) for c in columns)))
        kinds = dict(self._stored().dtypes)
        rows.select(*(F.col(c).cast(kinds[c]).alias(c) for c in [*columns, BUCKET])).repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(self.path)
        return last + rows.count()
