"""Cosines of many vectors with a bounded block of others, as matrix products in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Cells of a matrix of products that is held at once.
CELLS = 4_000_000


def _units(values: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay zero, so their cosines are 0."""
    norms = np.sqrt((values * values).sum(axis=1, keepdims=True))
    return np.divide(values, norms, out=np.zeros_like(values), where=norms > 0)


def _by_size(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, places, vectors) of the vectors of each size; nulls and vectors that hold nulls are left out."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes >= 0]).tolist():
        at = np.flatnonzero(sizes == size)
        flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
        whole = ~np.isnan(flat).any(axis=1)
        yield size, at[whole], _units(flat[whole])


def cosines(rows: DataFrame, side: DataFrame, max_side: int, k: int | None = None, least: float | None = None, places: int = 6) -> DataFrame:
    """(side's id, rows' id, score) of rows (id, vector) and side (id, vector), unrounded.

    The side is taken in blocks of about max_side rows; each goes to all tasks. With k, a task leaves out what is not
    among the k greatest of its rows for that id of the side, ties after rounding included; with least, what is below it.
    """
    spark = rows.sparkSession
    row_id, side_id = rows.columns[0], side.columns[0]
    schema = StructType([side.schema[0], rows.schema[0], StructField("score", DoubleType())])
    n = side.count()
    blocks = max(1, math.ceil(n / max_side))
    slack = 2 * 10.0**-places
    out = None
    for i in range(blocks):
        block = side if blocks == 1 else side.filter(F.pmod(F.xxhash64(side_id), F.lit(blocks)) == i)
        own = block.toArrow()
        arrow = own.schema.field(0).type
        by_size = {d: (own.column(0).combine_chunks().take(pa.array(at)), v) for d, at, v in _by_size(own.column(1).combine_chunks())}
        share = spark.sparkContext.broadcast(by_size)

        def run(batches: Iterator[pa.RecordBatch], share=share, arrow=arrow) -> Iterator[pa.RecordBatch]:
            best: dict[int, np.ndarray] = {}
            for whole in batches:
                for d, at, v in _by_size(whole.column(1)):
                    if d not in share.value or not len(at):
                        continue
                    ids, q = share.value[d]
                    step = max(1, CELLS // max(1, len(q)))
                    for a in range(0, len(at), step):
                        score = q @ v[a : a + step].T
                        keep = np.ones(score.shape, bool)
                        if least is not None:
                            keep &= score >= least - slack
                        if k is not None:
                            seen = score if d not in best else np.concatenate([best[d], score], axis=1)
                            best[d] = seen if seen.shape[1] <= k else np.partition(seen, seen.shape[1] - k, axis=1)[:, -k:]
                            keep &= score >= best[d].min(axis=1, keepdims=True) - slack if best[d].shape[1] == k else True
                        x, y = np.nonzero(keep)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)).cast(arrow), whole.column(0).take(pa.array(at[a + y])), pa.array(score[x, y])], names=[side_id, row_id, "score"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out
