"""What the training-data operators share: inputs, tables in the shared folder, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..shared import new_folder, new_path, stored

__all__ = ["group_edges", "group_pairs", "new_folder", "new_path", "rows_mapper", "slices", "small_and_large", "stored", "table", "whole_groups"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about `limit` bytes; one row may hold more."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    runs = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def group_edges(*keys: np.ndarray) -> np.ndarray:
    """Where each run of rows with equal keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int, size: int) -> Iterator[pa.Table]:
    """Rows that come group by group, in tables of whole groups of about so many rows or bytes; one group may hold more."""
    held: list[pa.RecordBatch] = []

    def taken() -> pa.Table:
        return pa.Table.from_batches(held)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names))
        if sum(b.num_rows for b in held) >= rows or sum(b.get_total_buffer_size() for b in held) > size:
            whole = taken()
            cut = int(group_edges(*(whole.column(k).to_numpy() for k in keys))[-1])  # the last group may go on
            if cut:
                yield whole.slice(0, cut)
                rest = whole.slice(cut)
                held = [pa.RecordBatch.from_arrays([pa.concat_arrays(c.chunks) for c in rest.columns], names=rest.schema.names)]
    if held:
        yield taken()


def group_pairs(begins: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all pairs (a before b) within each of the groups, which follow each other."""
    later = np.repeat(begins + counts, counts) - np.arange(counts.sum()) - 1 - begins[0]
    a = np.repeat(np.arange(counts.sum()), later)
    b = np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later) + a + 1
    return a + begins[0], b + begins[0]


def small_and_large(begins: np.ndarray, counts: np.ndarray, few: int = 64, rows: int = 4000) -> Iterator[tuple[int, int]]:
    """Ranges of groups: runs of groups of a few rows each, and larger groups one by one."""
    at = 0
    while at < len(begins):
        to = at
        while to < len(begins) and counts[to] <= few and begins[to] - begins[at] < rows:
            to += 1
        to = max(to, at + 1)
        yield at, to
        at = to


def rows_mapper(work: Callable[[dict[str, list]], Iterator[dict]], schema: pa.Schema, chunk: int = 2000) -> Callable:
    """A mapInArrow function from one that takes columns as lists, of about 2 MB of texts at a time, and yields a row at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            rows: list[dict] = []
            for row in work(batch.to_pydict()):
                rows.append(row)
                if len(rows) >= chunk:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run
