"""Words of many texts as postings, counted in Arrow batches where the texts are."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... counts[0] times, then from first[1] on, and so on."""
    return np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def counted(lists: pa.ListArray, known: pa.Array | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, term, row, tf), by term, then row: how often each row of lists of words has each of terms, its own or the known ones."""
    words, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    if known is None:
        coded = words.dictionary_encode()
        terms, term = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    else:
        terms, term = known, pc.fill_null(pc.index_in(words, known), -1).to_numpy().astype(np.int64)
        row, term = row[term >= 0], term[term >= 0]
    keys, tf = np.unique(term * max(1, len(lists)) + row, return_counts=True)
    return terms, keys // max(1, len(lists)), keys % max(1, len(lists)), tf
