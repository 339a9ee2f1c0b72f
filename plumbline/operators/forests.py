"""Spanning forests of the links that lie in one partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Links that a task holds at once (16 bytes each, and about as much again to contract them).
TASK_LINKS = 4_000_000


def roots(links: np.ndarray) -> np.ndarray:
    """[id, root] of all ids in a 2 x n array of links that are not the smallest of their component.

    Every root with a smaller neighbouring root is hooked to the smallest one, pointers
    are shortened, and links inside a component go, until none is left.
    """
    ids, ends = np.unique(links, return_inverse=True)
    left, right = ends.reshape(2, -1)
    root = np.arange(len(ids))
    while len(left):
        low, high = np.minimum(root[left], root[right]), np.maximum(root[left], root[right])
        apart = low != high
        left, right, low, high = left[apart], right[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    below = root != np.arange(len(ids))
    return np.stack([ids[below], ids[root[below]]])


def contract(links: DataFrame) -> DataFrame:
    """[child, parent] whole-number links that connect the same ids, in each partition a forest of stars.

    A partition is contracted as a whole, however its links are spread over batches: what
    is held is the forest so far and the links since. A partition whose forest alone
    exceeds ``TASK_LINKS`` gives more than one.
    """

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [np.zeros((2, 0), np.int64)], 0
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy() for c in ("child", "parent")]))
            size += batch.num_rows
            if size > TASK_LINKS:
                held = [roots(np.concatenate(held, axis=1))]
                size = held[0].shape[1]
                if size > TASK_LINKS // 2:
                    yield _batch(held[0])
                    held, size = [np.zeros((2, 0), np.int64)], 0
        yield _batch(roots(np.concatenate(held, axis=1)))

    return links.select("child", "parent").mapInArrow(forests, "child bigint, parent bigint")


def _batch(links: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(links[0]), pa.array(links[1])], ["child", "parent"])
