"""Operator 5: token ids packed into fixed-length rows, best fit decreasing.

Every task encodes its documents, cuts texts of more than ``length`` ids into pieces without losing
any, sorts the pieces of a window of ``window_tokens`` ids by falling length, and puts each into the
row with the least room that is enough; a segment tree over the room left finds that row. A window
bounds a task's memory whatever the size of its partition, and no shuffle is needed.

A row holds the id matrix's line (``input_ids``: little-endian, padded to ``length``), the cumulative
segment lengths (``cu_seqlens``) and where positions start again from 0 (``position_resets``);
``positions`` gives the position ids. Edge cases: a NULL or empty text is a segment of no ids; ids may
be NULL or repeat (``pieces`` numbers the parts of each row's own text); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import pretokens
from .common import lean, table

SCHEMA = "pack_id long, n_tokens int, n_segments int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, position_resets array<int>, input_ids binary"
_ARROW = pa.schema([("pack_id", pa.int64()), ("n_tokens", pa.int32()), ("n_segments", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("input_ids", pa.binary())])


class RoomTree:
    """Segment tree over the room left in open rows: finds the least room that is enough."""

    def __init__(self, length: int) -> None:
        self.leaves = 1 << length.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, by: int) -> None:
        k = room + self.leaves
        while k:
            self.open[k] += by
            k >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(row, its room) of the tightest row with room for ``size``; None if there is none."""
        k = size + self.leaves
        if not self.open[k]:
            while k > 1 and (k & 1 or not self.open[k + 1]):  # up, until a subtree to the right has one
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if self.open[2 * k] else 2 * k + 1
        room = k - self.leaves
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Indexes of the items of each row; no size is over ``length``."""
    tree, rows = RoomTree(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        if found is None:
            rows.append([i])
            tree.put(length - sizes[i], len(rows) - 1)
        else:
            row, room = found
            rows[row].append(i)
            tree.put(room - sizes[i], row)
    return rows


def pack(docs: DataFrame, length: int = 2048, model: str | None = None, pad_id: int = 0, window_tokens: int = 4_000_000) -> DataFrame:
    """One row per packed row of ``length`` ids, see the module."""
    path = pretokens.model_path(model)

    def run(batches):
        encoder = pretokens.Encoder(path)
        width = encoder.dtype.itemsize
        pad = pad_id.to_bytes(width, "little")
        held, pieces, window = 0, [], 0
        part = TaskContext.get().partitionId()

        def packed():
            rows = best_fit_decreasing([len(ids) // width for _, _, ids in pieces], length)
            for start in range(0, len(rows), 512):
                yield pa.RecordBatch.from_pylist([line((part << 36) + (window << 22) + start + k, [pieces[i] for i in row]) for k, row in enumerate(rows[start : start + 512])], _ARROW)

        def line(pack_id: int, row: list) -> dict:
            cu = np.cumsum([0, *(len(ids) // width for _, _, ids in row)]).tolist()
            resets = sorted({a for a, b in zip(cu, cu[1:], strict=False) if b > a})
            ids = b"".join(ids for _, _, ids in row)
            return {"pack_id": pack_id, "n_tokens": cu[-1], "n_segments": len(row), "doc_ids": [d for d, _, _ in row], "pieces": [p for _, p, _ in row], "cu_seqlens": cu, "position_resets": resets, "input_ids": ids + pad * (length - cu[-1])}

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.ids(batch.column(1)), strict=True):
                for k in range(0, max(1, len(ids)), length):
                    pieces.append((doc_id, k // length, ids[k : k + length].tobytes()))
                held += len(ids) + 1
                if held >= window_tokens:
                    yield from packed()
                    held, pieces, window = 0, [], window + 1
        if pieces:
            yield from packed()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(run, 5_000), SCHEMA)


def matrix(input_ids: list[bytes], length: int = 2048, dtype: str = "<u2") -> np.ndarray:
    """The id matrix of some packed rows."""
    return np.frombuffer(b"".join(input_ids), dtype).reshape(-1, length)


def positions(position_resets: list[int], length: int) -> np.ndarray:
    """Position ids of one packed row: counted from the last reset."""
    at = np.arange(length)
    starts = np.zeros(length, dtype=np.int64)
    starts[position_resets] = position_resets
    return at - np.maximum.accumulate(starts)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet: ``input_ids`` are the lines of the id matrix."""
    packed.write.mode("overwrite").parquet(path)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
