"""Packing: concatenate all documents' tokens and cut the stream into fixed windows.

Pass one tokenises each partition in its order, once, and stores a document's ids with the number of tokens before
it in its partition. The totals of the partitions (one row each) are summed up on the driver; pass two adds a
partition's base, so each document knows its place in the whole stream, and cuts it at multiples of the window. No
row is shuffled, and only a window's boundary records (its pieces) leave pass two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscore.llm.common import materialize

WINDOW, END_ID, VOCABULARY = 1024, 0, "byte_bpe_50k"
TOKENS = "part bigint, before bigint, doc_id bigint, n_tokens bigint, ids binary"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
#: Bytes of text that go into a batch of results.
BATCH_BYTES = 4 << 20


def tokenise(vocabulary: str, end_id: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tabscore.llm.tokens import ByteBPE

        encoder, part, before = ByteBPE(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint16).tobytes()
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "").tobytes() + end
                n = len(ids) // 2
                rows.append((part, before, doc_id.as_py(), n, ids))
                before, held = before + n, held + len(ids)
                if held >= BATCH_BYTES:
                    yield _batch(rows, TOKENS)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, TOKENS)

    return kernel


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])


def cut(bases: dict[int, int], window: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part, before, doc_id, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = bases[part] + before
                wide = np.frombuffer(ids, np.uint16).astype("<u4")
                start = 0
                while start < n:
                    length = min(window - (at + start) % window, n - start)
                    rows.append((doc_id, start, length, zlib.crc32(wide[start : start + length].tobytes()), n, (at + start) // window, (at + start) % window))
                    start += length
                if len(rows) >= 20_000:
                    yield _batch(rows, PIECES)
                    rows = []
            if rows:
                yield _batch(rows, PIECES)

    return kernel


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of a document in a window: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document, a null or empty one too, ends with end_id, so it has a piece at least. Rows are packed in the
    order in which they are read, repeated ones each for itself; a null doc_id stays null. Only the last sequence is
    shorter than the window, and is to be padded. No rows give no pieces. Other columns are not used.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stored = materialize(rows.mapInArrow(tokenise(vocabulary, end_id), TOKENS), "tokens")
    totals = sorted((r["part"], r["n"]) for r in stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    bases = dict(zip([p for p, _ in totals], [0, *accumulate(n for _, n in totals)], strict=False))
    return stored.mapInArrow(cut(bases, window), PIECES)
