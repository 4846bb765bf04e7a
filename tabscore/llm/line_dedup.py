"""Line dedup: range-partitioned line hashes, streamed in order, give per-document bitmaps of the lines to keep.

Only hashes travel. A long line becomes (hash, doc_id, line number, text key); rows are partitioned by ranges of
(hash, doc_id descending, line) and sorted in them, so a line that a third of all documents share is spread over as
many ranges as its rows need. A range's stream sees each hash's documents from the largest id down; a hash that
crosses ranges is completed from one boundary record a range: (first and last hash, their documents and counts).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.llm.common import ascii_lower, materialize

MIN_CHARS, MIN_DOCS = 40, 5


def line_keys(text: Column) -> Column:
    """Keys of a text's lines, by line: stripped of ASCII white space at both ends, A-Z lower-cased."""
    lines = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n", -1)
    return F.transform(lines, lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")))


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two halves of the hash, and the document, nulls as the smallest."""
    a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    return a, b, batch.column(2).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of sorted rows, batch by batch: the batch, its columns, where runs of one hash start, whether the first goes on
    from the batch before, and the number of new documents up to each row."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, d = _columns(batch)
        new_run = np.ones(len(a), bool)
        new_run[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        new_doc = new_run.copy()
        new_doc[1:] |= d[1:] != d[:-1]
        if last is not None:
            new_run[0] = (a[0], b[0]) != last[:2]
            new_doc[0] = new_run[0] or d[0] != last[2]
        starts = np.unique(np.concatenate([[0], np.flatnonzero(new_run)]))
        yield batch, (a, b, d), np.append(starts, len(a)), not new_run[0], np.concatenate([[0], np.cumsum(new_doc)])
        last = (a[-1], b[-1], d[-1])


def boundary_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a range: hash, documents, first and last document of its first and of its last run."""
    first = last = None
    n_runs = part = 0
    for batch, (a, b, d), edges, goes_on, docs in segments(batches):
        part = batch.column(6)[0].as_py()
        n_runs += len(edges) - 1 - goes_on
        for k in dict.fromkeys((0, len(edges) - 2)):
            lo, hi = int(edges[k]), int(edges[k + 1])
            n = int(docs[hi] - docs[lo])
            if k == 0 and goes_on:
                last[2], last[4] = last[2] + n, int(d[hi - 1])
            else:
                last = [int(a[lo]), int(b[lo]), n, int(d[lo]), int(d[hi - 1])]
                first = first or last
    if first:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, n_runs, *first, *last)], [x.split()[0] for x in BOUNDARY.split(", ")])


BOUNDARY = "part bigint, n_runs bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint, f4 bigint, l0 bigint, l1 bigint, l2 bigint, l3 bigint, l4 bigint"


def crossing_runs(records: list[tuple]) -> dict[int, dict[tuple[int, int], tuple[int, int]]]:
    """Of each range, the runs that other ranges share: hash -> (documents in all ranges, the largest document)."""
    chains, chain = [], []
    for r in sorted(records):
        part, n_runs, first, last = r[0], r[1], r[2:7], r[7:12]
        if chain and chain[-1][1][:2] == first[:2]:
            chain.append((part, first))
            if n_runs > 1:
                chains.append(chain)
                chain = [(part, last)]
        else:
            chains.append(chain)
            chain = [(part, last)]
    chains.append(chain)
    out: dict[int, dict[tuple[int, int], tuple[int, int]]] = {}
    for c in chains:
        if len(c) > 1:
            total = sum(run[2] for _, run in c) - sum(x[1][4] == y[1][3] for x, y in zip(c, c[1:], strict=False))
            for part, run in c:
                out.setdefault(part, {})[run[:2]] = (total, c[0][1][3])
    return out


def dropped_lines(shared: dict, min_docs: int):
    """A kernel that yields the rows of runs with min_docs documents at least, but for those of the first document."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The run that is open at a batch's end: documents so far, the first, and rows that wait for min_docs documents
        # (they are of fewer documents than that).
        count, top, waiting, known = 0, None, [], None
        for batch, (a, b, d), edges, goes_on, docs in segments(batches):
            mine = shared.get(batch.column(6)[0].as_py(), {})
            counts = docs[edges[1:]] - docs[edges[:-1]]
            ends = [0, len(counts) - 1]
            for k in sorted({*ends, *np.flatnonzero(counts >= min_docs).tolist()}):
                lo, hi = int(edges[k]), int(edges[k + 1])
                if k or not goes_on:
                    known = mine.get((int(a[lo]), int(b[lo])))
                    count, top, waiting = (known[0] if known else 0), (known[1] if known else int(d[lo])), []
                if not known:
                    count += int(counts[k])
                keep = d[lo:hi] != top
                if keep.any() and not (known and count < min_docs):
                    waiting.append(batch.slice(lo, hi - lo).filter(pa.array(keep)))
                if count >= min_docs:
                    yield from (w.select([2, 3, 4, 5]) for w in waiting)
                    waiting = []

    return kernel


def compressed(keep: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)


def expanded(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n, bitorder="little").astype(bool)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, drops = [], []
        for n, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[np.asarray(gone, dtype=np.int64)] = False
            maps.append(compressed(keep))
            drops.append(n - int(keep.sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(drops, pa.int64()), pa.array(maps, pa.binary())], ["doc_id", "text_key", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_key, n_lines, n_dropped, keep) of each document that loses lines; all others keep every line.

    keep is a zlib-compressed bitmap of the lines, the first in the lowest bit. text_key (xxhash64 of the text) tells
    apart rows that share doc_id but not the text; they count as one document, and so do rows with a null doc_id, the
    smallest of all. Null and empty texts are one empty line, which no rule drops. Other columns are not used.
    """
    text = F.coalesce("text", F.lit(""))
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.size(F.split(text, "\n", -1)).alias("n_lines"), F.posexplode(line_keys(F.col("text"))).alias("line", "key"))
    # Two hashes with different seeds: 128 bits.
    lines = keys.filter(F.length("key") >= min_chars).select(F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b"), "doc_id", "text_key", "n_lines", "line")
    order = [F.col("a"), F.col("b"), F.col("doc_id").desc_nulls_last(), F.col("line")]
    # Written first: to find the ranges, the rows are read twice, and splitting and hashing texts is most of the work.
    lines = materialize(lines, "line-hashes")
    # The checkpoint keeps partitions and their order, so both passes stream the same ranges.
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long")).checkpoint()
    crossing = crossing_runs([tuple(r) for r in ranged.mapInArrow(boundary_records, BOUNDARY).collect()])
    gone = ranged.mapInArrow(dropped_lines(crossing, min_docs), "doc_id bigint, text_key bigint, n_lines int, line int")
    by_doc = gone.groupBy("doc_id", "text_key", "n_lines").agg(F.collect_set("line").alias("gone"))
    return by_doc.mapInArrow(_bitmaps, "doc_id bigint, text_key bigint, n_lines int, n_dropped bigint, keep binary")


def kept_text(text: pd.Series, keep: pd.Series) -> pd.Series:
    """The lines of each text that its bitmap keeps; null where there is no bitmap."""

    def one(t: str | None, k: bytes | None) -> str | None:
        if t is None or k is None:
            return None
        lines = t.split("\n")
        return "\n".join(x for x, y in zip(lines, expanded(k, len(lines)), strict=True) if y)

    return pd.Series([one(t, k) for t, k in zip(text, keep, strict=True)], dtype=object)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with n_dropped and with the text that its bitmap keeps (a null text without one stays null)."""
    own = docs.drop("n_dropped").withColumn("_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    maps = bitmaps.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text_key"), "n_dropped", F.col("keep").alias("_keep"))
    both = own.join(maps, (F.col("_key") == F.col("_text_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    kept = F.coalesce(F.pandas_udf(kept_text, "string")(F.when(F.col("_keep").isNotNull(), F.col("text")), F.col("_keep")), F.col("text"))
    return both.withColumn("text", kept).withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0)).cast("long")).drop("_key", "_id", "_text_key", "_keep")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The registered query: what is left of every document, as a digest."""
    own = docs.select("doc_id", "text").withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long"))
    applied = apply_bitmaps(own, keep_bitmaps(docs))
    return applied.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
