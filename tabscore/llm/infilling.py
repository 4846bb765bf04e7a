"""Fill-in-middle: cut a text at two places of its own and put the middle last, behind marks.

Each text is decoded to a numpy array of code points (UTF-32). Neighbours of different classes bound a unit: a word or
its white space, a line, or (each code point a class of its own) a single code point; `flatnonzero` of the differences
gives all boundaries, the two chosen ranks index them, and the three pieces are slices that are encoded again.

Where to cut, and how to write it, comes from a hash of seed and doc_id alone, so reruns agree. Texts that hold a mark
themselves stay plain, as an empty text does; so the output can be read back, which `restore` does by Spark's own
functions. Null texts are empty texts; a null doc_id hashes as an empty one and stays null; repeated rows have equal
results; no rows give no rows; columns other than doc_id and text are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = MARKS = "<P>", "<S>", "<M>"
SEED, RATE, SUFFIX_FIRST = 1, 90, 20
#: The ASCII white space of words.
SPACES = np.array([0x20, *range(0x09, 0x0E)], np.uint32)
CUT = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
#: Code points that go into a batch of results.
BATCH = 4 << 20


def classes(points: np.ndarray, unit: str) -> np.ndarray:
    """A class for each code point; neighbours of one class are of one unit."""
    if unit == "codepoint":
        return np.arange(len(points))
    if unit == "word":
        return np.isin(points, SPACES)
    if unit == "line":
        return np.cumsum(np.concatenate([[False], points[:-1] == 0x0A])) if len(points) else np.empty(0, int)
    raise ValueError(f"unit is codepoint, word or line, not {unit!r}")


def boundaries(points: np.ndarray, unit: str) -> np.ndarray:
    """Where units begin and end: 0, all places between two units, the length; one place more than there are units."""
    if not len(points):
        return np.zeros(1, np.int64)
    kind = classes(points, unit)
    return np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(points)]])


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits for a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def rearranged(doc_id: int | None, text: str, unit: str, seed: int, rate: int, suffix_first: int) -> tuple:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of one text."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    at = boundaries(points, unit)
    n, (h1, h2, h3, h4) = len(at) - 1, draws(seed, doc_id)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    low, high = at[sorted((h1 % (n + 1), h2 % (n + 1)))]
    prefix, middle, suffix = (p.tobytes().decode("utf-32-le") for p in (points[:low], points[low:high], points[high:]))
    if h4 % 100 < suffix_first:
        return doc_id, n, "spm", int(low), int(high - low), f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return doc_id, n, "psm", int(low), int(high - low), f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, unit: str = "codepoint", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row for each document: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output.

    rate: how many of 100 documents are rearranged; suffix_first: how many of 100 of those have the suffix first.
    """
    if unit not in ("codepoint", "word", "line"):
        raise ValueError(f"unit is codepoint, word or line, not {unit!r}")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = [x.split()[0] for x in CUT.split(", ")]
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                rows.append(rearranged(doc_id.as_py(), text.as_py() or "", unit, seed, rate, suffix_first))
                held += len(rows[-1][-1])
                if held >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(kernel, CUT)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of. No piece holds a mark, and a mark can't begin in a piece and end in a mark."""
    parts = F.split(output, "|".join(MARKS), -1)
    piece = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(piece(1), piece(3), piece(2))).when(form == "spm", F.concat(piece(2), piece(3), piece(1))).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, of code points."""
    cut = fill_in_middle(docs)
    own = [c for c in cut.columns if c != "output"]
    return cut.select(*own, F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
