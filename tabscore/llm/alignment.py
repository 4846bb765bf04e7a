"""Cross-tokenizer alignment: where the tokens of two vocabularies end together, and which of them do so most often.

Both tokenizers see the same bytes: a space, then the text. Each byte has a label: no token ends there (.), one of A
(a), one of B (b), or one of each (#). A regular expression scans the labels for spans up to each #; the labels in a
span say how many tokens of A and of B make up that group. A group's last tokens end together, and are a link.

Pass one writes each document's groups (their digest, for the query) and its linked pairs with how often it has them.
Linked tokens end together, so the bytes of one end with those of the other: a vocabulary's pairs are at most as many
as its tokens have suffixes (`most_pairs`, some hundred thousand), whatever the corpus. So the counts of all pairs, by
partitions and then by Spark's sum, fit the driver, and go to pass two as a broadcast of a known bound.

Null and empty texts, and those whose bytes either tokenizer changes, have no tokens: zeros, and '' for the digest.
Repeated rows are aligned and counted each for itself, a null doc_id stays null, no rows give no rows, and columns
other than doc_id and text are not used. A text is one value in one task; nothing else grows with its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscore.llm.common import materialize
from tabscore.llm.tokens import ByteBPE

A, B = "byte_bpe_50k", "piece_bpe_32k"
#: The label of a byte by what ends there: nothing, a token of A, a token of B, one of each.
LABELS = b".ab#"
SPAN = re.compile(b"[^#]*#")
#: Rows of a batch of results.
ROWS = 2_000
GROUP = "struct<start: bigint, end: bigint, a: array<int>, b: array<int>>"
PAIRS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary"


class PlainBPE(ByteBPE):
    """The byte-level vocabulary, to which its special tokens' strings are ordinary text; with the bytes of its tokens."""

    def named(self, text: str) -> list[int]:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.json)
            self.tokenizer.encode_special_tokens = True
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @property
    def bytes(self) -> list[bytes]:
        return [self.plain.decode_single_token_bytes(i) for i in range(self.plain.n_vocab)]


class Pieces:
    """The vocabulary of pieces, with the bytes of its tokens."""

    def __init__(self, name: str):
        import public_tokenizers as public
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=public.path(f"{name}.model"))
        self.size = self.pieces.get_piece_size()
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.pieces.id_to_piece, range(self.size)))]


def decimals(n: int) -> np.ndarray:
    """The numbers below n as rows of ASCII digits, zero bytes before them, and one free byte after them."""
    width = len(str(n - 1))
    digits = np.arange(n)[:, None] // 10 ** np.arange(width - 1, -1, -1)[None, :]
    out = np.where((digits > 0) | (np.arange(width) == width - 1), digits % 10 + ord("0"), 0)
    return np.concatenate([out, np.zeros((n, 1), int)], axis=1).astype(np.uint8)


class Alignment:
    """One text's tokens, labels and groups; `a_end` and `b_end` are how many tokens there are up to each group's end."""

    def __init__(self, a: np.ndarray, b: np.ndarray, marks: np.ndarray):
        self.a, self.b, self.labels = a, b, marks.tobytes().translate(LABELS + bytes(252))
        self.ends = np.cumsum(np.fromiter(map(len, SPAN.findall(self.labels)), np.int64))
        self.a_end, self.b_end = (np.cumsum(marks & k > 0)[self.ends - 1] for k in (1, 2))

    def text(self, digits: np.ndarray) -> bytes:
        """The groups as a1,a2|b1;a3|b2, from the digits of all ids."""
        of_a, of_b = (np.repeat(np.arange(len(self.ends)), np.diff(x, prepend=0)) for x in (self.a_end, self.b_end))
        at_a = np.arange(len(self.a)) + np.concatenate([[0], self.b_end])[of_a]
        at_b = np.arange(len(self.b)) + self.a_end[of_b]
        rows = np.empty((len(self.a) + len(self.b), digits.shape[1]), np.uint8)
        rows[at_a], rows[at_b] = digits[self.a], digits[self.b]
        rows[:, -1] = ord(",")
        rows[at_a[self.a_end - 1], -1] = ord("|")
        rows[at_b[self.b_end - 1], -1] = ord(";")
        return rows.tobytes().translate(None, b"\0")[:-1]


class Aligner:
    def __init__(self, a: str = A, b: str = B):
        self.a, self.b = PlainBPE(a), Pieces(b)
        a_bytes = self.a.bytes
        if len(a_bytes) * self.b.size >= 1 << 32:
            raise ValueError("pairs of these vocabularies have no numbers of 32 bits")
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in of]) for of in (a_bytes, self.b.bytes))
        self.digits = decimals(max(len(a_bytes), self.b.size))

    def align(self, text: str) -> Alignment | None:
        """A text's alignment; none for an empty one, or if a tokenizer changes its bytes."""
        if not text:
            return None
        whole = (" " + text).encode()
        a, b = self.a.whole(" " + text), self.b.pieces.encode(text)
        if b"".join(map(self.b.bytes.__getitem__, b)) != whole or self.a.plain.decode_bytes(a) != whole:
            return None
        a, b, marks = np.array(a), np.array(b), np.zeros(len(whole), np.uint8)
        marks[np.cumsum(self.a_lengths[a]) - 1] |= 1
        marks[np.cumsum(self.b_lengths[b]) - 1] |= 2
        return Alignment(a, b, marks)

    def digest(self, text: str) -> tuple:
        """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of a text, its linked pairs told apart and counted."""
        found = self.align(text)
        if found is None:
            return 0, 0, 0, 0, "", b"", b""
        linked = found.a[found.a_end - 1] * self.b.size + found.b[found.b_end - 1]
        pairs, times = np.unique(linked.astype(np.uint32), return_counts=True)
        return len(found.a), len(found.b), len(found.ends), len(linked), hashlib.sha256(found.text(self.digits)).hexdigest(), pairs.tobytes(), times.astype(np.uint32).tobytes()

    def groups(self, text: str) -> list[dict]:
        """The groups of a text: byte offsets in it (the space before it is at -1), and the ids of A and of B."""
        found = self.align(text)
        if found is None:
            return []
        edges = [np.concatenate([[0], x]).tolist() for x in (found.ends, found.a_end, found.b_end)]
        return [
            {"start": start - 1, "end": end - 1, "a": found.a[i:m].tolist(), "b": found.b[j:n].tolist()}
            for start, end, i, m, j, n in zip(edges[0], edges[0][1:], edges[1], edges[1][1:], edges[2], edges[2][1:], strict=False)
        ]


def align(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """(doc_id, groups): each document's groups in order, (start, end, a, b) with byte offsets in the text and token ids.

    The first group starts at -1, where the space is that stands before the text.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a, b)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()], pa.int64()), pa.array([aligner.groups(text.as_py() or "")], kind)], ["doc_id", "groups"])

    return _texts(docs).mapInArrow(kernel, f"doc_id bigint, groups array<{GROUP}>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def linked(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """PAIRS of each document: numbers of tokens, groups and links, the groups' digest, the linked pairs and their times."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, numbers = Aligner(a, b), [pa.int64()] * 5
        names = [x.split()[0] for x in PAIRS.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = [(doc_id.as_py(), *aligner.digest(text.as_py() or "")) for doc_id, text in zip(part.column(0), part.column(1), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [*numbers, pa.string(), pa.binary(), pa.binary()], strict=True)], names)

    return _texts(docs).mapInArrow(kernel, PAIRS)


def _added(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs told apart, with the sums of their times."""
    keys, places = np.unique(np.concatenate(pairs), return_inverse=True)
    return keys, np.bincount(places, np.concatenate(times), len(keys)).astype(np.int64)


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n) of a partition's documents: never more rows than there are pairs."""
    keys, sums = np.empty(0, np.uint32), np.empty(0, np.int64)
    for batch in batches:
        parts = [[np.frombuffer(x.as_py(), np.uint32) for x in batch.column(i)] for i in (0, 1)]
        keys, sums = _added([keys, *parts[0]], [sums, *parts[1]])
    yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(sums)], ["pair", "n"])


def pair_counts(stored: DataFrame, b_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs in order, their counts over all documents, whether a count is its B token's highest)."""
    counted = stored.select("pairs", "times").mapInArrow(tally, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs, n = (counted.column(c).to_numpy().astype(np.int64) for c in ("pair", "n"))
    order = np.argsort(pairs)
    pairs, n = pairs[order], n[order]
    best = np.zeros(b_size, np.int64)
    np.maximum.at(best, pairs % b_size, n)
    return pairs.astype(np.uint32), n, n == best[pairs % b_size]


def scored(stored: DataFrame, b_size: int) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of documents as `linked` has them."""
    pairs, n, best = pair_counts(stored, b_size)
    held = stored.sparkSession.sparkContext.broadcast((pairs, n, best))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = held.value
        for batch in batches:
            n_best, count_sum = [], []
            for own, times in zip(batch.column(6), batch.column(7), strict=True):
                at, times = np.searchsorted(pairs, np.frombuffer(own.as_py(), np.uint32)), np.frombuffer(times.as_py(), np.uint32).astype(np.int64)
                n_best.append(int(times[best[at]].sum()))
                count_sum.append(int((times * n[at]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], [*names, "n_best", "count_sum"])

    found = stored.mapInArrow(kernel, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint")
    return found.select(*names[:5], "n_best", "count_sum", "groups_sha256")


def most_pairs(a: str = A, b: str = B) -> int:
    """How many pairs of tokens can end together at all: the bytes of one are the end of the other's."""
    aligner = Aligner(a, b)
    left = aligner.a.bytes

    def ends(tokens: list[bytes], others: list[bytes], least: int) -> int:
        times: dict[bytes, int] = {}
        for t in others:
            times[t] = times.get(t, 0) + 1
        return sum(times.get(t[k:], 0) for t in tokens for k in range(least, len(t)))

    return ends(left, aligner.b.bytes, 0) + ends(aligner.b.bytes, left, 1)


def alignment(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    return scored(materialize(linked(docs, a, b), "linked"), Pieces(b).size)
