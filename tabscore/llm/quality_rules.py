"""Quality rules: word and line counts, and how well public tokenizers fit a text.

Measures of fertility over the whole text: tokens a word and characters a token of a byte-level BPE vocabulary made for
many languages, the share of its words' bytes that a piece vocabulary falls back to, as it has no other piece for them,
and the entropy of the token ids in bits. A text's language is told by its function words, its script by its letters.

The bands of each language or script come from the table itself: quartiles of the measures over all texts that pass
the base rule, from counts of rounded values, by one aggregation. A band reaches from the median by a factor, or
further where the quartiles lie far apart. Latin script in no known language is held to the bands of all known Latin
languages together, as it may be anything that isn't prose; a language with few texts is held to those too. A text
outside one of its bands is rejected, and nothing else is asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.llm.common import materialize
from tabscore.llm.language import FUNCTION_WORDS, Language

BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean"
MEASURES = "language string, tokens_per_word double, chars_per_token double, byte_share double, entropy double"
MIN_WORDS, VOCABULARY = 50, "byte_bpe_multi_50k"
LATIN = tuple(FUNCTION_WORDS)
#: By measure: how many times more or less than the median a text may have, and how many quartile distances beyond the quartiles.
WIDTH = {"tokens_per_word": 1.5, "chars_per_token": 2.0, "entropy": 2.0}
FENCE, LEAST_TEXTS, PLACES = 6.0, 30, 3
#: The most bytes that fall back, in Latin and in any other script: most vocabularies lack whole scripts.
MOST_BYTES, MOST_BYTES_OTHER = 0.10, 0.50


def repeated_words(ids: np.ndarray) -> int:
    """Words in windows of three that are in the text twice or more."""
    if len(ids) < 4:
        return 0
    size = np.int64(ids.max() + 1)
    pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
    windows = pairs[:-1] * size + ids[2:]
    _, where, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[where] > 1
    if not twice.any():
        return 0
    held = np.zeros(len(ids), bool)
    for k in range(3):
        held[k : len(ids) - 2 + k] |= twice
    return int(held.sum())


class Words(dict):
    """word -> its place in the columns: bytes that are pieces, votes for each language. A text's new words are measured together."""

    ROOM = 300_000

    def __init__(self):
        from tabscore.llm.tokens import PieceBPE

        super().__init__()
        self.counts, self.language = PieceBPE(), Language()
        self.columns, self.new = np.zeros((1024, 1 + len(FUNCTION_WORDS))), []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        place = self[word] = len(self)
        return place

    def places(self, words: list[bytes]) -> np.ndarray:
        """The places of a text's words; what was known is forgotten before a text for which there may be no room."""
        if len(self) + len(words) > self.ROOM:
            self.clear()
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            start, stop = len(self) - len(self.new), len(self)
            while stop > len(self.columns):
                self.columns = np.concatenate([self.columns, np.zeros_like(self.columns)])
            self.columns[start:stop] = 0
            self.columns[start:stop, 0] = self.counts.bytes_of(self.new)
            for place, votes in enumerate(map(self.language.votes, self.new), start):
                if votes:
                    self.columns[place, 1:] = votes
            self.new.clear()
        return found


def base_counts(text: bytes, words: list[bytes], places: np.ndarray) -> tuple[int, int, int, int, int, bool]:
    n = len(words)
    points = sum(map(len, words)) - _continuations(text)
    symbols = sum(map(text.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    repeated = repeated_words(places)
    return n, points, symbols, len(lines) - len(set(lines)), repeated, n < MIN_WORDS or 100 * repeated > 50 * n


_HIGH = bytes(range(0x80, 0xC0))


def _continuations(text: bytes) -> int:
    """Bytes of UTF-8 that don't begin a code point."""
    return 0 if text.isascii() else len(text) - len(text.translate(None, _HIGH))


class Fertility:
    """The base counts and the measures of whole texts."""

    def __init__(self):
        from tabscore.llm.tokens import ByteBPE

        self.bpe, self.words = ByteBPE(VOCABULARY), Words()

    def __call__(self, text: bytes) -> tuple[tuple, tuple[str, float | None, float | None, float, float | None]]:
        """The base columns, and language or script, tokens a word, characters a token, byte share, bits of entropy; nulls without words."""
        words = text.split()
        places = self.words.places(words)
        base = base_counts(text, words, places)
        sums = self.words.columns[places].sum(axis=0).tolist()
        tag = self.words.language.told(sums[1:], len(words), text)
        if not words:
            return base, (tag, None, None, 0.0, None)
        plain = text.decode("utf-8", "replace")
        ids = self.bpe.encode(plain)
        p = (np.unique(ids, return_counts=True)[1] if len(ids) < 4000 else np.bincount(ids)) / len(ids)
        p = p[p > 0]
        return base, (tag, len(ids) / len(words), len(plain) / len(ids), sums[0] / sum(map(len, words)), float(-(p * np.log2(p)).sum()))


def _kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fertility = Fertility()
    names = [x.split()[0] for x in f"{BASE}, {MEASURES}".split(", ")]
    kinds = [*[pa.int64()] * 5, pa.bool_(), pa.string(), *[pa.float64()] * 4]
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch, rows = whole.slice(at, 1024), []
            for text in batch.column(1).cast(pa.large_binary()).to_pylist():
                base, measured = fertility(text or b"")
                rows.append((*base, *measured))
            cols = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", *names])


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and verdict, and the measures, for every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_kernel, f"doc_id {kind}, {BASE}, {MEASURES}")


def quartiles(measured: DataFrame) -> dict[tuple[str, str], tuple[int, float, float, float]]:
    """(group, measure) -> (texts, quartiles), over texts that pass the base rule; the group latin is of all known Latin languages."""
    groups = F.array(F.when(F.col("language") != "latin", F.col("language")), F.when(F.col("language").isin(*LATIN), F.lit("latin")))
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.round(m, PLACES).alias("value")) for m in WIDTH])
    rows = measured.filter(~F.col("base_failed")).select(F.explode(F.array_compact(groups)).alias("group"), cells.alias("cells")).select("group", F.inline("cells"))
    counts = rows.groupBy("group", "measure", "value").agg(F.count("*").alias("n"))
    found = counts.groupBy("group", "measure").agg(F.sum("n").alias("n"), F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("q"))
    return {(r["group"], r["measure"]): (r["n"], *r["q"]) for r in found.collect()}


def bands(measured: DataFrame) -> dict[str, dict[str, tuple[float, float]]]:
    """The least and most of each measure, by language or script; a group with too few texts has those of latin, if that has enough."""
    found, out = quartiles(measured), {}
    for group in (*LATIN, "latin", "other"):
        for m, width in WIDTH.items():
            n, low, middle, high = found.get((group, m), (0, None, None, None))
            if n < LEAST_TEXTS and group in LATIN:
                n, low, middle, high = found.get(("latin", m), (0, None, None, None))
            if n >= LEAST_TEXTS:
                out.setdefault(group, {})[m] = (min(middle / width, low - FENCE * (high - low)), max(middle * width, high + FENCE * (high - low)))
    return out


def within(of: dict[str, dict[str, tuple[float, float]]]) -> Column:
    """Whether a row's measures lie in its group's bands."""
    byte_share = F.col("byte_share") <= F.when(F.col("language") == "other", MOST_BYTES_OTHER).otherwise(MOST_BYTES)
    out = F.col("tokens_per_word").isNotNull() & byte_share
    for group, own in of.items():
        for m, (low, high) in own.items():
            if group != "other" or m != "tokens_per_word":  # other scripts may not put blanks between words
                out &= (F.col("language") != group) | F.col(m).between(low, high)
    return out


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and verdict, the measures, and kept, for every row of docs.

    Null, empty and blank texts have no words: they fail the base rule, their measures are null and they are not
    kept. Repeated rows agree, and count each for themselves in the bands; where a group has too few texts for bands,
    only the share of fallback bytes is asked. No rows give no rows. Other columns are not used.
    """
    measured = materialize(measures(docs), "measures")
    return measured.withColumn("kept", ~F.col("base_failed") & within(bands(measured)))


def verdicts(docs: DataFrame) -> DataFrame:
    """The registered query."""
    return quality_rules(docs)
