"""Toxicity: a convolutional text classifier in numpy.

A word is the sum of hashed rows of an embedding table, its own and those of its beginnings, so words that are new
are told by kin; filters of several widths slide over the whole text, the largest
response of each filter, rectified, goes to a logistic unit. The model is trained by stochastic gradients on all
labelled rows. It begins with several passes over MOST_ROWS rows and MOST_BYTES of text at most, evenly of both labels,
on the driver. If there are more, all of them are dealt, by hashes, to shards of about SHARD rows at most, each of which goes on
from that beginning with one pass over its rows in a task; what the shards changed is averaged, a row of numbers over
the shards that changed it. About every fifth row is left out of training, and all of these set the thresholds: one for
each language that function words tell, drawn towards the common one by SHRINK, so that the fewer rows a language has
the less it departs. A score is the probability with its language's threshold moved to 0.5.

Only the text of a row goes into its score. The model is a few megabytes and is broadcast; a text is scored in
blocks, so a long one needs no more memory than a short one.
"""

from __future__ import annotations

import copy
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.llm.common import discard, materialize
from tabscore.llm.language import Language

BUCKETS, DIM, FILTERS, WIDTHS, BLOCK, CACHED = 1 << 15, 16, 16, (1, 2, 3), 1 << 15, 1 << 17
PAD = max(WIDTHS) - 1
#: The bounds on labelled rows that are gathered to begin with and on the bytes of their texts.
MOST_ROWS, MOST_BYTES, SHARES = 6000, 64 << 20, 16
#: Rows of a shard, rows of numbers that are summed up together, steps of a logit in which rows for thresholds are counted.
SHARD, PIECE, FINE = 8192, 2048, 256
#: Passes over the rows to begin with, step size, weight decay, rows of a language that weigh as much as the common threshold.
EPOCHS, RATE, DECAY, SHRINK = 6, 0.1, 1e-4, 30
#: How much worse it is to reject a clean document, by share of its label, than to keep a toxic one.
ALARM = 4.0
_BLANKS = bytes(range(0x30)) + b":;<=>?@[\\]^_`{|}~\x7f"
_TABLE = bytes.maketrans(_BLANKS + bytes(range(65, 91)), b" " * len(_BLANKS) + bytes(range(97, 123)))


class Features(dict):
    """A word's rows of the embedding table: those of the word and of its first 4, 5 and 6 bytes, as packed numbers."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = rows_of(word)
        return value


def rows_of(word: bytes) -> bytes:
    return struct.pack("<4H", *(zlib.crc32(part) % BUCKETS for part in (b"=" + word, word[:4], word[:5], word[:6])))


def words_in(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def unpacked(rows: bytes) -> np.ndarray:
    return np.frombuffer(rows, "<u2").reshape(-1, 4)


@dataclass
class Model:
    embed: np.ndarray  # BUCKETS + 1 rows; the last, of zeros, pads short texts
    filters: list[np.ndarray]  # for each width: (width, DIM, FILTERS)
    out: np.ndarray
    bias: float
    thresholds: dict[str, float]  # of the logit

    def score(self, logit: float, language: str) -> float:
        z = logit - self.thresholds.get(language, self.thresholds[""])
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


class Scorer(dict):
    """The logit of whole texts. A word's responses to all offsets of all filters are computed once, as long as there is
    room for them; the response of a filter at a place is then a sum of its words' parts."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        parts = [w[k] for w in model.filters for k in range(len(w))]
        self.tables = model.embed @ np.concatenate(parts, axis=1)
        self.rows = np.zeros((CACHED + 1, self.tables.shape[1]), np.float32)  # row 0 pads
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(rows_of(word))
        value = self[word] = len(self) + 1
        return value

    def responses(self, words: list[bytes]) -> np.ndarray:
        if len(self) + len(words) > CACHED:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        if self.new:
            self.rows[len(self) - len(self.new) + 1 : len(self) + 1] = self.tables[unpacked(b"".join(self.new))].sum(axis=1)
            self.new.clear()
        return self.rows[np.concatenate([at, np.zeros(PAD + 1, np.int32)])]

    def logit(self, text: bytes | None) -> float:
        words = words_in(text)
        best = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
        for at in range(0, max(1, len(words)), BLOCK):
            made = self.responses(words[at : at + BLOCK + PAD])
            n, offset = max(1, min(BLOCK, len(words) - at)), 0
            for i, width in enumerate(WIDTHS):
                total = made[:n, offset : offset + FILTERS]
                for k in range(1, width):
                    total = total + made[k : n + k, offset + k * FILTERS : offset + (k + 1) * FILTERS]
                offset += width * FILTERS
                own = slice(i * FILTERS, (i + 1) * FILTERS)
                best[own] = np.maximum(best[own], total.max(axis=0))
        return float(np.maximum(best, 0) @ self.model.out) + self.model.bias


def flat(model: Model) -> np.ndarray:
    """All of a model's numbers but the thresholds, in rows of DIM."""
    rest = np.concatenate([*[w.ravel() for w in model.filters], model.out, [np.float32(model.bias)]])
    return np.concatenate([model.embed, np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)]).astype(np.float32)


def unflat(numbers: np.ndarray) -> Model:
    """The model of which flat gives these numbers, with thresholds of 0."""
    embed, rest, at, filters = numbers[: BUCKETS + 1].copy(), numbers[BUCKETS + 1 :].ravel(), 0, []
    for w in WIDTHS:
        filters.append(rest[at : at + w * DIM * FILTERS].reshape(w, DIM, FILTERS).copy())
        at += w * DIM * FILTERS
    n = len(WIDTHS) * FILTERS
    return Model(embed, filters, rest[at : at + n].copy(), float(rest[at + n]), {"": 0.0})


class Trainer:
    """A model in training, with the squares of its gradients so far, by which each number's steps get smaller."""

    def __init__(self, model: Model):
        self.model = model
        self.grads = [np.full_like(model.embed, 1e-2), *[np.full_like(w, 1e-2) for w in model.filters], np.full_like(model.out, 1e-2)]
        self.g_bias = 1e-2

    def step(self, h: np.ndarray, y: int) -> None:
        """h: embedding rows of each word. A long text is read in blocks, of which only the largest responses are kept."""
        model, grads, columns = self.model, self.grads, np.arange(FILTERS)
        embed, filters = model.embed, model.filters
        n = max(1, len(h))
        h = np.concatenate([h, np.full((PAD + 1, 4), BUCKETS, np.uint16)])
        tops, best = [None] * len(filters), [None] * len(filters)
        for at in range(0, n, BLOCK):
            m = min(BLOCK, n - at)
            vectors = embed[h[at : at + m + PAD]].sum(axis=1)
            for j, w in enumerate(filters):
                made = vectors[:m] @ w[0]
                for k in range(1, len(w)):
                    made += vectors[k : m + k] @ w[k]
                t = made.argmax(axis=0)
                value = made[t, columns]
                if at:
                    more = value > best[j]
                    tops[j], best[j] = np.where(more, at + t, tops[j]), np.where(more, value, best[j])
                else:
                    tops[j], best[j] = t, value
        met = [[embed[h[tops[j] + k]].sum(axis=1) for k in range(len(w))] for j, w in enumerate(filters)]
        flat_ = np.concatenate(best)
        live = np.maximum(flat_, 0)
        p = 1 / (1 + np.exp(-np.clip(live @ model.out + model.bias, -30, 30)))
        e = np.float32(p - y)
        back = e * model.out * (flat_ > 0)
        g = e * live + DECAY * model.out
        grads[-1] += g * g
        model.out -= RATE * g / np.sqrt(grads[-1])
        self.g_bias += e * e
        model.bias -= float(RATE * e / np.sqrt(self.g_bias))
        for j, w in enumerate(filters):
            own = back[j * FILTERS : (j + 1) * FILTERS]
            on = np.flatnonzero(own)
            if not len(on):
                continue
            for k in range(len(w)):
                rows_ = h[tops[j][on] + k]
                gw = np.zeros_like(w[k])
                gw[:, on] = met[j][k][on].T * own[on]
                gw += DECAY * w[k]
                ge = w[k][:, on].T * own[on][:, None]
                grads[1 + j][k] += gw * gw
                w[k] -= RATE * gw / np.sqrt(grads[1 + j][k])
                for part in range(4):
                    np.add.at(grads[0], rows_[:, part], ge * ge)
                    np.add.at(embed, rows_[:, part], -RATE * ge / np.sqrt(grads[0][rows_[:, part]]))
        embed[BUCKETS] = 0


def begin(rows: list[tuple[np.ndarray, int, str]], seed: int = 11) -> tuple[Trainer, list[tuple[np.ndarray, int, str]], bool]:
    """A trained model, the rows left for its thresholds, every fifth of each label, and whether it had both labels."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.15, (BUCKETS + 1, DIM)).astype(np.float32)
    embed[BUCKETS] = 0
    filters = [rng.normal(0, 0.4 / w**0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    model = Model(embed, filters, rng.normal(0, 0.2, len(WIDTHS) * FILTERS).astype(np.float32), 0.0, {"": 0.0})
    seen = [0, 0]
    fit, held = [], []
    for row in rows:
        seen[row[1]] += 1
        (held if seen[row[1]] % 5 == 0 else fit).append(row)
    trainer = Trainer(model)
    if not min(sum(y for _, y, _ in fit), sum(1 - y for _, y, _ in fit)):
        share = sum(y for _, y, _ in rows) / len(rows) if rows else 0.0
        model.out[:], model.bias = 0, 1.0 if share > 0.5 else -1.0
        return trainer, held, False
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fit)):
            trainer.step(*fit[i][:2])
    return trainer, held, True


def train(rows: list[tuple[np.ndarray, int, str]], seed: int = 11) -> Model:
    """rows: embedding rows of each word, label, language; every fifth of each label is left for the thresholds."""
    trainer, held, both = begin(rows, seed)
    if both:
        calibrate(trainer.model, [(logit_of(trainer.model, h), y, language) for h, y, language in held])
    return trainer.model


def logit_of(model: Model, h: np.ndarray) -> float:
    """The logit from a text's embedding rows, straight from the definition."""
    vectors = model.embed[np.concatenate([h, np.full((PAD + 1, 4), BUCKETS, np.uint16)])].sum(axis=1)
    n = max(1, len(h))
    best = [sum(vectors[k : n + k] @ w[k] for k in range(len(w))).max(axis=0) for w in model.filters]
    return float(np.maximum(np.concatenate(best), 0) @ model.out) + model.bias


def best_threshold(logits: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> float:
    """The cut with the largest share of label 1 above it less ALARM times the share of label 0: of several equally good
    ones the middle one, halfway between two different values. counts: how many rows each one stands for."""
    if not len(labels) or labels.min() == labels.max():
        return 0.0
    order = np.argsort(logits)
    z, y = logits[order], labels[order]
    ones, zeros = (of if counts is None else of * counts[order] for of in (y, 1 - y))
    below_1 = np.concatenate([[0], np.cumsum(ones)])
    below_0 = np.concatenate([[0], np.cumsum(zeros)])
    value = (ones.sum() - below_1) / ones.sum() + ALARM * below_0 / zeros.sum()
    value[1:-1][z[1:] == z[:-1]] = -np.inf
    cuts = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    good = np.flatnonzero(value >= value.max() - 1e-12)
    return float(cuts[good[len(good) // 2]])


def calibrate(model: Model, rows: list[tuple[float, int, str]], counts: list[int] | None = None) -> None:
    z, y, tags = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    each = np.ones(len(rows), np.int64) if counts is None else np.array(counts, np.int64)
    model.thresholds[""] = common = best_threshold(z, y, each) if len(rows) else 0.0
    for tag in sorted(set(tags)):
        own = tags == tag
        n = min(int((y * each)[own].sum()), int(((1 - y) * each)[own].sum()))
        if n:
            model.thresholds[str(tag)] = (n * best_threshold(z[own], y[own], each[own]) + SHRINK * common) / (n + SHRINK)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from: crc32 of doc_id as text, modulo 5, is 0 (a null doc_id is held out)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features, language = Features(), Language()
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([language(t or b"") for t in texts]), pa.array([b"".join(map(features.__getitem__, words_in(t))) for t in texts], pa.binary()), batch.column(2)], ["label", "language", "h", "left_out"])


def sample(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(label, text) of the rows to begin with, none of them held out: at most most_rows and most_bytes of UTF-8.

    Both bounds hold after the join with docs, half of each for either label: of rows that share a doc_id each counts
    for itself, but equal texts of one doc_id count once. No text has more than 1 / SHARES of a label's bytes; a label
    all of whose texts have more keeps its shortest, if that fits. Texts are taken in the order of a hash of their
    doc_id; one whose bytes would exceed what is left is passed over. docs are read once.
    """
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    marks = marks.filter(~held_out(F.col("doc_id"))).withColumn("order", F.xxhash64("doc_id", F.lit(3)))
    ids = None
    for label in (0, 1):
        part = marks.filter(F.col("label") == label).orderBy("order", "doc_id").limit(most_rows // 2)
        ids = part if ids is None else ids.unionByName(part)
    text = docs.filter("text is not null").select("doc_id", "text", F.xxhash64("text").alias("key"), F.octet_length("text").cast("long").alias("bytes"))
    found = text.filter(F.col("bytes") <= most_bytes // 2).join(F.broadcast(ids.select("doc_id", "label", "order")), "doc_id")
    found = materialize(found.groupBy("label", "order", "doc_id", "key").agg(F.max("bytes").alias("bytes"), F.max("text").alias("text")), "labelled")
    chosen, few = [], F.col("bytes") <= most_bytes // 2 // SHARES
    for label in (0, 1):
        own, left = found.filter(F.col("label") == label).select("doc_id", "order", "key", "bytes"), most_bytes // 2
        rows = own.filter(few).orderBy("order", "doc_id", "key").limit(most_rows // 2).collect() or own.orderBy("bytes", "order", "doc_id", "key").limit(1).collect()
        for r in rows:
            if r["bytes"] <= left:
                left -= r["bytes"]
                chosen.append((r["doc_id"], r["key"], label))
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(chosen, f"doc_id {kind}, key bigint, label int")
    return found.join(F.broadcast(chosen), ["doc_id", "key", "label"], "left_semi").select("label", "text")


def labelled(docs: DataFrame, labels: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, key, label, text) of all rows to learn from; rows of one doc_id and key, a hash of the text, are equal.

    parts: into how many partitions they are dealt by doc_id. Texts are shuffled once, at every size.
    """
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    text = docs.filter("text is not null").filter(~held_out(F.col("doc_id"))).select("doc_id", "text", F.xxhash64("text").alias("key"))
    marks = marks.filter(~held_out(F.col("doc_id")))
    if parts:
        text, marks = text.repartition(parts, "doc_id"), marks.repartition(parts, "doc_id")
    return text.join(marks.hint("merge"), "doc_id").select("doc_id", "key", "label", "text")


def for_thresholds(text: Column) -> Column:
    """A fifth of all texts, by their hashes: where not all rows are gathered these set the thresholds; copies stay together."""
    return F.pmod(F.xxhash64(text, F.lit(7)), F.lit(5)) == 0


def learn_rows(start):
    """(shard, piece, change, label, text) from (shard, doc_id, key, label, left_out, text) sorted by shard: what a
    shard's rows change in the numbers of start, in pieces, and the rows that are left out, as they are."""
    names, kinds = ["shard", "piece", "change", "label", "text"], [pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.large_binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*columns[:-1], columns[-1].cast(pa.string())], names)

    def changes(shard: int, own: Trainer) -> Iterator[pa.RecordBatch]:
        made = flat(own.model) - flat(start.value.model)
        for i, at in enumerate(range(0, len(made), PIECE)):
            yield batch_of([(shard, i, made[at : at + PIECE].tobytes(), None, None)])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, own, group, before = Features(), None, None, None
        for batch in batches:
            heads, apart = zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True), []
            for (shard, doc_id, key, label, left_out), value in zip(heads, batch.column(5).cast(pa.large_binary()), strict=True):
                if shard != group:
                    if own:
                        yield from changes(group, own)
                    group, own = shard, copy.deepcopy(start.value)
                if (doc_id, key) == before:
                    continue
                before, text = (doc_id, key), value.as_py()
                if left_out:
                    apart.append((shard, None, None, label, text))
                else:
                    own.step(unpacked(b"".join(map(features.__getitem__, words_in(text)))), label)
            if apart:
                yield batch_of(apart)
        if own:
            yield from changes(group, own)

    return kernel


def summed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, mean) from (piece, change) sorted by piece: the changes of each row of numbers, averaged over those that aren't 0."""
    group, total, count = None, None, None

    def batch_of() -> pa.RecordBatch:
        mean = (total / np.maximum(count, 1)[:, None]).astype(np.float32)
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([mean.tobytes()], pa.binary())], ["piece", "mean"])

    for batch in batches:
        for piece, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            change = np.frombuffer(value.as_buffer(), np.float32).reshape(-1, DIM)
            if piece != group:
                if group is not None:
                    yield batch_of()
                group, total, count = piece, np.zeros(change.shape), np.zeros(len(change), np.int64)
            total += change
            count += change.any(axis=1)
    if group is not None:
        yield batch_of()


def logit_rows(shared):
    """(language, label, z) from (label, text): logits in steps of 1 / FINE."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, language = Scorer(shared.value), Language()
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1).cast(pa.large_binary())]
            z = [round(scorer.logit(t) * FINE) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([language(t) for t in texts], pa.string()), batch.column(0), pa.array(z, pa.int64())], ["language", "label", "z"])

    return kernel


def learn_all(rows: DataFrame, start: Trainer) -> Model:
    """start, after one pass over all rows of labelled(), each partition a shard, and with thresholds of all those left out."""
    spark = rows.sparkSession
    dealt = rows.select(F.spark_partition_id().alias("shard"), "doc_id", "key", "label", for_thresholds(F.col("text")).alias("left_out"), "text", F.xxhash64("doc_id", "key", F.lit(3)).alias("order"))
    dealt = dealt.sortWithinPartitions("shard", "order", "doc_id", "key").drop("order")
    learnt = dealt.mapInArrow(learn_rows(spark.sparkContext.broadcast(start)), "shard int, piece int, change binary, label int, text string")
    learnt = materialize(learnt, "learnt")
    pieces = learnt.filter("piece is not null").repartition("piece").sortWithinPartitions("piece", "shard").select("piece", "change")
    mean = {r["piece"]: r["mean"] for r in pieces.mapInArrow(summed_rows, "piece int, mean binary").collect()}
    model = unflat(flat(start.model) + np.frombuffer(b"".join(mean[i] for i in sorted(mean)), np.float32).reshape(-1, DIM))
    logits = learnt.filter("piece is null").select("label", "text").mapInArrow(logit_rows(spark.sparkContext.broadcast(model)), "language string, label int, z bigint")
    # As many rows as there are steps between logits, of each language and label, whatever the table's size.
    found = logits.groupBy("language", "label", "z").count().collect()
    calibrate(model, [(r["z"] / FINE, r["label"], r["language"]) for r in found], [r["count"] for r in found])
    discard(learnt)
    return model


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> Model:
    """Trains on all labelled rows: on sample(docs, labels, most_rows, most_bytes), then, if there are more, on all of them.

    A doc_id with several labels counts as toxic if one of them is; rows without a label or a text are not used.
    """
    first = sample(docs, labels, most_rows, most_bytes).withColumn("left_out", for_thresholds(F.col("text")))
    hashed_rows = first.select("label", "text", "left_out").mapInArrow(_hash_rows, "label int, language string, h binary, left_out boolean")
    # Sorted by content, so that training doesn't depend on the order in which partitions arrive.
    found = sorted((r["h"], r["label"], r["language"], r["left_out"]) for r in hashed_rows.toLocalIterator())
    n = labelled(docs, labels).select("doc_id", "key").distinct().count()
    if n > len(found):
        start, _, both = begin([(unpacked(h), label, language) for h, label, language, left_out in found if not left_out])
        if both:
            return learn_all(labelled(docs, labels, -(-n // SHARD)), start)
    return train([(unpacked(h), label, language) for h, label, language, _ in found])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the column score (0 to 1), for every row; null and empty texts have the score of no words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in ("score", "text")]
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest], "text string", "score double"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        scorer, language = Scorer(own), Language()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.large_binary())
            scores = []
            for text in texts:
                t = text.as_py() or b""
                scores.append(own.score(scorer.logit(t), language(t)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*rest, "text", "score"])

    return docs.select(*rest, "text").mapInArrow(kernel, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The registered query: doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels)).select("doc_id", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
