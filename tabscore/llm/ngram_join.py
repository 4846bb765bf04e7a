"""N-gram Jaccard join: pairs of documents whose sets of five-word shingles have a Jaccard likeness of 0.8 or more.

A set is made of 64-bit hashes of its shingles. The join loses no pair and never lists all pairs:

1. Equal sets are one: a set stands for all its documents from here on (`members`).
2. Shingles that are frequent, as each batch of rows counts them, are marked in a bitmap, whose size follows the
   number of rows up to 2 ** MOST_BITS bits. Each set is ordered by (frequent, hash) and its first n - ceil(0.8 n) + 1
   shingles, the prefix, are dealt: two sets that are 0.8 alike share one of them. A shingle that still is in very
   many prefixes is marked too and the deal is made anew.
3. The deal is by ranges of (shingle, size, set), so the sets of one shingle, a tile, are spread over as many ranges
   as they need, each sorted by size and streamed.
4. A pair's bitmap signatures (parities of hashed shingles, as long as the set's size band asks for, folded to the
   shorter) differ in no more bits than the sets differ in shingles: bit counts bound the overlap from above.
5. The pairs that are left are verified by intersecting the sorted arrays, which are made of these pairs' sets alone:
   a set is found again by a text that has it, so no other text is cut into shingles once more.

A group of n near copies isn't expanded: first rounds test each set with a few neighbours of its tile and join what
is linked. Then a tile's sets of its largest component and all others are cut, by size, into blocks of their own, and
two blocks meet if their bands of sizes are within 5/4 and one of them is outside the largest component: signatures
of the pairs that aren't in one component yet are compared block by block. Components are the same as with all links,
as a pair that isn't tested lies in one component already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscore.llm.common import discard, materialize, spread_join

SHINGLE = 5
#: Likeness as a fraction, FREQUENT: rows of a batch of one shingle, TILE: sets of one shingle, from which it is marked.
LIKE, FREQUENT, TILE, STEPS = (4, 5), 3, 256, (1, 2, 5, 13)
#: Bits of the bitmaps of marked shingles and wanted sets, as a power of 2: at least, for each row, at most (32 MB).
LEAST_BITS, BITS_A_ROW, MOST_BITS = 24, 64, 28
#: Rows of a tile that are compared with each other, or with as many others, at once.
BLOCK = 256
#: Sets that a task remembers, to give equal ones once; what it forgets is given again and merged later.
REMEMBERED = 250_000
#: Rows whose sets are made at once, shingles that are held to count them (32 MB), parts by hash in which they are counted, words whose hashes are kept.
ROWS, HELD, PARTS, WORDS = 256, 4 << 20, 16, 100_000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WordHashes(dict):
    """64-bit hashes of words; forgets them when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles (of all its words, if they are fewer than five)."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    with np.errstate(over="ignore"):
        if n < SHINGLE:
            return _mixed((h * _MULTIPLIERS[:n]).sum(keepdims=True) + np.uint64(n))
        sums = h[: n - SHINGLE + 1] * _MULTIPLIERS[0]
        for k in range(1, SHINGLE):
            sums += h[k : n - SHINGLE + 1 + k] * _MULTIPLIERS[k]
        sums = _mixed(sums)
        sums.sort()
        return sums[np.append(True, sums[1:] != sums[:-1])]


def signature(s: np.ndarray) -> bytes:
    """Parities of the shingles by hash: 64 bits at least, twice as many as the set has elements, a power of two."""
    bits = 64
    while bits < 2 * len(s) and bits < 1 << 16:
        bits *= 2
    counts = np.bincount((s >> np.uint64(20)) & np.uint64(bits - 1), minlength=bits) & 1
    return np.packbits(counts.astype(bool), bitorder="little").tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """Bits in which two signatures differ, the longer folded to the shorter: at most the sets' symmetric difference."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def least_overlap(n: int, m: int) -> int:
    """Smallest intersection of sets of n and m elements with 100 * it >= 80 * union."""
    return -(-LIKE[0] * (n + m) // (LIKE[0] + LIKE[1]))


def _each_set(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    hashes = WordHashes()
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            yield batch, [shingles(t, hashes) for t in batch.column(batch.num_columns - 1).cast(pa.large_binary()).to_pylist()]


def _digest(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def _first_bits(digest: bytes, bits: int) -> int:
    return int.from_bytes(digest[:4], "big") >> 32 - bits


def _text_digest(text: bytes | None) -> bytes:
    return xxhash.xxh3_128_digest(text or b"")


def mark_bits(n_rows: int) -> int:
    return max(LEAST_BITS, min(MOST_BITS, (BITS_A_ROW * n_rows).bit_length()))


def frequent(sets: list[np.ndarray]) -> np.ndarray:
    """The first MOST_BITS bits of the shingles that FREQUENT or more of the sets have, counted by parts of the hashes."""
    edges = np.arange(1, PARTS, dtype=np.uint64) * np.uint64((1 << 64) // PARTS)
    cuts = [[0, *np.searchsorted(s, edges).tolist(), len(s)] for s in sets]
    out = []
    for i in range(PARTS):
        values, counts = np.unique(np.concatenate([s[cut[i] : cut[i + 1]] for s, cut in zip(sets, cuts, strict=True)]), return_counts=True)
        out.append(np.unique(values[counts >= FREQUENT] >> np.uint64(64 - MOST_BITS)).astype(np.int32))
    return np.concatenate(out)


def member_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, k, sig, text_mark, marks): every row's set by its digest; the signature, and the first MOST_BITS bits of the
    text's digest, once for equal sets of a task's rows; at the last row of a run of up to HELD shingles, the first
    MOST_BITS bits of those that are in several different sets of the run."""
    seen: set[bytes] = set()
    own: dict[bytes, np.ndarray] = {}
    held, last = 0, None

    def made(ids: pa.Array, ns: list[int], ks: list, sigs: list, texts: list, marks: np.ndarray | None) -> pa.RecordBatch:
        each = pa.array([*[None] * (len(ns) - 1), marks], pa.list_(pa.int32()))
        columns = [ids, pa.array(ns, pa.int64()), pa.array(ks, pa.binary()), pa.array(sigs, pa.binary()), pa.array(texts, pa.int32()), each]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "k", "sig", "text_mark", "marks"])

    for batch, sets in _each_set(batches):
        if last:
            full = held >= HELD
            yield made(*last, frequent(list(own.values())) if full and own else None)
            if full:
                own, held = {}, 0
        ks, sigs, texts = [_digest(s) for s in sets], [], []
        for k, s, text in zip(ks, sets, batch.column(batch.num_columns - 1).cast(pa.large_binary()), strict=True):
            known = k is None or k in seen
            sigs.append(None if known else signature(s))
            texts.append(None if known else _first_bits(_text_digest(text.as_py()), MOST_BITS))
            if k is not None:
                if k not in own:
                    own[k], held = s, held + len(s)
                if len(seen) < REMEMBERED:
                    seen.add(k)
        # Copied: a slice would keep the whole batch with its texts.
        last = pa.array(batch.column(0).to_pylist(), batch.column(0).type), [len(s) for s in sets], ks, sigs, texts
    if last:
        yield made(*last, frequent(list(own.values())) if own else None)


def _bitmap(marks: DataFrame, bits: int, before: bytes | None = None) -> bytes:
    """The marks (below 2 ** bits) as a bitmap: at most 2 ** (bits - 6) rows of 64 marks reach the driver, as columns."""
    words = marks.groupBy(F.shiftright("mark", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(mark & 63))")).alias("bits"))
    out = np.zeros(1 << (bits - 6), np.int64) if before is None else np.frombuffer(before, np.int64).copy()
    found = words.toArrow()
    out[found["w"].to_numpy()] |= found["bits"].to_numpy()
    return out.tobytes()


def prefix_rows(marked, bits: int):
    """(h, n, ka, kb): the prefix of each set; equal sets of a task's rows once."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, seen = np.frombuffer(marked.value, np.uint8), set()
        for _, sets in _each_set(batches):
            hs, ns, ks, reps = [], [], [], []
            for s in sets:
                k = _digest(s)
                if k is None or k in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(k)
                n = len(s)
                p = n - (LIKE[0] * n + LIKE[1] - 1) // LIKE[1] + 1
                at = s >> np.uint64(64 - bits)
                hot = (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
                plain = s[hot == 0][:p]
                hs.append(plain if len(plain) == p else np.concatenate([plain, s[hot == 1][: p - len(plain)]]))
                ns.append(n)
                ks.append(k)
                reps.append(p)
            if hs:
                pair = np.repeat(np.frombuffer(b"".join(ks), np.int64).reshape(-1, 2), reps, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.repeat(np.array(ns, np.int32), reps)), pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1]))], ["h", "n", "ka", "kb"])

    return kernel


def shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, sub, n, place, k) of a range's rows sorted by (h, n, ka, kb): each set of an h once, with its place there.

    An h of one set goes, unless it is the range's first or last, which others may share. Only one row is held back.
    """
    sub = TaskContext.get().partitionId()
    before, place, held, first = None, -1, None, True

    def batch_of(h, n, places, a, b) -> pa.RecordBatch:
        ks = np.stack([a, b], axis=1).tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array(h), pa.array(np.full(len(h), sub, np.int64)), pa.array(n.astype(np.int64)), pa.array(places.astype(np.int64)), pa.array([ks[i : i + 16] for i in range(0, len(ks), 16)], pa.binary())],
            ["h", "sub", "n", "place", "k"],
        )

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        edge = [np.concatenate([[x[0] if before is None else y], x[:-1]]) for x, y in zip(cols, before or [None] * 4, strict=True)]
        new = (cols[0] != edge[0]) | (cols[2] != edge[2]) | (cols[3] != edge[3])
        starts = cols[0] != edge[0]
        if before is None:
            new[0] = starts[0] = True
        before = [x[-1] for x in cols]
        starts = starts[new]
        h, n, a, b = (c[new] for c in cols)
        if not len(h):
            continue
        index = np.arange(len(h))
        begun = np.maximum.accumulate(np.where(starts, index, -1))
        places = np.where(begun < 0, place + 1 + index, index - begun)
        # A row stays if its h has another one, here, or held back, or before.
        alone = np.append(starts[1:], True) & starts
        keep = ~alone
        if first and starts[0]:
            keep[0] = True
        waits = bool(alone[-1]) and not keep[-1]
        if held is not None and not starts[0]:
            yield batch_of(*held)
        held = (h[-1:], n[-1:], places[-1:], a[-1:], b[-1:]) if waits else None
        if keep.any():
            yield batch_of(h[keep], n[keep], places[keep], a[keep], b[keep])
        first, place = False, int(places[-1])
    if held is not None:
        yield batch_of(*held)


def near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) from (a, b, na, nb, sa, sb): the pairs whose sets' bitmap signatures don't rule them out."""
    for batch in batches:
        na, nb = (batch.column(i).to_numpy() for i in (2, 3))
        sa, sb = (batch.column(i).to_pylist() for i in (4, 5))
        keep = [(n + m - differing_bits(x, y)) // 2 >= least_overlap(int(n), int(m)) for n, m, x, y in zip(na.tolist(), nb.tolist(), sa, sb, strict=True)]
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["a", "b"])


def tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) from rows (lo, hi, bid, k, n, root, in_major, sig) sorted by (lo, hi): pairs of the blocks lo and hi, one of
    which is outside its tile's largest component, of different components, whose sizes and signatures don't rule them out."""
    group, rows, seen = None, [], set()

    def compare() -> list[tuple[bytes, bytes]]:
        out, (lo, hi) = [], group
        ours, theirs = ([r for r in rows if r[0] == bid] for bid in (lo, hi))
        if any(r[4] for r in ours):
            ours, theirs = theirs, ours
        theirs_n = np.array([r[2] for r in theirs])
        roots = [r[3] for r in theirs]
        # By length of the signature: those of one length are compared as one matrix.
        shapes: dict[int, list[int]] = {}
        for j, r in enumerate(theirs):
            shapes.setdefault(len(r[5]), []).append(j)
        matrices = [(np.array(at), np.frombuffer(b"".join(theirs[j][5] for j in at), np.uint64).reshape(len(at), -1)) for at in shapes.values()]
        for r in ours:
            if r[4]:  # of the tile's largest component
                continue
            for at, matrix in matrices:
                x, y = np.frombuffer(r[5], np.uint64), matrix
                while len(x) > y.shape[1]:
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                while y.shape[1] > len(x):
                    y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
                n = theirs_n[at]
                differ = np.bitwise_count(y ^ x).sum(axis=1, dtype=np.int64)
                near = sum(LIKE) * ((n + r[2] - differ) // 2) >= LIKE[0] * (n + r[2])
                near &= (LIKE[0] * n <= LIKE[1] * r[2]) & (LIKE[0] * r[2] <= LIKE[1] * n)
                for j in at[near].tolist():
                    if roots[j] != r[3]:
                        pair = (min(r[1], theirs[j][1]), max(r[1], theirs[j][1]))
                        if pair not in seen:
                            if len(seen) < REMEMBERED // 2:
                                seen.add(pair)
                            out.append(pair)
        return out

    def batch_of(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for lo, hi, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (lo, hi) != group:
                if group and (pairs := compare()):
                    yield batch_of(pairs)
                group, rows = (lo, hi), []
            rows.append(row)
    if group and (pairs := compare()):
        yield batch_of(pairs)


def linked_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) from (a, b, xa, xb): the pairs whose sorted arrays share enough elements."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            keep.append(len(np.intersect1d(x, y, assume_unique=True)) >= least_overlap(len(x), len(y)))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["a", "b"])


def array_rows(wanted, bits: int):
    """(k, x): the sorted arrays of the sets of texts whose digests the bitmap has, equal texts of a task's rows once."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, seen, hashes = np.frombuffer(wanted.value, np.uint8), set(), WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                found = []
                for value in whole.slice(at, ROWS).column(whole.num_columns - 1).cast(pa.large_binary()):
                    text = value.as_py()
                    digest = _text_digest(text)
                    mark = _first_bits(digest, bits)
                    if not bitmap[mark >> 3] >> (mark & 7) & 1 or digest in seen:
                        continue
                    if len(seen) < REMEMBERED:
                        seen.add(digest)
                    s = shingles(text, hashes)
                    if len(s):
                        found.append((_digest(s), s.tobytes()))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], ["k", "x"])

    return kernel


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, root): the smallest node of each one's component, by alternating large and small stars (edges to smaller nodes only)."""

    def stars(e: DataFrame, large: bool) -> DataFrame:
        # Every node's smallest neighbour, itself included; large: larger neighbours go to it, small: smaller ones do.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        # Written, so that both sides of the join are plain exchanges, in which the edges of a hub can be split.
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), f"{name}-least")
        used.append(least)
        joined = both.join(least, "u")
        if large:
            return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        others = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        return others.unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()

    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    e, used = materialize(e, name), []
    while True:
        used.append(e)
        wide = materialize(stars(e, True), name)
        e = materialize(stars(wide, False), name)
        discard(*used, wide)
        used.clear()
        # All stars: every node has one edge, and none of them is a centre too.
        one_each = e.groupBy("u").count().filter("count > 1").limit(1).count() == 0
        if one_each and e.select(F.col("v").alias("u")).join(e.select("u"), "u", "left_semi").limit(1).count() == 0:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    Null texts and texts without words have an empty set, linked with nothing: their component_id is their own
    doc_id. Rows that share doc_id are rows for themselves; null doc_ids are never a component's smallest unless all
    are null. Equal sets are linked. Other columns are not used.
    """
    rows = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    members = materialize(rows.mapInArrow(member_rows, f"doc_id {kind}, n bigint, k binary, sig binary, text_mark int, marks array<int>"), "sets")
    spark, bits = docs.sparkSession, mark_bits(members.count())

    marked = _bitmap(members.select(F.explode("marks").alias("mark")).select(F.shiftright("mark", MOST_BITS - bits).alias("mark")).distinct(), bits)
    for again in (True, True, False):
        bitmap = spark.sparkContext.broadcast(marked)
        # Written first: to find the ranges, the rows are read twice.
        prefixes = materialize(docs.select("text").mapInArrow(prefix_rows(bitmap, bits), "h bigint, n int, ka bigint, kb bigint"), "prefixes")
        order = ("h", "n", "ka", "kb")
        dealt = prefixes.repartitionByRange(*order).sortWithinPartitions(*order)
        tiles = materialize(dealt.mapInArrow(shared_rows, "h bigint, sub bigint, n bigint, place bigint, k binary"), "tiles")
        discard(prefixes)
        alike = tiles.groupBy("h").agg(F.bit_xor(F.xxhash64("k")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "k")).alias("y"), F.count("*").alias("count")).filter("count > 1")
        alike = materialize(alike, "alike")
        long = alike.filter(F.col("count") > TILE).select(F.shiftright("h", 64 - bits).bitwiseAND(F.lit((1 << bits) - 1)).alias("mark")).distinct()
        more = _bitmap(long, bits, marked)
        if more == marked or not again:
            break
        discard(tiles, alike)
        marked = more

    # Tiles with the same sets have the same pairs: one of them is enough.
    kept = alike.groupBy("x", "y", "count").agg(F.min("h").alias("h")).select("h")
    every, tiles = tiles, materialize(spread_join(tiles, kept, alike.select("h", "count"), "h", "left_semi"), "tiles")
    sigs = members.filter("sig is not null").select("k", "n", "sig", "text_mark").join(tiles.select("k").distinct(), "k", "left_semi").dropDuplicates(["k"])
    sigs = materialize(sigs, "signatures")
    discard(every, alike)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that are links: arrays are made, of one text of each of their sets, in one more pass that only hashes all others."""
        pairs = materialize(pairs, f"{name}-pairs")
        if pairs.isEmpty():
            return pairs
        ends = sigs.join(pairs.select(F.explode(F.array("a", "b")).alias("k")), "k", "left_semi").select(F.shiftright("text_mark", MOST_BITS - bits).alias("mark")).distinct()
        wanted = spark.sparkContext.broadcast(_bitmap(ends, bits))
        arrays = materialize(docs.select("text").mapInArrow(array_rows(wanted, bits), "k binary, x binary").repartition("k").dropDuplicates(["k"]), f"{name}-arrays")
        x, y = (arrays.select(F.col("k").alias(c), F.col("x").alias(f"x{c}")) for c in "ab")
        out = materialize(pairs.join(x, "a").join(y, "b").select("a", "b", "xa", "xb").mapInArrow(linked_pairs, "a binary, b binary"), name)
        discard(pairs, arrays)
        return out

    def bounded(pairs: DataFrame) -> DataFrame:
        """The pairs that their signatures don't rule out."""
        x, y = (sigs.select(F.col("k").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}")) for c in "ab")
        return pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(near_pairs, "a binary, b binary")

    # A few neighbours first: what they link needs no more pairs.
    step = F.explode(F.array(*[F.lit(s) for s in STEPS]))
    p = tiles.withColumn("step", step).select("h", "sub", "n", "k", (F.col("place") + F.col("step")).alias("place")).alias("p")
    next_to = p.join(tiles.alias("q"), ["h", "sub", "place"]).filter((F.col("p.k") != F.col("q.k")) & (F.col("q.n") * LIKE[0] <= F.col("p.n") * LIKE[1]))
    next_to = next_to.select(F.least("p.k", "q.k").alias("a"), F.greatest("p.k", "q.k").alias("b")).distinct()
    edges = verified(bounded(next_to), "links")
    tagged = tiles.join(components(edges).withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    tagged = materialize(tagged, "tagged")

    # Then the tiles that still have several components, in blocks: those of the largest one, and all others.
    by_root = tagged.groupBy("h", "root").agg(F.count("*").alias("sets")).groupBy("h")
    largest = materialize(by_root.agg(F.max_by("root", "sets").alias("major"), F.count("*").alias("roots"), F.sum("sets").alias("count")).filter("roots > 1"), "largest")
    open_ = spread_join(tagged, largest.select("h", "major"), largest.select("h", "count"), "h", "inner")
    side, part = ("h", "sub", "in_major"), ("h", "sub", "in_major", "run")
    open_ = open_.withColumn("in_major", F.col("root") == F.col("major")).withColumn("run", (F.col("place") / BLOCK).cast("long"))
    open_ = materialize(open_.select(*part, "k", "n", "root"), "open-runs")
    # Numbers within a side, by runs of at most BLOCK places and the rows of the runs before: no window is longer than a run.
    runs = open_.groupBy(*part).agg(F.count("*").alias("rows"))
    runs = runs.withColumn("before", F.coalesce(F.sum("rows").over(Window.partitionBy(*side).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = open_.withColumn("at", F.row_number().over(Window.partitionBy(*part).orderBy("n", "k")) - 1).join(runs.select(*part, "before"), list(part))
    open_, begun = numbered.withColumn("at", F.col("at") + F.col("before")), open_
    open_ = open_.withColumn("bid", F.xxhash64(*side, (F.col("at") / BLOCK).cast("long")))
    open_ = materialize(open_.select("h", "bid", "k", "n", "root", "in_major"), "open")
    discard(begun)
    blocks = materialize(open_.groupBy("h", "bid", "in_major").agg(F.min("n").alias("least"), F.max("n").alias("most")), "blocks")
    one, two = blocks.alias("p"), blocks.alias("q")
    meet = (F.col("p.bid") <= F.col("q.bid")) & ~(F.col("p.in_major") & F.col("q.in_major"))
    meet &= (F.col("p.least") * LIKE[0] <= F.col("q.most") * LIKE[1]) & (F.col("q.least") * LIKE[0] <= F.col("p.most") * LIKE[1])
    pairs = one.join(two, "h").filter(meet).select(F.col("p.bid").alias("lo"), F.col("q.bid").alias("hi"))
    ends = pairs.select("lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("bid"))
    dealt = open_.join(sigs.select("k", "sig"), "k").join(ends, "bid").select("lo", "hi", "bid", "k", "n", "root", "in_major", "sig")
    rest = dealt.repartition("lo", "hi").sortWithinPartitions("lo", "hi").mapInArrow(tile_pairs, "a binary, b binary").distinct()
    edges = edges.unionByName(verified(rest, "links"))
    groups = components(edges, name="classes").withColumnRenamed("node", "k")
    discard(tiles, sigs, tagged, largest, open_, blocks)

    # A component's smallest id: first of each set, then of the linked sets; then back to the rows.
    by_set = materialize(members.filter("k is not null").groupBy("k").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("count")), "by-set")
    linked = materialize(by_set.join(groups, "k"), "linked")
    least = linked.groupBy("root").agg(F.min("smallest").alias("component_id"), F.count("*").alias("count"))
    of_set = spread_join(linked.select("k", "root"), least.select("root", "component_id"), least.select("root", "count"), "root", "inner").select("k", "component_id")
    of_set = by_set.join(of_set, "k", "left").select("k", F.coalesce("component_id", "smallest").alias("component_id"))
    out = spread_join(members.filter("k is not null").select("doc_id", "n", "k"), of_set, by_set.select("k", "count"), "k", "inner")
    out = out.select("doc_id", "n", "component_id").unionByName(members.filter("k is null").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
