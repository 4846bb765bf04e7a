"""Best-fit packing: whole documents in as few windows as a swap-based local search can reach.

Only documents longer than the window are cut, into pieces as long as it, the first of which takes the rest. Pass one
tokenises each partition in its order and writes its pieces (place, length, checksum), each with its number among the
partition's pieces of that length. What can be packed depends on lengths alone, of which there are no more than the
window has places: the driver takes the count of each length, at most `window` numbers however many documents there
are, and packs kinds of bins, each with the number of bins of that kind.

1. Best fit decreasing: the longest first, each into the fullest bin that has room for it.
2. Local search, from the emptiest underfull bins: move a piece to another bin, exchange one for one, two for one or
   one for two, whichever raises the sum of squared fills most. Tokens go to the fuller bin, so that bins run empty.
   One exchange is made in as many pairs of bins of the two kinds as there are. It ends when no exchange is left that
   raises the sum, or the bins are as few as the number of tokens allows.

Pass two numbers the pieces of each length over all partitions (sums of the partitions' counts, by length), and looks
each number up in the plan, whose rows are a kind of bin's pieces of one length: a range of numbers, the first
sequence, and the place in it. Only pieces without their ids are shuffled; no group is collected, and a length that a
third of all pieces share is a range like any other.

Null texts are empty; every document, an empty one too, ends with end_id and has a piece at least. Repeated rows are
packed each for itself, a null doc_id stays null, no rows give no pieces, and columns other than doc_id and text are
not used. Texts of any length are cut as above.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscore.llm.common import materialize
from tabscore.llm.packing import VOCABULARY, WINDOW

END_ID = 2
STORED = "part bigint, nth bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
#: A kind of bin: (length, how many) of its pieces, longest first.
Kind = tuple[tuple[int, int], ...]
ROWS = 20_000


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [(name, pa.int32() if kind == "int" else pa.int64()) for name, kind in map(str.split, schema.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])


def pieces_of(vocabulary: str, end_id: int, window: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tabscore.llm.tokens import ByteBPE

        encoder, part, met, rows = ByteBPE(vocabulary), TaskContext.get().partitionId(), Counter(), []
        end = np.array([end_id], "<u4")
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.concatenate([encoder.encode(text.as_py() or "").astype("<u4"), end])
                edges = [0, *range(len(ids) % window or window, len(ids) + 1, window)]
                if edges[-1] < len(ids):
                    edges.append(len(ids))
                for piece, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append((part, met[b - a], doc_id.as_py(), piece, a, b - a, zlib.crc32(ids[a:b])))
                    met[b - a] += 1
                if len(rows) >= ROWS:
                    yield _batch(rows, STORED)
                    rows = []
        if rows:
            yield _batch(rows, STORED)

    return kernel


# Packing by counts


def fill_of(kind: Kind) -> int:
    return sum(length * n for length, n in kind)


def changed(kind: Kind, less: tuple[int, ...], more: tuple[int, ...]) -> Kind:
    """The kind without some pieces, and with others."""
    held = Counter(dict(kind))
    held.subtract(less)
    held.update(more)
    return tuple(sorted(((length, n) for length, n in held.items() if n), reverse=True))


def best_fit(counts: dict[int, int], window: int) -> dict[Kind, int]:
    """How many bins of each kind best fit decreasing makes of so many pieces of each length."""
    room: dict[int, dict[Kind, int]] = {}
    rooms: list[int] = []

    def put(kind: Kind, left: int, n: int) -> None:
        if left not in room:
            room[left] = {}
            rooms.insert(bisect_left(rooms, left), left)
        room[left][kind] = room[left].get(kind, 0) + n

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            left = rooms[at] if at < len(rooms) else window
            kind, bins = room[left].popitem() if at < len(rooms) else ((), n)
            if at < len(rooms) and not room[left]:
                del room[left], rooms[at]
            # The bin just served has the least room, so it is filled before the next is begun.
            each = min(left // length, n)
            served = min(bins, n // each)
            put((*kind, (length, each)), left - each * length, served)
            if kind and bins > served:
                put(kind, left, bins - served)
            n -= each * served
    out: dict[Kind, int] = {}
    for kinds in room.values():
        out |= kinds
    return out


class Search:
    """Kinds of underfull bins, and exchanges between two of them.

    What each kind can give (nothing, one piece, or two) lies in arrays, in the order in which the kinds came up, so
    that a kind that was tried before is held against later ones only.
    """

    def __init__(self, bins: dict[Kind, int], window: int):
        self.window, self.full, self.open = window, {}, {}
        self.total, self.most = sum(fill_of(k) * n for k, n in bins.items()), 1 << 12
        #: Of what a kind can give: its tokens, how many pieces, the kind's fill; a kind that is gone counts as full.
        self.tokens, self.pieces, self.fills = (np.zeros(self.most, np.int64) for _ in range(3))
        self.rows: list[tuple[Kind, tuple[int, ...]]] = []
        self.first: dict[Kind, int] = {}
        self.tried: dict[Kind, int] = {}
        for kind, n in bins.items():
            self.add(kind, n)

    @staticmethod
    def gifts(kind: Kind) -> list[tuple[int, ...]]:
        ones = [length for length, _ in kind]
        return [(), *((a,) for a in ones), *((a, b) for a, b in combinations_with_replacement(ones, 2) if a != b or dict(kind)[a] > 1)]

    def add(self, kind: Kind, n: int) -> None:
        if not kind or fill_of(kind) == self.window:
            if kind:
                self.full[kind] = self.full.get(kind, 0) + n
            return
        if kind not in self.open:
            what, at = self.gifts(kind), len(self.rows)
            if at + len(what) > self.most:
                self.most = 2 * (at + len(what))
                self.tokens, self.pieces, self.fills = (np.concatenate([x[:at], np.zeros(self.most - at, np.int64)]) for x in (self.tokens, self.pieces, self.fills))
            own = slice(at, at + len(what))
            self.tokens[own], self.pieces[own], self.fills[own] = [sum(w) for w in what], [len(w) for w in what], fill_of(kind)
            self.rows += [(kind, w) for w in what]
            self.first[kind] = at
        self.open[kind] = self.open.get(kind, 0) + n

    def take(self, kind: Kind, n: int) -> None:
        self.open[kind] -= n
        if not self.open[kind]:
            at = self.first.pop(kind)
            self.fills[at : at + len(self.gifts(kind))] = self.window
            del self.open[kind]
            self.tried.pop(kind, None)

    def compact(self) -> None:
        """Forget the rows of kinds that are gone, once they are most of all."""
        if len(self.rows) > 2 * sum(len(self.gifts(k)) for k in self.open) + (1 << 12):
            kinds, before = sorted(self.open, key=self.first.__getitem__), {k: self.tried.get(k, 0) for k in self.open}
            starts = [self.first[k] for k in kinds]
            old, self.open, self.rows, self.first = self.open, {}, [], {}
            for k in kinds:
                self.add(k, old[k])
            moved = [*(self.first[k] for k in kinds), len(self.rows)]
            self.tried = {k: moved[bisect_left(starts, at)] for k, at in before.items()}

    def exchange(self, kind: Kind) -> Kind | None:
        """Make the exchange with a bin of this kind that raises the sum of squares most; what the bin is then, if one does."""
        since, end, own = self.tried.get(kind, 0), len(self.rows), fill_of(kind)
        self.tried[kind] = end
        if since == end:
            return None
        back, pieces, fills = (x[since:end] for x in (self.tokens, self.pieces, self.fills))
        itself = slice(max(0, self.first[kind] - since), max(0, self.first[kind] - since + len(self.gifts(kind)))) if self.open[kind] == 1 and self.first[kind] >= since else slice(0, 0)
        best, chosen = 0, None
        for give in self.gifts(kind)[1:]:
            # Tokens that the other bin gains: a move, one for one, two for one, one for two.
            d = sum(give) - back
            ok = (d > 0) & (d <= self.window - fills) & (len(give) + pieces <= 3)
            if len(give) > 1:
                ok &= pieces > 0
            ok[itself] = False
            gain = ok * d * (fills - own + d)
            j = int(gain.argmax())
            if gain[j] > best:
                best, chosen = int(gain[j]), (give, since + j)
        if chosen is None:
            return None
        give, (other, back) = chosen[0], self.rows[chosen[1]]
        times = min(self.open[kind], self.open[other]) if kind != other else self.open[kind] // 2
        self.take(kind, times)
        self.take(other, times)
        left = changed(kind, give, back)
        self.add(left, times)
        self.add(changed(other, back, give), times)
        return left

    def run(self) -> dict[Kind, int]:
        """The bins when no exchange is left, from the emptiest on, or when they are as few as can be."""
        fewest, going = -(-self.total // self.window), True
        while going:
            going = False
            for kind in sorted(self.open, key=lambda k: (fill_of(k), k)):
                while kind in self.open and (left := self.exchange(kind)) is not None:
                    going = True
                    if sum(self.full.values()) + sum(self.open.values()) <= fewest:
                        return self.full | self.open
                    kind = left if left in self.open else kind
            self.compact()
        return self.full | self.open


def packed(counts: dict[int, int], window: int = WINDOW) -> dict[Kind, int]:
    """How many bins of each kind hold so many pieces of each length."""
    return Search(best_fit(counts, window), window).run()


def plan_of(bins: dict[Kind, int]) -> np.ndarray:
    """Rows (length, first number, how many in a bin, first sequence, place of the first), in order of length and number."""
    rows, met, sequence = [], Counter(), 0
    for kind, n in sorted(bins.items(), reverse=True):
        at = 0
        for length, each in kind:
            rows.append((length, met[length], each, sequence, at))
            met[length] += each * n
            at += each * length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def placed(plan: np.ndarray):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One search finds both: lengths are far below 2 ** 16, numbers below 2 ** 47.
        keys = plan[:, 0] << 47 | plan[:, 1]
        for batch in batches:
            length, number = (batch.column(i).to_numpy() for i in (3, 5))
            _, first, each, sequence, at = plan[np.searchsorted(keys, length << 47 | number, "right") - 1].T
            bin_, slot = np.divmod(number - first, each)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence + bin_), pa.array(at + slot * length)], [x.split()[0] for x in PIECES.split(", ")])

    return kernel


def pack_by_swaps(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; sequences of at most window tokens."""
    if not 1 <= window < 1 << 16:
        raise ValueError("window is from 1 to 65,535")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stored = materialize(rows.mapInArrow(pieces_of(vocabulary, end_id, window), STORED), "pieces")
    sizes = stored.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    numbered = stored.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("number"))
    return numbered.mapInArrow(placed(plan_of(packed(counts, window))), PIECES)
