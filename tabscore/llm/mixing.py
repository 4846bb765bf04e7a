"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the copies that each of its documents gets; the whole part is sure, the rest is a
fractional copy, whose words are a mass between 0 and the document's size. Two documents with fractional mass are
paired: words move from one to the other, by chance which way (with the odds that keep each one's expectation), until
one of them is at 0 or at its size. So a source's mass stays as it is, and of two documents one is settled.

The pairing is a reduction tree. Documents are dealt to leaves of about LEAF by a hash of doc_id, each leaf is folded
in one expression and hands on its one unsettled document, and those are dealt to the leaves of the next level, until
a source has one left: log(n) / log(LEAF) levels, each of them shorter by LEAF. Only the last document of a source may
remain fractional; of its last copy the first words that the source still needs are taken.

Chance comes from hashes of the paired documents' ids, and the order in a leaf from hashes of ids: the result depends
on the rows alone, not on how they are partitioned. Rows that are alike in source, id and size are counted and then
numbered, so that they are dealt like any others, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscore.llm.common import WS, let, materialize

LEAF, SHARE, CAP, SEED = 128, 1.5, 2.0, 20
#: Rows alike that one task numbers at once.
COPIES = 10_000
#: Weights of the sources in their order, repeated. Fixed values.
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    trimmed = F.regexp_replace(text, f"^{WS}+|{WS}+$", "")
    return F.when(trimmed.isNull() | (trimmed == ""), F.lit(0)).otherwise(F.size(F.split(trimmed, WS + "+"))).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, place, source_size, n_docs, target) from (source, size); one row a source, nulls a source of their own.

    Filling by weight up to the caps: sources in the order of cap / weight are full as long as the level that the rest
    would get stands above their own; the windows below run over sources, not documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_place = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("place", F.row_number().over(by_place) - 1)
    per = per.withColumn("w", F.get(F.array(*[F.lit(w) for w in weights]), F.pmod("place", F.lit(len(weights))))).withColumn("full", cap * F.col("source_size"))
    order = Window.orderBy(F.col("full") / F.col("w"), "place")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("level", (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("w").over(after))
    per = per.withColumn("open", F.col("level") * F.col("w") < F.col("full"))
    level = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return per.withColumn("target", F.when(level.isNull(), F.col("full")).otherwise(F.least("full", level * F.col("w")))).select("source", "place", "source_size", "n_docs", "target")


def _uniform(*columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *columns), 11) / float(1 << 53)


def item_type(id_type: str) -> str:
    return f"struct<k:bigint,id:{id_type},size:bigint,mass:double>"


def fold_leaf(items: Column, item: str) -> Column:
    """struct<left, done> of a leaf's items (k, id, size, mass) in the order of k: settles all but one of them."""
    none = F.lit(None).cast(item)
    start = F.struct(none.alias("left"), F.array().cast(f"array<{item}>").alias("done"))

    def with_mass(x: Column, mass: Column) -> Column:
        return F.struct(x["k"].alias("k"), x["id"].alias("id"), x["size"].alias("size"), mass.alias("mass")).cast(item)

    def pair(acc: Column, b: Column) -> Column:
        a = acc["left"]
        room_a, room_b = a["size"] - a["mass"], b["size"] - b["mass"]
        up, down = F.least(room_a, b["mass"]), F.least(a["mass"], room_b)
        a_gains = _uniform(a["id"], b["id"], a["k"], b["k"]) * (up + down) < down
        # Of the four ends of the two moves, the one that is reached settles its document exactly.
        a_full, b_out = a_gains & (room_a <= b["mass"]), a_gains & (room_a > b["mass"])
        b_full = ~a_gains & (room_b <= a["mass"])
        size = lambda x: x["size"].cast("double")
        done = F.when(a_full, with_mass(a, size(a))).when(b_out, with_mass(b, F.lit(0.0))).when(b_full, with_mass(b, size(b))).otherwise(with_mass(a, F.lit(0.0)))
        left = F.when(a_full, with_mass(b, b["mass"] - up)).when(b_out, with_mass(a, a["mass"] + up)).when(b_full, with_mass(a, a["mass"] - down)).otherwise(with_mass(b, b["mass"] + down))
        return F.struct(left.alias("left"), F.concat(acc["done"], F.array(done)).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        settled = lambda y: (y["mass"] <= 0) | (y["mass"] >= y["size"])
        moved = F.when(settled(x), F.struct(acc["left"].alias("left"), F.concat(acc["done"], F.array(x)).alias("done")))
        moved = moved.when(acc["left"].isNull(), F.struct(x.alias("left"), acc["done"].alias("done")))
        moved = moved.when(settled(acc["left"]), F.struct(x.alias("left"), F.concat(acc["done"], F.array(acc["left"])).alias("done")))
        return moved.otherwise(pair(acc, x))

    return F.aggregate(items, start, step)


def numbered(frame: DataFrame) -> DataFrame:
    """frame (place, n, id, size, mass, copies) with a row for each copy and its hash k; many copies are numbered in several tasks."""

    def copies(rows: DataFrame, first: Column, last: Column) -> DataFrame:
        each = rows.withColumn("nth", F.explode(F.sequence(first, last)))
        return each.select("place", "n", "id", "size", "mass", F.xxhash64(F.lit(SEED + 1), "id", "size", "nth").alias("k"))

    few = copies(frame.filter(F.col("copies") <= COPIES), F.lit(1).cast("long"), F.col("copies"))
    many = frame.filter(F.col("copies") > COPIES).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    many = copies(many.repartition("place", "id", "size", "part"), F.col("part") * COPIES + 1, F.least(F.col("copies"), (F.col("part") + 1) * COPIES))
    return few.unionByName(many)


def settle(frame: DataFrame, leaves: int) -> DataFrame:
    """Rounds the fractional masses of frame (place, n, id, size, mass, k): the rows with mass 0, size, or, once a place, what is left over."""
    done, kind = None, item_type(frame.schema["id"].dataType.simpleString())
    rest, level = frame, 0
    while True:
        level += 1
        n_leaves = F.greatest(F.lit(1), F.ceil(F.col("n") / float(leaves))).cast("long")
        dealt = rest.withColumn("leaf", F.pmod(F.xxhash64(F.lit(level), "k"), n_leaves))
        item = F.struct(F.col("k"), F.col("id"), F.col("size"), F.col("mass")).cast(kind)
        folded = dealt.groupBy("place", "leaf").agg(F.first(n_leaves).alias("leaves"), F.array_sort(F.collect_list(item)).alias("items"))
        folded = folded.withColumn("fold", let(F.col("items"), lambda items: fold_leaf(items, kind)))
        folded = materialize(folded.select("place", "leaves", "fold"), f"mixing-level{level}")
        settled = folded.select("place", F.explode("fold.done").alias("x")).select("place", "x.*")
        done = settled if done is None else done.unionByName(settled)
        rest = folded.filter("fold.left is not null").select("place", F.col("leaves").alias("n"), "fold.left.*")
        if folded.agg(F.max("leaves")).first()[0] in (None, 1):
            return done.unionByName(rest.select(*done.columns))


def mix(docs: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS, leaves: int = LEAF) -> DataFrame:
    """doc_id, size, source_size, target (of its source), taken (words), for every row of docs; doc_id has any type.

    Null and blank texts have size 0 and are taken 0 times; null sources are one source, the last; rows of one doc_id
    and size are alike, and each is rounded for itself. Other columns of docs are not used.
    """
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mixing-sizes")
    per = targets(sized, share, cap, weights)
    # Rows alike are counted before they meet a source's totals: partial counts leave few of them to shuffle.
    alike = sized.groupBy("source", F.col("doc_id").alias("id"), "size").agg(F.count("*").alias("copies"))
    joined = alike.alias("a").join(per.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.id", "a.size", "a.copies", "b.source_size", "b.target", "b.place", "b.n_docs")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = joined.withColumn("sure", F.floor(rate)).withColumn("mass", (rate - F.col("sure")) * F.col("size"))
    # A struct of all that a row has to carry through the tree would be longer than the join back by place.
    frame = joined.select("place", F.col("n_docs").alias("n"), "id", "size", "mass", "copies")
    rounded = settle(numbered(frame), leaves)
    per = per.withColumn("rate", rate).select("place", "source_size", "target", F.floor("rate").alias("sure"))
    out = rounded.join(per, "place")
    taken = F.col("sure") * F.col("size") + F.round("mass").cast("long")
    return out.select(F.col("id").alias("doc_id"), F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", taken.cast("long").alias("taken"))
