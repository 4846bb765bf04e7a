"""From raw documents to packed sequences, in five stages. Each is written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscore.llm import line_dedup, mixing, ngram_join, packing, toxicity
from tabscore.llm.common import WS, delete, documents, work_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL can't train a classifier, draw the mix or tokenise; tests hold the stages against brute force.
ORACLE_SQL = None


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on what docs has of the labelled rows; the documents that the model rejects go, all others stay as they are.

    Null and empty texts have the score of no words; repeated rows share their score. No rows give no rows, and only
    the columns of documents leave, whatever else docs has.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model).filter("score < 0.5").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines of many documents stay in one of them; every document stays, if only with an empty text.

    Null texts stay null; rows that share a doc_id (or have none) count as one document and keep or lose a line
    together. No rows give no rows; other columns are not used.
    """
    return _measured(line_dedup.apply_bitmaps(docs.select(*COLUMNS), line_dedup.keep_bitmaps(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked rows stays, that with the smallest doc_id, then text hash; null doc_ids come last.

    A row is told by its doc_id and its text: different texts stay apart even where they share a doc_id or have none.
    Equal texts of one doc_id are copies, of which one stays (that with the smallest source, lang and n_chars). Rows
    without a word are linked with nothing and all stay. No rows give no rows; other columns are not used.
    """
    text = F.coalesce("text", F.lit(""))
    keys = {"_missing": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0)), "_h": F.xxhash64(text), "_g": F.xxhash64(F.lit(1), text)}
    own = docs.select(*COLUMNS).withColumns(keys)
    words = F.coalesce(F.col("text").rlike(WS.replace("[", "[^")), F.lit(False))
    # Copies go first, by a group limit in each task before the shuffle: what is joined then has a key of its own each.
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("source", "lang", "n_chars"))
    single = own.filter(words).withColumn("_rank", first).filter("_rank = 1").drop("_rank")
    row = F.struct(*keys)
    classes = ngram_join.near_duplicates(own.filter(words).select(row.alias("doc_id"), "text"))
    stays = classes.filter(F.col("doc_id") == F.col("component_id")).select("doc_id.*").distinct()
    return single.join(stays, list(keys), "left_semi").select(*COLUMNS).unionByName(own.filter(~words).select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a source's last copy may be the first words of a document.

    Texts without words have no share and go; a null source is a source of its own; repeated rows are
    rounded each for itself. No rows give no rows; other columns are not used.
    """
    # Rows alike in every column are one row with the words of all of them; others never share a key.
    own = docs.select(*COLUMNS).withColumn("_key", F.struct(F.xxhash64(*COLUMNS).alias("h"), F.xxhash64(F.lit(1), *COLUMNS).alias("g")))
    taken = mixing.mix(own.select(F.col("_key").alias("doc_id"), "source", "text")).groupBy(F.col("doc_id").alias("_key")).agg(F.max("size").alias("size"), F.sum("taken").alias("taken"))
    first = F.row_number().over(Window.partitionBy("_key").orderBy("doc_id"))
    both = own.withColumn("_rank", first).filter("_rank = 1").join(taken.filter("taken > 0"), "_key")
    copies = both.withColumn("_words", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size"))), lambda i: F.least(F.col("size"), F.col("taken") - i * F.col("size")))))
    pieces = F.split(F.regexp_replace("text", f"^{WS}+", ""), rf"(?<={WS})(?={WS.replace('[', '[^')})")
    cut = F.when(F.col("_words") < F.col("size"), F.array_join(F.slice(pieces, F.lit(1), F.col("_words").cast("int")), "")).otherwise(F.col("text"))
    return _measured(copies.withColumn("text", cut))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens; a null or empty text is one end token."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("packing", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents of sf_dir; returns the rows of the last one."""
    at, before = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            delete(spark, f"{at}/{before}")
        before = name
    return docs
