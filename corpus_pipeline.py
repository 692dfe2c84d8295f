"""A corpus pipeline of five stages over ``documents``.

Each stage reads all that the one before it kept, as Parquet in the shared
folder, and its decisions take effect. The columns stay those of ``documents``
until the last stage, which deals the rows into shards; others that the table
may have are left out. Nulls: a document without text has no language and goes
at the first stage; without doc_id it is never a near-duplicate; without source
it is of a source of its own. Repeated rows are one row after ``near_dedup``
(those without doc_id stay). Very long texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import Scratch, bit_filter, table, with_mark
from gridlark.llm.decontaminate import find_leaks
from gridlark.llm.language_id import UNKNOWN, held_out, predict, train
from gridlark.llm.mixing import mix_sources
from gridlark.llm.near_dup import near_duplicates
from gridlark.llm.sharding import shard_groups, text_group, text_size

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: A document is rejected if its language is less probable than this.
MIN_SCORE = 0.5
WEIGHTS, SHARE, MAX_EPOCHS = [5.0, 2.0, 1.0], 1.5, 2.0
SHARDS = 40


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language the model knows; ``und`` and doubtful ones go."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    out = predict(docs, model, carry=COLUMNS)
    return out.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near-duplicates (80 % of five-word shingles), in one row."""
    found = near_duplicates(docs, percent=80)
    again = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1 or not kept")
    with Scratch(spark) as scratch:
        again = scratch.table(again, "again")
        # rows that a filter tells apart stay as they are; only the others, whole texts that they are, are exchanged
        marked = with_mark(docs.select(*COLUMNS), "doc_id", bit_filter(again, "doc_id", scratch))
        some = marked.where("_mark").drop("_mark").join(again, "doc_id", "left")
        # of rows with one doc_id the least stays, by its columns in order
        row = F.struct(*[c for c in COLUMNS if c != "doc_id"])
        least = some.where("kept and n > 1").groupBy("doc_id").agg(F.min(row).alias("row")).select("doc_id", "row.*")
        out = marked.where("not _mark").drop("_mark").unionByName(some.where("kept is null").select(*COLUMNS)).unionByName(least)
        return table(out, "unlike")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which no item of ``benchmark`` is found."""
    out = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=COLUMNS)
    return out.where(F.size("hits") == 0).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that sources near their target weights; a document left out of the mix goes."""
    out = mix_sources(docs.select(*COLUMNS), WEIGHTS, SHARE, MAX_EPOCHS)
    out = out.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the mix into shards of near equal bytes; copies of a text stay together."""
    return shard_groups(docs, SHARDS, text_size(F.col("text")), text_group(F.col("text")), ["doc_id"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: Fitted models and hashes of sets are not for SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
