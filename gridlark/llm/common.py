"""What the operators of this folder share: words, shared tables, global prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a longest run of characters that are neither space nor TAB..CR.
WORD = r"[^\x20\x09-\x0D]+"

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master may go without that setting; it gets a temporary
    folder of its own. A cluster without it is an error.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="gridlark-")
        context.setCheckpointDir(_own_folders[app])
    return _own_folders[app]


def table(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a read of it, with its lineage cut."""
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(nullable(df.schema)).parquet(path)


class Scratch:
    """Tables that one run needs only until its result is written.

    They lie in a folder of their own below the shared one, which is deleted at
    the end of the ``with`` block; what is returned from it must be a ``table``.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame, name: str) -> DataFrame:
        return table(df, name, self.folder)

    def __exit__(self, *_: object) -> None:
        delete_folder(self.spark, self.folder)


#: Bits of a filter that tells which rows a join can concern: 32 MB, in rows of 1,024 words of 64.
FILTER_BITS, FILTER_WORDS = 1 << 28, 1 << 10


def bit_filter(wanted: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(_filter_at, _filter_words): the bits that the keys of a table set; FILTER_BITS in at most 4,096 rows, whatever the table.

    Words are put together before the shuffle; a task that packs them holds no more than the filter.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    words = wanted.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).cast("int").alias("word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
    at = F.floor(F.col("word") / FILTER_WORDS).cast("int")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, np.ndarray] = {}
        for batch in batches:
            place, word, mask = (c.to_numpy() for c in batch.columns)
            for k in np.unique(place):
                own = place == k
                rows.setdefault(int(k), np.zeros(FILTER_WORDS, np.int64))[word[own] % FILTER_WORDS] = mask[own]
        for k, row in rows.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([row], pa.list_(pa.int64()))], names=["_filter_at", "_filter_words"])

    # sorted, so that a batch has few places
    packed = words.select(at.alias("at"), "word", "mask").repartition("at").sortWithinPartitions("at")
    return scratch.table(packed.mapInArrow(pack, "_filter_at int, _filter_words array<long>"), "filter")


def with_mark(df: DataFrame, key: str, words: DataFrame, made: str = "_mark") -> DataFrame:
    """``df`` and whether a row's key may be in the table that a filter was made of; false is certain.

    Where the table is so large that most bits are set (some 10^8 keys), most rows are marked, and no harm is done.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    tested = df.withColumn("_bit", bit).join(F.broadcast(words), F.shiftright("_bit", 16).cast("int") == F.col("_filter_at"), "left")  # of bounded size
    hit = F.expr(f"coalesce(_filter_words[cast(shiftright(_bit, 6) % {FILTER_WORDS} as int)] & shiftleft(1L, cast(_bit & 63 as int)), 0L) <> 0")
    return tested.select(*df.columns, hit.alias(made))


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it lies; no error if it is not there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of texts that go to Python at a time, where the session has Spark's default of 10,000.
BATCH = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def texts(df: DataFrame) -> DataFrame:
    """``df``, whose rows are texts that go to Python: batches of Arrow are made smaller for the session.

    A batch is held by the JVM and by Python at once, so that its size times
    the tasks of an executor counts. A session's own setting is left alone.
    """
    conf = df.sparkSession.conf
    if conf.get(_ROWS) == "10000":
        conf.set(_ROWS, str(BATCH))
    return df


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null. Counts the places where a word ends."""
    ends = F.length(F.regexp_replace(text, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "w"))
    begins_blank = text.rlike(r"\A[\x20\x09-\x0D]")
    blanks = F.length(F.regexp_extract(text, r"\A[\x20\x09-\x0D]*", 0))
    return F.coalesce(ends - F.when(begins_blank, blanks).otherwise(0), F.lit(0)).cast("long")


def carried(df: DataFrame, carry: list[str], made: list[str]) -> list[str]:
    """Columns of ``df`` to pass through; they may not clash with columns made."""
    clash = sorted({c.lower() for c in carry} & {c.lower() for c in made})
    if clash:
        raise ValueError(f"carried columns clash with results: {clash}")
    missing = [c for c in carry if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return carry


def running_totals(df: DataFrame, order: list[str], sums: dict[str, str], name: str = "ranked", folder: str | None = None) -> DataFrame:
    """Global running totals without one task that sees all rows.

    Range-partition by ``order``, sum within each partition, then add what the
    partitions before it hold (one row per partition). ``sums`` maps a new
    column to the non-null numeric column it totals, own row included; ``rank`` (from 0)
    is added. Rows equal in all of ``order`` are in any order among themselves.
    The window within partitions is a second exchange, so this is for tables of
    groups, not of documents. The partitioned rows are written once, so partition ids cannot change
    between the two passes. An empty input gives an empty result.
    """
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    inner = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = parts.withColumns({f"_l_{k}": F.sum(v).over(inner) for k, v in sums.items()} | {"_l_rank": F.row_number().over(inner).cast("long")})
    local = table(local, name, folder)
    each = local.groupBy("_part").agg(*[F.sum(v).alias(f"_t_{k}") for k, v in sums.items()], F.count(F.lit(1)).alias("_t_rank"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition, not per input row
    offsets = each.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in [*sums, "rank"]])
    out = local.join(offsets, "_part")
    return out.select(*df.columns, *[(F.col(f"_l_{k}") + F.col(f"_o_{k}")).alias(k) for k in sums], (F.col("_l_rank") + F.col("_o_rank") - 1).alias("rank"))


def positions(df: DataFrame, key: str, order: list[str], made: str, name: str = "placed", folder: str | None = None) -> DataFrame:
    """``df`` and ``made``, the place (gapless from 0) of each row within its ``key``, by ``order``.

    Rows are range-partitioned by key and order and sorted, so that a hot key
    goes over many tasks; a row's number within its partition, less where its
    key begins there, plus what the partitions before hold of the key, is its
    place. Documents are exchanged once. The last criterion, beyond ``order``,
    is the row's place in the input: many equal rows do not fall into one
    partition. Null keys are one key.
    """
    tie = df.withColumn("_tie", F.monotonically_increasing_id())
    parts = tie.repartitionByRange(key, *order, "_tie").sortWithinPartitions(key, *order, "_tie").drop("_tie")
    parts = table(parts.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), name, folder)
    runs = parts.groupBy(F.col("_part").alias("_at"), F.col(key).alias("_key")).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition a key is in
    runs = runs.select("_at", "_key", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    out = parts.join(runs, (F.col("_part") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_key")))
    return out.select(*df.columns, (F.col("_row") + F.col("_shift")).alias(made))
