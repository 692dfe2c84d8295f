"""Token counts kept as rollups by signed deltas, with idempotent batch commits."""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import carried, shared_folder, slices, table, texts, word_count

#: Where the public vocabularies lie unless a caller says otherwise.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The versions that the registered query counts by, and their vocabularies.
VERSIONS = {"byte_bpe_50k": VOCABULARY, "byte_bpe_multi_50k": "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"}
#: Fixed value: the pattern that cuts a text into pieces for these vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

KEYS = ["source", "lang", "version"]


def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, text: str = "text", carry: list[str] | None = None, vocabularies: dict[str, str] | None = None) -> DataFrame:
    """The carried columns (default doc_id), version and n_tokens: a row per whole text and version.

    ``vocabularies`` maps versions to files of ranks that every executor finds
    at that path (default: the first of ``VERSIONS``). Each task loads them once and reads each text
    once. Null and empty texts have 0 tokens; very long ones are counted whole; repeated rows give repeated results.
    """
    carry = carried(docs, ["doc_id"] if carry is None else carry, ["version", "n_tokens"])
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry] + ["version string, n_tokens long"])
    at = len(carry)
    vocabularies = dict([next(iter(VERSIONS.items()))]) if vocabularies is None else vocabularies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = None
        for batch in slices(batches):
            encoders = encoders or {v: _encoder(path).encode_ordinary for v, path in vocabularies.items()}
            own = batch.column(at).to_pylist()
            for version, encode in encoders.items():
                counts = [len(encode(t)) if t else 0 for t in own]
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], names=[*carry, "version", "n_tokens"])

    return texts(docs.select(*carry, docs[text].alias("_text"))).mapInArrow(run, schema)


#: What a log holds: the value of a document and version after a batch.
LOG = "doc_id long, version string, gone boolean, n_tokens long, source string, lang string, number long"
DELTAS = "source string, lang string, version string, n_docs long, n_tokens long"


class TokenRollup:
    """Additive totals of documents and tokens by source, language and tokenizer version.

    A batch of events looks up the current values of its own documents in the
    logs of earlier batches, and writes a log of the values it changes and
    their signed deltas, summed by key: what is written grows with the batch,
    not with the corpus. Totals are the sum of the deltas of committed
    batches. All files lie under ``path`` in a shared folder; one row in
    ``commits`` makes a batch visible. What a lost job has written without a
    commit is never read, and the batch is simply applied again; a batch whose
    id is committed already changes nothing. There is one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = path or f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}"
        self.schema = "batch string, number long, base boolean, log string, deltas string"
        if path is None or not self._exists():
            spark.createDataFrame([], self.schema).write.mode("ignore").parquet(f"{self.path}/commits")

    def _exists(self) -> bool:
        try:
            self.spark.read.schema(self.schema).parquet(f"{self.path}/commits").limit(1).count()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return False
        return True

    def _commits(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/commits")

    def commits(self) -> list:
        """Commits in order, from the last compaction on: a row per batch, not per document."""
        base = self._commits().where("base").agg(F.max("number")).first()[0] or 0
        return sorted(self._commits().where(F.col("number") >= base).collect(), key=lambda r: r["number"])

    def committed(self, batch: str) -> bool:
        return bool(self._commits().where(F.col("batch") == batch).limit(1).count())

    def _commit(self, batch: str, number: int, base: bool, log: str, deltas: str | None) -> None:
        self.spark.createDataFrame([(batch, number, base, log, deltas)], self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def _logs(self, done: list) -> DataFrame:
        """The logs from the last compaction on."""
        paths = [r["log"] for r in done]
        return self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)

    def _deltas(self, done: list) -> DataFrame:
        """Signed sums by key, from the last compaction on."""
        paths = [r["deltas"] for r in done]
        deltas = self.spark.read.schema(DELTAS).parquet(*paths) if paths else self.spark.createDataFrame([], DELTAS)
        return deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    @staticmethod
    def _latest(logs: DataFrame) -> DataFrame:
        value = F.struct("gone", "n_tokens", "source", "lang")
        return logs.groupBy("doc_id", "version").agg(F.max_by(value, "number").alias("old"))

    def ledger(self) -> DataFrame:
        """The current value of each document and version."""
        now = self._latest(self._logs(self.commits())).where("not old.gone")
        return now.select("doc_id", "old.source", "old.lang", "version", "old.n_tokens")

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens of what the ledger holds now; keys that are back at no documents are left out."""
        return self._deltas(self.commits())

    def apply(self, events: DataFrame, batch: str) -> bool:
        """Apply a batch of events; False if it was committed before.

        ``events`` has doc_id, source, lang, version, op and n_tokens. op is
        ``upsert`` (an insert, or a revised count, source or language) or
        ``delete``. Of several events for one document and version in a batch
        a delete wins, then the largest (n_tokens, source, lang): the result
        does not depend on their order, and repeated events count once. A null
        count is 0; an event without doc_id, version or a known op is ignored;
        deleting what is not there does nothing. Null source and lang are keys
        of their own.
        """
        if self.committed(batch):
            return False
        done = self.commits()
        number = done[-1]["number"] + 1 if done else 0
        ranked = F.struct((F.col("op") == "delete").alias("gone"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), "source", "lang")
        wanted = events.where("doc_id is not null and version is not null and op in ('upsert', 'delete')")
        new = table(wanted.groupBy("doc_id", "version").agg(F.max(ranked).alias("new")), "rollup-events")
        old = self._latest(self._logs(done).join(new.select("doc_id", "version"), ["doc_id", "version"], "left_semi"))
        both = new.join(old, ["doc_id", "version"], "left")
        was = F.col("old").isNotNull() & ~F.col("old.gone")
        changed = both.where((~F.col("new.gone") & ~(was & F.col("old").eqNullSafe(F.col("new")))) | (F.col("new.gone") & F.coalesce(was, F.lit(False))))
        unit = uuid.uuid4().hex
        log, deltas = f"{self.path}/log/{unit}", f"{self.path}/deltas/{unit}"
        changed = changed.select("doc_id", "version", "new", F.when(was, F.col("old")).alias("old"))
        changed = table(changed, "rollup-changes")  # one join serves both writes
        changed.select("doc_id", "version", "new.*", F.lit(number).cast("long").alias("number")).write.parquet(log)
        minus = changed.where("old is not null").select("old.source", "old.lang", "version", F.lit(-1).alias("n_docs"), (-F.col("old.n_tokens")).alias("n_tokens"))
        plus = changed.where("not new.gone").select("new.source", "new.lang", "version", F.lit(1).alias("n_docs"), F.col("new.n_tokens").alias("n_tokens"))
        # partial sums first: a hot source sends one row per task
        minus.unionByName(plus).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(deltas)
        self._commit(batch, number, False, log, deltas)
        return True

    def compact(self) -> None:
        """Replace the logs so far by one that holds the current values, and the deltas by their sums; totals stay as they are."""
        done = self.commits()
        if done:
            number, unit = done[-1]["number"] + 1, uuid.uuid4().hex
            log, deltas = f"{self.path}/log/{unit}", f"{self.path}/deltas/{unit}"
            now = self._latest(self._logs(done)).where("not old.gone")
            now.select("doc_id", "version", "old.*", F.lit(number).cast("long").alias("number")).write.parquet(log)
            self._deltas(done).write.parquet(deltas)
            self._commit(f"compact-{unit}", number, True, log, deltas)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals by two tokenizer versions, reached by inserts, revised counts and deletes.

    Batch 1 inserts every document under both versions with provisional counts
    (its words), batch 2 revises them by the tokenizers' counts of every whole
    text, batch 3 deletes, from the second version alone, the documents whose
    text an earlier one has, and batch 2 comes once more. So the first version
    has the totals of the whole table, the second those of its distinct texts.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    columns = ["doc_id", "source", "lang", "version", F.lit("upsert").alias("op"), "n_tokens"]
    rollup = TokenRollup(spark)
    words = docs.select("doc_id", "source", "lang", word_count(F.col("text")).alias("n_tokens"))
    rollup.apply(words.withColumn("version", F.explode(F.lit(list(VERSIONS)))).select(*columns), "1-insert")
    revised = count_tokens(docs, carry=["doc_id", "source", "lang"], vocabularies=VERSIONS).select(*columns)
    rollup.apply(revised, "2-revise")
    digest = docs.where("text is not null").select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    digest = table(digest, "text-digests")
    first = digest.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = table(first, "text-first")  # a join of plain reads, which adaptive execution splits at a hot text
    repeats = digest.join(first, "digest").where("doc_id <> first").select("doc_id")
    nothing = F.lit(None).cast("string")
    gone = repeats.select("doc_id", nothing.alias("source"), nothing.alias("lang"), F.lit(list(VERSIONS)[1]).alias("version"), F.lit("delete").alias("op"), F.lit(0).alias("n_tokens"))
    rollup.apply(gone, "3-delete")
    rollup.apply(revised, "2-revise")
    return rollup.totals()
